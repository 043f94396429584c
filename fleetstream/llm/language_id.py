"""Language identification in two steps: the family, then the language in it.

Features are the relative frequencies of hashed byte 4-grams of the whole
text (letters lower-cased, everything else a blank).  One linear support
vector machine for each family against the rest picks the family; within it
one machine for each pair of its languages votes.  All are linear, so a
document's margin is the mean weight of its 4-grams: no feature vector is
built when predicting.

Training learns from a bounded sample: for each language value at most
``sample`` // languages rows, those with the smallest hash of id and text, equal
rows once, all counted over the whole table.  Held-out rows (``crc32(id) mod 5 = 0``), rows
with a null id, language or text, and texts without a letter are never learned
from.  Language, source and id are no inputs of a prediction.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
so is every row when nothing can be learned; with one learned language every
text with a letter gets it, with score 1; a null id counts as held out;
repeated rows each get the same answer; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ddl, lean, ship, text_steps
from .steps import bundle, squeezed, unbundle, unsqueezed

#: Families of languages by ISO 639-1 code; a language not named here is a family of its own.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv", "yi"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "turkic": ["az", "kk", "tr", "uz"],
}

DIM_BITS = 12
#: Text bytes at a time: a dozen arrays of four or eight bytes for each.
STEP = 1 << 20
#: Weights are summed as integers in units of 2^-UNIT_BITS: a sum has the same value wherever its text stands.
UNIT_BITS = 26

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def gram_codes(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Feature number of the 4-gram that starts at each byte; behind the end of
    its row (offsets ``off``) there are blanks."""
    b = _FOLD[buf]
    upper = np.zeros(len(buf), bool)  # capital Latin-1 letters are C3 80..9E
    upper[1:] = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)
    b[upper] += 0x20
    n = len(b)
    code = b.astype(np.uint32)
    for j in range(1, 4):
        x = np.full(n, 0x20, np.uint32)
        x[:max(0, n - j)] = b[j:]
        for k in range(1, j + 1):
            beyond = off[1:] - k
            x[beyond[beyond >= 0]] = 0x20
        code |= x << np.uint32(8 * j)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    code = (code ^ (code >> np.uint32(12))) * np.uint32(0x297A2D39)
    return code >> np.uint32(32 - DIM_BITS)


def train_svm(x: np.ndarray, y: np.ndarray, *, cost: float = 10.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by accelerated gradient descent;
    classes weigh the same, and rows whose y is 0 not at all.  Returns
    (weights, bias)."""
    d = x.shape[1]
    weight = np.select([y > 0, y < 0], [0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())]).astype(np.float32)
    w = np.zeros(d + 1, np.float32)
    v = w.copy()
    lip = 1.0 + 2 * cost * float((weight * (np.einsum("ij,ij->i", x, x) + 1)).sum())
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v[:d] + v[d]))
        g = -2 * cost * weight * y * slack
        grad = v + np.r_[x.T @ g, g.sum()].astype(np.float32)
        grad[d] -= v[d]
        new = v - grad / lip
        v = new + t / (t + 3) * (new - w)
        w = new
    return w[:d], float(w[d])


@dataclass
class Model:
    """families: names with their languages; weights: one column for each
    machine (families against the rest, then pairs), on mean 4-gram codes."""

    families: list[tuple[str, list[str]]]
    pairs: list[tuple[int, int, int]]  # (family, language a, language b)
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margins (rows x machines) -> (language, score in 0..1)."""
        n, k = len(margins), len(self.families)
        names = np.array([lang for _, langs in self.families for lang in langs], object)
        if k == 0:
            return np.full(n, "und", object), np.zeros(n)
        if k > 1:
            e = np.exp(2 * (margins[:, :k] - margins[:, :k].max(1, keepdims=True)))
            family, sure = margins[:, :k].argmax(1), e.max(1) / e.sum(1)
        else:
            family, sure = np.zeros(n, np.int64), np.ones(n)
        first = np.cumsum([0, *(len(langs) for _, langs in self.families)])
        out, score = np.empty(n, object), sure.copy()
        for f, (_, langs) in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            votes, belief = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
            for c, (pf, a, b) in enumerate(self.pairs, k if k > 1 else 0):
                if pf == f:
                    p = 1 / (1 + np.exp(-2 * margins[rows, c]))
                    votes[:, a] += p >= 0.5
                    votes[:, b] += p < 0.5
                    belief[:, a] += p / (len(langs) - 1)
                    belief[:, b] += (1 - p) / (len(langs) - 1)
            best = (votes + belief / 2).argmax(1)
            out[rows] = names[first[f] + best]
            if len(langs) > 1:
                score[rows] *= belief[np.arange(len(rows)), best]
        return out, np.clip(score, 0, 1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, h, text) -> (lang, h, counts of the features that occur, compressed)."""
    for b in batches:
        for i, j, buf, off in text_steps(b.column(2), STEP):
            code = gram_codes(buf, off)
            vec = []
            for a, z in zip(off[:-1], off[1:], strict=True):
                n = np.bincount(code[a:z], minlength=1 << DIM_BITS).astype(np.int64)
                there = np.flatnonzero(n)
                vec.append(bundle(squeezed(there), squeezed(n[there])))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(vec, pa.binary())],
                                              names=["lang", "h", "vec"])


def _picked(usable: DataFrame, each: int, counts: dict[str, int]) -> DataFrame:
    """(lang, h, text): for each language the ``each`` rows with the smallest
    hash of id and text, equal rows once.

    Hashes are spread evenly, so rows below a bound that twice ``each`` rows
    should meet are candidates, and only their hashes are ranked; a language that
    has too few candidates (many equal rows) gets its bound doubled."""
    rows = usable.withColumn("h", F.xxhash64("id", "text"))
    share = {v: min(1.0, (2 * each + 64) / n) for v, n in counts.items()}
    place = F.col("h").cast("double") / 2.0**64 + 0.5
    line = Window.partitionBy("lang").orderBy("h")
    while True:
        bound = F.element_at(F.create_map(*(F.lit(x) for kv in share.items() for x in kv)), F.col("lang"))
        near = (rows.filter(place <= bound).select("lang", "h").distinct()  # combined before the shuffle
                .withColumn("k", F.row_number().over(line)).filter(F.col("k") <= each)
                .groupBy("lang").agg(F.max("h").alias("last"), F.count(F.lit(1)).alias("n")).collect())
        last = {r["lang"]: r["last"] for r in near}
        few = [v for v in share if share[v] < 1 and sum(r["n"] for r in near if r["lang"] == v) < each]
        if not few:
            break
        share |= {v: min(1.0, 4 * share[v]) for v in few}
    cut = F.element_at(F.create_map(*(F.lit(x) for kv in last.items() for x in kv)), F.col("lang"))
    return rows.filter(F.col("h") <= cut).select("lang", "h", "text").dropDuplicates(["lang", "h"])


_LETTER = r"\p{L}"


def held_out(id: str):
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, *, sample: int = 4000, families: dict[str, list[str]] | None = None,
        id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from at most ``sample`` rows."""
    ship(docs.sparkSession)
    family_of = {x: f for f, langs in (families or FAMILIES).items() for x in langs}
    usable = docs.filter(~held_out(id) & F.col(lang).isNotNull() & F.col(text).rlike(_LETTER))
    usable = usable.select(F.col(id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()
    if not counts:
        return Model([], [], np.zeros((1 << DIM_BITS, 0), np.float32), np.zeros(0))
    each = max(1, sample // len(counts))
    rows = (_picked(usable, each, {r["lang"]: r["count"] for r in counts})
            .mapInArrow(_features, "lang string, h long, vec binary").toArrow())  # ``sample`` rows at most, a kilobyte or two each
    # one order, however the rows were partitioned: the machines' last digits depend on it
    label = np.array(rows.column("lang").to_pylist(), object)
    order = np.lexsort((label.astype(str), rows.column("h").to_numpy()))
    label = label[order]
    lean()
    x = np.zeros((len(label), 1 << DIM_BITS), np.float32)  # all else works in place
    vec = rows.column("vec")
    for k, r in enumerate(order.tolist()):
        at, n = (unsqueezed(p) for p in unbundle(vec[r].as_py()))
        x[k, at] = n / max(1, n.sum())
    del rows, vec
    mean = x.mean(0)
    spread = np.sqrt(np.maximum(0, np.einsum("ij,ij->j", x, x) / len(x) - mean * mean))
    scale = (1 / (spread + 1e-4)).astype(np.float32) / np.float32(np.sqrt(x.shape[1]))
    x -= mean
    x *= scale
    known = sorted({*label})
    names = sorted({family_of.get(v, v) for v in known})
    groups = [(f, [v for v in known if family_of.get(v, v) == f]) for f in names]
    machines, pairs = [], []
    if len(groups) > 1:
        for f, _ in groups:
            machines.append(train_svm(x, np.where([family_of.get(v, v) == f for v in label], 1, -1).astype(np.float32)))
    for k, (_, langs) in enumerate(groups):
        for a, b in combinations(range(len(langs)), 2):
            machines.append(train_svm(x, np.select([label == langs[a], label == langs[b]], [1, -1]).astype(np.float32)))
            pairs.append((k, a, b))
    w = np.stack([m[0] * scale for m in machines], 1) if machines else np.zeros((len(scale), 0), np.float32)
    return Model(groups, pairs, np.ascontiguousarray(w, np.float32), np.array([m[1] for m in machines]) - mean @ w)


def identify(docs: DataFrame, model: Model, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, lang_pred, score of each row of ``docs``."""
    return _predicted(docs.select(F.col(id), F.col(text)), model, text).select(
        id, held_out(id).alias("held_out"), F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))


def identified(docs: DataFrame, model: Model, *, min_score: float = 0.0, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of ``docs``, all columns, whose text has a language with a score of
    ``min_score`` or more; a null ``lang`` becomes the predicted language.  When
    the model has learned nothing, every text with a letter stays as it is."""
    if not model.families:
        return docs.filter(F.col(text).rlike(_LETTER))
    out = _predicted(docs, model, text).filter((F.col("__lang") != "und") & (F.col("__score") >= min_score))
    return out.select(*(F.coalesce(F.col(f"`{c}`"), F.col("__lang")).alias(c) if c == lang else F.col(f"`{c}`")
                        for c in docs.columns))


def _predicted(docs: DataFrame, model: Model, text: str) -> DataFrame:
    """``docs`` with __lang and __score."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # 2^DIM_BITS weights for each machine

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        columns = [np.rint(np.ldexp(m.weights[:, c].astype(np.float64), UNIT_BITS)).astype(np.int64) for c in range(m.weights.shape[1])]
        for b in batches:
            letter = b.column(len(names)).to_numpy(zero_copy_only=False).astype(bool)
            for i, j, buf, off in text_steps(b.column(names.index(text)), STEP):
                code = gram_codes(buf, off)
                n = np.maximum(1, np.diff(off))
                margins = np.zeros((j - i, len(columns)))
                for c, w in enumerate(columns):
                    total = np.r_[0, np.cumsum(w[code])]
                    margins[:, c] = np.ldexp((total[off[1:]] - total[off[:-1]]).astype(np.float64), -UNIT_BITS) / n + m.bias[c]
                lang, score = m.predict(margins)
                lang[~letter[i:j]], score[~letter[i:j]] = "und", 0.0
                yield pa.RecordBatch.from_arrays(
                    [*(x.slice(i, j - i) for x in b.columns[:-1]), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    names=[*names, "__lang", "__score"])

    names = docs.columns
    letter = F.coalesce(F.col(text).rlike(_LETTER), F.lit(False))
    return (docs.withColumn("__letter", letter)
            .mapInArrow(run, ddl(docs) + ", __lang string, __score double"))
