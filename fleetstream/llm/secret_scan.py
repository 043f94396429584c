"""Secret scans: broad candidates, then a random forest removes false positives.

Candidates are long runs of key characters that hold a digit, are all
capitals or hold the shape of an issued key, and every value behind an
assignment whose left side names a credential: of any length and characters,
behind blanks too, up to its closing quote on the line, or without one up to a
blank, a quote or the text's end.  A run that is only the front of such a value
is no candidate besides it.  Most are harmless: identifiers, capitalised words, numbers.  The
forest looks at the candidate's length and character classes, how usual its
character transitions are in this corpus, how much of it dictionary words
cover (words frequent in this corpus), the path it comes from (the source
column) and the words before and behind it.

Transitions and the dictionary are counted over all documents: a table of 64
character classes squared, and 2^20 counters of hashed words; both have a
fixed size.  The forest learns from labelled findings: rows (id, start,
is_secret) where the caller has them, otherwise findings that the review rules
below label (issued shapes and named values with a digit are secrets, runs
without a name are none; named values without a digit, or of fewer than
``SHORT`` bytes, stay unlabelled and only the forest decides); of either it takes at most ``sample``, the bound of training.

Defined cases: a null or empty text has no findings; a null source is the
empty path; a null id is kept; rows that repeat an id and text give the same
findings each; extra columns are ignored; without findings of both labels
nothing can be learned, and the review rules decide (an unlabelled finding
gets 0.5 and is returned).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, ship, stored, text_steps, word_hashes

DICTIONARY_BITS = 20
#: A word is in the dictionary from this share of all words on.
FREQUENT = 2e-6

_KEY = np.zeros(256, bool)
_KEY[0x30:0x3A] = _KEY[0x41:0x5B] = _KEY[0x61:0x7B] = True
_KEY[[0x2B, 0x2D, 0x2F, 0x5F]] = True  # + - / _
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_CLASS = np.full(256, 63, np.uint16)  # digits and letters by themselves, the rest together
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B] = np.arange(10), np.arange(10, 36), np.arange(36, 62)

#: Names that stand before an assigned credential.
CREDENTIAL = re.compile(r"(?i)(pass(word|wd|phrase)?|pwd|token|secret|api[_-]?key|access[_-]?key|auth|credential)s?[\"']?\s*(=|:|=>)\s*[\"']?$")
#: The value behind such a name and its first mark of assignment.
VALUE = re.compile(rb"[=:>]*\s*(?:\"([^\"\r\n]+)\"|'([^'\r\n]+)'|[\"']?([^\s\"']+))")
#: Named values of fewer bytes are not labelled.
SHORT = 6
#: Public shapes of issued keys (cloud access key ids, source hosts, chat, payment, maps).
ISSUED = re.compile(r"AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}")
#: Names that stand before identifiers which are no secrets.
HARMLESS = re.compile(r"(?i)(sha\d*|md5|hash|commit|uuid|guid|checksum|digest|isbn|order|invoice|phone|tel|id)[\"']?\s*[=:#]?\s*[\"']?$")

FEATURES = ["length", "digits", "capitals", "lowers", "marks", "distinct", "hex", "switches", "transitions",
            "dictionary", "assigned", "named", "harmless", "quoted", "word_before", "word_behind", "path_example", "path_depth"]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of one partition: transitions (chunk -1), then hashed words."""
    moves = np.zeros(1 << 12, np.int64)
    words = np.zeros(1 << DICTIONARY_BITS, np.int64)
    for b in batches:
        for _, _, buf, off in text_steps(b.column(0)):
            c = _CLASS[buf]
            moves += np.bincount(c[:-1] * np.uint16(64) + c[1:], minlength=1 << 12)
            w = Words(buf, off, _LETTER)
            h = word_hashes(w, lower=True)[w.end - w.start >= 3]
            words += np.bincount((h >> np.uint64(64 - DICTIONARY_BITS)).astype(np.int64), minlength=1 << DICTIONARY_BITS)
    chunks = [(-1, moves), *enumerate(words.reshape(64, -1))]
    yield pa.RecordBatch.from_arrays(
        [pa.array([k for k, _ in chunks], pa.int32()),
         pa.array([pa.compress(x.tobytes(), codec="zstd", asbytes=True) for _, x in chunks], pa.binary()),
         pa.array([x.nbytes for _, x in chunks], pa.int64())], names=["chunk", "body", "size"])


def _add(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(pa.decompress(b.as_py(), s, codec="zstd", asbytes=True), np.int64)
                for b, s in zip(t.column("body"), t.column("size").to_pylist(), strict=True))
    body = pa.compress(total.tobytes(), codec="zstd", asbytes=True)
    return pa.table({"chunk": pa.array([t.column("chunk")[0].as_py()], pa.int32()), "body": pa.array([body], pa.binary()),
                     "size": pa.array([total.nbytes], pa.int64())})


def corpus_statistics(docs: DataFrame, *, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(log chance of each transition, dictionary bits), counted over all texts."""
    schema = "chunk int, body binary, size long"
    # partial sums by partition groups first, so no task gets a table from every partition
    local = docs.select(text).mapInArrow(_statistics, schema).withColumn("salt", F.spark_partition_id() % 64)
    some = local.groupBy("chunk", "salt").applyInArrow(lambda t: _add(t), schema)
    rows = some.groupBy("chunk").applyInArrow(lambda t: _add(t), schema).collect()  # 65 rows of fixed size
    got = {r["chunk"]: np.frombuffer(pa.decompress(bytes(r["body"]), r["size"], codec="zstd", asbytes=True), np.int64) for r in rows}
    if not got:
        return np.full((64, 64), -np.log(64.0)), np.zeros(1 << DICTIONARY_BITS, bool)
    moves = got[-1].reshape(64, 64) + 1.0
    words = np.concatenate([got[k] for k in range(64)])
    return np.log(moves / moves.sum(1, keepdims=True)), words > max(2, FREQUENT * words.sum())


def _entry(body: bytes, before: str, behind: str, named: bool, path: str, moves: np.ndarray, known: np.ndarray) -> list[float]:
    b = np.frombuffer(body, np.uint8)
    n = len(b)
    c = _CLASS[b]
    digit, upper, lower = c < 10, (c >= 10) & (c < 36), (c >= 36) & (c < 62)
    kind = digit + 2 * upper + 3 * lower
    w = Words(b, np.array([0, n]), _LETTER)
    size = w.end - w.start
    in_dict = known[(word_hashes(w, lower=True) >> np.uint64(64 - DICTIONARY_BITS)).astype(np.int64)] & (size >= 3)
    assigned = before.rstrip("\"' ").endswith(("=", ":", "=>"))
    return [n, digit.mean(), upper.mean(), lower.mean(), 1 - (digit | upper | lower).mean(), len(set(body)) / n,
            float(bool(re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", body))), (kind[1:] != kind[:-1]).mean() if n > 1 else 0.0,
            float(moves[c[:-1], c[1:]].mean()) if n > 1 else 0.0, float(size[in_dict].sum() / n),
            float(assigned), float(named), float(bool(HARMLESS.search(before))),
            float(before[-1:] in "\"'" and behind[:1] in "\"'" and bool(before) and bool(behind)),
            float(before[-1:].isspace()), float(behind[:1].isspace() or not behind),
            float(bool(re.search(r"(?i)test|example|sample|mock|fixture", path))), float(path.count("/"))]


def _named_values(raw: bytes, buf: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of each value behind an assignment to a credential's name."""
    marks = np.flatnonzero((buf == 0x3D) | (buf == 0x3A))
    rows = np.searchsorted(off, marks, "right") - 1
    for p, r in zip(marks.tolist(), rows.tolist(), strict=True):
        lo, hi = int(off[r]), int(off[r + 1])
        if CREDENTIAL.search(raw[max(lo, p - 48):p + 1].decode(errors="ignore")):
            m = VALUE.match(raw, p + 1, hi)
            if m:
                yield (r, *m.span(m.lastindex))


def _candidates(stats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves, known = stats.value
        for b in batches:
            for i, j, buf, off in text_steps(b.column(2)):
                w = Words(buf, off, _KEY)
                size = w.end - w.start
                sums = lambda m: np.r_[0, np.cumsum(m)]
                digits, uppers = sums((buf >= 0x30) & (buf <= 0x39)), sums((buf >= 0x41) & (buf <= 0x5A))
                d, u = digits[w.end] - digits[w.start], uppers[w.end] - uppers[w.start]
                sure = (d > 0) | (u + d == size)
                raw = buf.tobytes()
                spans = {(a, z): (r, True) for r, a, z in _named_values(raw, buf, off)}
                fronts = {a for a, _ in spans}
                for k in np.flatnonzero(size >= 15).tolist():
                    s, e = int(w.start[k]), int(w.end[k])
                    if s not in fronts and (size[k] >= 16 and sure[k] or ISSUED.search(raw[s:e].decode())):
                        spans[s, e] = (int(w.row[k]), False)
                rows, at, found, marks, label, vec = [], [], [], [], [], []
                for (s, e), (r, named) in sorted(spans.items()):
                    lo, hi = max(int(off[r]), s - 48), min(int(off[r + 1]), e + 48)
                    before, behind = (raw[x:y].decode(errors="ignore") for x, y in ((lo, s), (e, hi)))
                    body = raw[s:e]
                    path = b.column(1)[i + r].as_py() or ""
                    rows.append(r)
                    at.append(s - int(off[r]))
                    found.append(e - s)
                    marks.append(hashlib.sha256(body).hexdigest())
                    if ISSUED.search(body.decode()):
                        label.append(True)
                    elif named:
                        label.append(True if e - s >= SHORT and digits[e] > digits[s] else None)
                    else:
                        label.append(False)
                    vec.append(_entry(body, before, behind, named, path, moves, known))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i).take(pa.array(rows, pa.int64())), pa.array(at, pa.int64()), pa.array(found, pa.int64()),
                     pa.array(marks, pa.string()), pa.array(label, pa.bool_()), pa.array(vec, pa.list_(pa.float64()))],
                    names=["id", "start", "length", "sha256", "reviewed", "features"])
    return run


def scan_secrets(docs: DataFrame, labels: DataFrame | None = None, *, sample: int = 20_000, trees: int = 30, depth: int = 8,
                 id: str = "doc_id", text: str = "text", path: str = "source", keep_all: bool = False) -> DataFrame:
    """id, start, length (bytes), sha256 of the finding, score: findings that
    the forest holds for secrets (all candidates with ``keep_all``)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    spark = docs.sparkSession
    ship(spark)
    stats = spark.sparkContext.broadcast(corpus_statistics(docs, text=text))  # fixed size
    source = F.col(path) if path in docs.columns else F.lit("")
    rows = docs.select(F.col(id).alias("id"), source.cast("string").alias("path"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = stored(rows.mapInArrow(_candidates(stats), f"id {kind}, start long, length long, sha256 string, reviewed boolean, "
                                   "features array<double>"), "secret-candidates")
    if labels is None:
        labelled = found.select(F.col("reviewed").cast("double").alias("label"), "features", "sha256", "id", "start")
    else:
        given = labels.select(F.col(id).alias("id"), "start", F.col("is_secret").cast("double").alias("label")).filter("label is not null")
        labelled = found.join(given, ["id", "start"]).select("label", "features", "sha256", "id", "start")
    # equal shares of both labels, those with the smallest hash: at most ``sample`` rows
    half = sample // 2
    halves = [labelled.filter(F.col("label") == x).orderBy(F.xxhash64("sha256", "id", "start")).limit(half) for x in (0.0, 1.0)]
    train = stored(halves[0].unionByName(halves[1]).select("label", array_to_vector("features").alias("vector")), "secret-training")
    if train.select("label").distinct().count() < 2:
        scored = found.withColumn("score", F.coalesce(F.col("reviewed").cast("double"), F.lit(0.5)))
    else:
        forest = RandomForestClassifier(featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=7).fit(train)
        scored = (forest.transform(found.withColumn("vector", array_to_vector("features")))
                  .withColumn("score", vector_to_array("probability")[1]))
    out = scored.select(F.col("id").alias(id), "start", "length", "sha256", "score")
    return out if keep_all else out.filter("score >= 0.5")
