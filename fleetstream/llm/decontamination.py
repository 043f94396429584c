"""Benchmark decontamination by winnowing.

A shared span of ``window`` words is what counts.  Every run of ``window``
words holds ``window - gram + 1`` grams of ``gram`` words; winnowing keeps the
smallest gram hash of each such run (the leftmost of equals), on both sides.
The choice depends on the run's words alone, so any shared run of ``window``
words keeps the same gram at the same place in it: each is found.  An item of
fewer words is one window by itself; every item length below ``window`` that
occurs is winnowed as a class of its own (at most ``window`` - 1 classes).

Document and item fingerprints are joined on (class, hash), and each hit is
extended word by word to both sides; the words decide, not the hashes.  Before
the join, a bit table of fixed size (2^``BLOOM_BITS`` bits, set by the items'
hashes) drops document fingerprints that no item can have.  It only saves
work: a full table would let every fingerprint through.

Defined cases: words are ``[0-9a-z]`` and everything beyond ASCII, after A-Z
is lower-cased; a null or wordless text has 0 words and no hits, and such an
item has no windows; item ids that repeat count once, a null item id as the
empty string; repeated rows each get the same answer; null ids are kept; extra
columns are ignored; empty tables give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ALNUM, Words, ship, small_or_shuffled, stored, text_steps, window_hashes, window_starts, word_hashes

BLOOM_BITS = 23


def classes_of(window: int, gram: int, lengths: list[int]) -> list[tuple[int, int, int]]:
    """(class = words of a window, words of a gram, grams of a window)."""
    return [(n, min(gram, n), n - min(gram, n) + 1) for n in sorted({min(n, window) for n in lengths if n > 0})]


def winnow(w: Words, h: np.ndarray, n: int, k: int, grams: int) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of the grams that winnowing keeps."""
    starts = np.flatnonzero(window_starts(w, n))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    g = window_hashes(h, k)
    m = len(h) - n + 1
    best, arg = g[:m].copy(), np.zeros(m, np.int64)
    for j in range(1, grams):
        less = g[j:m + j] < best
        best[less] = g[j:m + j][less]
        arg[less] = j
    kept = np.zeros(len(g), bool)
    kept[starts + arg[starts]] = True
    at = np.flatnonzero(kept)
    return at, g[at]


def _prints(classes: list[tuple[int, int, int]], bloom, only: int | None = None):
    """(id, key, text) -> one row (n_words) for each row, and one for each
    fingerprint: class, hash, place, the words from there on, and those before
    it, nearest first.  only: the item side, where a row has the class of its
    own length; ``only`` is the longest window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bloom.value, np.uint8)).astype(bool) if bloom is not None else None
        for b in batches:
            for i, j, buf, off in text_steps(b.column(2)):
                w = Words(buf, off, ALNUM)
                h = word_hashes(w, lower=True)
                rows: dict[str, list] = {c: [] for c in ("cls", "fp", "pos", "right", "left")}
                source: list[int] = []
                for n, k, grams in classes:
                    at, fp = winnow(w, h, n, k, grams)
                    if bits is not None:
                        ok = bits[fp >> np.uint64(64 - BLOOM_BITS)]
                        at, fp = at[ok], fp[ok]
                    if only is not None:
                        ok = np.minimum(w.count[w.row[at]], only) == n
                        at, fp = at[ok], fp[ok]
                    for p, f, r in zip(at.tolist(), fp.view(np.int64).tolist(), w.row[at].tolist(), strict=True):
                        a, z = max(int(w.first[r]), p - grams + 1), min(int(w.first[r + 1]), p + n)
                        words = w.text(a, z).lower().decode().split(" ")
                        source.append(r)
                        rows["cls"].append(n)
                        rows["fp"].append(f)
                        rows["pos"].append(p - int(w.first[r]))
                        rows["right"].append(words[p - a:])
                        rows["left"].append(words[:p - a][::-1])
                m = j - i
                take = pa.array(np.r_[np.arange(m), np.array(source, np.int64)].astype(np.int64))
                pad = lambda x, t, m=m: pa.array([None] * m + x, t)
                strings = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, m).take(take), b.column(1).slice(i, m).take(take),
                     pa.array(w.count.tolist() + [None] * len(source), pa.int64()),
                     pad(rows["cls"], pa.int32()), pad(rows["fp"], pa.int64()), pad(rows["pos"], pa.int64()),
                     pad(rows["right"], strings), pad(rows["left"], strings)],
                    names=["id", "key", "n_words", "cls", "fp", "pos", "right", "left"])
    return run


_SCHEMA = ("id {0}, key string, n_words long, cls int, fp long, pos long, "
           "right array<string>, left array<string>")


def _common(a: str, b: str):
    """Length of the common prefix of two arrays of words."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same))


def matches(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, gram: int = 5, id: str = "doc_id",
            text: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows (id, key, n_words) of every document, and the spans
    (id, key, item, start, stop) of document words that an item shares."""
    spark = docs.sparkSession
    ship(spark)
    side = lambda df, i, t: df.select(F.col(i).alias("id"), F.md5(F.coalesce(t, F.lit(""))).alias("key"), F.col(t).alias("text"))
    items, texts = side(benchmark, item_id, item_text), side(docs, id, text)
    # lengths of items, in words: only those below the window make classes
    counted = items.mapInArrow(_prints([], None), _SCHEMA.format(items.schema["id"].dataType.simpleString()))
    lengths = [r[0] for r in counted.select(F.least("n_words", F.lit(window))).distinct().collect()]
    classes = classes_of(window, gram, lengths)
    prints = stored(items.mapInArrow(_prints(classes, None, window), _SCHEMA.format(
        items.schema["id"].dataType.simpleString())).filter("cls is not null"), "item-prints")
    bits = np.zeros(1 << BLOOM_BITS, bool)
    slots = prints.select(F.shiftrightunsigned("fp", 64 - BLOOM_BITS).alias("slot")).distinct()
    bits[[r[0] for r in slots.collect()]] = True  # 2^BLOOM_BITS values at most
    bloom = spark.sparkContext.broadcast(np.packbits(bits).tobytes())

    found = stored(texts.mapInArrow(_prints(classes, bloom), _SCHEMA.format(
        texts.schema["id"].dataType.simpleString())), "document-prints")
    side_i = prints.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("item"), "cls", "fp",
                           F.col("right").alias("iright"), F.col("left").alias("ileft")).distinct()
    right, left = _common("right", "iright"), _common("left", "ileft")
    spans = (found.filter("cls is not null").join(side_i, ["cls", "fp"])
             .withColumn("r", right).withColumn("l", left).filter("r + l >= cls")
             .select("id", "key", "item", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("stop")))
    return found.filter("cls is null").select("id", "key", "n_words"), spans


def contamination(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", **options) -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``docs``."""
    rows, spans = matches(docs, benchmark, id=id, **options)
    spans = stored(spans, "spans")
    ids = F.array_sort(F.collect_set("item"))
    items = spans.groupBy("id", "key").agg(F.countDistinct("item").alias("n_items"), ids.alias("items"))
    # union of the spans of one document: at most as many as it has words
    before = Window.partitionBy("id", "key").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    hit = (spans.select("id", "key", "start", "stop").distinct()
           .withColumn("seen", F.coalesce(F.max("stop").over(before), F.lit(0)))
           .groupBy("id", "key").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "seen"))).alias("n_hit")))
    joined = rows
    for k, df in enumerate((items, hit)):
        df = df.withColumnsRenamed({"id": f"id{k}", "key": f"key{k}"})
        joined = joined.join(df, F.col("id").eqNullSafe(F.col(f"id{k}")) & (F.col("key") == F.col(f"key{k}")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        F.col("id").alias(id), "n_words", n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, all columns, without those that share a window with an item."""
    _, spans = matches(docs, benchmark, id=id, text=text, **options)
    hit = stored(spans.select(F.col("id").alias("__id"), F.col("key").alias("__key")).distinct(), "contaminated")
    key = F.md5(F.coalesce(F.col(text), F.lit("")))
    return docs.join(small_or_shuffled(hit), F.col(id).eqNullSafe(F.col("__id")) & (key == F.col("__key")), "left_anti")
