"""Token counts of whole texts; huge texts by overlap resynchronisation.

A text of at most ``chunk_bytes`` is encoded whole.  A longer one is cut into
chunks that overlap by ``overlap`` bytes, dealt over all tasks and encoded
with the offsets of its tokens.  Two neighbours are spliced at a boundary
that both have found at the same byte of their overlap and that is proven
stable: a token starts there and white space stands before it, inside both
chunks, and no piece of the vocabulary's splitter reaches over white space.
Tokens before the boundary are counted in the left chunk, those behind it in
the right one.  Where a pair of chunks shares no such boundary (a run without
white space longer than the overlap), the document goes through again with an
overlap ``WIDEN`` times as wide, and chunks of sixteen overlaps at least, until
its overlaps meet or one chunk covers the text: an unbroken text of 2 MB takes
three rounds, and each encodes it about once.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a null id is
kept; repeated rows each get a row; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE, Words, parts, ship, spread, stored, text_bytes, text_steps
from .tokens import STEP, codec, vocabulary


#: How much wider the overlap gets where chunks share no boundary.
WIDEN = 32


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            col = b.column(1)
            if not b.num_rows:
                continue
            n, size = [], []
            for _, _, buf, off in text_steps(col, STEP):
                n.append(c.counts(buf, off))
                size.append(np.diff(off))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.concatenate(size), pa.int64()), pa.array(np.concatenate(n), pa.int64())],
                names=["id", "n_bytes", "n_tokens"])
    return run


def _cut(chunk: int, overlap: int):
    """(id, key, text) -> one row for each chunk; the last one reaches the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(2)[i].as_py().encode()
                for k, at in enumerate(range(0, len(text), chunk)):
                    body = text[at:at + chunk + overlap]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([k], pa.int32()),
                         pa.array([at], pa.int64()), pa.array([at + len(body) >= len(text)]), pa.array([body], pa.binary())],
                        names=["id", "key", "chunk", "at", "last", "body"])
                    if at + len(body) >= len(text):
                        break
    return run


def _encode(path: str, overlap: int):
    """Chunk -> its token count, and the boundaries in its two overlaps as
    (place in the text, tokens of this chunk before it)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for at, last, body in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                buf = np.frombuffer(body, np.uint8)
                w = Words(buf, np.array([0, len(buf)]), NOT_SPACE)
                before = np.r_[0, np.cumsum(c.places(w)[1], dtype=np.int64)]
                ok = w.start > 0
                ok[ok] = SPACE[buf[w.start[ok] - 1]]
                left, right = ok & (w.start < overlap), ok & (w.start >= len(buf) - overlap)
                cols[0].append(int(before[-1]))
                for k, m in ((1, left), (3, right)):
                    cols[k].append((w.start[m] + at).tolist() if k == 1 or not last else [])
                    cols[k + 1].append(before[:-1][m].tolist() if k == 1 or not last else [])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in (0, 1, 2, 4)), pa.array(cols[0], pa.int64()), *(pa.array(x, longs) for x in cols[1:])],
                names=["id", "key", "chunk", "last", "n", "lp", "ln", "rp", "rn"])
    return run


def _spliced(big: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(id, key, n_tokens): the count is null where two chunks share no boundary."""
    spark = big.sparkSession
    n = parts(text_bytes(big), 8 << 20, spread(spark))
    chunks = (big.dropDuplicates(["id", "key"])
              .mapInArrow(_cut(chunk, overlap), "id {0}, key string, chunk int, at long, last boolean, body binary".format(
                  big.schema["id"].dataType.simpleString()))
              .repartition(n, "key", "chunk"))
    enc = chunks.mapInArrow(_encode(path, overlap), (
        f"id {big.schema['id'].dataType.simpleString()}, key string, chunk int, last boolean, n long, "
        "lp array<long>, ln array<long>, rp array<long>, rn array<long>"))
    # neighbours meet by an equi-join on the chunk number: a document's chunks stay spread
    left = enc.select("id", "key", "chunk", "last", "n", "rp", "rn")
    right = enc.select(F.col("id").alias("id2"), F.col("key").alias("key2"), (F.col("chunk") - 1).alias("chunk2"), "lp", "ln")
    x = F.array_min(F.array_intersect("rp", "lp"))
    pair = (left.join(right, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2"))
                      & (F.col("chunk") == F.col("chunk2")), "left")
            .withColumn("x", x))
    # tokens of the left chunk before x, less those of the right chunk before x
    add = F.when(F.col("last"), F.col("n")).otherwise(
        F.element_at("rn", F.array_position("rp", F.col("x")).cast("int"))
        - F.element_at("ln", F.array_position("lp", F.col("x")).cast("int")))
    return (pair.groupBy("id", "key")
            .agg(F.sum(F.when(F.col("last") | F.col("x").isNotNull(), add)).alias("n_tokens"),
                 F.max(F.when(~F.col("last") & F.col("x").isNull(), 1).otherwise(0)).alias("open")))


def token_counts(docs: DataFrame, path: str | None = None, *, id: str = "doc_id", text: str = "text",
                 chunk_bytes: int = 1 << 15, overlap: int = 512, limit: int = 2048) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row of ``docs``."""
    ship(docs.sparkSession)
    path = vocabulary(path)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > chunk_bytes
    small = rows.filter(~long).mapInArrow(_whole(path), f"id {kind}, n_bytes long, n_tokens long")

    big = rows.filter(long).select("id", F.md5("text").alias("key"), "text")
    done, todo, width = None, big, overlap
    while True:
        got = stored(_spliced(todo, path, max(chunk_bytes, 16 * width) if done is not None else chunk_bytes, width), "token-splices")
        closed = got.filter("open = 0").select("id", "key", "n_tokens")
        done = closed if done is None else done.unionByName(closed)
        if not got.filter("open = 1").limit(1).count():
            break
        width *= WIDEN
        again = got.filter("open = 1").select(F.col("id").alias("id2"), F.col("key").alias("key2"))
        todo = big.join(again, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")), "left_semi")
    counts = done.select(F.col("id").alias("id2"), F.col("key").alias("key2"), "n_tokens")
    large = (big.select("id", "key", F.octet_length("text").cast("long").alias("n_bytes"))
             .join(counts, F.col("id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("key2")))
             .select("id", "n_bytes", "n_tokens"))
    return (small.unionByName(large)
            .select(F.col("id").alias(id), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
