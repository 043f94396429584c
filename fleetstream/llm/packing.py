"""Best-fit packing of token pieces into sequences of a fixed capacity.

Bulk-synchronous best fit, largest pieces first.  A round takes the largest
size that is left, all its pieces at once.  Pieces are range-sorted in Spark
by (size, id, piece); the open sequences are a sorted list of gaps in the driver.
A sweep over that list finds the smallest gap that holds the size; the
piece of rank r goes to the r-th place of the sweep, so no two pieces claim
one place; the gaps shrink, what finds no gap opens new sequences, and the
next size follows.  The result is the one of sequential best-fit decreasing.

Pieces of one size, and sequences of one gap, are interchangeable, so a round
works on runs: (gap, first sequence, number of sequences).  There are at most
``capacity`` sizes and gaps, whatever the corpus holds, and the runs are what
the driver keeps: all rounds run there, on a histogram of sizes, and distributed
sweeps (range-sorted gaps, successor joins, conflicts by rank) are not built, as
a round has at most ``capacity`` runs to match.  Histogram and plan grow with
``capacity``, not with the rows.  The rows stay in Spark: they are encoded once, range-sorted
into their ranks (``ranked``; a frequent size is spread over many partitions)
and look up their place by (size, rank).

Defined cases: a null or empty text is one piece that holds only the end id;
a null id is kept; repeated rows are packed each; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, ranked, ship, stored, text_steps
from .tokens import STEP, codec, vocabulary


def token_pieces(docs: DataFrame, path: str | None = None, *, capacity: int = 2048, end_id: int = 0,
                 id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32 (and ids): each text's ids and the
    end id, cut every ``capacity`` ids."""
    ship(docs.sparkSession)
    path = vocabulary(path)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for i, j, buf, off in text_steps(b.column(1), STEP):
                ids, at = c.encode(buf, off)
                n = np.diff(at)
                k = n // capacity + 1  # n + 1 ids with the end id
                row = np.repeat(np.arange(j - i), k)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
                start = piece * capacity
                length = np.minimum(n[row] + 1 - start, capacity)
                flat = np.insert(ids, at[1:], end_id).astype("<u4")
                begin = at[row] + row + start
                stop = begin + length
                raw = memoryview(flat.tobytes())
                spans = [raw[4 * x:4 * y] for x, y in zip(begin.tolist(), stop.tolist(), strict=True)]
                cols = [b.column(0).slice(i, j - i).take(pa.array(row)), pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                        pa.array([zlib.crc32(s) for s in spans], pa.int64())]
                if keep_ids:
                    cols.append(pa.array([bytes(s) for s in spans], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long"
                           + ", ids binary" * keep_ids)


def best_fit_rounds(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rounds over the runs of sizes and gaps.

    Returns rows (size, first rank, first sequence, pieces a sequence takes,
    offset of the first of them), sorted by (size, first rank): the piece of
    rank r goes to sequence ``first + (r - first rank) // each`` at offset
    ``offset + (r - first rank) % each * size``.
    """
    gaps: list[int] = []  # gaps that some sequence has, sorted
    runs: dict[int, deque] = {}  # gap -> runs (first sequence, number)
    placed: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def put(gap: int, first: int, number: int) -> None:
        if gap:
            if gap not in runs:
                runs[gap] = deque()
                insort(gaps, gap)
            runs[gap].append((first, number))

    def fill(gap: int, first: int, number: int, size: int, rank: int, left: int) -> tuple[int, int]:
        """Fill sequences of one gap with pieces of one size: (pieces placed, sequences used)."""
        each = gap // size
        full = min(number, left // each)
        if full:
            placed.append((size, rank, first, each, capacity - gap))
            put(gap - each * size, first, full)
        used, done = full, full * each
        if full < number and left > done:
            rest = left - done  # under ``each``: the last pieces share one sequence
            placed.append((size, rank + done, first + full, rest, capacity - gap))
            put(gap - rest * size, first + full, 1)
            used, done = used + 1, left
        return done, used

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            k = bisect_left(gaps, size)
            if k == len(gaps):
                each = capacity // size
                number = -(-left // each)
                fill(capacity, opened, number, size, rank, left)
                opened += number
                break
            gap = gaps[k]
            first, number = runs[gap].popleft()
            if not runs[gap]:
                del runs[gap]
                gaps.pop(k)
            done, used = fill(gap, first, number, size, rank, left)
            if used < number:
                put(gap, first + used, number - used)
            left, rank = left - done, rank + done
    return np.array(sorted(placed), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, *, capacity: int = 2048, id: str = "id") -> DataFrame:
    """Add sequence_id and offset to pieces (id, piece, length <= capacity, ...)."""
    spark = pieces.sparkSession
    rows = stored(pieces, "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = spark.sparkContext.broadcast(best_fit_rounds(counts, capacity))  # runs: bounded by the capacity
    order = [id, "piece", *(c for c in ("ids_crc32",) if c in rows.columns)]
    numbered = ranked(rows, "length", order, "piece-ranks")
    names = numbered.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        key = (p[:, 0] << np.int64(42)) + p[:, 1]
        for b in batches:
            size = b.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = b.column(names.index("rank")).to_numpy(zero_copy_only=False)
            if not len(size):
                continue
            at = p[np.searchsorted(key, (size.astype(np.int64) << np.int64(42)) + rank, "right") - 1]
            k = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(at[:, 2] + k // at[:, 3], pa.int64()),
                 pa.array(at[:, 4] + k % at[:, 3] * size, pa.int64())],
                names=[*names[:-1], "sequence_id", "offset"])

    return numbered.mapInArrow(place, ddl(rows) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, *, capacity: int = 2048, end_id: int = 0,
                   id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of all texts with their place: id, piece, start, length,
    ids_crc32, (ids,) sequence_id, offset.  ``ids``: little-endian unsigned 32-bit."""
    out = pack(token_pieces(docs, path, capacity=capacity, end_id=end_id, id=id, text=text, keep_ids=keep_ids),
               capacity=capacity)
    return out.withColumnRenamed("id", id)
