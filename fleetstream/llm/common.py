"""Helpers shared by the corpus operators: inputs, shared tables, ranks, word arrays.

Row identity.  Operators address a row by ``(id, md5 of the text)``.  Rows
that repeat an id with another text are therefore documents of their own;
rows that repeat both are one document, and each such row gets the same
answer.  Operators that return one row per document return it once.
"""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step holds at a time (a longer text is one step).
STEP_BYTES = 4 << 20

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD1342543DE82EF95)
#: Odd random values, one for each byte (from a fixed seed, the same in every task).
_BYTE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Word bytes: everything but ASCII white space.
NOT_SPACE = ~SPACE
#: Word bytes: ASCII letters and digits and every byte beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


_SHIPPED: set[str] = set()
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application:
    executors need no copy of it on their own path.  Where the session leaves
    the size of Arrow batches at its default (64 MB), it is set to two steps:
    both sides of the socket hold a batch or two."""
    if spark.conf.get(_BATCH_BYTES).lower().rstrip("b") in ("67108864", "64m"):
        spark.conf.set(_BATCH_BYTES, str(2 * STEP_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent.parent
        if root.parent.is_dir():  # not itself inside an archive
            made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="llm-code-"), root.name),
                                       "zip", root.parent, root.name)
            spark.sparkContext.addPyFile(made)
        _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``);
    one of our own only on a local master that names none, as in tests."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="llm-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


_STORED: dict[str, list[str]] = {}


def release(spark: SparkSession, keep: str | None = None) -> None:
    """Delete the tables that operators have stored in this application: call
    it when the results that read them have been written.  ``keep``: those of
    this name stay."""
    app = spark.sparkContext.applicationId
    all_ = _STORED.pop(app, [])
    kept = [p for p in all_ if keep and p.rsplit("/", 1)[1].startswith(f"{keep}-")]
    if kept:
        _STORED[app] = kept
    for path in all_:
        if path in kept:
            continue
        hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends
    there, and no lost executor makes earlier steps run again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    _STORED.setdefault(spark.sparkContext.applicationId, []).append(path)
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the write's shuffle files go when it is done
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a few numbers each that a broadcast may hold.
BROADCAST_ROWS = 1_000_000


def small_or_shuffled(rows: DataFrame) -> DataFrame:
    """A stored table of keys as the small side of a join: broadcast up to
    ``BROADCAST_ROWS`` rows (some tens of megabytes), shuffled beyond."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows.hint("shuffle_hash")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: one aggregate, to size partitions by."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def parts(total: int, each: int, least: int) -> int:
    """Partitions of about ``each`` units, ``least`` at least."""
    return max(least, -(-total // each))


def spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def ranked(df: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """``rank``: place of each row among those with the same value of the
    integer column ``by``, from 0, in the order of ``order``.

    The rows are range-sorted on (by, order) and stored, so a frequent value
    is spread over many partitions.  A row's place in its partition plus the
    count of its value in earlier partitions is its rank; what the driver
    sees is one count for each (partition, value), of which a sorted layout
    has at most partitions + values.
    """
    spark = df.sparkSession
    cols = df.columns
    sorted_df = df.repartitionByRange(spread(spark), by, *order).sortWithinPartitions(by, *order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for b in batches:
            v = b.column(cols.index(by)).to_numpy(zero_copy_only=False)
            if not len(v):
                continue
            starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            place = np.arange(len(v)) - np.repeat(starts, np.diff(np.r_[starts, len(v)]))
            key = int(v[0])
            if starts.size > 1:
                place[:starts[1]] += seen.get(key, 0)
                seen = {int(v[-1]): len(v) - int(starts[-1])}
            else:
                place += seen.get(key, 0)
                seen = {key: seen.get(key, 0) + len(v)}
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(place, pa.int64()), pa.array(np.full(len(v), part, np.int32))],
                names=[*cols, "place", "part"])

    out = ddl(df) + ", place long, part int"
    rows = stored(sorted_df.mapInArrow(number, out), name)
    counts = rows.groupBy(by, "part").count().orderBy(by, "part").collect()
    before: dict = {}
    offsets = []
    for r in counts:
        offsets.append((r["part"], r[by], before.get(r[by], 0)))
        before[r[by]] = before.get(r[by], 0) + r["count"]
    if not offsets:
        return rows.select(*cols, F.col("place").alias("rank"))
    off = spark.createDataFrame(offsets, f"part int, {by} long, ahead long")
    return (rows.join(F.broadcast(off), ["part", by])  # partitions + values rows at most
            .select(*cols, (F.col("place") + F.col("ahead")).alias("rank")))


# --- word arrays -----------------------------------------------------------

class Words:
    """Words of some consecutive rows as arrays over one byte buffer.

    start, end: byte range of each word; row: its row; first: index of the
    first word of each row (length rows + 1).
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.buf, self.offsets = buf, offsets
        w = is_word[buf]
        if len(w):
            edge = offsets[:-1]
            edge = edge[edge < len(w)]
            begin = w.copy()
            begin[1:] &= ~w[:-1]
            begin[edge] = w[edge]
            stop = w.copy()
            stop[:-1] &= ~w[1:]
            last = offsets[1:] - 1
            last = last[last >= 0]
            stop[last] = w[last]
            self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(len(offsets) - 1), self.count)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j (not included), joined by one space."""
        b = self.buf
        return b" ".join(b[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j], strict=True))


_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        inv = np.uint64(pow(int(_P), -1, 1 << 64))
        for k, base in enumerate((_P, inv)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(w: Words, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word, the same wherever the word stands."""
    byte = _BYTE.copy()
    if lower:
        byte[0x41:0x5B] = byte[0x61:0x7B]
    out = np.empty(len(w.start), np.uint64)
    i, n = 0, len(w.start)
    while i < n:
        lo = w.start[i]
        j = max(i + 1, int(np.searchsorted(w.end, lo + (1 << 19), "right")))
        hi = w.end[j - 1]
        fwd, back = _powers(int(hi - lo) + 1)
        s = np.zeros(int(hi - lo) + 1, np.uint64)
        np.cumsum(byte[w.buf[lo:hi]] * fwd[:hi - lo], out=s[1:])
        a, b = w.start[i:j] - lo, w.end[i:j] - lo
        out[i:j] = (s[b] - s[a]) * back[a]
        i = j
    return mix(out)


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values of h (length len(h) - n + 1)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = np.zeros(m, np.uint64)
    for j in range(n):
        acc *= _Q
        acc += h[j:m + j]
    return mix(acc + np.uint64(n))


def window_starts(w: Words, n: int) -> np.ndarray:
    """Mask over the first len - n + 1 words: does a whole window of the row start here?"""
    m = len(w.start) - n + 1
    return w.row[:m] == w.row[n - 1:] if m > 0 else np.zeros(0, bool)


_LEAN = [False]


def lean() -> None:
    """Once in each Python worker: large arrays go back to the system when
    they are freed (glibc keeps ever larger ones otherwise), Arrow's buffers, too."""
    if not _LEAN[0]:
        _LEAN[0] = True
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        except (OSError, AttributeError):  # another C library
            pass


def text_steps(col: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``step`` bytes:
    (first row, row after the last, bytes, offsets of the rows in them).
    A null has no bytes."""
    lean()
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + n + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + step, "right")) - 1)
        yield i, j, buf[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def env_once() -> None:
    """One thread for native libraries inside a task."""
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
