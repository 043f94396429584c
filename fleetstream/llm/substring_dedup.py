"""Substring dedup: words covered by a repeated run of words are removed but
for the run's first occurrence, by prefix-partitioned suffix trees.

A suffix is a word position with at least ``length`` words of its document
behind it; below depth ``length`` its path doesn't matter.  Its path, (prefix,
rest) by halves, picks its group: groups are ranges of the path's hash, as many
as the corpus's size asks for.  So every prefix is carried to the depth where
it can't be split further, and no prefix, however frequent, is a group of its
own; prefixes of several lengths, chosen by counting followers, are not built,
nor are the inner nodes above depth ``length``, which no result needs.  A group
sorts its suffixes on their path.  A node that reaches depth ``length`` and has
two suffixes or more is a repeat; all of its suffixes but the first, by (id,
position), are later copies.

Which suffixes get there.  Most positions repeat nothing, so suffixes are
pruned first.  Every window of ``length`` words owns one anchor: the smallest
hash among its runs of half that length (``winnow``).  Equal windows own equal
anchors, so a window whose anchor occurs once is alone and stays behind; only
the anchors of all texts are compared (about one for six words), and only
windows with a repeated anchor become suffixes.

Skew.  Work goes by steps of some megabytes of text.  Within a step equal
anchors, and equal suffixes, are combined before they are sent: the later ones
are known to be copies.  So a passage that a third of all documents hold is
one entry a step, which bounds what one path brings to a group, and a prefix
with many followers is spread by its path.

The texts are read again where a step's answers arrive.  A step is known by its
partition and number; its checksum is sent along and compared, so an input
whose partitions change between two reads fails instead of mixing them up
(write it to Parquet first).

Equality is that of 96-bit path labels.  Defined cases: ids are integers, a
null id sorts first; rows that repeat an id are taken in the order of reading,
so a repeated row is a later copy; a null text has no words; texts of fewer
than ``length`` words keep all; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (NOT_SPACE, Words, lean, mix, parts, ship, spread, text_bytes, text_steps, window_hashes, window_starts,
                     word_hashes)

_SCHEMA = "bucket int, step long, kind int, body binary"
#: Kinds of rows: anchors of a step; its texts; its repeated anchors; suffixes; known later copies.
ANCHORS, TEXTS, REPEATED, SUFFIXES, COPIES = range(5)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """(step, checksum, ids, bytes, offsets) of (part, id, text) rows."""
    k = 0
    for b in batches:
        for i, j, buf, off in text_steps(b.column(2)):
            step = (b.column(0)[i].as_py() << 31) + k
            k += 1
            yield step, zlib.crc32(off.tobytes(), zlib.crc32(buf)), b.column(1).slice(i, j - i), buf, off


def _owned_anchors(w: Words, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, place of the anchor that each window owns, its hash)."""
    starts = np.flatnonzero(window_starts(w, length))
    half = length // 2
    g = window_hashes(h, half)
    best, place = g[starts], starts.copy()
    for j in range(1, length - half + 1):
        x = g[starts + j]
        less = x < best
        best[less] = x[less]
        place[less] = starts[less] + j
    return starts, place, best


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Range of the hash, in its order."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _groups(s: np.ndarray, buckets: int) -> np.ndarray:
    """Group of each suffix, by its whole path."""
    return _bucket(mix(s["prefix"] + mix(s["rest"].astype(np.uint64))), buckets)


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()),
         pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary())],
        names=["bucket", "step", "kind", "body"])


def _table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_batches([_rows(rows)])


def _send_anchors(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, _, _, buf, off in _steps(batches):
            w = Words(buf, off, NOT_SPACE)
            u = np.unique(_owned_anchors(w, word_hashes(w), length)[2])
            cut = np.searchsorted(_bucket(u, buckets), np.arange(buckets + 1))
            yield _rows([(k, step, ANCHORS, u[cut[k]:cut[k + 1]].tobytes()) for k in range(buckets) if cut[k] < cut[k + 1]])
    return run


def _send_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each step's ids and texts, compressed."""
    for step, check, ids, buf, off in _steps(batches):
        key = ids.cast(pa.int64()).fill_null(-1 << 63).to_numpy(zero_copy_only=False)
        null = np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes()
        head = np.array([check, len(key), len(buf)], np.int64).tobytes()
        raw = key.astype(np.int64).tobytes() + off.astype(np.int64).tobytes() + null + buf.tobytes()
        yield _rows([(0, step, TEXTS, head + pa.compress(raw, codec="zstd", asbytes=True))])


def _read_texts(body: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(checksum, ids, whether each is null, bytes, offsets)."""
    check, n, size = np.frombuffer(body, np.int64, 3).tolist()
    nulls = -(-n // 8)
    raw = pa.decompress(body[24:], 16 * n + 8 + nulls + size, codec="zstd", asbytes=True)
    null = np.unpackbits(np.frombuffer(raw, np.uint8, nulls, 16 * n + 8), count=n).astype(bool)
    return (check, np.frombuffer(raw, np.int64, n), null, np.frombuffer(raw, np.uint8, size, 16 * n + 8 + nulls),
            np.frombuffer(raw, np.int64, n + 1, 8 * n))


def _by_kind(t: pa.Table) -> dict[int, list[tuple[int, bytes]]]:
    out: dict[int, list] = {}
    for step, kind, body in zip(t.column("step").to_pylist(), t.column("kind").to_pylist(), t.column("body").to_pylist(), strict=True):
        out.setdefault(kind, []).append((step, body))
    return out


def _repeated_anchors(t: pa.Table) -> pa.Table:
    """One bucket of anchors: to each step those that another step has too."""
    lean()
    got = [(s, np.frombuffer(b, np.uint64)) for s, b in _by_kind(t).get(ANCHORS, [])]
    h = np.concatenate([x for _, x in got])
    u, n = np.unique(h, return_counts=True)
    u = u[n > 1]
    rows = [(0, s, REPEATED, x[np.isin(x, u, assume_unique=True)].tobytes()) for s, x in got]
    return _table([r for r in rows if r[3]])


_SUFFIX = np.dtype([("prefix", "<u8"), ("rest", "<u4"), ("id", "<i8"), ("at", "<u4")])


def _suffixes(length: int, buckets: int):
    """One step: its suffixes for the groups of their paths."""
    half = length // 2

    def run(t: pa.Table) -> pa.Table:
        got = _by_kind(t)
        (step, body), = got[TEXTS]
        check, ids, _, buf, off = _read_texts(body)
        w = Words(buf, off, NOT_SPACE)
        h = word_hashes(w)
        starts, place, anchor = _owned_anchors(w, h, length)
        live = np.concatenate([np.frombuffer(b, np.uint64) for _, b in got.get(REPEATED, [])] or [np.zeros(0, np.uint64)])
        g = window_hashes(h, half)
        # anchors with several places in this step are repeated, too
        u, n = np.unique(g[np.unique(place)], return_counts=True)
        live = np.union1d(live, u[n > 1])
        starts = starts[np.isin(anchor, live)]
        s = np.zeros(len(starts), _SUFFIX)
        s["prefix"], s["rest"] = g[starts], window_hashes(h, length - half)[starts + half] >> np.uint64(32)
        s["id"], s["at"] = ids[w.row[starts]], starts
        s = s[np.lexsort((s["at"], s["id"], s["rest"], s["prefix"]))]
        first = np.r_[True, (s["prefix"][1:] != s["prefix"][:-1]) | (s["rest"][1:] != s["rest"][:-1])][:len(s)]
        rows = [(step % buckets, step, COPIES, np.int64(check).tobytes() + s["at"][~first].tobytes())]
        s = s[first]
        group = _groups(s, buckets)
        order = np.argsort(group, kind="stable")
        s = s[order]
        cut = np.searchsorted(group[order], np.arange(buckets + 1))
        rows += [(k, step, SUFFIXES, s[cut[k]:cut[k + 1]].tobytes()) for k in range(buckets) if cut[k] < cut[k + 1]]
        return _table(rows)
    return run


def _tree(t: pa.Table) -> pa.Table:
    """One group: the later suffixes of its deep nodes, to their steps."""
    lean()
    got = _by_kind(t)
    rows = [(0, s, COPIES, b) for s, b in got.get(COPIES, [])]
    parts_ = got.get(SUFFIXES, [])
    if parts_:
        s = np.concatenate([np.frombuffer(b, _SUFFIX) for _, b in parts_])
        number = np.array([x for x, _ in parts_], np.int64)
        src = np.repeat(np.arange(len(parts_)), [len(b) // _SUFFIX.itemsize for _, b in parts_])
        order = np.lexsort((s["at"], number[src], s["id"], s["rest"], s["prefix"]))
        s, src = s[order], src[order]
        same = np.r_[False, (s["prefix"][1:] == s["prefix"][:-1]) & (s["rest"][1:] == s["rest"][:-1])]
        at, src = s["at"][same], src[same]
        order = np.argsort(src, kind="stable")
        at, src = at[order], src[order]
        cut = np.searchsorted(src, np.arange(len(parts_) + 1))
        rows += [(0, int(number[k]), COPIES, np.int64(-1).tobytes() + at[a:z].tobytes())
                 for k, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < z]
    return _table(rows)


def _kept(length: int, id_type: pa.DataType):
    """One step: its texts less the words that later copies cover."""
    def run(t: pa.Table) -> pa.Table:
        got = _by_kind(t)
        (_, body), = got[TEXTS]
        check, ids, null, buf, off = _read_texts(body)
        w = Words(buf, off, NOT_SPACE)
        step = np.zeros(len(w.start) + 1, np.int64)
        for _, b in got.get(COPIES, []):
            if np.frombuffer(b, np.int64, 1)[0] not in (-1, check):
                raise RuntimeError("the input's partitions changed between two reads; write it to Parquet first")
            at = np.frombuffer(b[8:], np.uint32).astype(np.int64)
            step += np.bincount(at, minlength=len(step))
            step -= np.bincount(at + length, minlength=len(step))
        gone = np.cumsum(step)[:-1] > 0
        removed = np.diff(np.r_[0, np.cumsum(gone)][w.first])
        # copy the bytes of kept words with the byte behind each, then turn those into blanks
        keep = np.flatnonzero(~gone)
        size = w.end[keep] - w.start[keep] + 1
        ends = np.cumsum(size)
        place = np.repeat(w.start[keep] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        out = np.append(buf, np.uint8(0x20))[place]
        out[ends - 1] = 0x20
        row_at = np.r_[0, ends][np.searchsorted(keep, w.first)]
        raw = out.tobytes()
        texts = [raw[a:max(a, z - 1)].decode() for a, z in zip(row_at[:-1].tolist(), row_at[1:].tolist(), strict=True)]
        return pa.table({"id": pa.array(ids, pa.int64(), mask=null).cast(id_type), "n_words": pa.array(w.count, pa.int64()),
                         "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(texts, pa.string())})
    return run


def dedup_substrings(docs: DataFrame, *, length: int = 20, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_words, n_removed, kept_text (kept words joined by one space) of each row."""
    from pyspark.sql.pandas.types import to_arrow_type
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id].dataType
    rows = docs.select(F.spark_partition_id().alias("part"), F.col(id).alias("id"), F.col(text).alias("text"))
    buckets = parts(text_bytes(rows), 16 << 20, spread(spark))
    texts = rows.mapInArrow(_send_texts, _SCHEMA)

    def by(df: DataFrame, key: str):
        # as many partitions as groups of suffixes: a task's share stays the same as the corpus grows
        return df.repartition(buckets, key).groupBy(key)

    anchors = by(rows.mapInArrow(_send_anchors(length, buckets), _SCHEMA), "bucket").applyInArrow(_repeated_anchors, _SCHEMA)
    suffixes = by(anchors.unionByName(texts), "step").applyInArrow(_suffixes(length, buckets), _SCHEMA)
    copies = by(suffixes, "bucket").applyInArrow(_tree, _SCHEMA)
    return (by(copies.unionByName(texts), "step")
            .applyInArrow(_kept(length, to_arrow_type(kind)),
                          f"id {kind.simpleString()}, n_words long, n_removed long, kept_text string")
            .withColumnRenamed("id", id))
