"""Periodic run detection: maximal stretches of words that repeat with a period.

A run is a stretch of consecutive words with smallest period q (words q apart
are equal) and at least max(``least``, ``times`` * q) words that no neighbouring
word extends keeping period q.

Scale-tiled.  Periods go by octaves [2^o, 2^(o+1)).  A document is exploded
into overlapping tiles for each octave: a boundary every 2^(o+1) words, with
2^(o+1) words before it and 6 * 2^o behind it.  A run of four periods of the
octave or more holds, for some boundary c, the whole square [c, c + 2q); a tile
is solved alone by the values of its two Z-functions at the octave's periods:
how far the words from c agree with those from c + q, and the words before c
with those before c + q.  Most values are 0 at the first word.  Of the others
only those that make a square with a primitive root go on (prefix hashes, at
most two or so for each boundary); their values are then compared word by word.
Each gives a fragment of a stretch with period q, cut off at the tile's ends.
Fragments of one (document, period) that share q words or more are parts of the
same stretch and are stitched; two different maximal stretches of a period
share fewer.  With a primitive root and two periods or more, q is the smallest
period, so no run is found under two periods.

Work is O(words) for each octave, whatever the text repeats.  Documents of at
most ``long_bytes`` keep all their tiles, and the stitching, in the task that
reads them.  Longer ones send bundles of neighbouring tiles (of one octave, or
of all octaves that are small beside the bundle) to all tasks, as word numbers;
fragments are shuffled by (text, period) and stitched by a window, and a text's
runs meet the text again by its SHA-256.  Copies of a long text are solved once.

Words are runs without ASCII white space, equal if their 64-bit hashes are.
Defined cases: a null or blank text has no words, no runs and an empty
collapsed text; null and repeated ids are kept, a row for each row; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, Words, _powers, mix, parts, ship, spread, text_bytes, text_steps, word_hashes
from .quality import let, words_of

#: Entries of one step's matrices.
_BLOCK = 1 << 20
_FACTOR = [np.zeros(2, np.int64)]


def _smallest_factor(n: int) -> np.ndarray:
    """Smallest prime factor of each number up to n at least."""
    if len(_FACTOR[0]) <= n:
        size = max(n + 1, 1 << 12)
        f = np.arange(size)
        for p in range(2, int(size ** 0.5) + 1):
            if f[p] == p:
                part = f[p * p::p]
                part[part == np.arange(p * p, size, p)] = p
        _FACTOR[0] = f
    return _FACTOR[0]


def _agree(x: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray, way: int) -> np.ndarray:
    """For each pair of places the number of equal words from there on
    (way 1) or back (way -1), ``room`` at most."""
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(room > 0)
    width = 8
    while live.size:
        on = []
        for i in range(0, live.size, max(1, _BLOCK // width)):
            k = live[i:i + max(1, _BLOCK // width)]
            step = out[k][:, None] + np.arange(width)
            ok = step < room[k][:, None]
            step = np.where(ok, step, 0) * way
            same = ok & (x[a[k][:, None] + step] == x[b[k][:, None] + step])
            got = np.where(same.all(1), width, same.argmin(1))
            out[k] += got
            on.append(k[(got == width) & (out[k] < room[k])])
        live = np.concatenate(on)
        width = min(2 * width, 1 << 12)
    return out


def fragments(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, begin: np.ndarray, stop: np.ndarray,
              first: int, last: int, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, period, start, end) of what each tile of octaves ``first`` to
    ``last`` finds.  Segment k is x[lo[k]:hi[k]]; its boundaries are those from
    begin[k], before stop[k]."""
    fwd = _powers(len(x) + 1)[0]
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * fwd[:len(x)], out=sums[1:])

    def equal(a, b, n):
        return (sums[a + n] - sums[a]) * fwd[b - a] == sums[b + n] - sums[b]

    out: list[tuple] = []
    for o in range(first, last + 1):
        size, gap = 1 << o, 2 << o
        n = np.where(hi - lo >= max(least, 4 * size), (np.minimum(stop - 1, hi - 2 * size) - begin) // gap + 1, 0).clip(0)
        seg = np.repeat(np.arange(len(lo)), n)
        if not seg.size:
            continue
        c = np.repeat(begin - gap * (np.cumsum(n) - n), n) + gap * np.arange(len(seg))
        q = np.arange(size, 2 * size)
        for i in range(0, len(c), max(1, _BLOCK // size)):
            s, at = seg[i:i + max(1, _BLOCK // size)], c[i:i + max(1, _BLOCK // size)]
            end = hi[s]
            there = at[:, None] + q
            hit = (there + q <= end[:, None]) & (x[at][:, None] == x[np.minimum(there, len(x) - 1)])
            row, col = np.nonzero(hit)
            a, p, s, end = at[row], q[col], s[row], end[row]
            ok = equal(a, a + p, p)
            a, p, s, end = a[ok], p[ok], s[ok], end[ok]
            # primitive roots only: no period p / f inside the root for a prime factor f
            prime, rest = np.ones(len(p), bool), p.copy()
            factor = _smallest_factor(2 * size)
            while (more := rest > 1).any():
                f = np.where(more, factor[rest], 1)
                d = p // f
                prime &= ~(more & equal(a, a + d, p - d))
                rest //= f
            a, p, s, end = a[prime], p[prime], s[prime], end[prime]
            ahead = _agree(x, a, a + p, np.minimum(end - a - p, 4 * size), 1)
            true = ahead >= p  # else the prefix hashes were wrong
            a, p, s, ahead = a[true], p[true], s[true], ahead[true]
            back = _agree(x, a - 1, a + p - 1, np.minimum(a - lo[s], 2 * size), -1)
            out.append((s, p, a - back, a + p + ahead))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(v).astype(np.int64) for v in zip(*out, strict=True))


def stitched(seg: np.ndarray, period: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Fragments of one segment and period that share a period are one stretch."""
    order = np.lexsort((end, start, period, seg))
    seg, period, start, end = seg[order], period[order], start[order], end[order]
    if not seg.size:
        return seg, period, start, end
    new = np.r_[True, (seg[1:] != seg[:-1]) | (period[1:] != period[:-1]) | (start[1:] > end[:-1] - period[1:])]
    at = np.flatnonzero(new)  # ends don't fall within a segment and period
    return seg[at], period[at], start[at], np.maximum.reduceat(end, at)


def _octaves(words: int) -> int:
    """Last octave that a run of four periods within so many words can have (-1: none)."""
    return (words // 4).bit_length() - 1


def _runs_inside(w: Words, h: np.ndarray, least: int, times: int):
    """(row, start, length, period) of the runs of whole rows, by row, start and period."""
    lo, hi = w.first[:-1], w.first[1:]
    top = _octaves(int(w.count.max(initial=0)))
    seg, p, s, e = stitched(*fragments(h, lo, hi, lo, hi, 0, top, least))
    ok = e - s >= np.maximum(least, times * p)
    seg, p, s, n = seg[ok], p[ok], s[ok] - lo[seg[ok]], (e - s)[ok]
    order = np.lexsort((p, s, seg))
    return seg[order], s[order], n[order], p[order]


def _columns(w: Words, seg: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[pa.Array]:
    """n_words, runs, collapsed (the words but those behind each run's first period)."""
    rows = len(w.count)
    step = np.zeros(len(w.start) + 1, np.int64)
    at = w.first[seg] + start
    np.add.at(step, at + period, 1)
    np.add.at(step, at + length, -1)
    keep = np.flatnonzero(np.cumsum(step)[:-1] == 0)
    size = w.end[keep] - w.start[keep] + 1
    ends = np.cumsum(size)
    place = np.repeat(w.start[keep] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
    raw = np.append(w.buf, np.uint8(0x20))[place]
    raw[ends - 1] = 0x20
    bound = np.r_[0, ends][np.searchsorted(keep, w.first)]
    flat = raw.tobytes()
    texts = [flat[a:max(a, z - 1)].decode() for a, z in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]
    offsets = np.searchsorted(seg, np.arange(rows + 1)).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(
        [pa.array(v, pa.int64()) for v in (start, length, period)], ["start", "length", "period"]))
    return [pa.array(w.count, pa.int64()), runs, pa.array(texts, pa.string())]


_RUNS = "array<struct<start: long, length: long, period: long>>"
_NAMES = ["id", "n_words", "runs", "collapsed"]


def _solve_whole(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in text_steps(b.column(1)):
                w = Words(buf, off, NOT_SPACE)
                found = _runs_inside(w, word_hashes(w), least, times)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *_columns(w, *found)], names=_NAMES)
    return run


_BUNDLE = "key string, at long, begin int, stop int, first int, last int, body binary"


def _bundles(tile: int):
    """(key, text) -> bundles of tiles: ``tile`` words with all octaves up to a
    sixteenth of them, and for each larger octave 16 * 2^o words."""
    low = (tile // 16).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                for _, _, buf, off in text_steps(b.column(1).slice(i, 1)):
                    ids = np.unique(word_hashes(Words(buf, off, NOT_SPACE)), return_inverse=True)[1].astype(np.int32)
                    n = len(ids)
                    rows = []
                    top = _octaves(n)
                    for first, last, core in [(0, min(low, top), tile)] * (top >= 0) + [(o, o, 16 << o) for o in range(low + 1, top + 1)]:
                        for at in range(0, n, core):
                            a, z = max(0, at - (2 << last)), min(n, at + core + (6 << last))
                            if n - at >= 2 << first:
                                rows.append((a, at - a, min(at + core, n) - a, first, last, ids[a:z].tobytes()))
                    for r in rows:
                        yield pa.RecordBatch.from_arrays(
                            [b.column(0).slice(i, 1), *(pa.array([v], t) for v, t in zip(
                                r, (pa.int64(), *[pa.int32()] * 4, pa.binary()), strict=True))],
                            names=["key", "at", "begin", "stop", "first", "last", "body"])
    return run


def _solve_bundles(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, r in enumerate(b.to_pylist()):
                x = mix(np.frombuffer(r["body"], np.int32).astype(np.uint64))
                one = lambda v: np.array([v], np.int64)
                _, p, s, e = stitched(*fragments(x, one(0), one(len(x)), one(r["begin"]), one(r["stop"]), r["first"], r["last"], 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["key"]] * len(p), pa.string()), *(pa.array(v, pa.int64()) for v in (p, s + r["at"], e + r["at"]))],
                    names=["key", "period", "start", "end"])
    return run


def _runs_of_long(texts: DataFrame, tile: int, least: int, times: int) -> DataFrame:
    """(key, runs) of (key, text)."""
    n = parts(4 * text_bytes(texts), 8 << 20, spread(texts.sparkSession))
    bundles = texts.mapInArrow(_bundles(tile), _BUNDLE).repartition(n, "key", "at", "first")
    found = bundles.mapInArrow(_solve_bundles(least), "key string, period long, start long, `end` long")
    # a text has few fragments of a period: one for each bundle and stretch
    line = Window.partitionBy("key", "period").orderBy("start", "end")
    new = F.coalesce(F.col("start") > F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1)) - F.col("period"), F.lit(True))
    stretches = (found.withColumn("new", new.cast("int")).withColumn("no", F.sum("new").over(line))
                 .groupBy("key", "period", "no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
                 .filter(F.col("end") - F.col("start") >= F.greatest(F.lit(least), times * F.col("period"))))
    run = F.struct("start", (F.col("end") - F.col("start")).alias("length"), "period")
    order = F.sort_array(F.collect_list(F.struct("start", "period", run.alias("run"))))
    return stretches.groupBy("key").agg(F.transform(order, lambda s: s["run"]).alias("runs"))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, runs) -> the result's columns."""
    for b in batches:
        for i, j, buf, off in text_steps(b.column(1)):
            w = Words(buf, off, NOT_SPACE)
            runs = b.column(2).slice(i, j - i).to_pylist()
            seg = np.repeat(np.arange(j - i), [len(r or ()) for r in runs])
            flat = [np.array([x[k] for r in runs for x in r or ()], np.int64) for k in ("start", "length", "period")]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *_columns(w, seg, *flat)], names=_NAMES)


def periodic_runs(docs: DataFrame, *, id: str = "doc_id", text: str = "text", least: int = 6, times: int = 4,
                  long_bytes: int = 1 << 16, tile: int = 1 << 13) -> DataFrame:
    """id, n_words, runs (start, length, period by start, then period),
    collapsed: a row for each row of ``docs``.

    collapsed: the words, joined by one space, but for those that some run
    contains after its first period.  times: 4 or more (the tiles' geometry)."""
    if times < 4 or tile < 16:
        raise ValueError("tiles find runs of four periods or more, in bundles of 16 words or more")
    ship(docs.sparkSession)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    out = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, runs {_RUNS}, collapsed string"
    long = F.coalesce(F.octet_length("text"), F.lit(0)) > long_bytes
    small = rows.filter(~long).mapInArrow(_solve_whole(least, times), out)
    big = rows.filter(long).withColumn("key", F.sha2("text", 256))
    runs = _runs_of_long(big.select("key", "text").dropDuplicates(["key"]), tile, least, times)
    large = big.join(runs, "key", "left").select("id", "text", "runs").mapInArrow(_finish, out)
    return small.unionByName(large).withColumnRenamed("id", id)


def most_repeated(runs: Column) -> Column:
    """The run with the greatest exact length / period; the first of such."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.reduce(runs, F.try_element_at(runs, F.lit(1)), lambda a, b: F.when(more(a, b), b).otherwise(a))


def with_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with runs planted: let h be the CRC-32 of the decimal id and
    g = floor(h / 10).  Where h ends in 0 and the text has n > 0 words, word i
    from a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)),
    and words are joined by one space.  Other rows, and null ids, stay."""
    h = F.crc32(F.col(id).cast("string"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return let(F.struct(a.alias("a"), p.alias("p")), lambda v: F.array_join(F.transform(
            words, lambda x, i: F.when(i < v["a"], x).otherwise(F.get(words, v["a"] + (i - v["a"]) % v["p"]))), " "))

    changed = let(words_of(F.col(text)), lambda words: F.when(F.size(words) > 0, planted(words)).otherwise(F.col(text)))
    return docs.withColumn(text, F.when(h % 10 == 0, changed).otherwise(F.col(text)))
