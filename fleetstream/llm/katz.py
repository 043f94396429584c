"""Language-model scoring: Katz backoff over Good-Turing discounted n-grams.

Tokens of a text are its words, A-Z lower-cased, then one end.  The history of a
token is the tokens before it in its text, behind a start; words that training
has not seen are one outcome, so each order is a distribution over V + 1 outcomes.

Counts r <= ``cutoff`` are discounted to r* = (r + 1) n[r + 1] / n[r], where n[r]
is how many n-grams of the order occur r times in training, as far as all of
0 < r* < r hold; above, the last discount r - r* goes on (Katz leaves such counts
alone; then a history whose n-grams are all frequent would leave nothing for
others).  Where not even r = 1 can be estimated, 1/2 is taken off.  Then
P(w | h) = r*(h w) / r(h) for a seen n-gram, else a(h) P(w | h'), with h' the
history less its first token, and a = 1 for a history never seen.  The backoff
weight a(h) = (sum of (r - r*) / r(h)) / (1 - sum of P(w | h')), both over the
words seen behind h, normalises exactly.  The first order gives the outcome of
unseen words what its discounts leave.

Two exchanges between steps (some megabytes of text) and buckets (ranges of
n-gram keys), see ``steps``:

1. Each step sends its distinct n-grams of all orders with their training
   counts; buckets add them up, store them as the counts table, count counts
   (summed by Spark, a few numbers reach the driver) and answer each step, with a
   mark on the n-grams that the step is to account for (its first holder is).
2. Each step scores its tokens up to their weights and sends, by history, the
   sums of both parts of a(h) over the n-grams it accounts for, and the histories
   whose weight it needs; buckets divide, store the weights table and answer.

A frequent n-gram is one entry a step.  An n-gram is known by a 64-bit hash of
its words.  Texts are read twice; a step whose n-grams have changed between
fails (write an input that isn't stable to Parquet first).

Defined cases: a null or blank text is its end alone; a null id counts as
training; null and repeated ids are kept, a row for each row, each trained on;
extra columns are ignored; without training text every token is the one
outcome of probability 1; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _Q, NOT_SPACE, Words, mix, parts, ship, spread, stored, text_bytes, text_steps, word_hashes
from .steps import SCHEMA, apply_by, batch, bucket_cuts, bundle, deltas, packed, squeezed, unbundle, undeltas, unpacked, unsqueezed

#: Text bytes of a step.
STEP = 4 << 20
#: Kinds of rows; the order of the n-grams is added to each of the first five.
COUNTS, ANSWERS, TABLE, SUMS, WEIGHTS = 100, 200, 300, 400, 500
STATS, TEXTS, STATE = 1, 2, 3

_END = np.uint64(0x5851F42D4C957F2D)


def _start(order: int) -> np.uint64:
    """Key of the history of a text's first token, for n-grams of an order."""
    return np.uint64(0x14057B7EF767814F + 2 * order)


class Grams:
    """Tokens of a step and the key and history key of the n-gram that ends at each."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, order: int):
        w = Words(buf, offsets, NOT_SPACE)
        self.n = w.count + 1
        self.stop = np.cumsum(self.n)
        tok = np.full(int(self.stop[-1]), _END)
        tok[np.arange(len(w.start)) + w.row] = word_hashes(w, lower=True)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.begin = self.stop - self.n
        self.key, self.history = [mix(tok)], [np.zeros(0, np.uint64)]
        for j in range(2, order + 1):
            h = np.r_[np.uint64(0), self.key[-1][:-1]]
            h[self.begin] = _start(j)
            self.history.append(h)
            self.key.append(mix(h * _Q + tok))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, np.ndarray, np.ndarray]]:
    k = 0
    for b in batches:
        for i, j, buf, off in text_steps(b.column(3), STEP):
            yield (b.column(0)[i].as_py() << 31) + k, pa.table([c.slice(i, j - i) for c in b.columns[1:]], ["id", "held", "text"]), buf, off
            k += 1


def _send_counts(order: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step, t, buf, off in _steps(batches):
            g = Grams(buf, off, order)
            train = ~t.column("held").to_numpy()[g.row]
            rows = []
            for j, key in enumerate(g.key, 1):
                u, back = np.unique(key, return_inverse=True)
                n = np.bincount(back, train, len(u)).astype(np.int64)
                cut = bucket_cuts(u, buckets)
                rows += [(k, step, COUNTS + j, bundle(deltas(u[a:z]), squeezed(n[a:z])))
                         for k, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < z]
            yield batch(rows)
    return run


def _send_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for step, t, _, _ in _steps(batches):
        yield batch([(0, step, TEXTS, packed(t))])


def _joined(got: list[tuple[int, int, bytes]], values: int) -> tuple:
    """Entries of one bucket in the order of their keys, and of their steps:
    (order of entries, step row of each entry, first entry of each key, values...)."""
    split = [unbundle(b) for _, _, b in got]
    keys = [undeltas(p[0]) for p in split]
    src = np.repeat(np.arange(len(got)), [len(k) for k in keys])
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    more = [np.concatenate([unsqueezed(p[1 + v], np.float64 if values > 1 else np.int64) for p in split])[order] for v in range(values)]
    return order, src, key[first], first, split, more


def _add_up(order: int, cutoff: int):
    """One bucket: totals for the steps, the counts table, counts of counts."""
    def run(rows: dict) -> Iterator[tuple]:
        (bucket,) = {b for got in rows.values() for _, b, _ in got}
        stats = np.zeros((order, cutoff + 4), np.int64)
        for j in range(1, order + 1):
            if not (got := rows.get(COUNTS + j)):
                continue
            place, src, key, first, _, (n,) = _joined(got, 1)
            total = np.add.reduceat(n, first)
            size = np.diff(np.r_[first, len(n)])
            answer, mine = np.empty(len(n), np.int64), np.zeros(len(n), bool)
            answer[place], mine[place[first]] = np.repeat(total, size), True
            cut = np.searchsorted(src, np.arange(len(got) + 1))
            for k, (step, _, _) in enumerate(got):
                a, z = cut[k], cut[k + 1]
                yield bucket, step, ANSWERS + j, bundle(squeezed(answer[a:z]), np.packbits(mine[a:z]).tobytes())
            seen = total > 0
            yield bucket, -1, TABLE + j, bundle(deltas(key[seen]), squeezed(total[seen]))
            stats[j - 1, 0], stats[j - 1, 1] = total.sum(), seen.sum()
            stats[j - 1, 2:-1] = np.bincount(total[total <= cutoff + 1], minlength=cutoff + 2)[1:]
            if j == 1:
                stats[0, -1] = total[key == mix(np.array([_END]))[0]].sum()
        yield bucket, -1, STATS, stats.tobytes()
    return run


class Discount(NamedTuple):
    """r* of the counts 1 to len(low), and what is taken off above."""
    low: tuple[float, ...]
    off: float

    def taken(self, r: np.ndarray) -> np.ndarray:
        """r - r* of positive counts."""
        out = np.full(len(r), self.off)
        for k, star in enumerate(self.low, 1):
            out[r == k] = k - star
        return out


def good_turing(n: list[int]) -> Discount:
    """From n[0], n[1], ...: how many n-grams occur once, twice, ..."""
    low: list[float] = []
    for r in range(1, len(n)):
        if not n[r - 1] or not 0 < (star := (r + 1) * n[r] / n[r - 1]) < r:
            break
        low.append(star)
    return Discount(tuple(low), len(low) - low[-1] if low else 0.5)


class Totals(NamedTuple):
    """Training tokens, distinct ones, texts; the discount of each order; the
    probability of the outcome of unseen words."""
    tokens: int
    distinct: int
    texts: int
    discounts: tuple[Discount, ...]
    unseen: float


def _totals(stats: np.ndarray) -> Totals:
    gt = tuple(good_turing(s[2:-1].tolist()) for s in stats)
    n, v, texts = int(stats[0, 0]), int(stats[0, 1]), int(stats[0, -1])
    counts = stats[0, 2:2 + len(gt[0].low)]
    taken = sum(c * (r - star) for r, (c, star) in enumerate(zip(counts.tolist(), gt[0].low, strict=True), 1))
    taken += (v - int(counts.sum())) * gt[0].off
    return Totals(n, v, texts, gt, taken / n if n else 1.0)


def _score(order: int, buckets: int, total: Totals):
    """One step: its texts' scores but for the weights; sums for the weights of histories."""
    def run(rows: dict) -> Iterator[tuple]:
        (step, _, body), = rows[TEXTS]
        t = unpacked(body)
        _, _, buf, off = next(text_steps(t.column("text").combine_chunks(), 1 << 62))
        g = Grams(buf, off, order)
        size = len(g.row)
        counts, seen, prob = [], [], np.full(size, total.unseen)
        level = np.zeros(size, np.int64)  # the longest n-gram that training has seen
        before: np.ndarray | None = None  # probability one order below
        needs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for j in range(1, order + 1):
            u, place, back = np.unique(g.key[j - 1], return_index=True, return_inverse=True)
            parts_ = [unbundle(b) for _, _, b in rows.get(ANSWERS + j, [])]
            c_u = np.concatenate([unsqueezed(p[0]) for p in parts_])
            if len(c_u) != len(u):
                raise RuntimeError("the input's partitions changed between two reads; write it to Parquet first")
            mine = np.concatenate([np.unpackbits(np.frombuffer(p[1], np.uint8), count=len(unsqueezed(p[0]))) for p in parts_]).astype(bool)
            c = c_u[back]
            if j == 1:
                base = np.log10((c + 0.5) / (total.tokens + 0.5 * (total.distinct + 1)))
                known = c > 0
                over = np.full(size, max(1, total.tokens))
            else:
                over = np.r_[0, counts[-1][:-1]]  # a history ends one token before, in the same text
                over[g.begin] = total.texts
            hit = c > 0
            p = np.zeros(size)
            gone = total.discounts[j - 1].taken(c[hit]) / over[hit]
            p[hit] = c[hit] / over[hit] - gone
            if j > 1:
                h = g.history[j - 1]
                own = place[mine & (c_u > 0)]
                left = np.zeros(size)
                left[hit] = gone
                keys, at = np.unique(h[own], return_inverse=True)
                sums = [np.bincount(at, left[own], len(keys)), np.bincount(at, before[own], len(keys))]
                want = np.flatnonzero(~hit & (over > 0))
                ask, ask_at = np.unique(h[want], return_inverse=True)
                needs.append((ask, ask_at, g.row[want]))
                every = np.union1d(keys, ask)
                full = [np.zeros(len(every)), np.zeros(len(every))]
                for f, s in zip(full, sums, strict=True):
                    f[np.searchsorted(every, keys)] = s
                asked = np.isin(every, ask, assume_unique=True)
                cut = bucket_cuts(every, buckets)
                for k, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if a < z:
                        yield k, step, SUMS + j, bundle(deltas(every[a:z]), squeezed(full[0][a:z]), squeezed(full[1][a:z]),
                                                        np.packbits(asked[a:z]).tobytes())
            prob[hit], level[hit] = p[hit], j
            counts.append(c)
            before = p
        docs = len(g.n)
        state = {"id": t.column("id"), "held_out": t.column("held"), "n_tokens": pa.array(g.n, pa.int64()),
                 "n_known": pa.array(np.bincount(g.row, known, docs).astype(np.int64)),
                 "base": pa.array(np.bincount(g.row, base, docs)), "score": pa.array(np.bincount(g.row, np.log10(prob), docs))}
        for j, (_, at, row) in enumerate(needs, 2):
            ends = np.searchsorted(row, np.arange(docs + 1)).astype(np.int32)
            state[f"need{j}"] = pa.ListArray.from_arrays(ends, pa.array(at, pa.int32()))
        yield 0, step, STATE, packed(pa.table(state))
    return run


def _divide(order: int):
    """One bucket: the weights table, and to each step the weights it asked for."""
    def run(rows: dict) -> Iterator[tuple]:
        (bucket,) = {b for got in rows.values() for _, b, _ in got}
        for j in range(2, order + 1):
            if not (got := rows.get(SUMS + j)):
                continue
            place, src, key, first, split, (left, lower) = _joined(got, 2)
            left, lower = np.add.reduceat(left, first), np.add.reduceat(lower, first)
            weight = left / np.maximum(1 - lower, 1e-300)
            answer = np.empty(len(place))
            answer[place] = np.repeat(weight, np.diff(np.r_[first, len(place)]))
            cut = np.searchsorted(src, np.arange(len(got) + 1))
            for k, (step, _, _) in enumerate(got):
                a, z = cut[k], cut[k + 1]
                asked = np.unpackbits(np.frombuffer(split[k][3], np.uint8), count=int(z - a)).astype(bool)
                if asked.any():
                    yield bucket, step, WEIGHTS + j, squeezed(answer[a:z][asked])
            yield bucket, -1, TABLE + j, bundle(deltas(key), squeezed(weight))
    return run


_RESULT = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def _finish(order: int, tokens: int):
    """One step: weights on the tokens that backed off."""
    def run(rows: dict) -> pa.Table:
        (_, _, body), = rows[STATE]
        t = unpacked(body)
        score = t.column("score").to_numpy().copy()
        for j in range(2, order + 1):
            lists = t.column(f"need{j}").combine_chunks()
            if got := rows.get(WEIGHTS + j):
                w = np.log10(np.concatenate([unsqueezed(b, np.float64) for _, _, b in got]))
                row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                score += np.bincount(row, w[lists.values.to_numpy()], len(lists))
        return pa.table([t.column("id"), t.column("held_out"), t.column("n_tokens"), t.column("n_known"),
                         pa.array(np.full(len(score), tokens)), t.column("base"), pa.array(score)], names=_RESULT)
    return run


def _entries(dtype):
    """Rows (order, key, value) of stored table bodies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                key, value = unbundle(body)
                key, value = undeltas(key).view(np.int64), unsqueezed(value, dtype)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind - TABLE, np.int32)), pa.array(key), pa.array(value)],
                                                 names=["order", "key", "value"])
    return run


class Scored(NamedTuple):
    """scores: a row for each document; counts: (order, key, value) of training's
    n-grams; weights: (order, key of the history, value); totals."""
    scores: DataFrame
    counts: DataFrame
    weights: DataFrame
    totals: Totals


def score_documents(docs: DataFrame, held_out: Column, *, order: int = 2, cutoff: int = 5, id: str = "doc_id",
                    text: str = "text") -> Scored:
    """Scores of all rows by n-grams of up to ``order`` words of those that
    ``held_out`` doesn't hold for (null: it doesn't).

    scores: id, held_out, n_tokens, n_known (seen in training), train_tokens,
    base_score (unigrams with 1/2 added), score (log10)."""
    spark = docs.sparkSession
    ship(spark)
    if not 1 <= order < 100 or cutoff < 1:
        raise ValueError("order from 1 to 99, cutoff from 1")
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.spark_partition_id().alias("part"), F.col(id).alias("id"),
                       F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))
    groups = parts(text_bytes(docs, text), 4 * STEP, spread(spark))

    added = apply_by(rows.mapInArrow(_send_counts(order, groups), SCHEMA), "bucket", groups, _add_up(order, cutoff))
    added = stored(added, "katz-counts")
    numbers = added.filter(f"kind = {STATS}").select("body").mapInArrow(_numbers, "i int, n long").groupBy("i").sum("n").collect()
    stats = np.zeros((order, cutoff + 4), np.int64)
    for i, n in numbers:
        stats.flat[i] = n
    total = _totals(stats)

    answers = added.filter(F.col("kind").between(ANSWERS, ANSWERS + 99))
    scored = stored(apply_by(answers.unionByName(rows.mapInArrow(_send_texts, SCHEMA)), "step", groups, _score(order, groups, total)),
                    "katz-sums")
    weights = stored(apply_by(scored.filter(F.col("kind").between(SUMS, SUMS + 99)), "bucket", groups, _divide(order)), "katz-weights")
    last = weights.filter(F.col("kind").between(WEIGHTS, WEIGHTS + 99)).unionByName(scored.filter(f"kind = {STATE}"))
    out = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scores = apply_by(last, "step", groups, _finish(order, total.tokens), out).withColumnRenamed("id", id)

    def entries(df: DataFrame, dtype, name: str) -> DataFrame:
        return (df.filter(F.col("kind").between(TABLE, TABLE + 99)).select("kind", "body")
                .mapInArrow(_entries(dtype), f"order int, key long, value {name}"))
    return Scored(scores, entries(added, np.int64, "long"), entries(weights, np.float64, "double"), total)


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            n = np.sum([np.frombuffer(x, np.int64) for x in b.column(0).to_pylist()], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], names=["i", "n"])
