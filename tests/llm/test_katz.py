import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetstream.llm import katz, queries
from fleetstream.llm.katz import good_turing, score_documents

from .conftest import LOWER, frame, words


class Plain:
    """Katz backoff in dictionaries."""

    def __init__(self, texts, order, cutoff):
        self.order = order
        self.counts = [Counter() for _ in range(order)]
        for t in texts:
            for j in range(1, order + 1):
                self.counts[j - 1].update(self.grams(t, j))
        self.texts = len(texts)
        self.n = sum(self.counts[0].values())
        self.gt = []
        for c in self.counts:
            of = Counter(c.values())
            self.gt.append(good_turing([of[r] for r in range(1, cutoff + 2)]))
        self.followers = [{} for _ in range(order)]
        for j in range(2, order + 1):
            for g in self.counts[j - 1]:
                self.followers[j - 1].setdefault(g[:-1], []).append(g[-1])

    @staticmethod
    def tokens(t):
        return [*words((t or "").translate(LOWER)), "</end>"]

    def grams(self, t, j):
        tok = ["<start>"] * (j - 1) + self.tokens(t)
        return [tuple(tok[i:i + j]) for i in range(len(tok) - j + 1)]

    def of(self, h):
        """Count of a history."""
        return self.texts if set(h) == {"<start>"} else self.counts[len(h) - 1][h]

    def star(self, j, r):
        low, off = self.gt[j - 1]
        return low[r - 1] if r <= len(low) else r - off

    def p(self, h, w):
        j = len(h) + 1
        if j == 1:
            c = self.counts[0]
            if c[w,]:
                return self.star(1, c[w,]) / self.n
            return 1 - sum(self.star(1, r) for r in c.values()) / self.n if self.n else 1.0
        c, n = self.counts[j - 1][*h, w], self.of(h)
        if c:
            return self.star(j, c) / n
        return self.weight(h) * self.p(h[1:], w) if n else self.p(h[1:], w)

    def weight(self, h):
        j, seen = len(h) + 1, self.followers[len(h)][h]
        return (1 - sum(self.star(j, self.counts[j - 1][*h, w]) for w in seen) / self.of(h)) / (1 - sum(self.p(h[1:], w) for w in seen))

    def score(self, t):
        return sum(math.log10(self.p(g[:-1], g[-1])) for g in self.grams(t, self.order))


def small(rows):
    return [r for r in rows if len(r[1] or "") < 3000]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_plain(spark, rows, order, monkeypatch):
    some = small(rows)
    model = Plain([t for i, t, _, _ in some if not held(i)], order, 5)
    want = sorted((repr(i), held(i), len(model.tokens(t)), sum(model.counts[0][w,] > 0 for w in model.tokens(t)), model.n,
                   sum(math.log10((model.counts[0][w,] + 0.5) / (model.n + 0.5 * (len(model.counts[0]) + 1))) for w in model.tokens(t)),
                   model.score(t)) for i, t, _, _ in some)
    got = score_documents(frame(spark, some), F.crc32(F.col("doc_id").cast("string")) % 5 == 1, order=order)
    got_rows = sorted((repr(r[0]), *r[1:]) for r in got.scores.collect())
    assert [r[:5] for r in got_rows] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got_rows], [r[5:] for r in want], rtol=1e-9)
    counts = Counter((r.order, r.value) for r in got.counts.collect())
    assert counts == Counter((j, n) for j, c in enumerate(model.counts, 1) for n in c.values())
    weights = sorted(r.value for r in got.weights.filter(f"order = {order}").collect())
    if order > 1:
        assert np.allclose(weights, sorted(model.weight(h) for h in model.followers[order - 1]), rtol=1e-7)


def test_plain_model_is_a_distribution(rows):
    model = Plain([t for _, t, _, _ in small(rows)], 3, 5)
    vocabulary = [w for w, in model.counts[0]] + ["never seen"]
    rng = np.random.default_rng(2)
    histories = [g[:-1] for g in model.counts[2]]
    for k in rng.integers(0, len(histories), 5):
        assert math.isclose(sum(model.p(histories[k], w) for w in vocabulary), 1, rel_tol=1e-9)
    assert math.isclose(sum(model.p(("nobody", "knows"), w) for w in vocabulary), 1, rel_tol=1e-9)


def test_many_steps(spark, rows, monkeypatch):
    """The same scores however the rows are dealt (the sums' last bits aside)."""
    some = small(rows)
    docs = frame(spark, some)
    cond = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    one = sorted((repr(r.doc_id), r.score) for r in score_documents(docs.coalesce(1), cond).scores.collect())
    many = sorted((repr(r.doc_id), r.score) for r in score_documents(docs.repartition(40), cond).scores.collect())
    assert [r[0] for r in one] == [r[0] for r in many] and np.allclose([r[1] for r in one], [r[1] for r in many], rtol=1e-12)


def test_discounts():
    assert good_turing([100, 30, 15, 9, 6, 4]).low == (0.6, 1.5, 2.4, 10 / 3, 4.0)
    assert good_turing([100, 60, 15]).low == ()  # no mass taken off: 2 * 60 / 100 > 1
    assert good_turing([0, 0]) == ((), 0.5)


def test_query(spark, rows, monkeypatch):
    docs = frame(spark, rows)
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = queries.op12_katz_backoff_scoring(spark, "")
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = got.collect()
    assert len(got) == len(rows) and all(r.score < 0 and r.held_out == held(r.doc_id) for r in got)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_nothing_to_learn_from(spark, no_docs):
    assert score_documents(no_docs, F.lit(False)).scores.collect() == []
    got = score_documents(frame(spark, [(1, "a b", None, None), (2, None, None, None)]), F.lit(True)).scores.collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [
        (1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert katz.Discount((), 0.5).taken(np.array([1, 9])).tolist() == [0.5, 0.5]
