from itertools import combinations

import pytest

from fleetstream.llm import jaccard, line_dedup, substring_dedup
from fleetstream.llm.components import components

from .conftest import LOWER, as_multiset, frame, words


def lines_brute(rows, m):
    """Kept text by (id, text): later copies of windows of m lines go."""
    docs = sorted({(i, t) for i, t, _, _ in rows if t is not None}, key=lambda d: (d[0] is not None, d[0] or 0))
    keys = {}
    for d in docs:
        keys.setdefault(d[0], []).append(d)
    seqs = {d: [(k, x) for k, x in enumerate(d[1].split("\n")) if x.strip(" \t\n\x0b\f\r")] for d in docs}
    return docs, keys, seqs


@pytest.mark.parametrize("m", [1, 2, 3])
def test_lines(docs, rows, m):
    # ids that repeat with another text have an order of their own (by text hash); leave them out of this check
    ids = [i for i, _ in {(i, t) for i, t, _, _ in rows}]
    unique = {i for i in ids if ids.count(i) == 1}
    _, _, seqs = lines_brute([r for r in rows if r[0] in unique], m)
    order = sorted(seqs, key=lambda d: d[0])
    first, gone = {}, {}
    for d in order:
        seq = seqs[d]
        for p in range(len(seq) - m + 1):
            w = tuple(x for _, x in seq[p:p + m])
            if w in first:
                gone.setdefault(d, set()).update(k for k, _ in seq[p:p + m])
            first.setdefault(w, (d, p))
    from pyspark.sql import functions as F
    got = line_dedup.dedup_lines(docs.filter(F.col("doc_id").isin(list(unique))), min_lines=m).collect()
    assert len(got) == sum(i in unique for i, *_ in rows)
    for r in got:
        src = next(t for i, t, _, _ in rows if i == r.doc_id)
        if src is None:
            assert r.text is None and (r.n_lines, r.n_removed) == (0, 0)
            continue
        d = (r.doc_id, src)
        drop = gone.get(d, set())
        assert r.text == "\n".join(x for k, x in enumerate(src.split("\n")) if k not in drop)
        assert (r.n_lines, r.n_removed) == (len(seqs[d]), len(drop))


def test_lines_rows_stay(docs, rows, no_docs):
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"] and got.count() == len(rows)
    assert line_dedup.dedup_lines(no_docs).collect() == []
    twice = [r for r in got.collect() if r.doc_id == rows[0][0]]
    assert twice[0].text == twice[1].text  # a repeated row is the same document


def substrings_brute(rows, n):
    first, out = set(), []
    for i, t, _, _ in rows:
        w = words(t)
        gone = set()
        for p in range(len(w) - n + 1):
            g = tuple(w[p:p + n])
            if g in first:
                gone.update(range(p, p + n))
            first.add(g)
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("n", [3, 20])
def test_substrings(spark, rows, n):
    distinct = []
    for r in rows:
        if r[0] is not None and r[0] not in [x[0] for x in distinct]:
            distinct.append(r)
    got = substring_dedup.dedup_substrings(frame(spark, distinct), length=n).collect()
    assert as_multiset(got) == as_multiset(substrings_brute(sorted(distinct, key=lambda r: r[0]), n))


def test_substrings_rows(docs, rows, no_docs):
    got = substring_dedup.dedup_substrings(docs).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 2
    assert substring_dedup.dedup_substrings(no_docs).collect() == []


def sets_of(rows, k=5):
    out = []
    for _, t, _, _ in rows:
        w = words((t or "").translate(LOWER))
        out.append(frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def jaccard_brute(rows, t, k=5):
    sets = sets_of(rows, k)
    par = list(range(len(rows)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= t * (len(sets[a]) + len(sets[b]) - both):
            par[find(a)] = find(b)
    least = {}
    for x, r in enumerate(rows):
        if r[0] is not None:
            least[find(x)] = min(least.get(find(x), r[0]), r[0])
    return [(r[0], len(sets[x]), least.get(find(x))) for x, r in enumerate(rows)]


@pytest.mark.parametrize("t,k,frequent", [(80, 5, 64), (50, 2, 2), (80, 3, 1)])
def test_jaccard(docs, rows, t, k, frequent):
    got = jaccard.similar_documents(docs, threshold=t, size=k, frequent=frequent).collect()
    assert as_multiset(got) == as_multiset(jaccard_brute(rows, t, k))


def test_jaccard_near_copies(spark):
    """A large group of near copies, chains among them, and documents of one common passage."""
    import random
    rng = random.Random(2)
    base = [f"w{x}" for x in range(120)]
    rows = []
    for i in range(150):
        w = base.copy()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(w), "en", "s"))
    for i in range(150, 220):
        rows.append((i, " ".join([*base[:40], *(f"y{i}_{x}" for x in range(rng.randint(5, 12)))]), "en", "s"))
    for frequent in (1, 64):
        got = jaccard.similar_documents(frame(spark, rows), frequent=frequent).collect()
        assert as_multiset(got) == as_multiset(jaccard_brute(rows, 80))


def test_jaccard_one_of_each(docs, rows, no_docs):
    brute = jaccard_brute(rows, 80)
    want = {(r[0], r[1]) for r, b in zip(rows, brute, strict=True) if b[2] == r[0]}
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns
    assert as_multiset((r.doc_id, r.text) for r in got.collect()) == as_multiset(want)
    assert jaccard.similar_documents(no_docs).collect() == []


def test_components(spark):
    import random
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 360)] + [(500, k) for k in range(501, 560)]
    par = {x: x for e in edges for x in e}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        par[max(x, y)] = min(x, y)
    want = {(x, find(x)) for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert as_multiset(got) == as_multiset(want)
