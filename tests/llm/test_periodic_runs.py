import hashlib
import random
import zlib

from fleetstream.llm import queries
from fleetstream.llm.periodic_runs import periodic_runs

from .conftest import as_multiset, frame, words


def brute_runs(w, least=6, times=4):
    """Every maximal stretch of every period; the smallest period of each."""
    found = {}
    for q in range(len(w) // times, 0, -1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found[i, j + q] = q
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(seed):
    """Texts of nested and neighbouring repeats over few words."""
    rng = random.Random(seed)
    out = []
    for k in range(60):
        w = []
        while len(w) < rng.randint(0, 200):
            unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            if rng.random() < 0.3:
                unit = unit * rng.randint(1, 5) + [rng.choice("abcd")]
            w += unit * rng.randint(1, 7)
        out.append((k, " ".join(w), "en", "s"))
    out.append((90, "a " * 3000, "en", "s"))
    out.append((91, "a " * 1000 + "b " + "a " * 999, "en", "s"))
    out.append((92, ("a b " * 40 + "c ") * 30, "en", "s"))
    return out


def check(spark, rows, **options):
    want = []
    for i, t, _, _ in rows:
        runs = brute_runs(words(t))
        want.append((i, len(words(t)), runs, collapsed(words(t), runs)))
    got = periodic_runs(frame(spark, rows), **options).collect()
    assert as_multiset((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in got) == as_multiset(want)


def test_whole(spark, rows):
    check(spark, [r for r in rows if len(r[1] or "") < 5000] + repetitive(1))


def test_tiles(spark, rows):
    """Every text in many bundles, of all octaves."""
    check(spark, [r for r in rows if len(r[1] or "") < 5000] + repetitive(2), long_bytes=0, tile=32)


def test_repeated_rows_of_a_long_text(spark):
    rows = [(1, "x y z " * 40, None, None)] * 5 + [(None, "x y z " * 40, None, None)]
    check(spark, rows, long_bytes=10, tile=16)


def test_query(spark, rows, monkeypatch):
    docs = frame(spark, rows)
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    want = []
    for i, t, _, _ in rows:
        w = words(t)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        if len(w) > 4000:
            continue  # the slow plain search
        runs = brute_runs(w)
        best = (None,) * 4
        for s, n, q in runs:
            if best[0] is None or n * best[2] > best[1] * q:
                best = (s, n, q, 1000 * n // q)
        want.append((i, len(runs), *best, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                     hashlib.sha256(collapsed(w, runs).encode()).hexdigest()))
    got = queries.op11_periodic_run_detection(spark, "")
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got, want = [tuple(r) for r in got.collect()], set(want)
    assert len(got) == len(rows) and want <= set(got)


def test_empty(no_docs):
    assert periodic_runs(no_docs).collect() == []
