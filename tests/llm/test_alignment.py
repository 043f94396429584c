import hashlib
from collections import Counter, defaultdict

from fleetstream.llm import alignment
from fleetstream.llm.alignment import Tokens, align_documents, aligned_texts

from .conftest import as_multiset, frame


def plain(rows):
    """Groups, links and counts of all rows, from the libraries' own tokens."""
    import public_tokenizers as P
    one = Tokens(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    symbol = {c: bytes([i]) for i, c in enumerate(alignment._byte_symbols())}
    docs, found = [], defaultdict(int)
    for i, t, _, _ in rows:
        groups, links = [], Counter()
        a = one.a.encode(" " + (t or ""), add_special_tokens=False).ids if t else []
        b = one.b.encode(t) if t else []
        pa_ = [b"".join(symbol[c] for c in one.a.id_to_token(x)) for x in a]
        pb = [bytes([int(p[3:5], 16)]) if one.b.is_byte(x) else p.replace("▁", " ").encode()
              for x, p in zip(b, one.b.id_to_piece(b), strict=True)] if b else []
        if not t or not b"".join(pa_) == b"".join(pb) == b" " + t.encode():
            a = b = []
        ends = [set(), set()]
        for k, pieces in enumerate((pa_ if a else [], pb if b else [])):
            at = 0
            for p in pieces:
                at += len(p)
                ends[k].add(at)
        for cut in sorted(ends[0] & ends[1]):
            groups.append(([], []))
            for k, (ids, pieces) in enumerate(((a, pa_), (b, pb))):
                at = 0
                for x, p in zip(ids, pieces, strict=True):
                    at += len(p)
                    if (groups_end(groups, k, at, cut, ends)):
                        groups[-1][k].append(x)
        for ga, gb in groups:
            for x in ga:
                for y in gb:
                    links[x, y] += 1
        for pair in links:
            found[pair] += 1
        docs.append((i, len(a), len(b), groups, links))
    top = defaultdict(int)
    for (x, _), n in found.items():
        top[x] = max(top[x], n)
    out = []
    for i, n_a, n_b, groups, links in docs:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((i, n_a, n_b, len(groups), sum(links.values()),
                    sum(n for p, n in links.items() if found[p] == top[p[0]]), sum(n * found[p] for p, n in links.items()),
                    hashlib.sha256(text.encode()).hexdigest() if n_a else ""))
    return out, {(*p, n, n == top[p[0]]) for p, n in found.items()}


def groups_end(groups, k, at, cut, ends):
    """Does a token that ends at ``at`` belong to the group that ends at ``cut``?"""
    before = max((e for e in ends[0] & ends[1] if e < cut), default=0)
    return before < at <= cut


ODD = ["<|endoftext|> </s> <s>", "▁ mark", " two  blanks \t tab\n\nlines ", "日本語 text", "😀😀 emoji", "é combined", "\x00 nul",
       "a" * 300, "don't  stop", "1234567890", " nbsp", "x", " ", "\n", "<0x41>", "ﬁne ligature"]


def test_equals_plain(spark, rows):
    some = [(i, t if t is None else t[:300], x, s) for i, t, x, s in rows] + [(900 + k, t, None, None) for k, t in enumerate(ODD)]
    want, pairs = plain(some)
    got, table = align_documents(frame(spark, some))
    assert as_multiset(got.collect()) == as_multiset(want)
    assert {(r.a, r.b, r.n_docs, r.best) for r in table.collect()} == pairs


def test_streams_equal_libraries(rows, monkeypatch):
    """Full token streams, also with a memo that is emptied again and again, and without one."""
    import numpy as np
    import public_tokenizers as P
    monkeypatch.setattr(alignment, "MEMO_SEGMENTS", 50)
    one = Tokens(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    assert one.cuts and one.ranks
    rng = np.random.default_rng(4)
    bits = ["a", "B", "é", "e\u0301", "'s", " ", " ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\u2581", "1", "23", ".", ",", "ß", "日本",
            "😀", "\x00", "\u200b", "!!", "word", " the", "ﬁ", "\u0301", "<s>", "Ω", "ж", "\u0085"]
    texts = [r[1] for r in rows if r[1]] + ["".join(rng.choice(bits, rng.integers(1, 14))) for _ in range(3000)]
    want = one.encode(texts)
    for cuts in (True, False):
        one.cuts = cuts
        for i in range(0, len(texts), 100):
            raw = [b" " + t.encode() for t in texts[i:i + 100]]
            got = one.streams(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
            for (ids, at), lib in zip(got, want, strict=True):
                for k in range(len(raw)):
                    assert ids[at[k]:at[k + 1]].tolist() == lib[i + k]


def test_rows_alone_and_together(rows):
    import public_tokenizers as P
    one = Tokens(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    texts = [r[1] for r in rows]
    counts, groups, row, pair, occ = aligned_texts(one, texts)
    for k, t in enumerate(texts):
        c, g, _, p, n = aligned_texts(one, [t])
        assert c[0].tolist() == counts[k].tolist() and g[0] == groups[k]
        assert p.tolist() == pair[row == k].tolist() and n.tolist() == occ[row == k].tolist()
    assert sum(bool(g) for g in groups) > 80


def test_groups_are_kept(spark):
    got = align_documents(frame(spark, [(1, "some plain words", None, None)]), keep_groups=True)[0].collect()[0]
    assert hashlib.sha256(got.groups.encode()).hexdigest() == got.groups_sha256 and got.groups.count(";") == got.n_groups - 1


def test_empty(no_docs):
    got, table = align_documents(no_docs)
    assert got.collect() == [] and table.collect() == []
