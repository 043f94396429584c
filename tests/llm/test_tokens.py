import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from fleetstream.llm import packing, token_counts
from fleetstream.llm.common import text_steps
from fleetstream.llm.tokens import codec, vocabulary

from .conftest import as_multiset


def library(text):
    return codec(vocabulary()).tok.encode(text or "", add_special_tokens=False).ids


def test_codec_equals_library(rows):
    c = codec(vocabulary())
    rng = np.random.default_rng(3)
    bits = ["a", "B", "é", "é", "É", "'s", "'", " ", "\n", "\t", "\u0085", " ", "\x1c", "1", "23", ".", ",", "<", "|", ">",
            "<|endoftext|>", "<|startoftext|>", "̸", "İ", "ß", "ẞ", "Σ", "日本", "😀", "ª", "µ", "ﬁ", "\x00", "​", "!!", "***"]
    texts = [r[1] for r in rows] + ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(3000)]
    for i, j, buf, off in text_steps(pa.array(texts, pa.string()), 1 << 16):
        ids, at = c.encode(buf, off)
        for k in range(j - i):
            assert ids[at[k]:at[k + 1]].tolist() == library(texts[i + k])


def test_cache_is_bounded(monkeypatch):
    from fleetstream.llm import tokens
    monkeypatch.setattr(tokens, "CACHE_WORDS", 10)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 10)
    c = tokens.WordCodec(vocabulary())
    texts = [f"word{k} other{k * 7}" for k in range(50)]
    for i, j, buf, off in text_steps(pa.array(texts), 64):
        ids, at = c.encode(buf, off)
        for k in range(j - i):
            assert ids[at[k]:at[k + 1]].tolist() == library(texts[i + k])


def test_counts(docs, rows):
    want = [(i, len((t or "").encode()), len(library(t)), len(library(t)) > 2048) for i, t, _, _ in rows]
    assert as_multiset(token_counts.token_counts(docs).collect()) == as_multiset(want)


def test_counts_resynchronise(docs, rows):
    """Short chunks and overlaps: splices in most texts, wider overlaps where no blank is near."""
    want = [(i, len(library(t))) for i, t, _, _ in rows]
    got = token_counts.token_counts(docs, chunk_bytes=300, overlap=8).select("doc_id", "n_tokens").collect()
    assert as_multiset(got) == as_multiset(want)


def test_packing(docs, rows):
    cap = 256
    got = packing.pack_documents(docs, capacity=cap, keep_ids=True).collect()
    want = []
    for i, t, _, _ in rows:
        ids = library(t) + [0]
        for k, s in enumerate(range(0, len(ids), cap)):
            raw = np.array(ids[s:s + cap], "<u4").tobytes()
            want.append((i, k, s, len(raw) // 4, zlib.crc32(raw), raw))
    assert as_multiset([(*r[:5], bytes(r.ids)) for r in got]) == as_multiset(want)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= cap
    assert len(seqs) <= math.ceil(sum(r.length for r in got) / cap) + 1


def test_rounds_are_best_fit_decreasing():
    """As many sequences as one-by-one best fit, and every rank placed once."""
    rng = np.random.default_rng(1)
    for cap in (10, 64, 500):
        sizes = rng.integers(1, cap + 1, 700)
        counts = Counter(sizes.tolist())
        bins = []
        for s in sorted(sizes.tolist(), reverse=True):
            fit = [k for k, g in enumerate(bins) if g >= s]
            if fit:
                bins[min(fit, key=lambda k: bins[k])] -= s
            else:
                bins.append(cap - s)
        plan = packing.best_fit_rounds(counts, cap)
        used = {}
        for s, n in counts.items():
            rows = plan[plan[:, 0] == s]
            for r in range(n):
                _, first, seq, each, offset = rows[np.searchsorted(rows[:, 1], r, "right") - 1]
                used.setdefault(seq + (r - first) // each, []).append((offset + (r - first) % each * s, s))
        for places in used.values():
            at = 0
            for offset, s in sorted(places):
                assert offset == at
                at += s
            assert at <= cap
        assert len(used) == len(bins)


def test_empty(no_docs):
    assert token_counts.token_counts(no_docs).collect() == []
    assert packing.pack_documents(no_docs).collect() == []


def test_unbroken_text_takes_few_rounds(spark, monkeypatch):
    """Chunks grow with their overlap: no text is encoded over and over."""
    text = "".join(f"{k:x}" for k in range(60_000))
    rounds = []
    was = token_counts.stored
    monkeypatch.setattr(token_counts, "stored", lambda df, name: (rounds.append(name), was(df, name))[1])
    docs = spark.createDataFrame([(1, text), (2, text + " " + text)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()}
    assert got == {1: len(library(text)), 2: len(library(text + " " + text))}
    assert len(rounds) <= 3
