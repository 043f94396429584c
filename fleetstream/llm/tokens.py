"""Token ids of texts by a ``tokenizers`` file, with words encoded once per task.

For a vocabulary whose normaliser and splitter never join two sides of white
space (as in word_bpe_49k.json: NFC, white space to one blank, lower case;
pieces hold no white space), a text's ids are the ids of its white-space
separated words, one after the other.  ``WordCodec`` keeps the ids of the
words that it has seen, in tables of bounded size.  A word made of Latin-1
letters, with ASCII marks behind it, goes straight to the merge model; any
other word goes through the library's whole ``encode``.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from .common import NOT_SPACE, Words, env_once, word_hashes

#: Words kept at most; the tables are emptied when they get there.
CACHE_WORDS = 1_500_000
CACHE_PIECES = 200_000
#: Text bytes that are encoded at a time.
STEP = 2 << 20

_MARKS = ".,!?;:*#$%&"
_LATIN = re.compile("[A-Za-z\u00aa-\u00ff]+")


def _byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies:
    printable Latin-1 bytes themselves, the others 256, 257, ... in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, k = [], 256
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(k))
            k += 1
    return out


class WordCodec:
    """Token ids of many texts at once; one object for each Python worker.

    A known word is found by its 64-bit hash in sorted arrays (place of its
    ids in a pool, number of ids); only new words are encoded one by one.
    """

    def __init__(self, path: str):
        env_once()
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.symbols = _byte_symbols()
        self._empty()

    def _empty(self) -> None:
        self.bare: dict[str, bytes] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.known, self.fresh = none, none

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def _piece(self, word: str) -> bytes:
        got = self.bare.get(word)
        if got is None:
            if word.isalpha():
                raw = word if word.isascii() else "".join(self.symbols[b] for b in word.encode())
                got = array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()
            else:
                got = self.whole(word).tobytes()
            self.bare[word] = got
        return got

    def word(self, raw: bytes) -> bytes:
        """Ids of one word without ASCII white space, as unsigned 32-bit values."""
        word = raw.decode("utf-8", "replace")
        bare = word.rstrip(_MARKS)
        if bare.isalpha() and (bare.isascii() or _LATIN.fullmatch(bare)):
            got = self._piece(bare.lower())
            return got + self._piece(word[len(bare):]) if len(bare) < len(word) else got
        return self.whole(word).tobytes()

    @staticmethod
    def _find(t: tuple, h: np.ndarray) -> np.ndarray:
        """Index of each hash in the sorted table, or -1."""
        if not len(t[0]):
            return np.full(len(h), -1)
        at = np.searchsorted(t[0], h)
        at[at == len(t[0])] = 0
        at[t[0][at] != h] = -1
        return at

    def _learn(self, w: Words, hashes: np.ndarray, which: np.ndarray) -> None:
        ids = [self.word(w.buf[s:e].tobytes()) for s, e in zip(w.start[which], w.end[which], strict=True)]
        n = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.used], np.zeros(self.used + 2 * len(flat), np.uint32)])
        self.pool[self.used:self.used + len(flat)] = flat
        at = self.used + np.cumsum(n, dtype=np.int64) - n
        self.used += len(flat)
        self.fresh = _merged(self.fresh, (hashes, at, n))
        if len(self.fresh[0]) * 4 > len(self.known[0]):
            self.known = _merged(self.known, self.fresh)
            self.fresh = tuple(x[:0] for x in self.fresh)

    def places(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place in the pool, number of ids) of each word."""
        if len(self.known[0]) + len(self.fresh[0]) > CACHE_WORDS:
            self._empty()
        if len(self.bare) > CACHE_PIECES:
            self.bare = {}
        h, first, back = np.unique(word_hashes(w), return_index=True, return_inverse=True)
        a, b = self._find(self.known, h), self._find(self.fresh, h)
        new = np.flatnonzero((a < 0) & (b < 0))
        if len(new):
            self._learn(w, h[new], first[new])
            a, b = self._find(self.known, h), self._find(self.fresh, h)
        place, n = np.zeros(len(h), np.int64), np.zeros(len(h), np.int32)
        for at, t in ((a, self.known), (b, self.fresh)):
            got = at >= 0
            place[got], n[got] = t[1][at[got]], t[2][at[got]]
        return place[back], n[back]

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one row after the other, and the rows' offsets in them."""
        w = Words(buf, offsets, NOT_SPACE)
        place, n = self.places(w)
        ends = np.cumsum(n, dtype=np.int64)
        ids = self.pool[np.repeat(place - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.r_[0, ends][w.first]

    def counts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each row."""
        w = Words(buf, offsets, NOT_SPACE)
        return np.diff(np.r_[0, np.cumsum(self.places(w)[1], dtype=np.int64)][w.first])


def _merged(a: tuple, b: tuple) -> tuple:
    h = np.concatenate([a[0], b[0]])
    order = np.argsort(h, kind="stable")  # two sorted runs: one merge
    return h[order], np.concatenate([a[1], b[1]])[order], np.concatenate([a[2], b[2]])[order]


_CODECS: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    """One codec for each file in this Python worker."""
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]


def vocabulary(path: str | None = None) -> str:
    """``path``, or the public 49k word vocabulary where it is installed."""
    if path:
        return path
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")
