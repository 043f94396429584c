"""Cross-tokenizer alignment: groups of tokens of two vocabularies that cover
the same bytes, and how often two token ids are linked in the corpus.

Each text is tokenised whole by both libraries: a byte-level BPE (A) of a blank
and the text, and a sentence-piece BPE (B) of the text, which adds that blank
itself.  A text counts only when the joined bytes of A's tokens, and those of
B's, are a blank and the text.  Byte places where a token of A and one of B both
end cut the tokens into groups; every A token of a group is linked with every B
token of it.

Whitespace-token anchors.  A shared end before which nothing is left open, and
behind which both token streams go on with a token marked by a blank, is an
anchor.  Anchors cut a text into windows of ids (about a word each) that can be
aligned alone.  The alignment of a window depends on its ids only, so windows of
a step are told apart by their id tuples (a 64-bit hash of both), each distinct
one is aligned once, and the others take over its groups and links.  The full
token streams are memoised, too, by segments that no token can cross.

Corpus counts.  Each step of input (some megabytes of text) leaves one row: its
documents with their links as (place in the step's pair list, occurrences), and
the pair list with the number of its documents that hold each pair.  Pair lists
are exploded and summed by pair, the highest count of each A id is taken from
the sums, and each step gets the counts of its own list back by a join, one row
for each pair and step, so a pair of all documents is one entry a step.  Steps
meet their counts by a join on the step; nothing is broadcast or collected.

Defined cases: a null or empty text, and one whose bytes a vocabulary changes,
has no tokens: zeros and an empty ``groups_sha256``; null and repeated ids are
kept, a row for each row, each counted as a document; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, _powers, env_once, mix, ship, stored, text_steps, word_hashes
from .steps import packed, unpacked
from .tokens import _byte_symbols, _merged

#: Segments whose ids a worker keeps, and their ids; the tables are emptied when they get there.
MEMO_SEGMENTS = 800_000
MEMO_IDS = 12_000_000
#: Text bytes of a step.
STEP = 4 << 20
# Fixed value: how byte-level vocabularies split a text into words.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Text bytes that are tokenised at a time.
ENCODE = 1 << 20


class Vocabulary:
    """Bytes of each token id, and its decimal digits, as buffers with offsets."""

    def __init__(self, pieces: list[bytes]):
        self.flat, self.at, self.size = _pool(pieces)
        self.spaced = np.array([p[:1] == b" " for p in pieces])
        self.digits = _pool([b"%d," % i for i in range(len(pieces))])

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return _gathered(self.flat, self.at[ids], self.size[ids])


def _pool(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in items], np.int64)
    return np.frombuffer(b"".join(items), np.uint8), np.cumsum(size) - size, size


def _places(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... (n[0] of them), at[1], ..."""
    ends = np.cumsum(n)
    return np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def _gathered(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    return flat[_places(at, n)]


# where a blank may begin a segment: behind and before one of these
_BEFORE = np.zeros(256, bool)
_BEFORE[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)  # two-byte letters: Latin and on, no blanks, no combining marks
_LEAD[0xC3:0xCC] = _LEAD[0xD0:0xE0] = True


class Tokens:
    """Full token streams of texts by both libraries, one object a worker.

    Neither vocabulary joins a character with a blank behind it, so a stream is
    that of its segments: cuts are made before a single blank between letters,
    digits or marks.  Segments are looked up by a 64-bit hash, new ones encoded.
    Files for which that doesn't hold are given whole texts (``cuts``)."""

    def __init__(self, bytes_path: str, pieces_path: str):
        env_once()
        import json

        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(bytes_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        symbol = {c: i for i, c in enumerate(_byte_symbols())}
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.va = Vocabulary([bytes(symbol[c] for c in t) if all(c in symbol for c in t) else t.encode() for t in names])
        pieces = self.b.id_to_piece(list(range(self.b.get_piece_size())))
        self.vb = Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode()
                              for i, p in enumerate(pieces)])
        made = json.loads(self.a.to_str())
        split = made["pre_tokenizer"] or {}
        self.cuts = (made["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
                     and not split.get("add_prefix_space") and not any("\u2581" in p.lstrip("\u2581") for p in pieces))
        # a vocabulary whose ids are in the order of its merges is one of ranks, which are faster to apply
        merges = [m if isinstance(m, str) else " ".join(m) for m in made["model"]["merges"]]
        vocab = made["model"]["vocab"]
        self.ranks = None
        if self.cuts and all(vocab.get(m.replace(" ", "")) == 256 + k for k, m in enumerate(merges)) and sorted(vocab.values())[:256] == list(range(256)):
            import tiktoken
            ranks = {bytes(symbol[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges) and all(c in symbol for c in t)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self._empty()

    def _empty(self) -> None:
        self.known = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.ids = [np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)]
        self.used = [0, 0]
        self.place = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.n = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def encode(self, texts: list[str]) -> list[list[list[int]]]:
        """Ids of a blank and each text."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        return [a, self.b.encode(texts, num_threads=1)]

    def _learn(self, raw: list[bytes]) -> None:
        texts = [r.decode() for r in raw]
        if self.ranks:
            found = [[self.ranks.encode_ordinary(t) for t in texts], self.b.encode([t[1:] for t in texts], num_threads=1)]
        else:
            found = self.encode([t[1:] for t in texts])
        for k, ids in enumerate(found):
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            total = int(n.sum())
            if self.used[k] + total > len(self.ids[k]):
                self.ids[k] = np.concatenate([self.ids[k][:self.used[k]], np.zeros(self.used[k] + 2 * total, np.int32)])
            self.ids[k][self.used[k]:self.used[k] + total] = np.fromiter((i for x in ids for i in x), np.int32, total)
            self.place[k] = np.r_[self.place[k], self.used[k] + np.cumsum(n) - n]
            self.n[k] = np.r_[self.n[k], n]
            self.used[k] += total

    def streams(self, buf: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B: ids of all rows of ``buf`` (each a blank and a text), the rows' offsets in them."""
        w = Words.__new__(Words)
        w.buf = buf
        cut = np.zeros(len(buf) + 1, bool)
        if self.cuts and len(buf) > 3:
            behind = _BEFORE[buf[1:-2]] | ((buf[1:-2] >> 6 == 2) & _LEAD[buf[:-3]])
            cut[2:-2] = (buf[2:-1] == 0x20) & behind & (_BEFORE[buf[3:]] | _LEAD[buf[3:]])
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        w.start, w.end = edges[:-1], edges[1:]
        if len(self.known[0]) > MEMO_SEGMENTS or max(self.used) > MEMO_IDS:
            self._empty()
        h, first, back = np.unique(word_hashes(w), return_index=True, return_inverse=True)
        at = np.searchsorted(self.known[0], h)
        at[at == len(self.known[0])] = 0
        new = np.flatnonzero(self.known[0][at] != h) if len(self.known[0]) else np.arange(len(h))
        if len(new):
            where = len(self.place[0]) + np.arange(len(new))
            self._learn([buf[s:e].tobytes() for s, e in zip(w.start[first[new]], w.end[first[new]], strict=True)])
            self.known = _merged(self.known, (h[new], where, np.zeros(len(new), np.int32)))
            at = np.searchsorted(self.known[0], h)
        seg = self.known[1][at][back]
        rows = np.searchsorted(w.start, offsets)
        out = []
        for k in (0, 1):
            n = self.n[k][seg]
            out.append((_gathered(self.ids[k], self.place[k][seg], n), np.r_[0, np.cumsum(n)][rows]))
        return out


def _aligned(va: Vocabulary, vb: Vocabulary, a: np.ndarray, at_a: np.ndarray, n_a: np.ndarray,
             b: np.ndarray, at_b: np.ndarray, n_b: np.ndarray) -> tuple:
    """Alignment of windows a[at_a:at_a + n_a] with b[at_b:at_b + n_b], which
    cover the same bytes: their groups as text, numbers of groups, and links
    (window, pair, occurrences), by window."""
    a, b = a[_places(at_a, n_a)], b[_places(at_b, n_b)]
    window = np.repeat(np.arange(len(n_a)), n_a)
    end_a, end_b = np.cumsum(va.size[a]), np.cumsum(vb.size[b])
    j = np.searchsorted(end_b, end_a)
    last_a, last_b = end_b[j] == end_a, np.zeros(len(b), bool)
    last_b[j[last_a]] = True
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    window_of = window[last_a]

    # a group's A ids, then its B ids; a comma behind each, a bar and a semicolon behind the last ones
    many_a, many_b = np.bincount(group_a), np.bincount(group_b)
    put_a = np.arange(len(a)) + np.repeat(np.cumsum(many_b) - many_b, many_a)
    put_b = np.arange(len(b)) + np.repeat(np.cumsum(many_a), many_b)
    flat = np.concatenate([va.digits[0], vb.digits[0]])
    at, size = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.int64)
    at[put_a], size[put_a] = va.digits[1][a], va.digits[2][a]
    at[put_b], size[put_b] = vb.digits[1][b] + len(va.digits[0]), vb.digits[2][b]
    text = _gathered(flat, at, size)
    stop = np.cumsum(size)
    text[stop[put_a[last_a]] - 1] = ord("|")
    text[stop[put_b[last_b]] - 1] = ord(";")
    n_groups = np.bincount(window_of, minlength=len(n_a))
    ends = stop[put_b[last_b]][np.cumsum(n_groups) - 1]
    whole = text.tobytes().decode("ascii")
    texts = [whole[x:y - 1] for x, y in pairwise([0, *ends.tolist()])]

    # links: distinct ids of a group on both sides, with how often each stands there
    ka, ca = np.unique(group_a << 32 | a, return_counts=True)
    kb, cb = np.unique(group_b << 32 | b, return_counts=True)
    of_b = np.bincount(kb >> 32)
    first_b = np.cumsum(of_b) - of_b
    n = of_b[ka >> 32]
    left, right = np.repeat(np.arange(len(ka)), n), _places(first_b[ka >> 32], n)
    mask = (1 << 32) - 1
    return texts, n_groups, window_of[ka[left] >> 32], (ka[left] & mask) << 32 | (kb[right] & mask), ca[left] * cb[right]


def aligned_texts(made: Tokens, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each text (rows: n_a, n_b, n_groups, n_links), its groups as
    text, and its links as (text, pair, occurrences)."""
    counts, groups = np.zeros((len(texts), 4), np.int64), [""] * len(texts)
    none = np.zeros(0, np.int64)
    rows = np.array([k for k, t in enumerate(texts) if t], np.int64)
    if not len(rows):
        return counts, groups, none, none, none
    raw = [b" " + texts[k].encode() for k in rows.tolist()]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    streams = made.streams(buf, off)
    good = np.ones(len(rows), bool)
    for (ids, at), v in zip(streams, (made.va, made.vb), strict=True):
        good &= np.diff(np.r_[0, np.cumsum(v.size[ids])][at]) == np.diff(off)
    for k, v in enumerate((made.va, made.vb)):  # rows of the right length, byte by byte
        ids, at = streams[k]
        wrong = v.joined(ids[np.repeat(good, np.diff(at))]) != buf[np.repeat(good, np.diff(off))]
        good[good] = np.diff(np.r_[0, np.cumsum(wrong)][np.r_[0, np.cumsum(np.diff(off)[good])]]) == 0
    if not good.any():
        return counts, groups, none, none, none
    rows = rows[good]
    (a, at_a), (b, at_b) = ((ids[np.repeat(good, np.diff(at))], np.r_[0, np.cumsum(np.diff(at)[good])]) for ids, at in streams)
    counts[rows, 0], counts[rows, 1] = np.diff(at_a), np.diff(at_b)

    # anchors: shared ends before tokens that both start with a blank, and the texts' ends
    va, vb = made.va, made.vb
    end_a, end_b = np.cumsum(va.size[a]), np.cumsum(vb.size[b])
    j = np.searchsorted(end_b, end_a)
    shared = np.flatnonzero(end_b[j] == end_a)[:-1]
    next_a, next_b = shared + 1, j[shared] + 1
    anchor = va.spaced[a[next_a]] & vb.spaced[b[next_b]]
    cut_a, cut_b = _marked(len(a), at_a, next_a[anchor]), _marked(len(b), at_b, next_b[anchor])
    text_of = np.searchsorted(at_a, cut_a[:-1], "right") - 1

    # windows of the same ids are aligned once
    key = _span_hash(a, cut_a) + mix(_span_hash(b, cut_b))
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    found, n_groups, window, pair, times = _aligned(va, vb, a, cut_a[first], np.diff(cut_a)[first], b, cut_b[first], np.diff(cut_b)[first])
    bounds = np.searchsorted(text_of, np.arange(len(rows) + 1)).tolist()
    named = back.tolist()
    for r, (x, y) in zip(rows.tolist(), pairwise(bounds), strict=True):
        groups[r] = ";".join([found[k] for k in named[x:y]])
    counts[rows, 2] = np.bincount(text_of, n_groups[back], len(rows)).astype(np.int64)

    # links of a text: those of its windows, summed by pair
    pairs, pair = np.unique(pair, return_inverse=True)
    n = np.bincount(window, minlength=len(first))
    of = _places((np.cumsum(n) - n)[back], n[back])
    key = np.repeat(text_of, n[back]) * len(pairs) + pair[of]
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    occ = np.add.reduceat(times[of][order], at)
    key = key[at]
    row, pair = rows[key // len(pairs)], pairs[key % len(pairs)]
    counts[:, 3] = np.bincount(row, occ, len(texts)).astype(np.int64)
    return counts, groups, row, pair, occ


def _marked(n: int, *places: np.ndarray) -> np.ndarray:
    """All of the places (0 to n), in order."""
    mark = np.zeros(n + 1, bool)
    for p in places:
        mark[p] = True
    return np.flatnonzero(mark)


def _span_hash(ids: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """64-bit hash of ids[cut[k]:cut[k + 1]] for each k."""
    fwd, back = _powers(len(ids) + 1)
    s = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * fwd[:len(ids)], out=s[1:])
    return mix((s[cut[1:]] - s[cut[:-1]]) * back[cut[:-1]])


_TOKENS: dict[tuple[str, str], Tokens] = {}


def tokens(bytes_path: str, pieces_path: str) -> Tokens:
    """One object for each pair of files in this Python worker."""
    key = bytes_path, pieces_path
    if key not in _TOKENS:
        _TOKENS[key] = Tokens(*key)
    return _TOKENS[key]


_STEP = "step long, pairs array<long>, n_docs array<int>, body binary"


def _align(bytes_path: str, pieces_path: str, keep_groups: bool):
    """(part, id, text) -> one row for each step."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = tokens(bytes_path, pieces_path)
        k = 0
        for b in batches:
            for i, j, _, _ in text_steps(b.column(2), STEP):
                parts = [aligned_texts(made, col.to_pylist()) for col in _few(b.column(2).slice(i, j - i))]
                shift = np.cumsum([0, *(len(p[0]) for p in parts)])
                counts = np.concatenate([p[0] for p in parts])
                groups = [g for p in parts for g in p[1]]
                row = np.concatenate([p[2] + s for p, s in zip(parts, shift[:-1], strict=True)])
                pairs, pair = np.unique(np.concatenate([p[3] for p in parts]), return_inverse=True)
                occ = np.concatenate([p[4] for p in parts])
                at = np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)
                cols = {"id": b.column(1).slice(i, j - i)}
                cols |= {n: pa.array(counts[:, c]) for c, n in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                cols["sha"] = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string())
                if keep_groups:
                    cols["groups"] = pa.array(groups, pa.string())
                cols["pair"] = pa.ListArray.from_arrays(at, pa.array(pair, pa.int32()))
                cols["occ"] = pa.ListArray.from_arrays(at, pa.array(occ, pa.int64()))
                docs = np.bincount(pair, minlength=len(pairs)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(b.column(0)[i].as_py() << 31) + k], pa.int64()), pa.array([pairs], pa.list_(pa.int64())),
                     pa.array([docs], pa.list_(pa.int32())), pa.array([packed(pa.table(cols))], pa.binary())],
                    names=["step", "pairs", "n_docs", "body"])
                k += 1
    return run


def _few(col: pa.Array) -> Iterator[pa.Array]:
    for i, j, _, _ in text_steps(col, ENCODE):
        yield col.slice(i, j - i)


def _counted(names: list[str]):
    """(body, counts of the step's pairs, whether each is its A id's highest) -> rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for body, count, best in zip(*b.columns, strict=True):
                t = unpacked(body.as_py())
                lists = t.column("pair").combine_chunks()
                at = lists.offsets.to_numpy()
                pair = lists.values.to_numpy()
                occ = t.column("occ").combine_chunks().values.to_numpy()
                count = count.values.to_numpy() if count.is_valid else np.zeros(0, np.int64)
                best = best.values.to_numpy(zero_copy_only=False) if best.is_valid else np.zeros(0, bool)
                total = lambda x: pa.array(np.diff(np.r_[0, np.cumsum(x)][at]), pa.int64())
                cols = {n: t.column(n).combine_chunks() for n in t.column_names if n not in ("pair", "occ")}
                cols |= {"n_best": total(occ * best[pair]), "count_sum": total(occ * count[pair])}
                yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)
    return run


def align_documents(docs: DataFrame, bytes_path: str | None = None, pieces_path: str | None = None, *, id: str = "doc_id",
                    text: str = "text", keep_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256 (and ``groups``: `a1,a2|b1;a3|b2,b3`, where kept); and the table of
    id pairs: a, b, n_docs (documents that hold the pair linked), best (the highest for a)."""
    spark = docs.sparkSession
    ship(spark)
    if not (bytes_path and pieces_path):
        import public_tokenizers
        bytes_path = bytes_path or public_tokenizers.path("byte_bpe_50k.json")
        pieces_path = pieces_path or public_tokenizers.path("piece_bpe_32k.model")
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.spark_partition_id().alias("part"), F.col(id).alias("id"), F.col(text).alias("text"))
    steps = stored(rows.mapInArrow(_align(bytes_path, pieces_path, keep_groups), _STEP), "alignment-steps")
    entries = (steps.select("step", F.posexplode(F.arrays_zip("pairs", "n_docs")).alias("pos", "x"))
               .select("step", "pos", "x.pairs", "x.n_docs").withColumnRenamed("pairs", "pair"))
    sums = stored(entries.groupBy("pair").agg(F.sum("n_docs").alias("n_docs")), "alignment-pairs")
    a = F.shiftright("pair", 32)
    top = sums.groupBy(a.alias("a")).agg(F.max("n_docs").alias("top"))
    table = (sums.withColumn("a", a).join(top, "a")
             .select("pair", F.col("a").cast("int").alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).cast("int").alias("b"), "n_docs",
                     (F.col("n_docs") == F.col("top")).alias("best")))
    counted = (entries.select("step", "pos", "pair").join(table.select("pair", "n_docs", "best"), "pair")
               .groupBy("step").agg(F.sort_array(F.collect_list(F.struct("pos", "n_docs", "best"))).alias("x"))
               .select("step", F.col("x.n_docs").alias("n_docs"), F.col("x.best").alias("best")))
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha"] + ["groups"] * keep_groups
    out = f"id {kind}, " + ", ".join(f"{n} long" for n in names[1:7]) + ", sha string" + ", groups string" * keep_groups
    done = (steps.select("step", "body").join(counted, "step", "left").select("body", "n_docs", "best")
            .mapInArrow(_counted(names), out)
            .withColumnsRenamed({"id": id, "sha": "groups_sha256"}))
    return done, table.drop("pair")
