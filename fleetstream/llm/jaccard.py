"""N-gram Jaccard join: documents whose sets of word shingles are similar.

Two documents link when ``100 * |x and y| >= threshold * |x or y|`` over their
distinct shingles of ``size`` lower-cased words.

1. Token frequencies.  Each input step (some megabytes of text) sends one
   entry for each distinct shingle to the bucket of its hash, with the number
   of its documents in the step; a bucket answers every step that holds a
   shingle which other documents have too, with the shingle's document
   frequency.  Entries are combined within a step, so a shingle of a third of
   all documents is one entry for each step.
2. Token-combination prefixes.  A set is ordered by (frequency, hash), rare
   shingles first.  A linked partner shares at least ceil(t * n) of its n
   shingles, so documents with fewer shared ones are done.  For the others, a
   partner shares a shingle of the prefix of p = n - ceil(t * n) + 1.
   Rare shingles of the prefix (at most ``frequent`` documents) are single
   index keys.  Where the prefix reaches frequent shingles, it is extended by
   c more: partners then share more than c frequent shingles, which fall into
   c classes by hash, so two shared ones meet in a class.  The index keys are
   the pairs of frequent shingles of one class.  c depends on the size level
   (power of four); a document is indexed at the levels that its partners can
   have, mostly its own.
3. Verification.  Documents with the same set are one node.  For each key the
   smallest node is compared with the others, linked nodes are put together,
   and then every node outside of its key's largest component is compared with
   all nodes of the key that aren't in its component yet: some of each key
   first, as they put much together, then all others, in one pass.  A sketch with a proven bound (the bits that
   differ need as many different shingles) keeps pairs that can't be similar
   from being made.  No other pair in two components goes untested, and groups
   of near copies never become all pairs.

Intersections are counted on the sets, so a similarity is exact up to
collisions of 54-bit hashes within two documents.

Defined cases: a text of fewer than ``size`` words is one shingle; a null or
wordless text has no shingles and no links, and its component is its own id;
documents with equal sets are linked; null ids count as no id when the
smallest of a component is taken; repeated rows each get the same answer;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (NOT_SPACE, Words, lean, mix, parts, ship, small_or_shuffled, spread, stored, text_bytes, text_steps, window_hashes,
                     window_starts, word_hashes)

#: Bits of a shingle's hash behind those that choose its bucket; sent as 6 bytes.
LOW = np.uint64((1 << 48) - 1)
#: Bits of a set's sketch: whether an odd number of its shared shingles falls on each.
SKETCH = 512


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    w = Words(buf, offsets, NOT_SPACE)
    h = word_hashes(w, lower=True)
    grams = window_hashes(h, size)
    ok = window_starts(w, size)
    out = []
    for first, n in zip(w.first[:-1].tolist(), w.count.tolist(), strict=True):
        if n >= size:
            out.append(np.unique(grams[first:first + n - size + 1]))
        elif n:
            out.append(window_hashes(h[first:first + n], n))
        else:
            out.append(np.zeros(0, np.uint64))
    assert len(ok) == len(grams)
    return out


def least_shared(n, t: int):
    """Shingles that a set of n shares with any linked one, at least: ceil(n * t / 100)."""
    return -(-n * t // 100)


def _token(bucket: np.ndarray | int, h: np.ndarray) -> np.ndarray:
    """Low 16 bits of the bucket number, and the low bits of the hash, as one
    integer: 64 bits of the hash's choice, however many buckets there are."""
    return (np.asarray(bucket).astype(np.uint64) << np.uint64(48)) | (h & LOW)


def _split(buckets: int, size: int):
    """(id, text) -> entries for the buckets, and what stays with the step.

    kind 1: shingles of one bucket: n, the low 48 bits of their hashes, the row
    in the step, then (place, documents) of those in several rows.
    kind 2: ids, set sizes, signatures; kind 3: (shingle, row) of further rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, step = TaskContext.get().partitionId(), 0
        for b in batches:
            for i, j, buf, off in text_steps(b.column(1)):
                for lo in range(0, j - i, 1 << 16):  # row numbers are 16 bits wide
                    hi = min(lo + (1 << 16), j - i)
                    number = (part << 31) + step
                    step += 1
                    sets = shingle_sets(buf[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], size)
                    n = np.array([len(s) for s in sets])
                    h = np.concatenate(sets)
                    row = np.repeat(np.arange(hi - lo), n)
                    sig = [(int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(s)) if len(s) else 0)) for s in sets]
                    order = np.argsort(h, kind="stable")
                    h, row = h[order], row[order]
                    new = np.r_[True, h[1:] != h[:-1]][:len(h)]
                    starts = np.flatnonzero(new)
                    count = np.diff(np.r_[starts, len(h)])
                    u, first = h[starts], row[starts]
                    bucket = ((u >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)  # in order of the hash
                    own = [("kind 2", pickle.dumps((b.column(0).slice(i + lo, hi - lo).to_pylist(), n.tolist(), sig)))]
                    if not new.all():
                        tok = _token(((h[~new] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), h[~new])
                        own.append(("kind 3", tok.tobytes() + row[~new].astype(np.uint16).tobytes()))
                    blobs = [(number % buckets, int(k[-1]), body) for k, body in own]
                    cut = np.searchsorted(bucket, np.arange(buckets + 1))
                    for k in range(buckets):
                        a, z = cut[k], cut[k + 1]
                        if a < z:
                            many = np.flatnonzero(count[a:z] > 1)
                            low = (u[a:z] & LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                            blobs.append((k, 1, b"".join((
                                np.uint32(z - a).tobytes(), low.tobytes(), first[a:z].astype(np.uint16).tobytes(),
                                many.astype(np.uint32).tobytes(), count[a:z][many].astype(np.uint32).tobytes()))))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[0] for x in blobs], pa.int32()), pa.array([number] * len(blobs), pa.int64()),
                         pa.array([x[1] for x in blobs], pa.int32()), pa.array([x[2] for x in blobs], pa.binary())],
                        names=["bucket", "step", "kind", "body"])
    return run


def _frequencies(t: pa.Table) -> pa.Table:
    """One bucket: frequencies of the shingles that more than one row has, to
    their steps (kind 4: shingles, rows, frequencies); the rest passes."""
    lean()
    kind = t.column("kind").to_numpy()
    out = t.filter(pa.array(kind != 1)).select(["step", "kind", "body"])
    mine = np.flatnonzero(kind == 1)
    if not len(mine):
        return out
    bucket = t.column("bucket")[0].as_py()
    steps, bodies = t.column("step").to_numpy()[mine], t.column("body").take(pa.array(mine))
    hs, rows, counts, at = [], [], [], []
    for k, body in enumerate(bodies):
        raw = np.frombuffer(body.as_buffer(), np.uint8)
        n = int(raw[:4].view(np.uint32)[0])
        h = np.zeros((n, 8), np.uint8)
        h[:, :6] = raw[4:4 + 6 * n].reshape(n, 6)
        c = np.ones(n, np.uint32)
        rest = raw[4 + 8 * n:].copy().view(np.uint32)
        c[rest[:len(rest) // 2]] = rest[len(rest) // 2:]
        hs.append(h.reshape(-1).view(np.uint64))
        rows.append(raw[4 + 6 * n:4 + 8 * n].copy().view(np.uint16))
        counts.append(c)
        at.append(np.full(n, k, np.int32))
    h, row, count, at = map(np.concatenate, (hs, rows, counts, at))
    u, back = np.unique(h, return_inverse=True)
    df = np.bincount(back, weights=count).astype(np.uint32)[back]
    hit = df > 1
    order = np.argsort(at[hit], kind="stable")
    h, row, df, at = h[hit][order], row[hit][order], df[hit][order], at[hit][order]
    cut = np.searchsorted(at, np.arange(len(mine) + 1))
    back_to = [(int(steps[k]), 4, _token(bucket, h[a:z]).tobytes() + row[a:z].tobytes() + df[a:z].tobytes())
               for k, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if a < z]
    answers = pa.table({"step": pa.array([x[0] for x in back_to], pa.int64()), "kind": pa.array([x[1] for x in back_to], pa.int32()),
                        "body": pa.array([x[2] for x in back_to], pa.binary())})
    return pa.concat_tables([out.cast(answers.schema), answers])


def index_keys(tokens: np.ndarray, df: np.ndarray, n: int, t: int, frequent: int) -> np.ndarray:
    """Index keys of a set of n shingles; tokens: those that others have too,
    in the order (frequency, hash), with their frequencies."""
    need = least_shared(n, t)
    single = n - len(tokens)  # no other document has them; they stand first
    prefix = n - need + 1 - single
    rare = int(np.searchsorted(df, frequent, "right"))
    keys = [mix(tokens[:min(prefix, rare)].astype(np.uint64))]
    if prefix > rare:
        for level in range((int(need).bit_length() - 1) // 2, (int(n * 100 // t).bit_length() - 1) // 2 + 1):
            c = max(1, 4 ** level // 4)
            x = tokens[rare:prefix + c].astype(np.uint64)
            m = mix(x + np.uint64(level))
            k = m % np.uint64(c)
            order = np.lexsort((x, k))
            m, k = m[order], k[order]
            run = np.searchsorted(k, k, "right")  # end of each one's class
            for gap in range(1, int((run - np.arange(len(k))).max(initial=1))):
                a = np.flatnonzero(np.arange(len(k)) + gap < run)
                keys.append(mix(m[a] * np.uint64(3) + m[a + gap]))
    return np.unique(np.concatenate(keys))


def _documents(t_percent: int, frequent: int, id_type: pa.DataType):
    """One step: a row for each document, with tokens and keys where it may have partners."""
    def run(t: pa.Table) -> pa.Table:
        ids, n, sig = [], [], []
        toks, rows, dfs, further = [], [], [], []
        for kind, body in zip(t.column("kind").to_pylist(), t.column("body"), strict=True):
            raw = body.as_buffer()
            if kind == 2:
                ids, n, sig = pickle.loads(raw)
            else:
                wide = 10 if kind == 3 else 14
                m = len(raw) // wide
                tok = np.frombuffer(raw, np.uint64, m)
                row = np.frombuffer(raw, np.uint16, m, 8 * m)
                if kind == 3:
                    further.append((tok, row))
                else:
                    toks.append(tok)
                    rows.append(row)
                    dfs.append(np.frombuffer(raw[10 * m:], np.uint32, m))
        if toks:
            tok, row, df = map(np.concatenate, (toks, rows, dfs))
            if further:  # their frequency came for the first row
                u, where = np.unique(tok, return_index=True)
                ftok, frow = (np.concatenate(x) for x in zip(*further, strict=True))
                df = np.r_[df, df[where[np.searchsorted(u, ftok)]]]
                tok, row = np.r_[tok, ftok], np.r_[row, frow]
            order = np.lexsort((tok, df, row))
            tok, row, df = tok[order], row[order], df[order]
            cut = np.searchsorted(row, np.arange(len(ids) + 1))
        else:
            tok, df, cut = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(len(ids) + 1, np.int64)
        tokens, keys, sketch = [], [], []
        for k, size in enumerate(n):
            a, z = cut[k], cut[k + 1]
            if size and z - a >= least_shared(size, t_percent):
                tokens.append(np.sort(tok[a:z]).view(np.int64))
                keys.append(index_keys(tok[a:z], df[a:z], size, t_percent, frequent).view(np.int64))
                odd = np.bincount((mix(tok[a:z]) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
                sketch.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            else:
                tokens.append(None)
                keys.append(None)
                sketch.append(None)
        node = [x.to_bytes(8, "big") + y.to_bytes(8, "big") + s.to_bytes(4, "big") if s else None for (x, y), s in zip(sig, n, strict=True)]
        longs = pa.list_(pa.int64())
        return pa.table({"id": pa.array(ids, id_type), "n": pa.array(n, pa.int64()), "node": pa.array(node, pa.binary()),
                         "tokens": pa.array(tokens, longs), "keys": pa.array(keys, longs), "sketch": pa.array(sketch, longs)})
    return run


def indexed(docs: DataFrame, *, threshold: int, size: int, frequent: int, id: str, text: str) -> DataFrame:
    """(id, n, node, tokens, keys, sketch) of each document; node stands for its set."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    from pyspark.sql.pandas.types import to_arrow_type
    kind = rows.schema["id"].dataType
    buckets = parts(text_bytes(rows), 8 << 20, spread(spark))
    entries = rows.mapInArrow(_split(buckets, size), "bucket int, step long, kind int, body binary")
    # as many partitions as buckets: a task's share stays the same as the corpus grows
    answers = entries.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_frequencies, "step long, kind int, body binary")
    return stored(answers.repartition(buckets, "step").groupBy("step").applyInArrow(
        _documents(threshold, frequent, to_arrow_type(kind)),
        f"id {kind.simpleString()}, n long, node binary, tokens array<long>, keys array<long>, "
        "sketch array<long>"), "jaccard-documents")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) with their similarity tested: (a, b, linked)."""
    one = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}"))
    both = F.size(F.array_intersect("ta", "tb"))
    return (pairs.join(one("a"), "a").join(one("b"), "b")
            .select("a", "b", (100 * both >= threshold * (F.col("na") + F.col("nb") - both)).alias("linked")))


def _pair(x: str, y: str):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _fits(x: str, y: str, threshold: int):
    return (100 * F.least(x, y) >= threshold * F.greatest(x, y))


def _may_link(x: list[str], y: list[str], nx: str, ny: str, threshold: int):
    """Whether two sets can be similar enough, by what their difference has at
    least: the shingles that no other document has, and one shingle for each
    sketch bit that differs.  x, y: columns (shingles of its own, sketch...)."""
    apart = F.col(x[0]) + F.col(y[0])
    for a, b in zip(x[1:], y[1:], strict=True):
        apart = apart + F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    return (100 + threshold) * apart <= (100 - threshold) * (F.col(nx) + F.col(ny))


#: Nodes of a key that are compared with the key's others in one task.
BLOCK = 2048


def linked_nodes(sets: DataFrame, threshold: int, at_once: int = 1 << 21) -> DataFrame:
    """(node, component) of the nodes with links.

    Two passes over the keys whose nodes aren't all in one component: the first
    compares some nodes of a key (``at_once`` pairs for a key, about) and puts
    together what is linked, the second all that are still apart.  A key's
    nodes are dealt into blocks, so its pairs are made by many tasks."""
    from .components import components, merged

    entries = sets.select("node", "n", F.explode("keys").alias("key"))
    leaders = (entries.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"), F.max("node").alias("last"))
               .filter(F.col("lead.node") < F.col("last")).select("key", "lead"))
    shared = stored(entries.join(leaders, "key").select("key", "node", "n", "lead"), "jaccard-index")
    first = (shared.filter(F.col("node") != F.col("lead.node")).filter(_fits("n", "lead.n", threshold))
             .select(*_pair("node", "lead.node")).distinct())
    tested = stored(_verified(first, sets, threshold), "jaccard-tested")
    comp = stored(components(tested.filter("linked").select("a", "b")), "jaccard-components")
    entries = shared.select("key", "node", "n")
    bits = [f"s{k}" for k in range(SKETCH // 64)]
    sketches = sets.select("node", (F.col("n") - F.size("tokens")).alias("own"), *(F.col("sketch")[k].alias(c) for k, c in enumerate(bits)))
    one, two = ["own", *bits], ["own2", *(f"{c}2" for c in bits)]
    for some in (True, False):
        placed = entries.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # keys whose nodes are not all in one component
        sizes = placed.groupBy("key", "component").agg(F.count("*").alias("m"))
        open_keys = (sizes.groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("main"),
                                              F.sum("m").alias("m"), F.count("*").alias("k")).filter("k > 1"))
        # each entry with the two open keys before it among its node's
        along = Window.partitionBy("node").orderBy("key")
        entries_open = stored(placed.join(open_keys.select("key", "main", "m"), "key").join(sketches, "node")
                              .withColumn("k1", F.lag("key", 1).over(along)).withColumn("k2", F.lag("key", 2).over(along)),
                              "jaccard-open")
        picked = entries_open.filter("component <> main")
        blocks = F.expr(f"(m + {BLOCK - 1}) div {BLOCK}")
        if some:
            picked = picked.filter(F.expr(f"pmod(xxhash64(node, key), m) < greatest(4, {at_once} div m)"))
            blocks = F.lit(1).cast("long")
        picked = picked.select("key", "node", "n", "component", "k1", "k2", F.expr("pmod(xxhash64(key, node), {})".format(
            1 if some else f"(m + {BLOCK - 1}) div {BLOCK}")).alias("block"), *one)
        others = entries_open.select("key", F.col("node").alias("other"), F.col("n").alias("n2"), F.col("component").alias("c2"), "main",
                                     F.col("k1").alias("q1"), F.col("k2").alias("q2"), *(F.col(a).alias(b) for a, b in zip(one, two, strict=True)),
                                     F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
        # two nodes that share the key before, too, meet there: the first key they share is the one that counts
        before = F.lit(False)
        for x in ("k1", "k2"):
            for y in ("q1", "q2"):
                before = before | F.coalesce(F.col(x) == F.col(y), F.lit(False))
        # where both are picked, one of them brings the pair
        once = (F.col("c2") == F.col("main")) | (F.col("node") < F.col("other")) if not some else F.lit(True)
        pairs = (picked.join(others, ["key", "block"]).filter("component <> c2")
                 .filter(once & ~before & _may_link(one, two, "n", "n2", threshold))
                 .select(*_pair("node", "other")).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti"))
        more = stored(_verified(pairs, sets, threshold), "jaccard-tested")
        links = more.filter("linked").select("a", "b")
        if not links.isEmpty():
            comp = stored(merged(comp, links), "jaccard-components")
        if some:
            tested = tested.unionByName(more)
            entries = entries_open.select("key", "node", "n")
    return comp


def similar_documents(docs: DataFrame, *, threshold: int = 80, size: int = 5, frequent: int = 64,
                      id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_shingles, component_id (smallest id that links lead to) of each row of ``docs``."""
    rows = indexed(docs, threshold=threshold, size=size, frequent=frequent, id=id, text=text)
    sets = stored(rows.filter("keys is not null").select("node", "n", "tokens", "keys", "sketch").dropDuplicates(["node"]), "jaccard-sets")
    comp = linked_nodes(sets, threshold)
    slim = (rows.select("id", "n", "node").join(comp, "node", "left")
            .select("id", "n", F.coalesce("component", "node").alias("component")))
    least = slim.filter("component is not null").groupBy("component").agg(F.min("id").alias("least"))
    return (slim.join(least, "component", "left")
            .select(F.col("id").alias(id), F.col("n").alias("n_shingles"),
                    F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id")))


def one_of_each(docs: DataFrame, *, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Rows of ``docs``, all columns, less those whose component has a smaller
    address (id, text hash), null ids last; of rows that repeat an id and a text
    one stays."""
    key = F.unhex(F.md5(F.col(text)))
    address = F.struct(F.when(F.col(id).isNull(), F.lit(True)).alias("no_id"), F.col(id).alias("id"), key.alias("key"))  # nulls come first
    found = similar_documents(docs.select(address.alias("__address"), F.col(text).alias("text")), id="__address", text="text", **options)
    gone = stored(found.filter("component_id < __address").select(F.col("__address.id").alias("__id"), F.col("__address.key").alias("__key"))
                  .distinct(), "near-copies")
    return docs.join(small_or_shuffled(gone), F.col(id).eqNullSafe(F.col("__id")) & (key == F.col("__key")),
                     "left_anti").dropDuplicates([id, text])
