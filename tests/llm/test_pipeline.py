"""run() against plain Python, stage by stage."""
import importlib
import math
import tempfile
import zlib

import numpy as np

import corpus_pipeline
from fleetstream.llm import queries

from .conftest import as_multiset, words
from .test_dedup import jaccard_brute
from .test_screen import alnum, contamination_brute
from .test_tokens import library


def lines_brute(rows, m):
    docs = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    first, gone = set(), {}
    for i, t, *_ in docs:
        seq = [(k, x) for k, x in enumerate(t.split("\n")) if words(x)]
        for p in range(len(seq) - m + 1):
            w = tuple(x for _, x in seq[p:p + m])
            if w in first:
                gone.setdefault(i, set()).update(k for k, _ in seq[p:p + m])
            first.add(w)
    out = []
    for i, t, lang, s in rows:
        drop = gone.get(i, set())
        left = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop)
        if not drop or words(left):
            out.append((i, left, lang, s))
    return out


def test_run(spark, rows):
    distinct = []
    for r in rows:
        if r[0] is not None and r[0] not in [x[0] for x in distinct]:
            distinct.append(r)
    items = [(1, " ".join(alnum(distinct[5][1])[:12])), (2, " ".join(alnum(distinct[9][1])[2:20])), (3, None)]
    sf = tempfile.mkdtemp(prefix="llm-sf-")
    full = [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in distinct]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(sf + "/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(sf + "/benchmark.parquet")

    kept = [r for r in distinct if any(c.isalpha() for c in r[1] or "")]
    kept = lines_brute(kept, 2)
    kept = [r for r, b in zip(kept, jaccard_brute(kept, 80), strict=True) if b[2] == r[0]]
    kept = [r for r, b in zip(kept, contamination_brute(kept, items, 10), strict=True) if not b[5]]
    want = []
    for i, t, *_ in kept:
        ids = library(t) + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            raw = np.array(ids[s:s + 2048], "<u4").tobytes()
            want.append((i, k, s, len(raw) // 4, zlib.crc32(raw)))
    got = corpus_pipeline.run(spark, sf).collect()
    assert as_multiset(tuple(r)[:5] for r in got) == as_multiset(want)
    total = {}
    for r in got:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert max(total.values()) <= 2048 and len(total) <= math.ceil(sum(total.values()) / 2048) + 1


def test_stages(spark, no_docs, tmp_path):
    """Stages return the columns they get, also for an empty table."""
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language ID", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.collect() == []


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = {n.split("_")[0] for n in entry.queries() if n[:2] == "op" and n[2].isdigit()}
    assert names == {f"op{k}" for k in range(1, 14)} and "pipeline" in entry.queries()
    assert set(queries.QUERIES) <= set(entry.queries())
    assert {"op2_suffix_array_line_dedup", "op3_winnowing_decontamination", "op7_suffix_tree_substring_dedup"} <= set(entry.oracle_sql())
