"""The pipeline's first stage where languages are missing."""
import corpus_pipeline

from .conftest import corpus, frame


def test_nothing_learned(spark):
    rows = [(i, t, None, s) for i, t, _, s in corpus()]
    got = corpus_pipeline.identify_languages(spark, frame(spark, rows), "").collect()
    want = [t for _, t, *_ in rows if any(c.isalpha() for c in t or "")]
    assert sorted(r.text for r in got) == sorted(want) and all(r.lang is None for r in got)


def test_missing_language(spark):
    """A null lang is filled in; others stay."""
    rows = corpus()[:48]
    docs = frame(spark, [(i, t, None if k % 4 == 0 else lang, s) for k, (i, t, lang, s) in enumerate(rows)])
    got = {r.doc_id: r.lang for r in corpus_pipeline.identify_languages(spark, docs, "").collect()}
    assert len(got) == 48
    assert all(got[i] == lang for k, (i, _, lang, _) in enumerate(rows) if k % 4)
    assert sum(got[i] == lang for i, _, lang, _ in rows) >= 46
