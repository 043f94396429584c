"""Language and score are functions of the text alone."""
from fleetstream.llm import language_id


def test_order_of_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    short = spark.createDataFrame([(10**6 + k, t, None) for k, t in enumerate(["a", "the", "der", "où", "é", "x y", "ñ"] * 20)],
                                  "doc_id long, text string, lang string")
    docs = docs.unionByName(short)
    model = language_id.fit(docs, sample=100)
    want = None
    for rows in (docs.coalesce(1), docs.orderBy("text").coalesce(1), docs.orderBy("doc_id", ascending=False).repartition(5)):
        got = language_id.identify(rows, model).join(docs.select("doc_id", "text"), "doc_id").collect()
        by_text = {}
        for r in got:
            by_text.setdefault(r.text, set()).add((r.lang_pred, r.score))
        assert all(len(v) == 1 for v in by_text.values())
        want = want or by_text
        assert by_text == want
    again = language_id.fit(docs.orderBy("text").repartition(7), sample=100)
    assert (again.weights == model.weights).all() and (again.bias == model.bias).all()
