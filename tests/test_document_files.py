"""Document files: folders of bounded size, a file for every row."""

import os

from fleetstream.plans import fixtures as fx
from fleetstream.session import to_local_path
from fleetstream.sources import files as srcf


def test_document_files_share_folders(spark, workdir, monkeypatch):
    """the folders grow with the files by the thousand, not one for each file."""
    monkeypatch.setattr(fx, "FOLDER_FILES", 20)
    rows = [(i, f"text {i}\nmore", "en") for i in range(200)] + [(7, "text 7\nmore", "en"), (200, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{workdir}/documents.parquet")
    root = fx.document_files(spark, workdir)
    folders = os.listdir(to_local_path(root))
    assert 2 <= len(folders) <= 11
    got = srcf.whole_files(spark, f"{root}/*").select(fx.doc_file_name(), "text").collect()
    assert sorted(map(tuple, got)) == sorted((f"d{i}", (t or "") + "\n") for i, t, _ in rows)
    # by path: by name, as `find | sort` gives it
    names = [r.name for r in srcf.sample_files(spark, f"{root}/*", "*.txt", 30).select(fx.doc_file_name()).collect()]
    assert names == sorted([f"d{i}" for i, _, _ in rows], key=lambda n: n + "/")[:30]


def test_a_batch_is_listed_by_few_tasks(spark, workdir):
    from fleetstream.session import cluster_cores
    srcf.list_files(spark, workdir)
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    assert int(spark.conf.get(key)) <= max(8, 4 * cluster_cores(spark))


def test_messages_are_not_shuffled_by_type(spark):
    """payloads stay where they are, the route table comes to them."""
    from fleetstream.operators import messages as msg
    from test_plans import exchanges, plan
    messages = spark.createDataFrame([("a", "x"), ("b", None)], "name string, type string")
    routes = spark.createDataFrame([("x", "i")], "type string, image string")
    out = msg.route(messages, routes.distinct(), strict=False)
    tree = plan(out)
    assert "BroadcastHashJoin" in tree and "SortMergeJoin" not in tree and exchanges(out) <= 1
    assert sorted((r.name, r.image) for r in out.collect()) == [("a", "i"), ("b", None)]


def test_language_file_is_written_in_parts(spark, workdir, monkeypatch):
    """F16: several tasks write one file; texts stay whole and in the order of the ids."""
    monkeypatch.setattr(fx, "LANGUAGE_PART", 500)
    rows = [(i, f"text {i}\nmore", "en" if i % 3 else None) for i in range(300)] + [(7, "again", "en"), (8, None, "fr")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{workdir}/documents.parquet")
    root = to_local_path(fx.language_files(spark, workdir))
    assert sorted(os.listdir(root)) == ["name=en", "name=fr", "name=none"]
    for name in ("en", "fr", "none"):
        with open(f"{root}/name={name}/part-00000.txt") as fh:
            got = fh.read()
        texts = [(i, (t or "") + "\n") for i, t, lang in rows if (lang or "none") == name]
        want = "".join(t for _, t in sorted(texts, key=lambda x: x[0]))
        assert got == want or (name == "en" and got == want.replace("text 7\nmore\nagain\n", "again\ntext 7\nmore\n"))
