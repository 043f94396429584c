"""Session and path helpers."""

from fleetstream.session import materialize, shared_root, spread_if_narrow, to_local_path


def test_spread_only_when_narrow(spark):
    want = spark.sparkContext.defaultParallelism
    narrow = spark.range(0, 100, 1, 1)
    assert spread_if_narrow(narrow).rdd.getNumPartitions() == want
    wide = spark.range(0, 100, 1, 2)
    assert spread_if_narrow(wide) is wide


def test_scanned_paths_are_plain(spark, workdir):
    """One name for a file, whoever lists or scans it: blanks, plus, percent, umlauts."""
    import os
    from fleetstream.sources import files, logs
    folder = os.path.join(workdir, "run 1+2", "wörker 1")
    os.makedirs(folder)
    for name in ("a b.log", "c%20d.log"):
        with open(os.path.join(folder, name), "w") as fh:
            fh.write("x\ny\n")
    glob = f"{workdir}/*/*/*"
    listed = sorted(r.path for r in files.list_files(spark, glob).collect())
    assert [p.split("/")[-1] for p in listed] == ["a b.log", "c%20d.log"]
    scans = (logs.named_lines(spark, workdir, "*/*/*"), files.whole_files(spark, glob), logs.scan_logs(spark, workdir))
    for df in scans:
        assert sorted({to_local_path(r.path) for r in df.select("path").collect()}) == [to_local_path(p) for p in listed]
    row = logs.scan_logs(spark, workdir).select("run", "host").distinct().collect()
    assert [tuple(r) for r in row] == [("run 1+2", "wörker 1")]


def test_materialize_in_shared_folder(spark):
    root = shared_root(spark)
    df = materialize(spark.range(5), "t")
    assert df.count() == 5
    local_root = to_local_path(root)
    assert any(to_local_path(p).startswith(local_root) for p in df.inputFiles())


def test_materialized_tables_are_released(spark):
    import os
    from fleetstream.session import release_materialized
    path = to_local_path(materialize(spark.range(5), "t").inputFiles()[0])
    assert os.path.exists(path)
    release_materialized(spark)
    assert not os.path.exists(path)
