"""Running totals, rebasing, trimming and load classes."""

import random

from pyspark.sql import functions as F

from fleetstream.operators import ordered, timeline as tl


def test_running_total_hand_example(spark):
    # FIXTURES A10
    rows = [(1, 0, .5, 0), (2, 1, .25, 1), (3, 0, .75, 2), (3, 2, .1, 3), (4, 1, .0, 4)]
    df = spark.createDataFrame([("r",) + x for x in rows], "run string, ts long, worker int, cpu double, line long")
    for fn in (ordered.running_latest_sum, ordered.running_latest_sum_single):
        kw = {"n_buckets": 3} if fn is ordered.running_latest_sum else {}
        out = fn(df, ["run"], "worker", [0, 1, 2], "cpu", ["ts", "worker", "line"], **kw)
        got = [r.total for r in out.orderBy("ts", "worker").collect()]
        assert got == [.5, .75, 1.0, 1.1, .85]


def test_bucketed_equals_single_window(spark):
    rnd = random.Random(7)
    rows = [(f"r{rnd.randrange(3)}", rnd.randrange(2000), rnd.randrange(5), rnd.random(), i)
            for i in range(10000)]
    df = spark.createDataFrame(rows, "run string, ts long, worker int, v double, line long")
    args = (["run"], "worker", [0, 1, 2, 3, 4], "v", ["ts", "worker", "line"])
    a = ordered.running_latest_sum(df, *args, n_buckets=37).select("line", F.col("total").alias("a"))
    b = ordered.running_latest_sum_single(df, *args).select("line", F.col("total").alias("b"))
    assert a.join(b, "line").filter(F.col("a") != F.col("b")).count() == 0
    assert a.count() == 10000


def test_rank_and_previous_matches_window(spark):
    from pyspark.sql import Window
    rnd = random.Random(3)
    rows = [(f"s{rnd.randrange(4)}", rnd.randrange(500), i, rnd.randrange(25)) for i in range(5000)]
    df = spark.createDataFrame(rows, "s string, ts long, id long, q int")
    got = ordered.rank_and_previous(df, ["s"], ["ts", "id"], ["q"], rank_col="t", n_buckets=13)
    w = Window.partitionBy("s").orderBy("ts", "id")
    ref = df.select("id", F.row_number().over(w).alias("t2"), F.lag("q").over(w).alias("pq2"))
    j = got.join(ref, "id")
    assert j.filter((F.col("t") != F.col("t2")) | ~F.col("prev_q").eqNullSafe(F.col("pq2"))).count() == 0


def test_load_rate_classes(spark):
    qs = [12, 12, 20, 22, 17, 5, 6]
    df = spark.createDataFrame([("a", i, i, q) for i, q in enumerate(qs)],
                               "series string, ts_ms long, event_id long, queue int")
    got = [(r.t, r.rate, r.action, r.amount) for r in tl.load_rate(df, n_buckets=2).orderBy("t").collect()]
    assert [g[2] for g in got] == ["small", "small", "large", "small", "slowdown", "slowdown", "steady"]
    assert got[0][1] is None and got[2][1] == 8.0 and [g[0] for g in got] == list(range(1, 8))
    assert [g[3] for g in got] == [1, 1, 2, 1, 0, 0, 0]


def test_rebase_trim_view(spark):
    df = spark.createDataFrame([("r", float(t)) for t in (10, 11, 12, 15)], "run string, ts double")
    reb = tl.rebase(df, tl.origins_of(df))
    assert sorted(r.t for r in reb.collect()) == [0.0, 1.0, 2.0, 5.0]
    assert sorted(r.t for r in tl.trim(reb, 1.0, 5.0).collect()) == [2.0, 5.0]
    assert sorted(r.t for r in tl.view_range(reb, 1.0, 5.0).collect()) == [1.0, 2.0, 5.0]


def test_core_equivalents_order(spark):
    v = spark.range(1).select(tl.core_equivalents(F.lit(0.85)).alias("c")).first().c
    assert v == 0.85 / 5 * 40


def test_default_share(spark):
    req = spark.createDataFrame([(1, "a"), (2, "b")], "id long, image string")
    prof = spark.createDataFrame([("a", 1), ("a", 3)], "image string, cpu long")
    got = {r.image: r.share for r in tl.default_share(req, prof, units=10.0).collect()}
    assert got == {"a": 0.2, "b": 0.125}


def test_makespan(spark):
    comp = spark.createDataFrame([("r", 1588708133), ("r", 1588708000)], "run string, completed_s long")
    starts = spark.createDataFrame([("r", 1588707496409)], "run string, ts_ms long")
    r = tl.makespan(comp, starts).first()
    assert r.n_tasks == 2 and abs(r.makespan_s - 636.591) < 1e-6


def test_sinks_roundtrip(spark, workdir):
    from fleetstream.functions import formats, parsers
    from fleetstream.operators import sinks
    from fleetstream.sources.logs import scan_logs
    df = spark.createDataFrame([("r1", "master", 3, 1000), ("r1", "master", None, 2000),
                                ("r2", "master", 7, 3000)], "run string, host string, cores int, ts long")
    lines = df.select("run", "host", formats.core_line("cores", "ts").alias("line"))
    sinks.write_lines(lines, workdir + "/logs", partition_cols=["run", "host"])  # K2
    back = scan_logs(spark, workdir + "/logs", "*/*/*.txt")
    parsed = back.select("run", "host", parsers.parse_core_line("line").alias("p"))
    got = sorted(((r.run, r.host, r.p.cores, r.p.ts_ms) for r in parsed.collect()),
                 key=lambda x: x[3])
    assert got == [("r1", "master", 3, 1000), ("r1", "master", None, 2000), ("r2", "master", 7, 3000)]
    sinks.write_series(df, workdir + "/series")  # K3
    assert spark.read.parquet(workdir + "/series").count() == 3


def test_hot_run_is_split_across_buckets(spark):
    """One run holds 90% of the samples: the bucketed scan still bounds
    every (run, bucket) window partition near N / buckets."""
    from pyspark.sql import functions as F
    n, k = 20000, 16
    df = spark.range(n).select(
        F.when(F.col("id") % 10 == 0, F.concat(F.lit("cold"), (F.col("id") % 3).cast("string")))
        .otherwise(F.lit("hot")).alias("run"),
        (F.col("id") * 7 % 100003).alias("ts"),
        (F.col("id") % 5).cast("int").alias("worker"),
        F.rand(3).alias("v"), F.col("id").alias("line"))
    b = ordered.add_range_bucket(df, ["ts", "line"], k)
    sizes = [r["count"] for r in b.groupBy("run", "_bucket").count().collect()]
    assert max(sizes) <= 2 * n / k  # the hot run is cut into ~k pieces
    out = ordered.running_latest_sum(df, ["run"], "worker", [0, 1, 2, 3, 4], "v",
                                     ["ts", "worker", "line"], n_buckets=k)
    # no task of the window stage sees more than a small share of the rows
    # (AQE would merge this tiny shuffle into one partition; the plan itself
    # is what is checked here)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per_task = out.withColumn("_p", F.spark_partition_id()).groupBy("_p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in per_task) <= n / 2


def test_ties_are_split_across_buckets(spark):
    """Four distinct times: the second order column splits what ties in the first."""
    from pyspark.sql import functions as F
    n, k = 20000, 64
    df = spark.range(n).select(F.lit("r").alias("run"), (F.col("id") % 4).alias("ts"), F.col("id").alias("line"),
                               (F.col("id") % 5).cast("int").alias("worker"), F.rand(3).alias("v"))
    b = ordered.add_range_bucket(df, ["ts", "line"], k)
    sizes = [r["count"] for r in b.groupBy("_bucket").count().collect()]
    assert len(sizes) >= k / 2 and max(sizes) <= 3 * n / k
    args = (["run"], "worker", [0, 1, 2, 3, 4], "v", ["ts", "line"])
    wide = ordered.running_latest_sum(df, *args, n_buckets=k).select("line", "total")
    one = ordered.running_latest_sum_single(df, *args).select("line", F.col("total").alias("t2"))
    assert wide.join(one, "line").filter("total <> t2").count() == 0 and wide.count() == n


def test_null_groups_and_missing_origins(spark):
    from fleetstream.operators import timeline as tl
    df = spark.createDataFrame([(None, 1, 10, 0.5, 1), (None, 1, 20, 0.25, 2), ("a", 1, 15, 1.0, 3)],
                               "run string, worker int, ts_ms long, cpu double, line_id long")
    out = tl.cluster_running_total(df, [1])
    assert sorted(r.cluster_cpu for r in out.collect()) == [0.25, 0.5, 1.0]
    ranked = ordered.rank_and_previous(df, ["run"], ["ts_ms", "line_id"], ["cpu"], total_col="n")
    assert sorted((r.line_id, r._rank, r.n, r.prev_cpu) for r in ranked.collect()) == \
        [(1, 1, 2, None), (2, 2, 2, 0.5), (3, 1, 1, None)]
    origins = spark.createDataFrame([(None, 10.0)], "run string, origin double")
    t = {r.line_id: r.t for r in tl.rebase(df.withColumn("ts", df.ts_ms.cast("double")), origins).collect()}
    assert t == {1: 0.0, 2: 10.0, 3: None}
    assert tl.trim(df, 12, None, "ts_ms").count() == 2 and tl.trim(df, None, 15, "ts_ms").count() == 2


def test_undeclared_worker_fails(spark):
    import pytest
    from fleetstream.operators import timeline as tl
    df = spark.createDataFrame([("a", 6, 15, 0.9, 3)], "run string, worker int, ts_ms long, cpu double, line_id long")
    with pytest.raises(Exception, match="undeclared worker 6"):
        tl.cluster_running_total(df, [1, 2]).collect()


def test_splice_is_in_order(spark):
    """O1: rows come in time order, ties by worker, then by line."""
    from fleetstream.operators import timeline as tl
    rows = [("r", w, k, 1000 + k // 3) for k in range(40) for w in (3, 1, 2)]
    df = spark.createDataFrame(rows, "run string, worker int, line_id long, ts_ms long").repartition(4)
    got = [(r.ts_ms, r.worker, r.line_id) for r in tl.splice_workers(df).collect()]
    assert got == sorted(got) and len(got) == len(rows)


def test_null_order_values_come_first(spark):
    """A NULL time, or a NULL tie, sorts first, as in a window; a NULL value changes nothing."""
    rnd = random.Random(11)
    some = lambda x, p: None if rnd.random() < p else x
    rows = [(f"r{rnd.randrange(2)}", some(rnd.randrange(300), .1), rnd.randrange(4), some(rnd.random(), .2), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "run string, ts long, worker int, v double, line long")
    for order in (["ts", "worker", "line"], ["ts", "line"]):
        args = (["run"], "worker", [0, 1, 2, 3], "v", order)
        a = ordered.running_latest_sum(df, *args, n_buckets=9).select("line", F.col("total").alias("a"))
        b = ordered.running_latest_sum_single(df, *args).select("line", F.col("total").alias("b"))
        assert a.join(b, "line").filter(F.col("a") != F.col("b")).count() == 0 and a.count() == 3000
    from pyspark.sql import Window
    got = ordered.rank_and_previous(df, ["run"], ["ts", "line"], ["worker"], rank_col="t", n_buckets=9)
    w = Window.partitionBy("run").orderBy("ts", "line")
    ref = df.select("line", F.row_number().over(w).alias("t2"), F.lag("worker").over(w).alias("p2"))
    assert got.join(ref, "line").filter((F.col("t") != F.col("t2")) | ~F.col("prev_worker").eqNullSafe(F.col("p2"))).count() == 0


def test_open_workers_equal_declared_ones(spark):
    """The sum of changes is the sum of latest values, exact where those are."""
    rnd = random.Random(12)
    rows = [(f"r{rnd.randrange(2)}", some, rnd.randrange(40), rnd.choice([None, rnd.randrange(100) / 64]), i)
            for i in range(4000) for some in (rnd.choice([None, rnd.randrange(500)]),)]
    df = spark.createDataFrame(rows, "run string, ts long, worker int, v double, line long")
    a = ordered.running_latest_sum_open(df, ["run"], "worker", "v", ["ts", "worker", "line"], n_buckets=7).select("line", F.col("total").alias("a"))
    b = ordered.running_latest_sum_single(df, ["run"], "worker", list(range(40)), "v", ["ts", "worker", "line"]).select("line", F.col("total").alias("b"))
    assert a.join(b, "line").filter(F.col("a") != F.col("b")).count() == 0 and a.count() == 4000
    one = spark.createDataFrame([("r", 1, 0, 0.1 + 0.2, 0), ("r", 2, 0, 1e-3, 1)], df.schema)
    got = ordered.running_latest_sum_open(one, ["run"], "worker", "v", ["ts", "line"]).orderBy("ts").collect()
    assert [r.total for r in got] == [0.1 + 0.2, 1e-3]  # a value alone comes back as it was


def test_load_rate_over_time(spark):
    df = spark.createDataFrame([("a", t, i, q) for i, (t, q) in enumerate([(0, 0), (500, 4), (500, 9), (4500, 1), (None, 3)])],
                               "series string, ts_ms long, event_id long, queue int")
    got = {r.event_id: r.rate for r in tl.load_rate(df, time_col="ts_ms").collect()}
    assert got == {4: None, 0: None, 1: 8.0, 2: None, 3: -2.0}  # no time, first, half a second, no time passed, four seconds


def test_makespan_without_a_start(spark):
    comp = spark.createDataFrame([("r", 10), ("s", 20), (None, 30)], "run string, completed_s long")
    starts = spark.createDataFrame([("r", 4000)], "run string, ts_ms long")
    got = {r.run: (r.n_tasks, r.makespan_s) for r in tl.makespan(comp, starts).collect()}
    assert got == {"r": (1, 6.0), "s": (1, None), None: (1, None)}
