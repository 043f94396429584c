"""Parser units on the literal lines of the recorded logs (FIXTURES A1-A5)."""

import pytest
from pyspark.sql import functions as F

from fleetstream.functions import formats, parsers


def parse(spark, lines, fn):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    return [r.p for r in df.select("i", fn("line").alias("p")).orderBy("i").collect()]


def test_core_old_format(spark):
    rows = parse(spark, [
        "2 -  1582039274007mS since epoch",
        "40 -  1582038366040mS since epoch",
        " -  1582039289557mS since epoch",
        "garbage",
    ], parsers.parse_core_line)
    assert [(r.ok, r.cores, r.ts_ms) for r in rows] == [
        (True, 2, 1582039274007), (True, 40, 1582038366040),
        (True, None, 1582039289557), (False, None, None)]
    assert rows[0].ts == 1582039274007 / 1000


def test_core_per_worker_format(spark):
    rows = parse(spark, [
        "6,7,6,6,6, -  1582207056333mS since epoch",
        "0,0,0,0,0, -  1582207056333mS since epoch",
        " -  1582207056333mS since epoch",
        "6,7 -  1mS",
    ], parsers.parse_core_list_line)
    assert rows[0].ok and rows[0].cores == [6, 7, 6, 6, 6]
    assert rows[1].cores == [0, 0, 0, 0, 0]
    assert rows[2].ok and rows[2].cores == []  # unreachable page: empty, not an error
    assert not rows[3].ok


def test_cpu_lines_recorded(spark):
    lines = [
        "%Cpu(s):  0.8 us,  0.1 sy,  0.0 ni, 99.0 id,  0.1 wa,  0.0 hi,  0.0 si,  0.0 st",
        "%Cpu(s):  0.0 us,  1.1 sy,  0.0 ni, 98.9 id,  0.0 wa,  0.0 hi,  0.0 si,  0.0 st -  1574326357947mS since epoch",
        "%Cpu(s):  0.0 us,  0.0 sy,  0.0 ni,100.0 id,  0.0 wa,  0.0 hi,  0.0 si,  0.0 st -  1574326359577mS since epoch",
    ]
    rows = parse(spark, lines, parsers.parse_cpu_line)
    assert [r.ok for r in rows] == [False, True, True]  # first burst line has no stamp
    assert rows[1].cpu == (0.0 + 1.1) / 100 and rows[1].ts_ms == 1574326357947
    assert rows[2].id == 100.0 and rows[2].cpu == 0.0  # 'ni,100.0 id' parses


def test_bad_line_policy(spark):
    df = spark.createDataFrame([("2 -  1mS",), ("x",)], "line string")
    parsed = df.withColumn("p", parsers.parse_core_line("line"))
    assert parsers.keep_parsed(parsed, "p").count() == 1
    assert parsers.keep_parsed(parsed, "p", mode="keep").count() == 2
    with pytest.raises(Exception, match="does not match"):
        parsers.keep_parsed(parsed, "p", mode="strict").collect()


def test_executor_total_cores(spark):
    js = '[{"id":"driver","totalCores":0},{"id":"1","totalCores":8},{"id":"2","totalCores":8}]'
    df = spark.createDataFrame([(js,), ("[]",)], "j string")
    got = [r.t for r in df.select(parsers.executor_total_cores("j").alias("t")).collect()]
    assert got == [16, 0]
    # The same sum relationally
    rel = (df.limit(1).select(F.explode(F.from_json("j", "array<struct<id:string,totalCores:int>>")).alias("e"))
           .agg(F.sum("e.totalCores")).first()[0])
    assert rel == 16


def test_status_page_cells(spark):
    html = "\n".join(["<tr>", "<td>8 (0 Used)</td>", "<td>8 (3 Used)</td>", "<td>16 (2 Used)</td>",
                      "<td>8 (0 Used)</td>", "<td>8 (7 Used)</td>", "<td>8 (0 Used)</td>"])
    df = spark.createDataFrame([(html,), ("<html></html>",)], "h string")
    got = [r.j for r in df.select(parsers.matches_joined("h").alias("j")).collect()]
    assert got == ["0,3,0,7,0,", ""]


def test_completion_line_roundtrip(spark):
    df = spark.createDataFrame([(1588708133,)], "s long")
    line = df.select(parsers.completion_line("s").alias("l")).first().l
    assert line == "cellprofiler completed: 1588708133"
    back = spark.createDataFrame([(line,)], "l string").select(
        parsers.parse_completion_line("l").alias("p")).first().p
    assert back.ok and back.completed_s == 1588708133


def test_metric_lines_roundtrip(spark):
    """K2 lines parse back to the written values (P1-P3 inverse)."""
    df = spark.range(0, 3000).select(
        "id",
        ((F.col("id") * 7) % 1001 / 10).alias("us"), ((F.col("id") * 13) % 1001 / 10).alias("sy"),
        (F.lit(1574326357947) + F.col("id") * 977).alias("ts_ms"),
        F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise((F.col("id") % 41).cast("int")).alias("cores"),
        F.array(*[((F.col("id") + i) % 9).cast("int") for i in range(5)]).alias("lst"))
    z = F.lit(0.0)
    out = df.select(
        "*",
        parsers.parse_cpu_line(formats.cpu_line("us", "sy", z, z, z, z, z, z, "ts_ms")).alias("c"),
        parsers.parse_core_line(formats.core_line("cores", "ts_ms")).alias("k"),
        parsers.parse_core_list_line(formats.core_list_line("lst", "ts_ms")).alias("w"))
    bad = out.filter(~F.col("c.ok") | (F.col("c.us") != F.col("us")) | (F.col("c.sy") != F.col("sy"))
                     | (F.col("c.ts_ms") != F.col("ts_ms")) | ~F.col("k.ok")
                     | ~F.col("k.cores").eqNullSafe(F.col("cores")) | (F.col("w.cores") != F.col("lst"))
                     | (F.col("w.ts_ms") != F.col("ts_ms")))
    assert bad.count() == 0


def test_cpu_line_layout_matches_top(spark):
    z = F.lit(0.0)
    line = spark.range(1).select(formats.cpu_line(F.lit(0.0), F.lit(1.1), z, F.lit(98.9), z, z, z, z,
                                                  F.lit(1574326357947)).alias("l")).first().l
    assert line == ("%Cpu(s):  0.0 us,  1.1 sy,  0.0 ni, 98.9 id,  0.0 wa,  0.0 hi,  0.0 si,"
                    "  0.0 st -  1574326357947mS since epoch")


def test_cpu_line_equals_stated_format(spark):
    vals = [(0.8, 0.1, 0.0, 99.0, 0.1, 0.0, 0.0, 0.0, 1574326357947),
            (12.3, 45.6, 0.0, 42.1, 0.0, 0.0, 0.0, 0.0, 1),
            (100.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 99)]
    df = spark.createDataFrame(vals, ", ".join(f"c{i} double" for i in range(8)) + ", ts long")
    got = [r.l for r in df.select(formats.cpu_line(*[f"c{i}" for i in range(8)], "ts").alias("l")).collect()]
    assert got == [formats.CPU_LINE_FORMAT % v for v in vals]
