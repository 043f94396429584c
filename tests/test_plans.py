"""Physical-plan checks: the properties the scale design relies on."""

import contextlib
import io
import re

from conftest import SF_SMALL
from fleetstream.plans import catalog


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


def test_parsers_have_no_python(spark):
    for name in ("cpu_log", "core_log", "core_log_workers", "executor_cores", "page_counts",
                 "message_decode", "metric_lines"):
        p = plan(catalog.QUERIES[name](spark, SF_SMALL))
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_listing_does_not_read_contents(spark):
    p = plan(catalog.QUERIES["file_listing"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", p)
    assert schemas and all("content" not in s for s in schemas)


def test_running_total_window_is_bucketed(spark):
    p = plan(catalog.QUERIES["cluster_cpu"](spark, SF_SMALL))
    specs = re.findall(r"Arguments: \[[^\n]*\], \[([^\]]*)\], \[", p)
    windows = [s for s in specs]
    assert windows, p
    # the window over the big table is partitioned by (run, bucket); only the
    # small per-bucket carry table is windowed by run alone
    assert any("_bucket" in s for s in windows)


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(catalog.QUERIES["default_share"](spark, SF_SMALL))
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in p or \
        "ReadSchema: struct<p_partkey:bigint,p_size:int,p_retailprice:double>" in p
    p = plan(catalog.QUERIES["page_counts"](spark, SF_SMALL))
    assert "ReadSchema: struct<page_id:bigint,html:string>" in p


def exchanges(df) -> int:
    tree = plan(df).split("\n\n")[0]
    return len(re.findall(r"[+-] Exchange\b", tree)) + len(re.findall(r"^Exchange\b", tree, re.M))


def test_one_batch_is_shuffled_at_most_twice(spark):
    """X1 on the stream: one sort numbers the rows, one exchange deals them."""
    from pyspark.sql import functions as F
    from fleetstream.operators import slices
    df = spark.range(268).select(F.timestamp_seconds("id").alias("m"), F.col("id").cast("string").alias("path")).persist()
    df.count()
    assert exchanges(slices.balanced_partitions(df, ["m", "path"], 268, 40)) <= 2


def test_metric_lines_scan_once(spark):
    p = plan(catalog.QUERIES["metric_lines"](spark, SF_SMALL))
    assert len(re.findall(r"\(\d+\) Scan parquet", p)) == 1


def test_ordered_scan_shuffles_the_rows_once(spark):
    """Rows and heads on (run, bucket); the summaries on the same keys and on the run.  No join."""
    df = catalog.QUERIES["cluster_cpu"](spark, SF_SMALL)
    assert exchanges(df) <= 3 and "Join" not in plan(df)
    assert "Join" not in plan(catalog.QUERIES["load_rate"](spark, SF_SMALL))
