"""The log analyses of the measured cluster, end to end, on real log folders.

Layout (as the pollers and the copy step leave it)::

    <data>/<run>/master/cores.log        core counts (old or per-worker format)
    <data>/<run>/worker<i>/cpu.log       `top` lines of worker i

``cluster_series`` is the whole-cluster figure: running total of the
workers' latest CPU (W1) in core equivalents (M3) and the executor cores,
both on the clock of the first CPU sample (W2), trimmed (F6).
``worker_series`` is the per-worker figure: allocated cores / 8 against
measured CPU per worker, on the clock of the first cores sample (W2, A2, M4,
U3), in the viewed range (F7).  Both return long tables ``(run, series,
worker, t, value)`` that ``sinks.write_series`` stores (K3).

Ties in time are broken by worker, then by line order in the file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import parsers
from ..functions.parsers import keep_parsed
from ..operators import timeline as tl
from ..session import materialize
from ..sources.logs import scan_logs

ORDER = ["ts_ms", "worker", "block_start", "line_key"]


CPU_FILES = "worker*/cpu.log"
CORE_FILES = "master/cores.log"


def cpu_samples(spark: SparkSession, data: str, runs: str = "*", mode: str = "drop",
                files: str = CPU_FILES, counts: Observation | None = None) -> DataFrame:
    """P3 over ``<data>/<run>/worker*/cpu.log``; worker index from the host name."""
    lines = scan_logs(spark, data, f"{runs}/{files}")
    parsed = keep_parsed(lines.withColumn("p", parsers.parse_cpu_line("line")), "p", mode, counts)
    return parsed.select(
        "run", "host",
        F.coalesce(F.regexp_extract("host", r"([0-9]+)$", 1).try_cast("int"), F.raise_error(
            F.concat(F.lit("fleetstream: no worker number in host name "), "host"))).alias("worker"),
        "block_start", "line_key", "p.ts_ms", "p.ts", "p.cpu")


def core_samples(spark: SparkSession, data: str, runs: str = "*", per_worker: bool = False,
                 mode: str = "drop", files: str = CORE_FILES, counts: Observation | None = None) -> DataFrame:
    """P1 (old format, ``cores`` int or NULL) or P2 (``cores`` int array) over
    ``<data>/<run>/master/cores.log``.  The format is an argument: both
    patterns accept an empty count, so it cannot be guessed per line."""
    lines = scan_logs(spark, data, f"{runs}/{files}")
    fn = parsers.parse_core_list_line if per_worker else parsers.parse_core_line
    parsed = keep_parsed(lines.withColumn("p", fn("line")), "p", mode, counts)
    return parsed.select("run", "block_start", "line_key", "p.ts_ms", "p.ts", "p.cores")


def bad_lines(spark: SparkSession, data: str, runs: str = "*", per_worker: bool = False,
              cpu_files: str = CPU_FILES, core_files: str = CORE_FILES) -> DataFrame:
    """Lines that the parsers drop: ``(run, host, log, n_lines, n_bad)``."""
    fn = parsers.parse_core_list_line if per_worker else parsers.parse_core_line
    cpu = scan_logs(spark, data, f"{runs}/{cpu_files}").select(
        "run", "host", F.lit("cpu").alias("log"), parsers.parse_cpu_line("line")["ok"].alias("ok"))
    core = scan_logs(spark, data, f"{runs}/{core_files}").select(
        "run", "host", F.lit("cores").alias("log"), fn("line")["ok"].alias("ok"))
    return cpu.unionByName(core).groupBy("run", "host", "log").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum((~F.col("ok")).cast("bigint")).alias("n_bad"))


def cluster_series(spark: SparkSession, data: str, runs: str = "*",
                   workers: Sequence[int] | None = None,
                   start: float | None = None, end: float | None = None,
                   total_cores: int | None = None, cpu_files: str = CPU_FILES,
                   core_files: str = CORE_FILES, mode: str = "drop",
                   cores_per_worker: int = tl.CORES_PER_WORKER,
                   counts: tuple[Observation, Observation] | None = None) -> DataFrame:
    """``workers``: those to sum, in that order; None: all in the logs.  A
    sample of any other fails the job.  A run without CPU samples is on the
    clock of its first cores sample.  ``counts``: lines and bad lines of the CPU
    and of the cores logs, counted as they are read (there when this returns)."""
    cpu_counts, core_counts = counts or (None, None)
    # parsed once and written as a table in the shared checkpoint folder:
    # the bucketed running total reads its input three times
    cpu = materialize(cpu_samples(spark, data, runs, mode, files=cpu_files, counts=cpu_counts), "cpu-samples")
    core = materialize(core_samples(spark, data, runs, mode=mode, files=core_files, counts=core_counts), "core-samples")
    n_workers = cpu.select("worker").distinct().count() if workers is None else len(workers)
    if total_cores is None:
        total_cores = cores_per_worker * n_workers
    first = tl.origins_of(cpu).withColumn("first", F.lit(0)).unionByName(tl.origins_of(core).withColumn("first", F.lit(1)))
    origin = first.groupBy("run").agg(F.min_by("origin", "first").alias("origin"))
    cores = tl.rebase(core, origin).select(
        "run", F.lit("cores").alias("series"), F.lit(None).cast("int").alias("worker"), "t",
        F.col("cores").cast("double").alias("value"))
    out = cores
    if n_workers:
        total = tl.cluster_running_total(cpu, workers, value_col="cpu", out="cluster_cpu", order_cols=ORDER)
        out = tl.rebase(total, origin).select(
            "run", F.lit("cpu").alias("series"), F.lit(None).cast("int").alias("worker"), "t",
            tl.core_equivalents(F.col("cluster_cpu"), n_workers, total_cores).alias("value")).unionByName(cores)
    return tl.trim(out, start, end)


def worker_series(spark: SparkSession, data: str, runs: str = "*",
                  start: float | None = None, end: float | None = None,
                  cores_per_worker: int = tl.CORES_PER_WORKER, cpu_files: str = CPU_FILES,
                  core_files: str = CORE_FILES, mode: str = "drop") -> DataFrame:
    lists = materialize(core_samples(spark, data, runs, per_worker=True, mode=mode, files=core_files), "core-lists")
    cpu = cpu_samples(spark, data, runs, mode, files=cpu_files)
    origin = tl.origins_of(lists)
    alloc = tl.rebase(tl.per_worker_cores(lists), origin).select(
        "run", F.lit("allocated").alias("series"), "worker", "t",
        tl.allocated_fraction(F.col("cores"), cores_per_worker).alias("value"))
    measured = tl.rebase(cpu, origin).select(
        "run", F.lit("measured").alias("series"), "worker", "t", F.col("cpu").alias("value"))
    return tl.view_range(alloc.unionByName(measured), start, end)
