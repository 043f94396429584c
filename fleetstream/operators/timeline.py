"""Cluster and per-worker timelines from parsed log samples.

Inputs are long tables ``(run, worker, line_id, ts_ms, ts, value)``; the
operators keep that shape (no wide pivots of the whole series), so a run
with many workers or a very long run stays spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import join_groups, rank_and_previous, running_latest_sum, running_latest_sum_open

# Load-rate and share parameters of the scaling manager
# (names and defaults as published with the reference).
DEFAULT_CPU_SHARE = 0.125
LOWER_RATE_LIMIT = 2
UPPER_RATE_LIMIT = 5
SLOWDOWN_RATE = -2
QUEUE_SIZE_LIMIT = 10
LARGE_SCALEUP_AMOUNT = 2
SMALL_SCALEUP_AMOUNT = 1
# measured cluster: 5 workers of 8 cores
CORES_PER_WORKER = 8
N_WORKERS = 5
TOTAL_CORES = 40


def splice_workers(traces: DataFrame, order_cols: Sequence[str] = ("ts_ms", "worker", "line_id"),
                   group_cols: Sequence[str] = ("run",)) -> DataFrame:
    """U1 + O1: all workers' traces in one table, in time order; ties keep the
    worker order, then the line order (explicit keys: Spark sorts are not
    stable).  A global sort is range-partitioned, so it scales."""
    return traces.orderBy(*group_cols, *order_cols)


def cluster_running_total(samples: DataFrame, workers: Sequence[int] | None,
                          value_col: str = "cpu", out: str = "cluster_cpu",
                          group_cols: Sequence[str] = ("run",),
                          order_cols: Sequence[str] = ("ts_ms", "worker", "line_id"),
                          n_buckets: int | None = None) -> DataFrame:
    """W1 + G3: at every sample, the sum over ``workers`` (in that order) of
    each worker's latest value; a worker not seen yet counts 0.  A sample of a
    worker outside of ``workers`` fails the job: its share would be missing.
    ``workers`` None: all that there are, however many, summed exactly."""
    if workers is None:
        return running_latest_sum_open(samples, group_cols, "worker", value_col, order_cols, out=out, n_buckets=n_buckets)
    known = F.col("worker").isin(list(workers))
    samples = samples.withColumn("worker", F.when(known, F.col("worker")).otherwise(F.raise_error(F.concat(
        F.lit("fleetstream: sample of an undeclared worker "), F.coalesce(F.col("worker").cast("string"), F.lit("NULL"))))))
    return running_latest_sum(samples, group_cols, "worker", workers, value_col,
                              order_cols, out=out, n_buckets=n_buckets)


def core_equivalents(total: Column, n_workers: int = N_WORKERS,
                     total_cores: int = TOTAL_CORES) -> Column:
    """M3: cluster CPU in cores: ``sum / n_workers * total_cores`` (this order)."""
    return total / F.lit(n_workers) * F.lit(total_cores)


def allocated_fraction(cores: Column, cores_per_worker: int = CORES_PER_WORKER) -> Column:
    """M4: allocated share of a worker: ``cores / 8``."""
    return cores / F.lit(cores_per_worker)


def per_worker_cores(core_lists: DataFrame, cores_col: str = "cores") -> DataFrame:
    """A2: per-worker rows from the per-worker core list (worker = position + 1).
    An empty list (page unreachable) gives no rows."""
    keep = [c for c in core_lists.columns if c != cores_col]
    return core_lists.select(*keep, F.posexplode(cores_col).alias("_pos", "cores")).select(
        *keep, (F.col("_pos") + 1).cast("int").alias("worker"), "cores")


def rebase(df: DataFrame, origins: DataFrame, ts_col: str = "ts", out: str = "t",
           on: Sequence[str] = ("run",)) -> DataFrame:
    """``t = ts - origin`` with a per-run origin table ``(run, origin)``.
    The origin may come from another series (cluster view: first CPU sample;
    per-worker view: first cores sample).  A run without an origin keeps its
    rows, with ``t`` NULL."""
    return join_groups(df, F.broadcast(origins.select(*on, "origin")), list(on), "left").withColumn(
        out, F.col(ts_col) - F.col("origin")).drop("origin")


def origins_of(df: DataFrame, ts_col: str = "ts", on: Sequence[str] = ("run",)) -> DataFrame:
    """First timestamp per run (reference: row 0 of the time-sorted series =
    its minimum).  Partial aggregation; the result has one row per run."""
    return df.groupBy(*on).agg(F.min(ts_col).alias("origin"))


def trim(df: DataFrame, start: float | None, end: float | None, t_col: str = "t") -> DataFrame:
    """``start < t <= end`` (plain range; see README for the argmax
    quirk).  A bound of None trims nothing on its side."""
    if start is not None:
        df = df.filter(F.col(t_col) > F.lit(start))
    return df if end is None else df.filter(F.col(t_col) <= F.lit(end))


def view_range(df: DataFrame, start: float | None, end: float | None, t_col: str = "t") -> DataFrame:
    """the figure's closed x range ``[start, end]``; None leaves a side open."""
    if start is not None:
        df = df.filter(F.col(t_col) >= F.lit(start))
    return df if end is None else df.filter(F.col(t_col) <= F.lit(end))


def overlay(allocated: DataFrame, measured: DataFrame,
            cols: Sequence[str] = ("run", "worker", "line_id", "t", "value")) -> DataFrame:
    """Allocated and measured series on one axis, tagged by ``series``.
    An overlay, not a join: the two clocks are never aligned."""
    a = allocated.select(*cols, F.lit("allocated").alias("series"))
    m = measured.select(*cols, F.lit("measured").alias("series"))
    return a.unionByName(m)


def cores_over_executors(polls: DataFrame, json_col: str, keys: Sequence[str]) -> DataFrame:
    """Total cores of each poll, summed over one row for each executor of
    its list; a poll whose list is empty or no JSON has NULL."""
    items = F.from_json(F.col(json_col), "array<struct<id:string,totalCores:int>>")
    rows = polls.select(*keys, F.explode_outer(items).alias("x"))
    return rows.groupBy(*keys).agg(F.sum(F.col("x.totalCores").cast("bigint")).alias("total_cores"))


def last_of_burst(lines: DataFrame, burst_cols: Sequence[str], order_col: str,
                  line_col: str = "line", marker: str = "Cpu(s)") -> DataFrame:
    """F8: ``grep marker | tail -n 1`` per burst: among the lines holding
    ``marker``, keep the last one of each burst.  Bursts are small groups;
    Spark plans the rank filter as a group limit before the shuffle."""
    w = Window.partitionBy(*burst_cols).orderBy(F.col(order_col).desc())
    return (lines.filter(F.col(line_col).contains(marker))
            .withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") == 1).drop("_rn"))


def makespan(completions: DataFrame, starts: DataFrame,
             on: Sequence[str] = ("run",)) -> DataFrame:
    """Per run, last completion (s) minus copy start (ms / 1000).  A run
    without a start keeps its row, start and makespan NULL."""
    done = completions.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.max("completed_s").alias("last_completed_s"))
    start = starts.groupBy(*on).agg(F.min("ts_ms").alias("start_ms"))
    return join_groups(done, start, list(on), "left").withColumn(
        "makespan_s", F.col("last_completed_s") - F.col("start_ms") / F.lit(1000))


def load_rate(queues: DataFrame, series_cols: Sequence[str] = ("series",),
              order_cols: Sequence[str] = ("ts_ms", "event_id"), queue_col: str = "queue",
              lower: float = LOWER_RATE_LIMIT, upper: float = UPPER_RATE_LIMIT,
              slowdown: float = SLOWDOWN_RATE, queue_limit: int = QUEUE_SIZE_LIMIT,
              large: int = LARGE_SCALEUP_AMOUNT, small: int = SMALL_SCALEUP_AMOUNT,
              n_buckets: int | None = None, time_col: str | None = None, unit_s: float = 0.001) -> DataFrame:
    """``t`` = row number in time order, ``rate = dqueue / dt`` against the
    previous sample (dt in seconds, from ``time_col`` in units of ``unit_s``;
    without one samples count as a second apart; no rate where no time has
    passed or it isn't known), and the load class:
    slowdown if rate <= slowdown; large if rate >= upper; small if rate >=
    lower, or queue > queue_limit and rate > slowdown; else steady.  First
    sample (no rate): small if queue > queue_limit, else steady."""
    times = [time_col] if time_col and time_col != queue_col else []
    ranked = rank_and_previous(queues, series_cols, order_cols, prev_cols=[queue_col, *times],
                               rank_col="t", n_buckets=n_buckets)
    q = F.col(queue_col)
    prev_q = F.col(f"prev_{queue_col}")
    dt = (F.col(time_col) - F.col(f"prev_{time_col}")).cast("double") * F.lit(unit_s) if times else F.lit(1.0)
    rate = F.when(prev_q.isNotNull() & (dt > 0), (q - prev_q).cast("double") / dt)
    over_limit = q > F.lit(queue_limit)
    action = (
        F.when(F.col("rate").isNull(), F.when(over_limit, "small").otherwise("steady"))
        .when(F.col("rate") <= F.lit(slowdown), "slowdown")
        .when(F.col("rate") >= F.lit(upper), "large")
        .when((F.col("rate") >= F.lit(lower)) | (over_limit & (F.col("rate") > F.lit(slowdown))),
              "small")
        .otherwise("steady")
    )
    amount = (F.when(F.col("action") == "large", F.lit(large))
              .when(F.col("action") == "small", F.lit(small)).otherwise(F.lit(0)))
    return (ranked.withColumn("rate", rate).withColumn("action", action)
            .withColumn("amount", amount).drop(f"prev_{queue_col}", *(f"prev_{c}" for c in times)))


def default_share(requests: DataFrame, profiles: DataFrame, image_col: str = "image",
                  cpu_col: str = "cpu", default: float = DEFAULT_CPU_SHARE,
                  units: float = 1.0) -> DataFrame:
    """CPU share per requested image: mean of its profile samples, or the
    default share for images not profiled yet (left join + coalesce).

    ``cpu_col`` may hold integer units (``units`` per core): the sum is then
    exact and the mean does not depend on the order of the partial sums."""
    prof = profiles.groupBy(image_col).agg(
        (F.sum(cpu_col).cast("double") / F.count(cpu_col) / F.lit(units)).alias("_mean"))
    return (requests.join(prof, on=image_col, how="left")
            .withColumn("share", F.coalesce(F.col("_mean"), F.lit(default)))
            .withColumn("profiled", F.col("_mean").isNotNull())
            .drop("_mean"))


__all__ = [
    "splice_workers", "cluster_running_total", "core_equivalents", "allocated_fraction",
    "per_worker_cores", "rebase", "origins_of", "trim", "view_range", "overlay",
    "cores_over_executors", "last_of_burst", "makespan", "load_rate", "default_share",
]
