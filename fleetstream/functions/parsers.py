"""Log line parsers as Column expressions.

Every parser returns a struct whose ``ok`` field says whether the line has
the expected shape.  ``ok`` comes from ``rlike``: ``regexp_extract`` gives
``''`` both for "no match" and "empty group", so it cannot tell them apart.
All work stays in JVM expressions (codegen); there is no Python UDF here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Line formats written by the pollers of the measured cluster.
# They must stay as they are to read the same lines.
# core count, old format:   "2 -  1582039274007mS since epoch"
CORES_OLD_PATTERN = r"^([0-9]+)? -  ([0-9]+)mS"
# core count per worker:    "6,7,6,6,6, -  1582207056333mS since epoch"
CORES_PER_WORKER_PATTERN = r"^(([0-9]+,)*) -  ([0-9]+)mS"
# CPU line from `top`, eight percentages then the stamp
CPU_FIELDS = ("us", "sy", "ni", "id", "wa", "hi", "si", "st")
CPU_PATTERN = (r"^%Cpu\(s\):\s*([0-9\.]+)\s*us,\s*([0-9\.]+)\s*sy,\s*([0-9\.]+)\s*ni,"
               r"\s*([0-9\.]+)\s*id,\s*([0-9\.]+)\s*wa,\s*([0-9\.]+)\s*hi,\s*([0-9\.]+)\s*si,"
               r"\s*([0-9\.]+)\s*st\s*-\s*([0-9]+)mS")
# completion line of an external task
COMPLETION_PREFIX = "cellprofiler completed: "
# worker table cell on the master status page: "<td>8 (3 Used)</td>"
USED_CORES_CELL_PATTERN = r"<td>8 \(([0-9]) Used\)</td>"
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ms_to_seconds(ms) -> Column:
    """M1: epoch milliseconds -> float seconds (``int / 1000``)."""
    return _col(ms) / F.lit(1000)


def parse_core_line(line) -> Column:
    """P1 + M6: ``<cores>? -  <ms>mS``; a missing count is NULL."""
    line = _col(line)
    cores_txt = F.regexp_extract(line, CORES_OLD_PATTERN, 1)
    ts_ms = F.regexp_extract(line, CORES_OLD_PATTERN, 2).try_cast("bigint")
    return F.struct(
        (line.rlike(CORES_OLD_PATTERN) & ts_ms.isNotNull()
         & ((cores_txt == "") | cores_txt.try_cast("int").isNotNull())).alias("ok"),
        F.nullif(cores_txt, F.lit("")).try_cast("int").alias("cores"),
        ts_ms.alias("ts_ms"),
        ms_to_seconds(ts_ms).alias("ts"),
    )


def parse_core_list_line(line) -> Column:
    """P2 + A1: ``c1,c2,...,cn, -  <ms>mS`` -> int array (empty list -> [])."""
    line = _col(line)
    listed = F.regexp_extract(line, CORES_PER_WORKER_PATTERN, 1)
    parts = F.filter(F.split(listed, ","), lambda x: x != F.lit(""))
    ts_ms = F.regexp_extract(line, CORES_PER_WORKER_PATTERN, 3).try_cast("bigint")
    return F.struct(
        (line.rlike(CORES_PER_WORKER_PATTERN) & ts_ms.isNotNull()
         & F.forall(parts, lambda x: x.try_cast("int").isNotNull())).alias("ok"),
        F.transform(parts, lambda x: x.try_cast("int")).alias("cores"),
        ts_ms.alias("ts_ms"),
        ms_to_seconds(ts_ms).alias("ts"),
    )


def parse_cpu_line(line) -> Column:
    """P3 + M2: eight percentages and the stamp; cpu = (us + sy) / 100.

    ``rlike`` checks the whole shape; the nine numbers are then the first
    nine runs of ``[0-9.]`` in the line (the labels hold none), taken with a
    single ``regexp_extract_all`` instead of one regex pass per field."""
    line = _col(line)
    ok = line.rlike(CPU_PATTERN)
    nums = F.regexp_extract_all(line, F.lit(r"([0-9\.]+)"), 1)
    fields = [F.get(nums, i).try_cast("double").alias(name) for i, name in enumerate(CPU_FIELDS)]
    ts_ms = F.get(nums, len(CPU_FIELDS)).try_cast("bigint")
    us = F.get(nums, 0).try_cast("double")
    sy = F.get(nums, 1).try_cast("double")
    numbers = F.slice(nums, 1, len(CPU_FIELDS))
    return F.struct(
        (ok & ts_ms.isNotNull() & F.forall(numbers, lambda x: x.try_cast("double").isNotNull())).alias("ok"),
        *fields,
        ts_ms.alias("ts_ms"),
        ms_to_seconds(ts_ms).alias("ts"),
        ((us + sy) / F.lit(100)).alias("cpu"),
    )


def parse_completion_line(line, prefix: str = COMPLETION_PREFIX) -> Column:
    """P12 (read side): ``<prefix><epoch seconds>``."""
    line = _col(line)
    pattern = "^" + _quote(prefix) + r"([0-9]+)$"
    return F.struct(
        (line.rlike(pattern) & F.regexp_extract(line, pattern, 1).try_cast("bigint").isNotNull()).alias("ok"),
        F.regexp_extract(line, pattern, 1).try_cast("bigint").alias("completed_s"),
    )


def completion_line(seconds, prefix: str = COMPLETION_PREFIX) -> Column:
    """P12 (write side)."""
    return F.concat(F.lit(prefix), _col(seconds).cast("string"))


def executor_total_cores(json_text) -> Column:
    """``reduce .[] as $item (0; . + $item.totalCores)`` over the executor list."""
    items = F.from_json(_col(json_text), "array<struct<id:string,totalCores:int>>")
    return F.aggregate(items, F.lit(0).cast("bigint"),
                       lambda acc, x: acc + F.coalesce(x["totalCores"], F.lit(0)))


def matches_joined(text, pattern: str = USED_CORES_CELL_PATTERN, group: int = 1) -> Column:
    """P5: every match of ``pattern`` (group ``group``), joined by ',' with a
    trailing comma; no match gives ``''`` (as ``tr '\\n' ','`` on no output)."""
    found = F.regexp_extract_all(_col(text), F.lit(pattern), group)
    return F.when(F.size(found) == 0, F.lit("")).otherwise(
        F.concat(F.array_join(found, ","), F.lit(",")))


def keep_parsed(df, parsed_col: str = "p", mode: str = "drop", counts=None):
    """Bad-line policy: ``drop`` keeps ``ok`` rows, ``strict`` raises on the
    first bad row (``raise_error`` inside the job, no collect), ``keep`` keeps
    all rows with the flag.  ``counts``: an ``Observation`` that gets
    ``n_lines`` and ``n_bad`` from the pass that reads the lines."""
    ok = F.col(f"{parsed_col}.ok")
    if counts is not None:
        df = df.observe(counts, F.count(F.lit(1)).alias("n_lines"), F.count(F.when(~ok, 1)).alias("n_bad"))
    if mode == "drop":
        return df.filter(ok)
    if mode == "strict":
        return df.withColumn(
            parsed_col,
            F.when(ok, F.col(parsed_col)).otherwise(
                F.raise_error(F.lit("fleetstream: line does not match the log format"))
            ),
        )
    if mode == "keep":
        return df
    raise ValueError(f"unknown mode {mode!r}")


def _quote(text: str) -> str:
    out = []
    for ch in text:
        out.append("\\" + ch if ch in r".^$*+?()[]{}|\-" else ch)
    return "".join(out)
