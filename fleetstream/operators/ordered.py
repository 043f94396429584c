"""Order-dependent scans that scale: running values without one task per group.

A window ``partitionBy(run).orderBy(ts)`` sends a whole run to one task; if a
run holds a third of the data, so does that task.  The helpers here split the
order into equal-count ranges ("buckets") taken from approximate quantiles
of the leading order column, and compute per-bucket summaries over a small
table (``#groups x #buckets`` rows).  Each row then needs only its own
``(group, bucket)`` partition plus the value carried in from earlier buckets.
That value is a row of its own at the head of the bucket: rows and heads are
shuffled once, on ``(group, bucket)``, and one window reads both, so every
bucket is its own share of the work, at any scale.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"
#: Rows that a bucket holds, about; a window over one is one task's work.
ROWS_PER_BUCKET = 200_000

_NUMBER = ("tinyint", "smallint", "int", "bigint", "float", "double")


def add_range_bucket(df: DataFrame, order_cols: Sequence[str] | str, n_buckets: int | None = None,
                     out: str = BUCKET) -> DataFrame:
    """Equal-count ranges of the order (first column numeric) as an int column.

    The number of buckets follows the row count.  Rows that tie in the first
    column are split by the second one, where that is numeric too: the key is
    the first value plus the second's place between its least and greatest,
    as a fraction under the first column's smallest step of 1.  A tie in the
    key stays in one bucket; the key never goes against the order.  Bounds
    come from ``approxQuantile``: one double for each bucket reaches the
    driver.  The lookup is Spark's binary-search ``Bucketizer``.  Rows without
    a first value have a bucket of their own before all others, where a sort
    puts them.
    """
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    types = dict(df.dtypes)
    first = F.col(order_cols[0]).cast("double")
    tie = order_cols[1] if len(order_cols) > 1 and types[order_cols[1]] in _NUMBER else None
    whole = types[order_cols[0]] in _NUMBER[:4]  # steps of 1: room for a fraction
    tie = tie if whole else None
    low, high = (F.min(tie), F.max(tie)) if tie else (F.lit(0), F.lit(0))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("base"), low.alias("low"), high.alias("high")).first()
    spark = df.sparkSession
    if n_buckets is None:
        n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions", "8")), -(-r["n"] // ROWS_PER_BUCKET))
    key = first - F.lit(r["base"] if r["base"] is not None else 0.0)
    if tie and r["high"] is not None and r["high"] > r["low"]:
        key = key + F.coalesce((F.col(tie) - F.lit(r["low"])) / F.lit(float(r["high"] - r["low"]) * 1.001), F.lit(0.0))
    tmp = out + "_d"
    keyed = df.withColumn(tmp + "_k", key)
    probs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = keyed.approxQuantile(tmp + "_k", probs, 1.0 / (4 * n_buckets)) if probs else []
    inner = sorted({float(b) for b in bounds if b is not None}) or [0.0]
    splits = [float("-inf"), *inner, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol=tmp + "_k", outputCol=tmp,
                          handleInvalid="keep").transform(keyed)
    place = F.when(first.isNull(), F.lit(-1)).otherwise(F.col(tmp).cast("int"))
    return bucketed.withColumn(out, place).drop(tmp, tmp + "_k")


def join_groups(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a table that has one row for each group; a NULL key is a
    group like any other.  Keeps the columns of ``df``."""
    other = small.withColumnsRenamed({c: f"_g_{c}" for c in on})
    cond = None
    for c in on:
        same = F.col(c).eqNullSafe(F.col(f"_g_{c}"))
        cond = same if cond is None else cond & same
    return df.join(other, cond, how).drop(*[f"_g_{c}" for c in on])


_INTEGRAL = ("tinyint", "smallint", "int", "bigint")


def _ordering(df: DataFrame, order_cols: Sequence[str], skip: Sequence[str] = ()) -> Column:
    """Ordering value for ``max_by`` over ``order_cols`` (minus ``skip``,
    columns constant within the aggregation group).

    ``max_by`` with a struct ordering has a buffer Spark can only aggregate by
    sorting.  When the order is at most two integral columns ``(a, b)`` it is
    packed into one ``decimal(38,0)``, ``a' * (2^64 + 2) + b'`` with ``a' = a +
    2^61 + 1``, ``b' = b + 2^63 + 1`` and 0 for a NULL, which comes first.  That
    keeps the order exactly for ``|a| < 2^61`` (epoch milliseconds for
    millions of years) and any ``b``, and lets Spark hash-aggregate."""
    cols = [c for c in order_cols if c not in set(skip)]
    types = dict(df.dtypes)
    if 0 < len(cols) <= 2 and all(types.get(c) in _INTEGRAL for c in cols):
        whole = lambda x: F.lit(str(x)).cast("decimal(38,0)")
        up = lambda c, by: F.coalesce(F.col(c).cast("decimal(38,0)") + whole(by + 1), whole(0))
        if len(cols) == 1:
            return up(cols[0], 2 ** 63).cast("decimal(38,0)")
        a, b = cols
        return (up(a, 2 ** 61) * whole(2 ** 64 + 2) + up(b, 2 ** 63)).cast("decimal(38,0)")
    return F.struct(*[F.col(c) for c in cols])


def running_latest_sum(df: DataFrame, group_cols: Sequence[str], key_col: str,
                       keys: Sequence, value_col: str, order_cols: Sequence[str],
                       out: str = "total", n_buckets: int | None = None) -> DataFrame:
    """W1 (scale form): walk rows of each group in ``order_cols`` order, keep the
    latest ``value_col`` of every key in ``keys`` (0 before the first), and emit
    their sum in the order of ``keys`` at every row.

    1. bucket every row by equal-count ranges of ``order_cols[0]``;
    2. per ``(group, bucket)`` the last value of each key (``max_by``, a
       partial aggregation);
    3. over that small table, the value each key carries *into* a bucket;
    4. per ``(group, bucket)`` window: the latest value so far in the bucket,
       the carried value being its first, else 0.
    """
    group_cols = list(group_cols)
    order_cols = list(order_cols)
    b = add_range_bucket(df, order_cols, n_buckets)
    part = group_cols + [BUCKET]
    order_struct = _ordering(b, order_cols, skip=[key_col])
    key = F.col(key_col)
    there = F.col(value_col).isNotNull()  # a NULL changes no latest value

    last_in_bucket = b.groupBy(*part).agg(*[
        F.max_by(F.when(key == F.lit(k), F.col(value_col)),
                 F.when((key == F.lit(k)) & there, order_struct)).alias(f"_last{i}")
        for i, k in enumerate(keys)
    ])
    before = (Window.partitionBy(*group_cols).orderBy(BUCKET)
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = last_in_bucket.select(*part, *[
        F.last(F.col(f"_last{i}"), ignorenulls=True).over(before).alias(f"_carry{i}")
        for i in range(len(keys))
    ])

    # the carry row stands first in its bucket; it meets the rows in the
    # window's own shuffle, so there is no join and a NULL group is like any other
    both = _with_head(b, carry)
    upto = Window.partitionBy(*part).orderBy(_HEAD, *order_cols).rowsBetween(Window.unboundedPreceding, 0)
    latest = [
        F.coalesce(
            F.last(F.when(F.col(_HEAD) == 0, F.col(f"_carry{i}")).when(key == F.lit(k), F.col(value_col)),
                   ignorenulls=True).over(upto),
            F.lit(0.0),
        )
        for i, k in enumerate(keys)
    ]
    total = latest[0]
    for c in latest[1:]:
        total = total + c
    return both.withColumn(out, total).filter(F.col(_HEAD) == 1).select(*df.columns, out)


_HEAD = "_head"


def _with_head(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows (``_head`` 1) and, for each bucket, a head row (``_head`` 0); a
    column that only one of them has is NULL on the other."""
    return rows.withColumn(_HEAD, F.lit(1)).unionByName(
        heads.withColumn(_HEAD, F.lit(0)), allowMissingColumns=True)


def _halves(v: Column) -> tuple[Column, Column]:
    """A double as two integers, of 2^-32 and of 2^-64: exact for values that
    are whole multiples of 2^-64 (from 2^-11 on all are, and are below 2^31)."""
    scaled = v * F.lit(2.0 ** 32)
    return F.floor(scaled).cast("bigint"), F.floor((scaled - F.floor(scaled)) * F.lit(2.0 ** 32)).cast("bigint")


def running_latest_sum_open(df: DataFrame, group_cols: Sequence[str], key_col: str, value_col: str,
                            order_cols: Sequence[str], out: str = "total", n_buckets: int | None = None) -> DataFrame:
    """W1 for any number of keys: as ``running_latest_sum`` over all keys there
    are, without a column for each.

    A row changes the sum by its value less its key's value before (0 before the
    first; a NULL value changes nothing), so the sum is a prefix sum of
    changes.  Changes are integers (``_halves``), so sums of buckets add up
    exactly and the result is the exact sum, rounded once."""
    from ..session import materialize
    group_cols, order_cols = list(group_cols), list(order_cols)
    there = F.col(value_col).isNotNull()
    moved = rank_and_previous(df.filter(there), [*group_cols, key_col], order_cols, [value_col], n_buckets=n_buckets)
    new, old = _halves(F.col(value_col).cast("double")), _halves(F.coalesce(F.col(f"prev_{value_col}").cast("double"), F.lit(0.0)))
    moved = moved.select(*df.columns, (new[0] - old[0]).alias("_high"), (new[1] - old[1]).alias("_low"))
    none = F.lit(0).cast("bigint")
    rows = materialize(moved.unionByName(df.filter(~there).select(*df.columns, none.alias("_high"), none.alias("_low"))), "changes")

    b = add_range_bucket(rows, order_cols, n_buckets)
    part = [*group_cols, BUCKET]
    before = Window.partitionBy(*group_cols).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    sums = b.groupBy(*part).agg(F.sum("_high").alias("_high"), F.sum("_low").alias("_low"))
    heads = sums.select(*part, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_high", "_low")))
    upto = Window.partitionBy(*part).orderBy(_HEAD, *order_cols).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_high").over(upto) / F.lit(2.0 ** 32) + F.sum("_low").over(upto) / F.lit(2.0 ** 64)
    return _with_head(b, heads).withColumn(out, total).filter(F.col(_HEAD) == 1).select(*df.columns, out)


def running_latest_sum_single(df: DataFrame, group_cols: Sequence[str], key_col: str,
                              keys: Sequence, value_col: str, order_cols: Sequence[str],
                              out: str = "total") -> DataFrame:
    """W1 as one window per group.  Exact but one task per group: kept as the
    reference form for tests, not for large inputs."""
    w = (Window.partitionBy(*group_cols).orderBy(*order_cols)
         .rowsBetween(Window.unboundedPreceding, 0))
    key = F.col(key_col)
    latest = [
        F.coalesce(F.last(F.when(key == F.lit(k), F.col(value_col)), ignorenulls=True).over(w),
                   F.lit(0.0))
        for k in keys
    ]
    total = latest[0]
    for c in latest[1:]:
        total = total + c
    return df.withColumn(out, total)


def rank_and_previous(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                      prev_cols: Sequence[str] = (), rank_col: str = "_rank",
                      n_buckets: int | None = None, total_col: str | None = None) -> DataFrame:
    """1-based row number in ``order_cols`` order within each group, plus the
    previous row's ``prev_cols`` (``prev_<name>``, NULL on the first row) --
    ``row_number`` and ``lag`` over a whole group, without one task per group.

    ``total_col``: rows of the group.  Bucket counts give each bucket's row
    offset and the group's total; the last row of the previous
    non-empty bucket gives the ``lag`` value of a bucket's first row.
    """
    group_cols = list(group_cols)
    order_cols = list(order_cols)
    prev_cols = list(prev_cols)
    b = add_range_bucket(df, order_cols, n_buckets)
    part = group_cols + [BUCKET]
    order_struct = _ordering(b, order_cols)

    per_bucket = b.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max_by(F.col(c), order_struct).alias(f"_lastof_{c}") for c in prev_cols],
    )
    over_buckets = Window.partitionBy(*group_cols).orderBy(BUCKET)
    before = over_buckets.rowsBetween(Window.unboundedPreceding, -1)
    heads = per_bucket.select(
        *part,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        *([F.sum("_n").over(Window.partitionBy(*group_cols)).alias("_total")] if total_col else []),
        *[F.lag(f"_lastof_{c}").over(over_buckets).alias(c) for c in prev_cols],
    )
    both = _with_head(b, heads)  # see running_latest_sum
    inside = Window.partitionBy(*part).orderBy(_HEAD, *order_cols)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    # the head row is row 1 of its bucket
    out = both.withColumn(rank_col, F.last("_offset", ignorenulls=True).over(upto) + F.row_number().over(inside) - 1)
    if total_col:
        out = out.withColumn(total_col, F.last("_total", ignorenulls=True).over(upto))
    for c in prev_cols:
        out = out.withColumn(f"prev_{c}", F.lag(c).over(inside))
    return out.filter(F.col(_HEAD) == 1).select(
        *df.columns, rank_col, *([total_col] if total_col else []), *[f"prev_{c}" for c in prev_cols])
