"""Running totals that do not put a whole account in one task.

``sum(x) OVER (PARTITION BY bank ORDER BY ...)`` sends every row of a bank to
one task; with a handful of accounts, one of them can hold a third of the
ledger.  This is a scan in levels instead.  The order is cut by keys that
refine each other (day, second of the day, file and range of rows), so that a
level has few values under one value of the level above, however many rows:

1. sum the rows per finest key (combined on the map side), and these sums per
   key of every level;
2. per level, a running sum over the keys under one key of the level above
   (a day has 86,400 seconds; an account has some ten thousand days);
3. a row's total is the sum of the levels' totals before its keys, plus a
   running sum within its finest key.

Nothing is sampled, written or executed while the plan is built.  Money is
DECIMAL, so the sum in levels equals the one-window sum exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, partition_by: list[str], order_by: list[str], value: str,
                  out: str, levels: list[Column]) -> DataFrame:
    """Add ``out`` = running sum of ``value`` per ``partition_by`` in ``order_by`` order.

    ``order_by`` must be a total order within each partition (end it in a
    unique row position), as for any deterministic running total.  ``levels``
    are keys from coarse to fine: ordering by them and then by ``order_by``
    must be the same as ordering by ``order_by``.
    """
    value_type = df.schema[value].dataType
    n = len(levels)
    keys = ["_p", *[f"_l{i}" for i in range(n)]]
    rows = df.select("*", F.struct(*partition_by).alias("_p"),
                     *[F.struct(c).alias(f"_l{i}") for i, c in enumerate(levels)])

    totals = rows.groupBy(*keys).agg(F.sum(value).alias("_s"))
    offsets = None
    for i in range(n - 1, -1, -1):
        own, above = keys[:i + 2], keys[:i + 1]
        level = totals if i == n - 1 else totals.groupBy(*own).agg(F.sum("_s").alias("_s"))
        before = (Window.partitionBy(*above).orderBy(own[-1])
                  .rowsBetween(Window.unboundedPreceding, -1))
        level = level.select(*own, F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"))
        if offsets is None:
            offsets = level.withColumnRenamed("_b", "_offset")
        else:
            offsets = (_join(offsets, level, own)
                       .withColumn("_offset", F.col("_offset") + F.col("_b")).drop("_b"))

    inside = (Window.partitionBy(*keys).orderBy(*order_by)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = rows.withColumn("_local", F.sum(value).over(inside))
    return _join(local, offsets, keys).select(
        *df.columns, (F.col("_offset") + F.col("_local")).cast(value_type).alias(out))


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe equi-join on ``keys`` (rows without an account or date keep their totals)."""
    named = right.withColumnsRenamed({k: f"{k}_r" for k in keys})
    cond = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"{k}_r"))
        cond = same if cond is None else cond & same
    return left.join(named, cond).drop(*[f"{k}_r" for k in keys])
