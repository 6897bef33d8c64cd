"""Next-month forecast per account, category and side (M1-M4).

For each account: completed months only (before ``as_of``'s month, C9),
transfers excluded (C2), the last 24 months present (C10, relative to the
account's latest month), net per month and category (F17).  A month counts as
income when that net is positive and as expense when negative (S12); the
months of one side, in order, are the series x = 0..n-1 (G3, gaps collapse).
With n >= 4 the least-squares line is extended one step, with 2 <= n < 4 the
mean is used; fewer than 2 points give no forecast.  Negative results are 0.

Exactness: the series is in integer cents, so the line's value at x = n is the
rational number P / Q with

    Sx = n(n-1)/2,  den = n^2 (n^2 - 1) / 12,  num = n*Sxy - Sx*Sy
    P  = num * n(n+1)/2 + Sy * den,            Q = n * den

(for the mean: P = Sy, Q = n).  P / Q is rounded half-even to a whole cent
with integer division; no floating point is involved, so the result does not
depend on partitioning or engine.  (A float polyfit can land on the other
side of an exact half-cent tie; that is the only possible difference.)

All the work after the first aggregate runs on one row per (account, month,
category): the ledger itself is read once and reduced on the map side.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.functions.dates import month_of
from kontor.operators import filters
from kontor.operators.fixed_values import (
    FORECAST_LOOKBACK_MONTHS, FORECAST_MIN_MONTHS, FORECAST_TREND_MIN, TRANSFER_CATEGORIES,
)

_INT = "decimal(38,0)"


def monthly_by_category(ledger: DataFrame, as_of: dt.date | str,
                        by: list[str] = ("bank",)) -> DataFrame:
    """F17 with C2, C9, C10: net per (account, month, category) in the look-back."""
    hist = filters.completed_months(
        filters.hide_transfers(ledger, TRANSFER_CATEGORIES), as_of)
    hist = hist.filter(F.col("date").isNotNull())
    monthly = (hist.groupBy(*by, month_of("date").alias("month"), "category")
               .agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("net")))
    # latest month per account, over all categories (null ones included)
    latest = monthly.groupBy(*by).agg(F.max("month").alias("_latest"))
    monthly = monthly.join(latest, list(by), "inner")
    cutoff = F.add_months(F.col("_latest"), -(FORECAST_LOOKBACK_MONTHS - 1))
    return (monthly.filter((F.col("month") >= cutoff) & F.col("category").isNotNull())
            .drop("_latest"))


def forecast_next_month(ledger: DataFrame, as_of: dt.date | str,
                        by: list[str] = ("bank",)) -> DataFrame:
    """M1/M2/M4: ``(bank, side, category, n_months, predicted, forecast_month)``."""
    monthly = monthly_by_category(ledger, as_of, by)
    sided = (monthly.filter(F.col("net") != 0)
             .withColumn("side", F.when(F.col("net") > 0, F.lit("income"))
                         .otherwise(F.lit("expenses")))
             .withColumn("y", (F.abs("net") * 100).cast(_INT)))
    series = Window.partitionBy(*by, "side", "category").orderBy("month")
    sided = sided.withColumn("x", (F.row_number().over(series) - 1).cast(_INT))

    g = sided.groupBy(*by, "side", "category").agg(
        F.count("*").cast("long").alias("n_months"),
        F.sum("y").cast(_INT).alias("sy"),
        F.sum(F.col("x") * F.col("y")).cast(_INT).alias("sxy"))
    g = g.filter(F.col("n_months") >= FORECAST_MIN_MONTHS)

    n = F.col("n_months").cast(_INT)
    sx = (n * (n - 1) / 2).cast(_INT)
    den = (n * n * (n * n - 1) / 12).cast(_INT)
    num = (n * F.col("sxy") - sx * F.col("sy")).cast(_INT)
    trend = F.col("n_months") >= FORECAST_TREND_MIN
    p = F.when(trend, (num * (n * (n + 1) / 2).cast(_INT) + F.col("sy") * den).cast(_INT)) \
        .otherwise(F.col("sy"))
    q = F.when(trend, (n * den).cast(_INT)).otherwise(n)
    g = g.withColumn("_p", p).withColumn("_q", q)

    # half-even rounding of P/Q to an integer, for P > 0 (P <= 0 clamps to 0)
    quot = F.expr("_p div _q").cast(_INT)
    g = g.withColumn("_d", quot).withColumn("_r2", ((F.col("_p") - F.col("_d") * F.col("_q")) * 2)
                                           .cast(_INT))
    up = (F.col("_r2") > F.col("_q")) | ((F.col("_r2") == F.col("_q")) & (F.col("_d") % 2 == 1))
    cents = F.when(F.col("_p") <= 0, F.lit(0)).otherwise(
        F.col("_d") + F.when(up, F.lit(1)).otherwise(F.lit(0)))
    label = F.date_format(F.add_months(F.trunc(F.lit(as_of).cast("date"), "MM"), 1), "MMMM yyyy")
    return g.select(*by, "side", "category", "n_months",
                    (cents.cast(_INT).cast("decimal(38,2)") / 100).cast("double").alias("predicted"),
                    label.alias("forecast_month"))
