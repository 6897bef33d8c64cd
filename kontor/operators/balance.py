"""Running balance from signed amounts, per account, in ledger order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.plans.joins import join_small
from kontor.plans.prefix import running_total
from kontor.schema import MONEY, ROW_ORDER


#: Rows of one file that a running sum may go over in one task.
ROWS_PER_RANGE = 1 << 20


def ledger_levels(rows_per_range: int = ROWS_PER_RANGE) -> list[Column]:
    """Keys that refine the ledger order (date, src_file, src_row): day, second of the day,
    and exact time, file and range of rows."""
    return [F.to_date("date"), F.date_format("date", "HH:mm:ss"),
            F.struct("date", "src_file", F.floor(F.col("src_row") / rows_per_range))]


def running_balance(df: DataFrame, out: str = "balance", account: str = "bank",
                    opening: DataFrame | None = None) -> DataFrame:
    """Balance after each movement = opening balance + running sum of ``amount``.

    Ordered by (date, src_file, src_row) within each account.  ``opening`` is
    an optional ``(bank, opening)`` table (missing accounts start at 0).  The
    sum is the scan in levels of ``plans.prefix``: no account is ever gathered
    into one task, and nothing runs while the plan is built.
    """
    cols = [c for c in df.columns if c != out]
    res = running_total(df.select(*cols), [account], ROW_ORDER, "amount", out, ledger_levels())
    if opening is not None:
        res = (join_small(res, opening.select(account, "opening"), account, "left")
               .withColumn(out, (F.col(out) + F.coalesce("opening", F.lit(0))).cast(MONEY))
               .drop("opening"))
    return res
