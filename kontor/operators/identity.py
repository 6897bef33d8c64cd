"""Identity of movements: the stable transaction id (B3) and duplicate removal (G1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kontor.functions.text import iso_timestamp_text, py_float_text
from kontor.schema import ROW_ORDER


def tx_id_expr(bank: str = "bank", date: str = "date", concept: str = "concept",
               amount: str = "amount") -> Column:
    """md5 hex of ``bank|isoformat(date)|concept|repr(float(amount))``.

    The id is not unique: two movements with the same day, text and amount
    share it (and then share an override), as in the original.
    """
    txt = F.concat_ws(
        "|",
        F.coalesce(F.col(bank), F.lit("None")),
        F.coalesce(iso_timestamp_text(F.col(date)), F.lit("NaT")),
        F.coalesce(F.col(concept), F.lit("nan")),
        py_float_text(F.col(amount)))
    return F.md5(txt)


def with_tx_id(df: DataFrame, out: str = "tx_id") -> DataFrame:
    return df.withColumn(out, tx_id_expr())


def dedup_key() -> list[Column]:
    """The duplicate key: account + amount + balance when the balance is
    known (no date: re-exports with shifted times still collapse), else
    account + timestamp + amount + text.  Money is compared in cents."""
    has_bal = F.col("balance").isNotNull()
    return [
        F.col("bank").alias("_k_bank"),
        has_bal.alias("_k_hasbal"),
        F.bround("amount", 2).alias("_k_amount"),
        F.when(has_bal, F.bround("balance", 2)).alias("_k_balance"),
        F.when(~has_bal, F.col("date")).alias("_k_date"),
        F.when(~has_bal, F.coalesce(F.col("concept"), F.lit("nan"))).alias("_k_concept"),
    ]


def dedup(df: DataFrame, order: list[str] = ROW_ORDER) -> DataFrame:
    """G1: keep the first row of each duplicate key in ledger order.

    An aggregate, not a ``row_number`` window: ``min(struct(order..., row))``
    is combined on the map side, so a key with millions of copies is reduced
    before the shuffle instead of being sorted in one task.  Spark sorts for it;
    a hash of the key goes first in the grouping, so the sorts compare one number
    and texts only within equal keys.  (Measured: 1.5 times as fast as without the
    hash, 1.8 times as fast as a hash aggregate of a packed order and a join back.)
    """
    cols = df.columns
    payload = [c for c in cols if c not in order]
    keyed = df.select(*dedup_key(), F.struct(*order, *payload).alias("_row"))
    kcols = [c for c in keyed.columns if c != "_row"]
    first = (keyed.withColumn("_hash", F.xxhash64(*kcols)).groupBy("_hash", *kcols)
             .agg(F.min("_row").alias("_row")))
    return first.select(*[F.col("_row")[c].alias(c) for c in cols])
