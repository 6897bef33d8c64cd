"""Assembling the ledger table from movements of any source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.functions.text import strip
from kontor.operators.balance import running_balance
from kontor.operators.categorize import Rules, categorize
from kontor.operators.fixed_values import DEFAULT_RULES
from kontor.schema import LEDGER_COLUMNS, LEDGER_SCHEMA, MONEY


def build_ledger(movements: DataFrame, rules: Rules = DEFAULT_RULES,
                 with_balance: bool = True) -> DataFrame:
    """Movements ``(date, concept, amount, bank, src_file, src_row[, balance])``
    -> ledger: category from the keyword rules (D1); a balance column from the
    running sum (G6) when the source has none and ``with_balance`` is set.

    Reports that never read ``balance`` should pass ``with_balance=False``:
    the running sum is a sort of the whole ledger.
    """
    df = movements.withColumn("concept", strip("concept"))
    df = categorize(df, "concept", "category", rules)
    if "balance" not in df.columns:
        if with_balance:
            df = running_balance(df)
        else:
            df = df.withColumn("balance", F.lit(None).cast(MONEY))
    return df.select(*LEDGER_COLUMNS)


def bank_key(bank) -> Column:
    """Folder name of an account in the stored ledger: ``b`` and the name, ``n`` for null.
    The letter keeps Spark from reading names such as ``007`` as numbers."""
    return F.coalesce(F.concat(F.lit("b"), bank), F.lit("n"))


def write_ledger(ledger: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The stored form: parquet partitioned by account folder and year, sorted by
    date inside each file so min/max statistics prune date ranges.  The account's
    name itself stays a text column of the rows.

    Range partitioning on the full row order (not hash on bank/year) splits a
    hot account-year over many writers, each writing its own file.
    """
    (ledger.withColumn("bank_key", bank_key(F.col("bank"))).withColumn("year", F.year("date"))
     .repartitionByRange("bank", "date", "src_file", "src_row")
     .sortWithinPartitions("bank", "date", "src_file", "src_row")
     .write.mode(mode).partitionBy("bank_key", "year").parquet(path))


def read_ledger(spark: SparkSession, path: str, banks: list[str | None] | None = None) -> DataFrame:
    """The stored ledger with its columns and types; ``banks`` reads only their folders."""
    stored = spark.read.schema(T.StructType([
        *LEDGER_SCHEMA.fields, T.StructField("bank_key", T.StringType()),
        T.StructField("year", T.IntegerType())])).parquet(path)
    if banks is not None:
        stored = stored.filter(F.col("bank_key").isin(
            ["n" if b is None else "b" + b for b in banks]))
    return stored.select(*LEDGER_COLUMNS)


# ------------------------------------------------- ledger and overrides by id
def write_by_id(rows: DataFrame, table: str, buckets: int, path: str) -> None:
    """Store a table with a ``tx_id`` (the ledger with its ids, or the overrides) in buckets
    by id, each one sorted file, so that joins on the id neither move nor sort its rows.

    Every bucket is written by one task, so ``buckets`` is chosen for the ledger's size (some
    hundred MB in each).  Ids are hashes: a hot account spreads over all buckets.
    """
    (rows.repartition(buckets, "tx_id").sortWithinPartitions("tx_id")
     .write.mode("overwrite").option("path", path)
     .bucketBy(buckets, "tx_id").sortBy("tx_id").saveAsTable(table))


def merge_overrides_by_id(spark: SparkSession, table: str, new: DataFrame, into: str,
                          buckets: int, path: str) -> None:
    """D10 on overrides stored by id: only ``new`` is moved to the buckets; the stored rows
    are merged where they lie and written to the table ``into`` (a table is not overwritten
    while it is read)."""
    new = new.select("tx_id", F.col("category").alias("new"), F.lit(True).alias("given"))
    both = spark.table(table).select("tx_id", F.col("category").alias("old")).join(
        new, "tx_id", "full")
    merged = both.select("tx_id", F.when(F.col("given"), F.col("new")).otherwise(
        F.col("old")).alias("category"))
    write_by_id(merged, into, buckets, path)
