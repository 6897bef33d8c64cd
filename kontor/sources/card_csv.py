"""Card exports (CSV with a header): A1-A3, A23, with D1/D2 categorisation.

Columns: Type, Product, Started Date, Completed Date, Description, Amount,
Fee, Currency, State, Balance.  Only COMPLETED rows count; a file without a
State column contributes nothing.  Values are read as text and coerced with
``try_*`` functions: a bad date or amount becomes null (and the row is then
dropped by the loader), never an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.functions.dates import parse_timestamp
from kontor.functions.money import plain_money
from kontor.functions.text import strip
from kontor.operators.categorize import Rules, categorize, type_override
from kontor.operators.fixed_values import CARD_COMPLETED_STATE, DEFAULT_RULES
from kontor.operators.identity import dedup
from kontor.schema import LEDGER_COLUMNS, LEDGER_SCHEMA
from kontor.sources.csv_records import csv_lines, headed_records, split_record

#: Columns of a card export that jobs use, whatever others a file has and in what order.
CARD_COLUMNS = ["Type", "Product", "Started Date", "Completed Date", "Description", "Amount",
                "Fee", "Currency", "State", "Balance"]

CARD_DATE_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm",
                     "yyyy-MM-dd"]


def read_card_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A2/A3: read exports with a header, the ``CARD_COLUMNS`` as text.

    ``paths`` are files or glob patterns (``folder/*.csv``), listed by Spark.

    Every file's columns stand where its own header says: the header is a row like
    others, its role positions are joined to the file's records, so neither the
    number of different headers nor of files shapes the plan or reaches the driver.
    The first of columns with one name counts; a column that a file lacks is null.
    Files without a ``State`` column are skipped.  Quoted fields may span lines and
    file splits (``sources.csv_records``).  ``src_file`` is the file path; ``src_row`` a
    position-derived id (file order within a split) of the record's first line.
    """
    heads, records = headed_records(csv_lines(spark, paths))
    names = split_record(F.regexp_replace("record", "^\ufeff", ""))
    roles = [F.array_position(names, c).cast("int").alias(f"_at{i}")
             for i, c in enumerate(CARD_COLUMNS)]
    heads = (heads.select("src_file", *roles)
             .filter(F.col(f"_at{CARD_COLUMNS.index('State')}") > 0))
    rows = (records.select("src_file", "src_row", split_record(F.col("record")).alias("_fields"))
            .join(heads, "src_file"))
    return rows.select(*[F.get("_fields", F.col(f"_at{i}") - 1).alias(c)
                         for i, c in enumerate(CARD_COLUMNS)], "src_file", "src_row")


def parse_card_rows(rows: DataFrame, bank: str, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """A1 + D1 + D2: completed rows to ledger rows (before null drops and dedup)."""
    if "State" not in rows.columns:                       # A3
        return rows.sparkSession.createDataFrame([], LEDGER_SCHEMA)
    df = rows.filter(F.col("State") == CARD_COMPLETED_STATE)
    df = df.select(
        parse_timestamp(F.col("Started Date"), CARD_DATE_FORMATS).alias("date"),
        strip(F.coalesce(F.col("Description"), F.lit("nan"))).alias("concept"),
        plain_money("Amount").alias("amount"),
        plain_money("Balance").alias("balance"),
        F.lit(bank).alias("bank"),
        F.col("Type"),
        F.col("src_file"), F.col("src_row").cast("long").alias("src_row"))
    df = type_override(categorize(df, "concept", "category", rules), "Type", "category")
    return df.select(*LEDGER_COLUMNS)


def load_card_bank(rows: DataFrame, bank: str, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """A16 for card exports: parse, drop rows without date or amount (C8),
    remove duplicates keeping the first in ledger order (G1)."""
    return dedup(parse_card_rows(rows, bank, rules).dropna(subset=["date", "amount"]))
