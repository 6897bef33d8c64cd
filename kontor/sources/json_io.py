"""JSON list and map files: the category vocabulary (A18) and the overrides.

The original keeps each as one JSON document.  The vocabulary is small and
read and written as one value.  The overrides' document has an entry a line,
in sorted parts, and is read by lines; a document on one line is one row.
Their other form is a JSON-lines (or parquet) table of ``(tx_id, category)``
rows, also written and read in parallel.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.operators.fixed_values import EMPTY_VOCABULARY_DEFAULT


def read_if_there(read: Callable[[], DataFrame], otherwise: DataFrame) -> DataFrame:
    """What ``read`` gives, or ``otherwise`` if its path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return otherwise


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of names; the default list when the file is absent."""
    default = spark.createDataFrame([(json.dumps(EMPTY_VOCABULARY_DEFAULT),)], "value string")
    doc = read_if_there(lambda: spark.read.text(path, wholetext=True), default)
    return doc.select(F.explode(F.from_json("value", "array<string>")).alias("category"))


def _one_value(rows: DataFrame, path: str) -> None:
    """Write a one-row table of one text column as a single file."""
    rows.coalesce(1).write.mode("overwrite").text(path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """The names, sorted, as one JSON array.  A JSON document is one value, so its
    names meet in one task; a vocabulary of any larger kind belongs in a table."""
    _one_value(vocab.select(F.to_json(F.sort_array(F.collect_list(vocab.columns[0])))
                            .alias("value")), path)


def write_overrides_document(overrides: DataFrame, path: str) -> None:
    """A19 (compatible form): one JSON object ``{tx_id: category}``, ids sorted, an entry a
    line.  Its parts, one after the other, are the document; written in parallel.  Repeated
    or null ids are an error."""
    spark = overrides.sparkSession
    rows = overrides.groupBy("tx_id").agg(F.count(F.lit(1)).alias("n"),
                                          F.max("category").alias("category"))
    ends = overrides.agg(F.min("tx_id").alias("first"), F.max("tx_id").alias("last"),
                         F.count(F.lit(1)).alias("n")).first()
    if not ends["n"]:
        _one_value(spark.createDataFrame([("{}",)], "value string"), path)
        return
    entry = F.to_json(F.create_map(F.col("tx_id"), F.col("category")),
                      {"ignoreNullFields": "false"})
    wrong = F.col("tx_id").isNull() | (F.col("n") > 1)
    value = F.when(wrong, F.raise_error(F.concat(
        F.lit("null or repeated override id: "), F.coalesce("tx_id", F.lit("null"))))
        .cast("string")).otherwise(F.concat(
            F.when(F.col("tx_id") == F.lit(ends["first"]), "{").otherwise(""),
            F.expr("substring(entry, 2, length(entry) - 2)"),
            F.when(F.col("tx_id") == F.lit(ends["last"]), "}").otherwise(",")))
    (rows.orderBy("tx_id").withColumn("entry", F.when(~wrong, entry))
     .select(value.alias("value")).write.mode("overwrite").text(path))


def read_overrides_document(spark: SparkSession, path: str) -> DataFrame:
    """A19 (compatible form): one JSON object ``{tx_id: category}``; ``{}`` if absent.  Read
    by lines that hold whole entries, as ``write_overrides_document`` and ``json.dump`` (with
    or without indent) write them; a line that does not is an error."""
    lines = read_if_there(lambda: spark.read.text(path),
                          spark.createDataFrame([], "value string"))
    line = F.regexp_replace("value", r"^\s*\{?\s*|\s*[,}]?\s*$", "")
    entries = F.from_json(F.concat(F.lit("{"), line, F.lit("}")), "map<string,string>",
                          {"mode": "FAILFAST"})
    return (lines.filter(F.length(line) > 0)
            .select(F.explode(entries).alias("tx_id", "category")))


def write_overrides_table(overrides: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A19 (scale form): JSON lines, one override per line, written in parallel."""
    overrides.select("tx_id", "category").write.mode(mode).json(path)


def read_overrides_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tx_id string, category string").json(path)
