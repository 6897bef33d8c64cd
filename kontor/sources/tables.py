"""Reading the parquet tables a job runs on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, base_dir: str, name: str) -> DataFrame:
    """``{base_dir}/{name}.parquet``; column pruning and filter pushdown come
    from the projections and filters applied afterwards."""
    return spark.read.parquet(f"{base_dir.rstrip('/')}/{name}.parquet")
