"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every session running these operators should have.  The time zone
# only matters for zoned timestamps; the ledger itself uses timestamp_ntz.
RECOMMENDED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove RDD checkpoint files (running totals) once their DataFrame is gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str = "local[*]", shuffle_partitions: int = 8,
              app_name: str = "kontor", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the recommended settings.

    On a cluster pass the real master and a shuffle partition count sized to
    the data (roughly input bytes / 128 MB); AQE coalesces what is left over.
    """
    builder = (SparkSession.builder.master(master).appName(app_name)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in {**RECOMMENDED_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
