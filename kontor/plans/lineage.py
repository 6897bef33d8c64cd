"""Where lineage is cut.

A reliable checkpoint goes to the shared folder named by ``spark.checkpoint.dir``
(the cluster's setting wins).  Only a local-mode session without that setting
gets a scratch folder of its own, as in tests; on a cluster an unset
checkpoint dir is an error rather than a silent machine-local folder.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) so checkpoints survive executor loss")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="kontor-ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable (not local) checkpoint: survives executor loss, freezes
    non-deterministic steps such as range-partition sampling."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
