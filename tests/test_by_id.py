"""Ledger and overrides stored by id: joins that move no ledger row."""

import uuid

from pyspark.sql import functions as F

from kontor.operators import overrides
from kontor.operators.ledger import merge_overrides_by_id, write_by_id


def test_override_join_has_no_exchange_and_no_sort(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex}"
    ledger = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("tx_id"),
                                      F.lit("b").alias("bank"), "id", F.lit("fuel").alias("category"))
    old = ledger.filter("id % 3 = 0").select("tx_id", F.lit("rent").alias("category"))
    new = ledger.filter("id % 6 = 0").select("tx_id", F.when(F.col("id") % 12 != 0, "atm").alias("category"))
    try:
        write_by_id(ledger, f"{name}_l", 4, str(tmp_path / "l"))
        write_by_id(old, f"{name}_o", 4, str(tmp_path / "o"))
        merge_overrides_by_id(spark, f"{name}_o", new, f"{name}_n", 4, str(tmp_path / "n"))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = overrides.apply_overrides(spark.table(f"{name}_l"), spark.table(f"{name}_n"))
        rows = got.select("id", "category").collect()
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for t in "lon":
            spark.sql(f"DROP TABLE IF EXISTS {name}_{t}")
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    want = overrides.apply_overrides(ledger, overrides.merge_overrides(old, new))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want.select("id", "category").collect()))
    assert {r["category"] for r in rows} == {"fuel", "rent", "atm"}       # a null override keeps the rule's
