"""Keyword rules from a table of any size: the categories of the compiled rules."""

import random

import pytest
from pyspark.sql import functions as F

from kontor.operators.categorize import (categorize, categorize_by_table, keyword_anchors, rules_table)


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_compiled_rules(spark, seed):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choices("abcÉñ. %", k=k))
    rules = [([word(rng.randint(0, 7)) for _ in range(rng.randint(0, 4))], f"c{i % 9}")
             for i in range(40)]
    rows = [(i, word(rng.randint(0, 25)), "x") for i in range(300)] + [(900, None, "x"), (901, "", "x")]
    df = spark.createDataFrame(rows, "id long, concept string, gram string")
    want = {r["id"]: r["category"] for r in categorize(df, rules=rules).collect()}
    got = categorize_by_table(df, rules_table(spark, rules))
    assert got.columns == [*df.columns, "category"]
    assert {r["id"]: r["category"] for r in got.collect()} == want and len(set(want.values())) > 3


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a")], "id long, concept string")
    assert categorize_by_table(df, rules_table(spark, [])).first()["category"] == "other"
    assert categorize_by_table(df.limit(0), rules_table(spark, [(["a"], "x")])).count() == 0


def test_fifty_thousand_keywords_meet_few_texts(spark):
    rules = spark.range(50_000).select(
        F.col("id").cast("int").alias("ordinal"),
        F.array(F.concat(F.lit("shop "), F.substring(F.md5(F.col("id").cast("string")), 1, 8)))
        .alias("keywords"), F.concat(F.lit("c"), F.col("id") % 10).alias("category"))
    anchors = keyword_anchors(rules)
    assert anchors.count() == 50_000
    # no anchor is the beginning that all keywords share
    assert anchors.groupBy("gram").count().agg(F.max("count")).first()[0] < 200
    rows = spark.range(500).select(
        "id", F.concat(F.lit("card SHOP "), F.substring(F.md5((F.col("id") * 100).cast("string")), 1, 8),
                       F.lit(" town")).alias("concept"))
    got = categorize_by_table(rows, rules).collect()
    assert all(r["category"] == f"c{r['id'] * 100 % 10}" for r in got) and len(got) == 500


def numbered(spark, n):
    """Rules for numbers behind one long beginning, and as many texts with them."""
    name = F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0"))
    rules = spark.range(n).select(F.col("id").cast("int").alias("ordinal"),
                                  F.array(name).alias("keywords"), F.lit("c").alias("category"))
    return rules, spark.range(n).select("id", F.concat(F.lit("AUTO "), name).alias("concept"))


def test_pairs_to_test_grow_with_the_rules_only(spark):
    # numbers share their short grams: each anchor has to hold more than four digits
    rules, _ = numbered(spark, 30_000)
    assert keyword_anchors(rules).groupBy("gram").count().agg(F.max("count")).first()[0] <= 3


def test_nothing_that_grows_is_broadcast(spark):
    rules, rows = numbered(spark, 300)
    got = categorize_by_table(rows, rules)
    assert got.filter("category = 'c'").count() == 300
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") - plan.count("Join Cross") == plan.count("rightHint=(strategy=merge)") > 4
