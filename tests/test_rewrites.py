"""Ordered label rewrites (D3, D4): results of a plain loop, and plans that stay linear."""

import random
import re

import pytest
from pyspark.sql import functions as F

from kontor.operators import categorize as C
from kontor.operators import report
from kontor.operators.categorize import RewriteRule, rewrites_from_table, sequential_rewrite
from kontor.sources.standin import purchase_rewrites


def plain(label, amount, rules):
    for r in rules:
        if r.pattern == r.min_abs == r.eq_abs is None:
            continue
        if (r.pattern is None or label is not None and re.search(r.pattern, label)) \
                and (r.min_abs is None or amount is not None and abs(amount) >= r.min_abs) \
                and (r.eq_abs is None or amount is not None and abs(amount) == r.eq_abs):
            label = r.label
    return label


def random_rules(rng, n):
    labels = ["ab", "ba", "abc", "c.c", "a", ""]
    patterns = ["a", "b", "ab", "^a", "c$", "a.c", "[bc]b", "", "\\.", "b|c", None, None]
    amounts = [None, None, None, 0.0, 1.0, 2.5, 376.18]
    return [RewriteRule(rng.choice(labels), rng.choice(patterns), rng.choice(amounts),
                        rng.choice(amounts)) for _ in range(n)]


@pytest.mark.parametrize("seed, compiled", [(s, 24) for s in range(6)] + [(7, 0), (8, 0)])
def test_equals_a_loop_over_the_rules(spark, monkeypatch, seed, compiled):
    monkeypatch.setattr(C, "COMPILED_REWRITES", compiled)
    rng = random.Random(seed)
    rules = random_rules(rng, rng.randint(1, 30))
    rows = [("".join(rng.choices("abc.", k=rng.randint(0, 5))),
             rng.choice([None, 0.0, -1.0, 1.0, 2.0, -2.5, 2.6, 376.18, -400.0])) for _ in range(150)]
    rows += [(None, 1.0), (None, None), (None, -376.18)]
    df = spark.createDataFrame(rows, "concept string, amount double")
    got = sequential_rewrite(df, rules, out="label").collect()
    assert sorted(got, key=str) == sorted(((c, a, plain(c, a, rules)) for c, a in rows), key=str)
    totals: dict = {}
    for c, a in rows:
        if (label := plain(c, a, rules)) is not None:
            totals[label] = totals.get(label, 0) + (a or 0)
    for r in report.label_totals(df, rewrites=rules).collect():
        assert abs(totals.pop(r.label) - r.amount) < 1e-6
    assert not totals


def test_no_rules_and_a_pattern_that_python_cannot_read(spark):
    df = spark.createDataFrame([("x", 1.0)], "concept string, amount double")
    assert sequential_rewrite(df, [RewriteRule("y")]).collect() == df.collect()
    with pytest.raises(re.error):
        sequential_rewrite(df, [RewriteRule("y", pattern="(")])


def test_rules_from_a_table(spark):
    table = spark.createDataFrame([(2, "b", None, None, 3.0), (1, "a", "x", 1.0, None)],
                                  "ordinal int, label string, pattern string, min_abs double, eq_abs double")
    assert rewrites_from_table(table) == [RewriteRule("a", "x", 1.0), RewriteRule("b", eq_abs=3.0)]


def plan_size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


@pytest.mark.parametrize("totals", [False, True])
def test_plan_grows_linearly_with_the_rules(spark, totals):
    rules = purchase_rewrites()
    assert len(rules) == 125 and any(r.eq_abs for r in rules)
    df = spark.createDataFrame([("red ring Brand#3", -7.0)], "concept string, amount double")
    df = df.withColumn("date", F.lit("2024-01-01").cast("timestamp"))
    spark.conf.set("spark.sql.maxToStringFields", "100000")
    try:
        sizes = {}
        for n in (25, 50, 100, 125):
            if totals:
                out = report.year_label_totals(df, exclude=["fees", "rest"], rewrites=rules[:n])
            else:
                out = report.year_label_totals(sequential_rewrite(df, rules[:n]), exclude=["fees"])
            sizes[n] = plan_size(out)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxToStringFields")
    assert sizes[125] - sizes[100] < 1.5 * (sizes[50] - sizes[25]), sizes
    assert plan.count("Brand#17$") == sum("Brand#17$" in (r.pattern or "") for r in rules)
    assert out.count() == 1
