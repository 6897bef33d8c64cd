"""Blocks of the finite-state scan stay within their rows, whatever the line numbers."""

import random

import pytest
from pyspark.sql import functions as F

from kontor.plans.fsm import fsm_scan, line_blocks


def blocks(spark, df, n):
    return {(r["doc"], r["_blk"]): (r["n"], r["lo"], r["hi"]) for r in
            line_blocks(df, "doc", "line", n).groupBy("doc", "_blk").agg(
                F.count("*").alias("n"), F.min("line").alias("lo"), F.max("line").alias("hi")).collect()}


def test_dense_lines_and_one_far_away(spark):
    df = spark.range(200_000).select(F.lit("a").alias("doc"), F.col("id").alias("line")).union(
        spark.createDataFrame([("a", 10 ** 12)], "doc string, line long"))
    got = blocks(spark, df, 1 << 16)
    assert max(n for n, _, _ in got.values()) <= 1 << 16
    assert sum(n for n, _, _ in got.values()) == 200_001 and len(got) <= 8


@pytest.mark.parametrize("block_rows", [1, 2, 7, 100])
def test_blocks_follow_the_order_and_their_bound(spark, block_rows):
    rng = random.Random(block_rows)
    rows = []
    for doc in "abc":
        at = 0
        for _ in range(rng.randint(1, 400)):
            at += rng.choice([1, 1, 1, 2, 900, 1 << 20, 1 << 40])
            rows.append((doc, at))
    rng.shuffle(rows)
    got = blocks(spark, spark.createDataFrame(rows, "doc string, line long"), block_rows)
    for doc in "abc":
        own = sorted((b, x) for (d, b), x in got.items() if d == doc)
        assert all(n <= block_rows for _, (n, _, _) in own)
        assert all(a[1][2] < b[1][1] for a, b in zip(own, own[1:]))
        assert sum(n for _, (n, _, _) in own) == sum(d == doc for d, _ in rows)
        # neighbours together hold more than one block's stretch, so blocks are not too small
        assert len(own) <= 2 + 4 * sum(d == doc for d, _ in rows) / max(1, block_rows)


def test_scan_over_uneven_lines_equals_a_loop(spark):
    rng = random.Random(4)
    rows, want = [], {}
    table, marks = [[1, 0, 0], [2, 1, 0], [2, 0, 1]], {(0, 0), (2, 2)}
    for doc, n in (("a", 300), ("b", 5), ("c", 64), ("d", 65)):
        at, state, mark = 0, 0, None
        for _ in range(n):
            at += rng.choice([1, 2, 1 << 33])
            y = rng.randrange(3)
            rows.append((doc, at, y))
            if (state, y) in marks:
                mark = at
            want[doc, at] = (state, mark)
            state = table[state][y]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc string, line long, sym int")
    got = fsm_scan(df, "doc", "line", "sym", table, 0, marks, block_rows=64).collect()
    assert {(r["doc"], r["line"]): (r["state_before"], r["mark"]) for r in got} == want
