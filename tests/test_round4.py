"""The unified ledger leaves no more on disk than its rows (finding F1 of round 4)."""

import contextlib
import datetime
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from kontor import registry
from kontor.plans.fsm import fsm_scan
from kontor.plans.lineage import checkpoint_dir
from kontor.sources import files, grids, statements


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Thirty orders of four customers."""
    d = str(tmp_path_factory.mktemp("tables"))
    day = datetime.datetime(1997, 3, 1)
    priority = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    spark.createDataFrame([(i, f"Customer#{i}", 10.5 * i, "BUILDING") for i in range(4)],
                          "c_custkey long, c_name string, c_acctbal double, c_mktsegment string"
                          ).write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame(
        [(i, i % 4, "FOP"[i % 3], 100.25 + i, day + datetime.timedelta(days=9 * i),
          priority[i % 5]) for i in range(30)],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    return d


@contextlib.contextmanager
def settings(spark, **conf):
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def folders(spark):
    top = re.sub("^file:/*", "/", checkpoint_dir(spark)) + "/kontor-scratch"
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_load_all_keeps_its_ledgers_only(spark, tables):
    before = folders(spark)
    got = registry.QUERIES["load_all"](spark, tables)
    assert all("/ledger-" in f for f in got.inputFiles())
    assert {f.rsplit("-", 1)[0] for f in folders(spark) - before} == {
        "joined-orders", "ledger-Bank3", "ledger-BNCR", "ledger-Caixa", "ledger-Bank1"}
    n = {r["bank"]: r["count"] for r in got.groupBy("bank").count().collect()}
    assert n == {"Bank1": 30, "Caixa": 30, "Bank3": 20, "BNCR": 30}


def test_a_staged_table_leaves_no_shuffle_files(spark):
    df = spark.range(1000).repartition(3, "id")
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()

    def shuffles():
        return set(re.findall(r"\d+", str(tracker.shuffleStatuses().keySet())))

    conf, before = spark.conf.get(files.SHUFFLE_CLEANUP, None), shuffles()
    staged = files.stage_table(df, "cleaned")
    assert shuffles() <= before
    assert spark.conf.get(files.SHUFFLE_CLEANUP, None) == conf
    assert staged.count() == 1000


def test_staged_files_are_read_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(files, "STAGED_FILE_ROWS", 100)
    before = spark.conf.get(files.READ_SPLITS, None)
    staged = files.stage_table(spark.range(0, 1000, 1, 1), "many")
    assert len(staged.inputFiles()) == 10 and staged.count() == 1000
    assert spark.conf.get(files.READ_SPLITS, None) == before


@pytest.mark.parametrize("parse", [grids.parse_yearly, grids.parse_multi_layout])
def test_sheet_rows_are_not_shuffled_to_their_files(spark, parse):
    raw = spark.range(0, 100, 1, 4).select(
        F.concat(F.lit("a/"), F.col("id") % 3, F.lit(".xlsx")).alias("path"),
        F.col("id").alias("row_no"),
        F.array(*[F.lit(x) for x in ("2020-01-01", "x", "shop", "1.00", "2.00", "y")]).alias("cells"))
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        plan = parse(raw)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_a_concept_strips_each_description_once(spark):
    df = spark.createDataFrame(
        [(" shop ", "two"), ("Fecha de operación 01/02/2020 shop", "shop"), (None, " x "), ("", None),
         ("fecha de operaci x", None)], "a string, b string")
    out = df.select(grids.concept_from_descriptions(F.col("a"), F.col("b")).alias("c"))
    assert [r.c for r in out.collect()] == ["shop two", "shop", "x", "no description",
                                            "no description"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(a#") == 1


def rows_and_states(rng):
    """Lines of documents, and what a loop over them says."""
    table, marks = [[1, 0, 0], [2, 1, 0], [2, 0, 1]], {(0, 0), (2, 2)}
    rows, want = [], {}
    for doc, n in (("a", 300), ("b", 5), ("c", 64), ("d", 900), ("e", 1)):
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
    return rows, want, table, marks


@pytest.mark.parametrize("block_rows", [1, 10, 1 << 16])
@pytest.mark.parametrize("tasks", [1, 4, 23])
def test_scan_over_cuts_between_tasks_equals_a_loop(spark, tasks, block_rows):
    rows, want, table, marks = rows_and_states(random.Random(tasks))
    df = spark.createDataFrame(rows, "doc string, line long, sym int")
    with settings(spark, **{"spark.sql.adaptive.enabled": "false",
                            "spark.sql.shuffle.partitions": str(tasks)}):
        got = fsm_scan(df, "doc", "line", "sym", table, 0, marks, block_rows=block_rows).collect()
    assert len(got) == len(rows)
    assert {(r["doc"], r["line"]): (r["state_before"], r["mark"]) for r in got} == want


def parsed_by_loop(lines):
    """Records ``(line_no, concept, amount, balance)`` of one document's lines."""
    out, i = [], 0
    money, date = re.compile(statements.MONEY_RE), re.compile(statements.DATE_RE)
    while i < len(lines):
        if lines[i].startswith(statements.STOP_PREFIX):
            break
        if not date.match(lines[i]):
            i += 1
            continue
        at, i, words = i, i + 2, []
        while i < len(lines) and not money.match(lines[i]):
            words.append(lines[i])
            i += 1
        if i + 1 >= len(lines) or not money.match(lines[i + 1]):
            break
        out.append((at, " ".join(words).strip(), float(lines[i].replace(",", "")),
                    float(lines[i + 1].replace(",", ""))))
        i += 2
    return out


@pytest.mark.parametrize("tasks,block_rows", [(1, 1 << 16), (1, 3), (5, 1 << 16), (40, 7)])
def test_records_over_cuts_between_tasks_equal_a_loop(spark, tasks, block_rows):
    rng, docs, want = random.Random(tasks + block_rows), [], []
    kinds = [["05/03", "1", "shop", "-1.50", "8.50"], ["05/03", "1", "two", "words", "2.00", "1.00"],
             ["06/03", "2", "3.00", "4.00"], ["x"], ["7.00"], ["05/03", "1", *"long" * 9, "1.00", "2.00"]]
    for d in range(12):
        lines = [x for _ in range(rng.randint(0, 60)) for x in rng.choice(kinds)]
        if d % 3 == 0:
            lines += ["05/03", "1", *["unclosed"] * 30]
        if d % 3 == 1:
            lines[len(lines) // 2:len(lines) // 2] = ["Saldo anterior: 1.00"]
        docs += [(f"d{d}", i, x) for i, x in enumerate(lines)]
        want += [(f"d{d}", *r) for r in parsed_by_loop(lines)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc string, line_no long, line string")
    with settings(spark, **{"spark.sql.adaptive.enabled": "false",
                            "spark.sql.shuffle.partitions": str(tasks)}):
        got = statements.parse_statement_lines(df, block_rows).collect()
    assert sorted((r["doc"], r["line_no"], r["concept"], float(r["amount"]), float(r["balance"]))
                  for r in got) == sorted(want)


def test_repeated_lines_give_what_the_grouping_of_lines_gives(spark):
    """Every line twice, under one number: the date's copy is the reference, the reference's
    copies are the text, the amount's copy is the balance."""
    text = ["05/03", "1", "shop", "-1.50", "8.50"]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(text * 2) for _ in range(2)]
                               + [(None, 0, "05/03")], "doc string, line_no long, line string")
    got = statements.parse_statement_lines(df).collect()
    assert [(r["line_no"], r["concept"], float(r["amount"]), float(r["balance"]))
            for r in sorted(got, key=lambda r: r["line_no"])] == [
        (0, "1 1 shop shop", -1.5, -1.5), (5, "1 1 shop shop", -1.5, -1.5)]
