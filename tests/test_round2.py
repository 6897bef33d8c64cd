"""Undo and retention, large rule tables, account names, wide amounts, Python's strip and repr."""

import random

from pyspark.sql import functions as F

from kontor.functions.text import py_float_text, strip
from kontor.operators import overrides
from kontor.operators.categorize import categorize
from kontor.operators.ledger import read_ledger, write_ledger
from kontor.schema import LEDGER_COLUMNS, LEDGER_SCHEMA
from kontor.sources.card_csv import load_card_bank, parse_card_rows
from kontor.streaming.ingest import append_batch, merge_batch


def table(spark, entries):
    return spark.createDataFrame(list(entries.items()), "tx_id string, category string")


def in_force(log, version):
    return dict(tuple(r) for r in overrides.overrides_as_of(log, version).collect())


def test_undo_removes_what_a_later_save_leaves_out(spark):
    saves = [{"t1": "a"}, {"t1": "a", "t2": "b"}, {"t1": "a"}, {"t1": None, "t2": "c"}]
    log = None
    for i, s in enumerate(saves, 1):
        log = overrides.save_version(log, table(spark, s) if s else None, i)
    for i, s in enumerate(saves, 1):
        assert in_force(log, i) == s


def test_retention_changes_nothing_in_kept_versions(spark):
    rng = random.Random(1)
    rows, state, history = [], {}, {}
    for v in range(1, 41):
        for t in rng.sample(range(12), 3):
            gone = f"t{t}" in state and rng.random() < .4
            state = {k: c for k, c in state.items() if k != f"t{t}"}
            if not gone:
                state[f"t{t}"] = f"c{v}"
            rows.append((v, f"t{t}", None if gone else f"c{v}", gone))
        history[v] = dict(state)
    log = spark.createDataFrame(rows, "version long, tx_id string, category string, deleted boolean")
    short = overrides.retain_versions(log, 15)
    assert short.select("version").distinct().count() <= 16
    for v in (26, 30, 40):
        assert in_force(short, v) == history[v] == in_force(log, v)
    again = overrides.retain_versions(short, 15)
    assert in_force(again, 40) == history[40]
    assert overrides.retain_versions(log.limit(0)).count() == 0


def test_thousands_of_keywords(spark):
    rules = [([f"word{i} " for i in range(j, 5000, 7)] + [f"x{j}."], f"c{j}") for j in range(7)]
    texts = [("a word4999 b", "c1"), ("WORD6 end", "c6"), ("word6", "other"), (None, "other"),
             ("x3.word0 ", "c0"), ("x3.", "c3"), ("", "other")]
    df = spark.createDataFrame(texts, "t string, want string")
    rows = categorize(df, "t", "got", rules).collect()
    assert [r["got"] for r in rows] == [r["want"] for r in rows]


def test_rule_with_hundreds_of_keywords(spark):
    df = spark.createDataFrame([("has k299",), ("none",)], "t string")
    got = categorize(df, "t", "c", [([f"k{i}" for i in range(300)], "hit")]).collect()
    assert [r["c"] for r in got] == ["hit", "other"]


def movements(spark, rows):
    return spark.createDataFrame(rows, "bank string, d string, concept string, amount string").select(
        F.to_timestamp_ntz("d").alias("date"), "concept",
        F.col("amount").cast(LEDGER_SCHEMA["amount"].dataType).alias("amount"),
        F.lit(None).cast(LEDGER_SCHEMA["balance"].dataType).alias("balance"), "bank",
        F.lit("other").alias("category"), F.lit("f").alias("src_file"),
        F.monotonically_increasing_id().alias("src_row"))


NAMES = ["007", "7", "", None, "2024-01-01", "a/b=c %", "n", "1e3", "b"]


def test_account_names_stay_text(spark, tmp_path):
    lg = movements(spark, [(n, "2024-01-02", f"c{i}", "1.5") for i, n in enumerate(NAMES)])
    path = str(tmp_path / "ledger")
    write_ledger(lg, path)
    back = read_ledger(spark, path)
    assert back.columns == LEDGER_COLUMNS and back.schema["bank"].dataType.typeName() == "string"
    assert {(r["concept"], r["bank"]) for r in back.collect()} == \
        {(f"c{i}", n) for i, n in enumerate(NAMES)}
    assert [r["bank"] for r in read_ledger(spark, path, ["007", None]).orderBy("concept").collect()] \
        == ["007", None]
    stream = str(tmp_path / "stream")
    append_batch(merge_batch(spark, lg, stream, 0), stream, 0)
    assert {r["bank"] for r in spark.read.parquet(stream).collect()} == set(NAMES)
    assert merge_batch(spark, lg, stream, 1).count() == 0


def test_thousands_of_accounts_in_a_batch(spark, tmp_path):
    lg = movements(spark, [(f"acc{i}", "2024-01-02", "x", "2") for i in range(5000)])
    path = str(tmp_path / "stream")
    append_batch(merge_batch(spark, lg, path, 0), path, 0)
    assert merge_batch(spark, lg, path, 1).count() == 0
    folders = list((tmp_path / "stream_keys" / "level=0" / "slot=0").glob("_kb=*"))
    assert 0 < len(folders) <= 64


CARD = ("Type string, `Started Date` string, Description string, Amount string, State string,"
        " Balance string, src_file string, src_row long")


def test_small_and_large_amounts_are_kept(spark):
    rows = [("x", "2024-01-01 10:00:00", "\u00a0 tiny \u2003\x1c", "0.00012345", "COMPLETED", None, "f", 1),
            ("x", "2024-01-01 10:00:01", "huge", "100000000000000001.25", "COMPLETED", None, "f", 2),
            ("x", "2024-01-01 10:00:02", "comma", "1,234.56", "COMPLETED", None, "f", 3),
            ("x", "2024-01-01 10:00:03", "five", "-3.14159", "COMPLETED", None, "f", 4)]
    got = {r["concept"]: str(r["amount"]) for r in
           load_card_bank(spark.createDataFrame(rows, CARD), "B").collect()}
    assert got == {"tiny": "0.0001234500", "huge": "100000000000000001.2500000000",
                   "five": "-3.1415900000"}


def test_file_without_a_state_column_has_ledger_types(spark):
    got = parse_card_rows(spark.createDataFrame([("a",)], "Type string"), "B")
    assert got.schema == LEDGER_SCHEMA and got.count() == 0


def test_strip_is_pythons(spark):
    blanks = [chr(c) for c in range(0x3100) if chr(c).isspace()] + ["\u200b", "\x00", "\x1b", "\x7f"]
    texts = [b + "a" + b + "z" + b for b in blanks] + ["", " ", "\n\t", "a\n", "\ufeffa"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["s"] for r in df.select("i", strip("t").alias("s")).collect()}
    assert got == {i: t.strip() for i, t in enumerate(texts)}


def test_float_text_is_pythons_repr(spark):
    rng = random.Random(2)
    texts = ["0", "1", "-1", "12.5", "0.1", "100000", "0.0001", "0.00001", "-0.0000015", "1e15",
             "9999999999999998", "10000000000000000", "123456789012345678.25", "3.14159", "-0.0012",
             "1234567890123.1234567891", "9007199254740993"]
    texts += [f"{rng.uniform(-1e5, 1e5):.2f}" for _ in range(150)]
    texts += [f"{rng.uniform(-10, 10):.{rng.randrange(3, 10)}f}" for _ in range(100)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn(
        "x", F.col("t").cast("double").cast("decimal(38,10)"))
    for r in df.select("t", "x", py_float_text("x").alias("s")).collect():
        assert r["s"] == repr(float(r["x"])), r


def test_last_balance_follows_time_then_file_then_row(spark):
    from kontor.operators import report
    rng = random.Random(3)
    rows = [(rng.choice("ab"), f"2024-01-0{rng.randrange(1, 4)} {rng.choice(['00:00:00', '23:59:59', '07:08:09.000001', '07:08:09'])}",
             rng.choice(["f1", "f2", None]), i, float(i)) for i in range(300)]
    rows += [("old", "1901-02-03 04:05:06", "f", 2 ** 62, 1.0), ("old", "1901-02-03 04:05:06", "f", 5, 2.0)]
    df = spark.createDataFrame(rows, "bank string, d string, src_file string, src_row long, x double").select(
        "bank", F.to_timestamp_ntz("d").alias("date"), "src_file", "src_row",
        F.col("x").cast("decimal(38,10)").alias("balance"))
    best = {}
    for r in df.collect():
        at = (r["date"], r["src_file"] is not None, r["src_file"] or "", r["src_row"])
        for key in ((r["bank"], r["date"].date()), (r["bank"], None)):
            best[key] = max(best.get(key, (at, None)), (at, float(r["balance"])), key=lambda v: (v[0], v[1] is not None))
    got = {(r["bank"], r["date"]): r["balance"] for r in report.eod_balance(df).collect()}
    got |= {(r["bank"], None): r["balance"] for r in report.latest_balance(df).collect()}
    assert got == {k: v for k, (_, v) in best.items()}


def test_balance_reports_sort_no_ledger(spark):
    from kontor.operators import report
    df = movements(spark, [("a", "2024-01-02", "x", "1")]).withColumn("balance", F.col("amount"))
    for q in (report.eod_balance(df), report.eod_balance_chart(df), report.latest_balance(df)):
        plan = q._jdf.queryExecution().sparkPlan().toString()
        first = plan[plan.rindex("Aggregate("):] if "Aggregate(" in plan else plan
        assert "max_by" in plan or "min_by" in plan
        assert "SortAggregate" not in plan[plan.rindex("HashAggregate"):], first
