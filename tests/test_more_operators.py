"""Smaller operators: JSON sources, inventory, head rows, orderings, versions,
vocabulary change, streaming replay."""

import os
import tempfile

from pyspark.sql import functions as F

from kontor.operators import filters, identity, overrides, report
from kontor.sources import files, grids, json_io
from kontor.streaming.ingest import append_batch, merge_batch
from tests.conftest import SMALL


def test_json_documents_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="kontor-json-")
    voc = os.path.join(folder, "categories.json")
    with open(voc, "w", encoding="utf-8") as f:
        f.write('["other", "café", "rent"]')
    ov = os.path.join(folder, "overrides.json")
    with open(ov, "w", encoding="utf-8") as f:
        f.write('{"a1": "rent", "b2": "other"}')
    assert sorted(r.category for r in json_io.read_vocabulary(spark, voc).collect()) == \
        ["café", "other", "rent"]
    assert json_io.read_vocabulary(spark, voc + ".missing").collect()[0].category == "otros"
    assert dict(json_io.read_overrides_document(spark, ov).collect()) == {"a1": "rent",
                                                                        "b2": "other"}
    assert json_io.read_overrides_document(spark, ov + ".missing").count() == 0
    out = os.path.join(folder, "vocab-out")
    json_io.write_vocabulary(json_io.read_vocabulary(spark, voc), out)
    text = spark.read.text(out).first().value
    assert text == '["café","other","rent"]'


def test_overrides_document_in_parts(spark):
    import json

    import pytest
    folder = tempfile.mkdtemp(prefix="kontor-json-")
    rows = {f'i{i}"\\\n{{}},é': None if i % 50 == 0 else f"c, }}{i % 7}" for i in range(2000)}
    frame = spark.createDataFrame(list(rows.items()), "tx_id string, category string")
    out = os.path.join(folder, "many")
    json_io.write_overrides_document(frame.repartition(5), out)
    parts = sorted(n for n in os.listdir(out) if n.startswith("part-"))
    texts = [open(os.path.join(out, n), encoding="utf-8").read() for n in parts]
    assert len("".join(texts).splitlines()) == len(rows)        # an entry a line, none in one value
    whole = json.loads("".join(texts))
    assert whole == rows and list(whole) == sorted(rows)
    assert dict(json_io.read_overrides_document(spark, out).collect()) == rows
    for i, indent in enumerate((None, 2)):
        path = os.path.join(folder, f"dump{i}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(rows, f, indent=indent)
        assert dict(json_io.read_overrides_document(spark, path).collect()) == rows
    json_io.write_overrides_document(frame.limit(0), out)
    assert json_io.read_overrides_document(spark, out).count() == 0
    for bad in ([("a", "x"), ("a", "y")], [(None, "x"), ("b", "y")]):
        with pytest.raises(Exception):
            json_io.write_overrides_document(
                spark.createDataFrame(bad, "tx_id string, category string"), out)


def test_inventory_and_extension_filter(spark):
    inv = [(r.name, r.size_kb) for r in files.file_inventory(spark, SMALL, "*.parquet").collect()]
    brute = sorted((n, os.path.getsize(os.path.join(SMALL, n)) / 1024.0)
                   for n in os.listdir(SMALL) if n.endswith(".parquet"))
    assert inv == brute
    paths = spark.createDataFrame([("a/X.XLSX",), ("a/y.xls",), ("a/z.csv",)], "path string")
    got = [r.path for r in files.extension_filter(paths, ["xls", "xlsx"]).collect()]
    assert got == ["a/X.XLSX", "a/y.xls"]


def test_head_rows(spark):
    raw = spark.createDataFrame([("f", i, [str(j) for j in range(9)]) for i in range(5)],
                                "path string, row_no long, cells array<string>")
    out = grids.head_rows(raw, 3).collect()
    assert len(out) == 3 and all(len(r.cells) == 6 for r in out)


def test_orderings(spark):
    df = spark.createDataFrame(
        [("2024-01-02 10:00:00", "f", 2, 5.0), ("2024-01-02 10:00:00", "f", 1, None),
         ("2024-01-01 09:00:00", "g", 9, 1.0)], "d string, src_file string, src_row long, b double"
    ).select(F.to_timestamp_ntz("d").alias("date"), "src_file", "src_row", F.col("b").alias("balance"))
    assert [r.src_row for r in files.ledger_order(df).collect()] == [9, 1, 2]
    assert [r.src_row for r in report.sort_by(df, "balance", ascending=False).collect()] == [2, 9, 1]


def test_save_version_and_vocabulary_change(spark):
    ov1 = spark.createDataFrame([("a", "x")], "tx_id string, category string")
    ov2 = spark.createDataFrame([("a", "y"), ("b", "z")], "tx_id string, category string")
    log = overrides.save_version(overrides.save_version(None, ov1, 1), ov2, 2)
    assert dict(overrides.overrides_as_of(log, 1).collect()) == {"a": "x"}
    assert dict(overrides.overrides_as_of(log, 2).collect()) == {"a": "y", "b": "z"}
    v1 = spark.createDataFrame([("a",), ("b",)], "category string")
    v2 = spark.createDataFrame([("b",), ("a",)], "category string")
    assert not overrides.vocabulary_changed(v1, v2)
    assert overrides.vocabulary_changed(v1, v2.limit(1))
    merged = overrides.vocabulary_merge(v1, spark.createDataFrame([(" A ",), ("New ",), ("",)],
                                                                  "name string"))
    assert [(r.category, r.is_new) for r in merged.collect()] == \
        [("a", False), ("b", False), ("new", True)]


def test_stream_batch_replay_appends_nothing_twice(spark, tmp_path):
    from kontor.registry import ledger
    lg = ledger(spark, SMALL)
    path = str(tmp_path / "ledger")
    append_batch(merge_batch(spark, lg, path, 0), path, 0)
    # a later batch with the same rows finds them all known
    assert merge_batch(spark, lg, path, 1).count() == 0
    # batch 0 re-run (its index entries ignored) rewrites the same rows
    append_batch(merge_batch(spark, lg, path, 0), path, 0)
    assert spark.read.parquet(path).count() == lg.count()
    # a re-run after an attempt whose key write landed but whose ledger write
    # did not: the batch's own index entries are ignored, its rows written
    other = str(tmp_path / "ledger2")
    first = merge_batch(spark, lg, other, 0)
    (first.select(*[c for c in first.columns if c.startswith("_k_")], "_kh", "_kb")
     .write.partitionBy("_kb").parquet(other + "_keys/level=0/slot=0"))
    append_batch(merge_batch(spark, lg, other, 0), other, 0)
    assert spark.read.parquet(other).count() == lg.count()
    # the probe reads only the key-index buckets the batch touches
    one = lg.filter("bank = 'Bank1'").orderBy("src_row").limit(3)
    probe = merge_batch(spark, one, path, 2)
    assert probe.count() == 0
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        probe.collect()
        plan = probe._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = [x.split("]")[0] for x in plan.split("PartitionFilters: [")[1:]]
    assert any("_kb" in x for x in scans)           # the account is a column of the rows


def test_filters_small(spark):
    df = spark.createDataFrame([("own transfer", 1.0), (None, -2.0), ("rent", 0.0)],
                               "category string, amount double")
    assert filters.hide_transfers(df).count() == 2          # null category kept
    assert filters.income(df).count() == 1 and filters.expenses(df).count() == 1
    assert filters.notebook_expenses(df).count() == 2       # zero counts as expense
    assert filters.in_selection(df, categories=[]).count() == 0


def test_ingest_one_batch_or_many_gives_the_same_keys(spark, tmp_path):
    """K1 property: the same exports in one micro-batch or one file per batch."""
    from kontor.operators.categorize import categorize
    from kontor.registry import ledger
    from kontor.sources.standin import STANDIN_RULES, reexport
    from kontor.streaming.ingest import run_until_caught_up, start_ingest
    lg = ledger(spark, SMALL)
    inbox = str(tmp_path / "inbox")
    lg.drop("category").coalesce(1).write.parquet(inbox + "/a")
    reexport(lg).drop("category").coalesce(2).write.parquet(inbox + "/b")
    schema = lg.drop("category").schema

    def parse(b):
        return categorize(b, "concept", "category", STANDIN_RULES)

    keys = []
    for name, opts in (("one", {}), ("many", {"maxFilesPerTrigger": "1"})):
        out = str(tmp_path / name)
        run_until_caught_up(start_ingest(spark, inbox + "/*", schema, out + "/ledger",
                                         out + "/ckpt", parse, options=opts))
        led = spark.read.parquet(out + "/ledger")
        keys.append(sorted(tuple(r) for r in led.select(*identity.dedup_key()).collect()))
    assert keys[0] == keys[1] and len(keys[0]) > 0


def test_ingest_auto_classifies_new_rows(spark, tmp_path):
    """K1 with D6: rows of a new export get overrides from learned prefixes."""
    from kontor.operators.identity import with_tx_id
    from kontor.registry import ledger
    from kontor.sources.json_io import read_overrides_table
    from kontor.streaming.ingest import run_until_caught_up, start_ingest
    lg = ledger(spark, SMALL)
    old = lg.filter("year(date) < 1998")
    new_rows = lg.filter("year(date) >= 1998")
    ids = with_tx_id(old)
    # the user labelled every old 'BUILDING 1-URGENT' row
    ov = ids.filter(F.col("concept") == "BUILDING 1-URGENT").select(
        "tx_id", F.lit("works").alias("category")).distinct()
    ov.write.json(str(tmp_path / "overrides"))
    overrides.learn_prefix_rules(ids, ov).write.parquet(str(tmp_path / "rules"))
    inbox = str(tmp_path / "inbox")
    new_rows.drop("category").write.parquet(inbox + "/x")
    schema = new_rows.drop("category").schema
    run_until_caught_up(start_ingest(
        spark, inbox + "/*", schema, str(tmp_path / "ledger"), str(tmp_path / "ckpt"),
        lambda b: b.withColumn("category", F.lit("other")),
        classify=(str(tmp_path / "rules"), str(tmp_path / "overrides"))))
    got = read_overrides_table(spark, str(tmp_path / "overrides"))
    added = got.join(ov, "tx_id", "left_anti")
    # every learned prefix starts with 'build': all new BUILDING rows qualify
    want = with_tx_id(new_rows).filter(F.col("concept").startswith("BUILDING")) \
        .select("tx_id").distinct()
    assert added.count() == want.count() > 0
    assert added.select("category").distinct().collect()[0].category == "works"


def test_remaining_filters(spark):
    import datetime as dt
    df = spark.createDataFrame(
        [("a", "B1", dt.datetime(2024, 5, 31, 23), "Pago Lidl", 1.0),
         ("b", "B2", dt.datetime(2024, 6, 1, 0), "pago lidl", None),
         ("c", "B1", None, "Otro", 2.0)],
        "tx_id string, bank string, date timestamp_ntz, concept string, amount double")
    assert [r.tx_id for r in filters.text_contains(df, "Lidl").collect()] == ["a"]   # C13
    assert [r.tx_id for r in filters.exclude_labels(df, ["Otro"]).collect()] == ["a", "b"]
    assert [r.tx_id for r in filters.one_bank(df, "B2").collect()] == ["b"]          # C14
    ov = spark.createDataFrame([("a", "x")], "tx_id string, category string")
    assert sorted(r.tx_id for r in filters.not_overridden(df, ov).collect()) == ["b", "c"]
    assert [r.tx_id for r in filters.drop_nulls(df, ["date", "amount"]).collect()] == ["a"]
    assert [r.tx_id for r in filters.completed_months(df, "2024-06-15").collect()] == ["a"]
    assert [r.tx_id for r in filters.date_range(df, "2024-05-31", "2024-05-31").collect()] == ["a"]


def test_report_tables_written(spark, tmp_path):
    from kontor.registry import ledger
    from kontor.sources.standin import bank_currency
    lg = ledger(spark, SMALL)
    names = report.write_report_tables(lg, "2001-08-01", str(tmp_path / "report"),
                                       bank_currency(spark))
    assert len(names) == 10
    fc = spark.read.parquet(str(tmp_path / "report" / "bank_forecast"))
    assert set(fc.columns) >= {"bank", "side", "category", "predicted"}
    totals = spark.read.parquet(str(tmp_path / "report" / "metric_totals")).first()
    assert totals.total_income >= 0 and totals.total_expenses >= 0


def test_number_and_time_text_forms(spark):
    """Python float repr / JavaScript String(x) of money, ISO timestamps."""
    import datetime as dt
    from decimal import Decimal
    from kontor.functions.text import iso_timestamp_text, js_number_text, py_float_text
    vals = ["12.50", "3.00", "-0.10", "12345678.50", "0.00", None]
    df = spark.createDataFrame([(None if v is None else Decimal(v),) for v in vals],
                               "x decimal(18,2)")
    got = [(r.p, r.j) for r in df.select(py_float_text("x").alias("p"),
                                         js_number_text("x").alias("j")).collect()]
    assert [g[0] for g in got] == [repr(float(v)) if v is not None else "nan" for v in vals]
    assert [g[1] for g in got] == ["12.5", "3", "-0.1", "12345678.5", "0", None]
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5),),
                                (dt.datetime(2024, 1, 2, 3, 4, 5, 120),)], "t timestamp_ntz")
    assert [r.s for r in ts.select(iso_timestamp_text("t").alias("s")).collect()] == \
        [dt.datetime(2024, 1, 2, 3, 4, 5).isoformat(), dt.datetime(2024, 1, 2, 3, 4, 5, 120).isoformat()]


def test_descriptions_with_bare_operation_lead(spark):
    df = spark.createDataFrame([("Fecha de operación 01/02/2024", "Tienda"),
                                ("Fecha de operación", None), (None, None)],
                               "d1 string, d3 string")
    got = [r.c for r in df.select(grids.concept_from_descriptions(F.col("d1"), F.col("d3"))
                                  .alias("c")).collect()]
    assert got == ["Tienda", "no description", "no description"]
