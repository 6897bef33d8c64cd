"""Inputs that a job reads several times are worked out once (findings F3 to F8)."""

import datetime

import pytest

from kontor import registry
from kontor.sources import card_csv, statements


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Ten orders of four customers, with items of two parts."""
    d = str(tmp_path_factory.mktemp("tables"))
    day = datetime.datetime(1997, 3, 1)
    priority = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    made = {
        "customer": ([(i, f"Customer#{i}", 10.5 * i, "BUILDING") for i in range(4)],
                     "c_custkey long, c_name string, c_acctbal double, c_mktsegment string"),
        "orders": ([(i, i % 4, "FO"[i % 2], 100.25 + i, day + datetime.timedelta(days=i % 7),
                     priority[i % 5]) for i in range(10)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                   "o_orderdate timestamp_ntz, o_orderpriority string"),
        "lineitem": ([(i % 10, i % 2, i // 10, 50.0 if i % 3 else 7.0, "RN"[i % 2], day)
                      for i in range(20)],
                     "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, "
                     "l_returnflag string, l_shipdate timestamp_ntz"),
        "part": ([(i, f"ring {i}", "Brand#1", f"TYPE {i}") for i in range(2)],
                 "p_partkey long, p_name string, p_brand string, p_type string")}
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def read_by(monkeypatch, name):
    """The files behind the ledger that a stand-in gets."""
    seen, own = [], getattr(registry.S, name)

    def wrapped(*args):
        seen.extend(args[-1].inputFiles())
        return own(*args)

    monkeypatch.setattr(registry.S, name, wrapped)
    return seen


@pytest.mark.parametrize("name", ["overrides_table", "edits_table"])
def test_overrides_come_from_the_stored_ledger(spark, tables, monkeypatch, name):      # F8
    seen = read_by(monkeypatch, name)
    got = registry.QUERIES["apply_overrides_by_id"](spark, tables)
    assert seen and not any("orders.parquet" in f for f in seen)
    assert got.count() == 10


def test_the_reexport_comes_from_the_first_export(spark, tables, monkeypatch):          # F6
    seen = read_by(monkeypatch, "reexport")
    got = registry.QUERIES["incremental_ingest"](spark, tables)
    assert seen and not any("orders.parquet" in f for f in seen)
    # the rows without a balance (3-MEDIUM) are new, with their shifted times
    assert got.count() == 12


def test_csv_lines_are_put_together_once(spark, tmp_path):                              # F3
    (tmp_path / "a.csv").write_text('Description,State\n"two\nlines, one",COMPLETED\nx,REVERTED\n')
    (tmp_path / "b.csv").write_text("State,Type\nCOMPLETED,ATM\n")
    got = card_csv.read_card_csv(spark, [str(tmp_path / "*.csv")])
    assert not any(f.endswith(".csv") for f in got.inputFiles())
    assert sorted(got.select("Description", "State", "Type").collect(), key=str) == sorted(
        [("two\nlines, one", "COMPLETED", None), ("x", "REVERTED", None),
         (None, "COMPLETED", "ATM")], key=str)


def test_statement_lines_are_scanned_once(spark):                                       # F4, F5, F7
    text = ["Fecha de este estado: 31/03/1997", "SALDO DIARIO", "05/03", "1", "shop", "-1.50",
            "8.50", "06/03", "2", "cut off"]
    lines = spark.createDataFrame([(d, i, x) for d in "ab" for i, x in enumerate(text)],
                                  "doc string, line_no long, line string")
    for block_rows in (3, 1000):
        got = statements.parse_statement_lines(lines, block_rows)
        assert got.inputFiles() and all("stmt-parts" in f for f in got.inputFiles())
        assert sorted((r["doc"], r["line_no"], r["concept"]) for r in got.collect()) == [
            ("a", 2, "shop"), ("b", 2, "shop")]
