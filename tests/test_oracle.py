"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest

import __spark_entry__ as E
from kontor.oracle_sql import SQL
from kontor.registry import QUERIES
from scripts.check_oracle import rows_of
from tests.conftest import SMALL

NAMES = sorted(QUERIES)


def test_every_query_has_sql():
    assert set(NAMES) == set(SQL) & set(E.oracle_sql()) & set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SMALL)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(dcols)
    assert rows_of(cols, rows) == rows_of(dcols, cur.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["bank", "month", "amount"]
    assert df.count() > 0
