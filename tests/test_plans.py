"""Plan shape: no Python in the report plans, pruned scans, checked broadcasts."""

from kontor.operators import filters, identity, overrides, report
from kontor.registry import ledger
from kontor.sources import standin
from tests.conftest import SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_reports_stay_in_the_jvm(spark):
    lg = ledger(spark, SMALL, with_balance=False)
    for df in (report.monthly_net_by_bank(filters.hide_transfers(lg)),
               report.movement_summary(lg), report.category_share(lg),
               report.movements_view(identity.with_tx_id(lg), sort=False)):
        p = _plan(df)
        assert "PythonUDF" not in p and "ArrowEvalPython" not in p and "BatchEvalPython" not in p


def test_scan_reads_only_needed_columns(spark):
    lg = ledger(spark, SMALL, with_balance=False)
    p = _plan(report.monthly_net_by_bank(lg))
    assert "o_totalprice" in p and "c_name" not in p and "c_acctbal" not in p


def test_small_overrides_end_up_broadcast(spark):
    """No hint: AQE measures the override side at run time and broadcasts it."""
    lg = identity.with_tx_id(ledger(spark, SMALL, False))
    ov = standin.overrides_table(spark, SMALL, lg)
    df = overrides.apply_overrides(lg, ov)
    df.collect()
    p = _plan(df)
    assert "BroadcastHashJoin" in p


def test_stored_ledger_prunes_partitions_and_pushes_filters(spark, tmp_path):
    from kontor.operators.ledger import read_ledger, write_ledger
    lg = ledger(spark, SMALL)
    write_ledger(lg, str(tmp_path / "ledger"))
    stored = read_ledger(spark, str(tmp_path / "ledger"), ["Bank2"])
    q = filters.date_range(stored, "1996-01-01", "1996-12-31")
    p = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in p and "Bank2" in p
    assert q.count() == lg.filter("bank = 'Bank2' and year(date) = 1996").count()
