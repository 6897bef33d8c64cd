"""The key index in levels: which runs hold which batches, replays, and its size."""

import pytest

from kontor.streaming import ingest as I


def slots_after(batches, crash_every=0):
    """Contents (batch numbers) of every (level, slot) as batches come; some come twice."""
    runs: dict = {}
    for n in range(batches):
        for attempt in range(2 if crash_every and n % crash_every == 0 else 1):
            for level, slots, target in I.due_merges(n):
                runs[level + 1, target] = set().union(*(runs[level, s] for s in slots))
            live = [runs[r] for r in I.live_runs(n)]
            assert sorted(b for r in live for b in r) == list(range(n))     # each batch once
            runs[0, I._slot(n)] = {n}
    return runs


@pytest.mark.parametrize("fan_in", [2, 3, 8])
def test_live_runs_hold_every_earlier_batch_once(monkeypatch, fan_in):
    monkeypatch.setattr(I, "FAN_IN", fan_in)
    runs = slots_after(700, crash_every=1)
    levels = 1 + max(level for level, _ in runs)
    assert len(runs) <= 2 * fan_in * levels and fan_in ** (levels - 1) <= 700


def test_folders_stay_as_many_over_many_batches(spark, tmp_path, monkeypatch):
    from kontor.schema import LEDGER_SCHEMA
    monkeypatch.setattr(I, "FAN_IN", 2)
    monkeypatch.setattr(I, "KEY_BUCKETS", 2)
    path, folders = str(tmp_path / "ledger"), []
    rows = spark.range(400).selectExpr(
        "timestamp_ntz '2024-01-01 00:00:00' as date", "cast(id as string) concept",
        "cast(id as decimal(38,10)) amount", "cast(null as decimal(38,10)) balance",
        "'b' bank", "'other' category", "'f' src_file", "id src_row").to(LEDGER_SCHEMA)
    for n in range(13):
        # five new rows and five of earlier batches; every sixth batch comes twice
        batch = rows.filter(f"src_row between {5 * n - 5} and {5 * n + 4}")
        for attempt in range(2 if n % 6 == 0 else 1):
            new = I.merge_batch(spark, batch, path, n)
            I.append_batch(new, path, n)
        folders.append(len(list((tmp_path / "ledger_keys").glob("level=*/slot=*"))))
    got = [r["src_row"] for r in spark.read.parquet(path).select("src_row").collect()]
    assert sorted(got) == list(range(5 * 13))
    assert I.merge_batch(spark, rows.filter("src_row < 65"), path, 13).count() == 0
    assert max(folders) <= 4 * 4
    # a small batch is looked up by its hashes
    probe = I.merge_batch(spark, rows.filter("src_row = 3"), path, 13)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = probe._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "_kh" in plan.split("PushedFilters: [")[-1].split("]")[0] or "EqualTo(_kh" in plan
