"""Rules updated by changes equal rules learned anew; as-of reads on intervals."""

import random

import pytest

from kontor.operators import learning as L
from kontor.operators import overrides as O

CONCEPTS = ["coffee house", "coffee", "Coffee bar", "tea", "teapot shop north", "teapot shop south", "ab"]


@pytest.mark.parametrize("seed", range(2))
def test_updates_equal_learning_anew(spark, seed):
    rng = random.Random(seed)
    ids = [f"t{i}" for i in range(14)]
    ledger = spark.createDataFrame([(t, rng.choice(CONCEPTS)) for t in ids] + [("t0", "ab")][:0],
                                   "tx_id string, concept string")
    state = {t: rng.choice(["a", "b", "other", None]) for t in rng.sample(ids, 6)}

    def table():
        return spark.createDataFrame(list(state.items()), "tx_id string, category string")

    counts = L.prefix_counts(ledger, table())
    rules = L.rules_of(counts)
    for _ in range(2):
        entries, before = [], table()
        for t in rng.sample(ids, 5):
            if t in state and rng.random() < 0.5:
                state.pop(t)
                entries.append((t, None, True))
            else:
                state[t] = rng.choice(["a", "b", "other", None])
                entries.append((t, state[t], False))
        entries = spark.createDataFrame(entries, "tx_id string, category string, deleted boolean")
        delta = L.count_changes(L.override_changes(before, entries, ledger))
        rules = L.update_rules(rules, counts, delta)
        counts = L.merge_counts(counts, delta)
        rules = spark.createDataFrame(rules.collect(), rules.schema)         # cut the lineage
        counts = spark.createDataFrame(counts.collect(), counts.schema)
        want = sorted(map(tuple, O.learn_prefix_rules(ledger, table()).collect()))
        assert sorted(map(tuple, rules.collect())) == want
        assert sorted(map(tuple, L.rules_of(counts).collect())) == want
        assert sorted(map(str, counts.collect())) == sorted(map(str, L.prefix_counts(ledger, table()).collect()))


def test_intervals_give_every_version_by_a_filter(spark, tmp_path):
    rng = random.Random(9)
    log = [(v, f"t{i}", rng.choice(["a", "b", None]), rng.random() < 0.3)
           for v in range(1, 9) for i in range(12) if rng.random() < 0.4]
    log = spark.createDataFrame(log, "version long, tx_id string, category string, deleted boolean")
    path = str(tmp_path / "intervals")
    O.write_intervals(O.log_intervals(log), path)
    stored = O.read_intervals(spark, path)
    for v in range(0, 11):
        want = sorted(map(str, O.overrides_as_of(log, v).collect()))
        got = O.intervals_as_of(stored, v)
        assert sorted(map(str, got.collect())) == want
        if v >= 4:
            kept = O.retain_intervals(O.log_intervals(log), 4)
            assert sorted(map(str, O.intervals_as_of(kept, v).collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan and "PushedFilters" in plan
