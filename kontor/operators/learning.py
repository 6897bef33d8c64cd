"""Learned prefix rules kept up to date (D5): counts that a save's changes update.

``overrides.learn_prefix_rules`` reads the whole ledger and all overrides.  After an
upload or a save only a few overrides differ, so the library can keep, next to the
overrides, how many of them speak for each (prefix, category):

* ``prefix_counts`` counts all overrides once;
* ``override_changes`` is what a version of the override log changes (its own entries
  and what was in force for their ids), ``count_changes`` turns it into counts to add
  (negative for what no longer holds);
* ``merge_counts`` adds them, and ``update_rules`` works out anew the rules of the
  prefixes that they touch and keeps all others.

Counts add up, so changes may also be kept as runs and merged now and then.  A rule is
a prefix whose overrides all have one category that is not null, as in
``learn_prefix_rules``; 'other' teaches nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.functions.text import concept_key
from kontor.operators.fixed_values import DEFAULT_CATEGORY, LEARN_PREFIX_MAX, LEARN_PREFIX_MIN
from kontor.operators.overrides import concepts_of, prefixes


def _counted(rows: DataFrame) -> DataFrame:
    """(prefix, category, n) of rows (concept, category, n) that teach something."""
    rows = rows.filter(F.col("category").isNull() | (F.col("category") != DEFAULT_CATEGORY))
    # summed per concept first: only distinct concepts are expanded
    rows = rows.groupBy(concept_key("concept").alias("key"), "category").agg(F.sum("n").alias("n"))
    exploded = rows.filter(F.col("n") != 0).select("category", "n", F.explode(
        prefixes(F.col("key"), LEARN_PREFIX_MIN, LEARN_PREFIX_MAX)).alias("p"))
    return (exploded.groupBy(F.col("p.prefix").alias("prefix"), "category")
            .agg(F.sum("n").alias("n")).filter(F.col("n") != 0))


def prefix_counts(ledger: DataFrame, overrides: DataFrame) -> DataFrame:
    """How many overrides speak for each (prefix, category): ``(prefix, category, n)``."""
    rows = concepts_of(ledger, overrides).join(overrides.select("tx_id", "category"), "tx_id")
    return _counted(rows.select("concept", "category", F.lit(1).cast("long").alias("n")))


def override_changes(before: DataFrame, entries: DataFrame, concepts: DataFrame) -> DataFrame:
    """What log entries ``(tx_id, category, deleted)`` change: ``(concept, category, n)`` with
    n = -1 for the override in force ``before`` and 1 for the new one.  ``concepts`` has the
    concepts of the entries' ids (others do no harm); an id without one teaches nothing."""
    old = before.select("tx_id", "category").join(entries.select("tx_id"), "tx_id", "left_semi")
    both = (old.select("tx_id", "category", F.lit(-1).cast("long").alias("n"))
            .unionByName(entries.filter(~F.col("deleted")).select(
                "tx_id", "category", F.lit(1).cast("long").alias("n"))))
    return both.join(concepts.select("tx_id", "concept"), "tx_id").select(
        "concept", "category", "n")


def count_changes(changes: DataFrame) -> DataFrame:
    """Counts to add for some changes: ``(prefix, category, n)``."""
    return _counted(changes)


def merge_counts(counts: DataFrame, delta: DataFrame) -> DataFrame:
    """Counts with others added; what is left at zero goes."""
    return (counts.unionByName(delta).groupBy("prefix", "category").agg(F.sum("n").alias("n"))
            .filter(F.col("n") != 0))


def rules_of(counts: DataFrame) -> DataFrame:
    """``(prefix, category)`` of the prefixes that speak for one category."""
    per_prefix = counts.groupBy("prefix").agg(
        F.min("category").alias("lo"), F.max("category").alias("hi"),
        F.max(F.col("category").isNull()).alias("null"))
    return (per_prefix.filter((F.col("lo") == F.col("hi")) & ~F.col("null"))
            .select("prefix", F.col("lo").alias("category")))


def update_rules(rules: DataFrame, counts: DataFrame, delta: DataFrame) -> DataFrame:
    """The rules after ``delta`` is added to ``counts`` (both as before it): those of the
    prefixes in ``delta`` are worked out anew, the others stay."""
    touched = delta.select("prefix").distinct()
    anew = merge_counts(counts.join(touched, "prefix", "left_semi"), delta)
    return rules.join(touched, "prefix", "left_anti").unionByName(rules_of(anew))
