"""User overrides: applying them (D8, B7, D12), learning prefix rules from them
(D5), classifying new rows with those rules (D6), spreading an edit to rows
with the same concept prefix (D7), merging (D10), versions (D11, A20) and the
category vocabulary (D9).

Overrides are a table ``(tx_id, category)``; the history is an append-only log of
changes ``(version, tx_id, category, deleted)``.  Prefix matching never pairs rows with rules:
the *distinct* concepts are expanded into their (at most 30) prefixes and
equi-joined with the rule prefixes, then the result is joined back to the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kontor.functions.text import concept_key, strip
from kontor.operators.fixed_values import (
    DEFAULT_CATEGORY, LEARN_PREFIX_MAX, LEARN_PREFIX_MIN, LEGACY_CATEGORY, PREFIX_LEN,
    SNAPSHOTS_KEPT,
)
from kontor.plans.joins import join_small


# ------------------------------------------------------------- apply
def normalize_category(c: Column) -> Column:
    """Null -> 'other'; the retired 'accommodation' -> 'other'."""
    c = F.coalesce(c, F.lit(DEFAULT_CATEGORY))
    return F.when(c == LEGACY_CATEGORY, F.lit(DEFAULT_CATEGORY)).otherwise(c)


def apply_overrides(ledger: DataFrame, overrides: DataFrame) -> DataFrame:
    """D8 + B7: an override replaces the automatic category (left join on
    tx_id; ``overrides`` has one row per tx_id, so rows never multiply)."""
    ov = overrides.select("tx_id", F.col("category").alias("_ov"))
    out = join_small(ledger, ov, "tx_id", "left")
    return (out.withColumn("category", normalize_category(F.coalesce("_ov", "category")))
            .drop("_ov"))


def migrate_legacy(overrides: DataFrame) -> DataFrame:
    """Overrides pointing at the retired category now point at 'other'."""
    return overrides.withColumn(
        "category", F.when(F.col("category") == LEGACY_CATEGORY, F.lit(DEFAULT_CATEGORY))
        .otherwise(F.col("category")))


# ------------------------------------------------------------ learn
def concepts_of(ledger: DataFrame, ids: DataFrame) -> DataFrame:
    """The concept of each id (ids sharing a tx_id share the concept)."""
    rows = join_small(ledger.select("tx_id", "concept"), ids.select("tx_id").distinct(),
                      "tx_id", "left_semi")
    return rows.groupBy("tx_id").agg(F.max("concept").alias("concept"))


def prefixes(key: Column, lo: int, hi: int) -> Column:
    """Prefixes of lengths lo..min(len, hi); none when the text is shorter than lo."""
    n = F.least(F.length(key), F.lit(hi))
    lengths = F.when(F.length(key) >= lo, F.sequence(F.lit(lo), n)) \
        .otherwise(F.array().cast("array<int>"))
    return F.transform(lengths, lambda L: F.struct(L.alias("len"),
                                                   F.substring(key, 1, L).alias("prefix")))


def learn_prefix_rules(ledger: DataFrame, overrides: DataFrame) -> DataFrame:
    """``(prefix, category)`` rules from every non-'other' override.

    Each overridden concept (trimmed, lower case) yields its prefixes of 5..30
    characters; a prefix seen with two categories (a null one counts as a
    category) is dropped (F20).  The ambiguity test is ``min = max`` and no
    null, which aggregates on the map side however many overrides share a
    prefix.
    """
    # 'other' overrides teach nothing; a null category still counts as a
    # category of its own (a prefix seen with it is ambiguous, as in the original)
    ov = overrides.filter(F.col("category").isNull() | (F.col("category") != DEFAULT_CATEGORY))
    concepts = concepts_of(ledger, ov)
    labelled = (concepts.join(ov.select("tx_id", "category"), "tx_id", "inner")
                .select(concept_key("concept").alias("_ck"), "category").distinct())
    # distinct (concept, category) pairs are expanded, not one row per override
    exploded = labelled.select(
        "category",
        F.explode(prefixes(F.col("_ck"), LEARN_PREFIX_MIN, LEARN_PREFIX_MAX)).alias("p"))
    per_prefix = exploded.groupBy(F.col("p.prefix").alias("prefix")).agg(
        F.min("category").alias("_lo"), F.max("category").alias("_hi"),
        F.max(F.col("category").isNull()).alias("_null"))
    return (per_prefix.filter((F.col("_lo") == F.col("_hi")) & ~F.col("_null"))
            .select("prefix", F.col("_lo").alias("category")))


# ---------------------------------------------------------------- apply
def auto_classify(ledger: DataFrame, overrides: DataFrame, rules: DataFrame,
                  banks: list[str] | None = None) -> DataFrame:
    """Rows (of ``banks``, or all) without an override get the category of
    their longest matching learned prefix.  Returns new ``(tx_id, category)``
    overrides; rows that already have an override are never touched (C15).
    """
    rows = ledger.select("bank", "tx_id", "concept")
    if banks is not None:
        rows = rows.filter(F.col("bank").isin(banks))
    rows = join_small(rows, overrides.select("tx_id"), "tx_id", "left_anti")
    rows = rows.withColumn("_ck", concept_key("concept"))

    concepts = rows.select("_ck").distinct()
    cand = concepts.select(
        "_ck", F.explode(prefixes(F.col("_ck"), LEARN_PREFIX_MIN, LEARN_PREFIX_MAX))
        .alias("p")).select("_ck", F.col("p.len").alias("_len"), F.col("p.prefix").alias("prefix"))
    hits = join_small(cand, rules.select("prefix", "category"), "prefix", "inner")
    best = hits.groupBy("_ck").agg(F.max_by("category", "_len").alias("category"))
    # the longest match decides; an empty category there sets nothing (no
    # fall-back to a shorter prefix)
    best = best.filter(F.col("category") != "")

    out = join_small(rows, best, "_ck", "inner")
    # rows that share an id share the concept, and so the category
    return out.select("tx_id", "category").distinct()


# ---------------------------------------------------------------- bulk
def concept_prefix(c: Column) -> Column:
    """First 20 characters of the trimmed, lower-case concept."""
    return F.substring(concept_key(c), 1, PREFIX_LEN)


def bulk_apply(ledger: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits ``(edit_seq, bank, tx_id, category)`` in ``edit_seq`` order.

    Each edit sets its own row and every row of the same account whose
    concept starts with the edited row's 20-character prefix (a shorter
    concept gives a shorter prefix; an empty one spreads to nothing).  When
    several edits reach a row, the latest wins.  Returns ``(tx_id, category)``.
    """
    edits = edits.select("edit_seq", "bank", "tx_id", "category")
    concepts = concepts_of(ledger, edits)
    e = (edits.join(concepts, "tx_id", "inner")
         .withColumn("prefix", concept_prefix(F.col("concept"))))
    # latest edit per (bank, prefix): the only one that can win on those rows
    by_prefix = (e.filter(F.length("prefix") > 0)
                 .groupBy("bank", "prefix")
                 .agg(F.max(F.struct("edit_seq", "category")).alias("w")))

    rows = ledger.select("bank", "tx_id", concept_key("concept").alias("_ck"))
    concepts_b = rows.select("bank", "_ck").distinct().filter(F.length("_ck") > 0)
    cand = concepts_b.select(
        "bank", "_ck",
        F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length("_ck"), F.lit(PREFIX_LEN))),
                              lambda L: F.substring(F.col("_ck"), 1, L))).alias("prefix"))
    hit = join_small(cand, by_prefix, ["bank", "prefix"], "inner")
    per_concept = hit.groupBy("bank", "_ck").agg(F.max("w").alias("w"))
    spread = (join_small(rows, per_concept, ["bank", "_ck"], "inner")
              .select("tx_id", "w"))
    direct = edits.select("tx_id", F.struct("edit_seq", "category").alias("w"))
    return (spread.unionByName(direct)
            .groupBy("tx_id").agg(F.max("w").alias("w"))
            .select("tx_id", F.col("w.category").alias("category")))


def bulk_count(result: DataFrame) -> DataFrame:
    """F16: how many ids an operation set."""
    return result.agg(F.count_distinct("tx_id").cast("long").alias("n"))


# --------------------------------------------------------- merge, versions
def merge_overrides(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old.update(new)`` — an id in ``new`` takes the new category."""
    kept = old.select("tx_id", "category").join(new.select("tx_id"), "tx_id", "left_anti")
    return kept.unionByName(new.select("tx_id", "category"))


def _with_removals(log: DataFrame) -> DataFrame:
    return log if "deleted" in log.columns else log.withColumn("deleted", F.lit(False))


def overrides_as_of(log: DataFrame, version: int) -> DataFrame:
    """The overrides in force at ``version`` (undo = an earlier version; redo = a
    later one): each id's latest entry up to it, unless that entry removes the id.
    A log without the column ``deleted`` has no removals."""
    log = _with_removals(log)
    latest = (log.filter(F.col("version") <= F.lit(version))
              .groupBy("tx_id").agg(F.max("version").alias("version")))
    return (log.join(latest, ["tx_id", "version"]).filter(~F.col("deleted"))
            .select("tx_id", "category"))


def log_intervals(log: DataFrame) -> DataFrame:
    """The log as intervals ``(tx_id, category, valid_from, valid_to)``: an override is in
    force from its version up to, not including, the id's next entry (null: to this day).
    Removals only end an interval.  Each id's own entries meet in a window, which are as
    many as it has versions."""
    log = _with_removals(log)
    own = Window.partitionBy("tx_id").orderBy("version")
    return (log.withColumn("valid_to", F.lead("version").over(own)).filter(~F.col("deleted"))
            .select("tx_id", "category", F.col("version").alias("valid_from"), "valid_to"))


def write_intervals(intervals: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store intervals so that an as-of read is a filter: the ones still in force apart from
    the ended ones, these sorted by their end (row groups are skipped by its bounds)."""
    rows = intervals.withColumn("ended", F.col("valid_to").isNotNull())
    (rows.repartitionByRange("ended", "valid_to", "valid_from", "tx_id")
     .sortWithinPartitions("ended", "valid_to", "valid_from", "tx_id")
     .write.mode(mode).partitionBy("ended").parquet(path))


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tx_id string, category string, valid_from long, valid_to long, "
                             "ended boolean").parquet(path)


def intervals_as_of(intervals: DataFrame, version: int) -> DataFrame:
    """D11 on intervals: the overrides in force at ``version``.  A filter: the log is neither
    shuffled nor aggregated, and of stored intervals those that ended before are skipped."""
    at = F.lit(version)
    return (intervals.filter((F.col("valid_from") <= at)
                             & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))
            .select("tx_id", "category"))


def retain_intervals(intervals: DataFrame, first: int) -> DataFrame:
    """G7 on intervals: what ended at ``first`` or before goes, so every as-of from ``first``
    on gives the same; a filter as well."""
    return intervals.filter(F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(first)))


def save_version(log: DataFrame | None, overrides: DataFrame, version: int) -> DataFrame:
    """A20 (write side): a save of the full override set appends what it changes.

    The log holds (version, tx_id, category, deleted): an entry for every id that
    is new or has another category than before, and one marked ``deleted`` for
    every id that is no longer there (an undo).  A null category is a value.
    """
    at = F.lit(version).cast("long").alias("version")
    if log is None:
        return overrides.select(at, "tx_id", "category", F.lit(False).alias("deleted"))
    before = overrides_as_of(log, version - 1).select(
        F.col("tx_id").alias("b_id"), F.col("category").alias("b_category"))
    both = overrides.join(before, F.col("tx_id") == F.col("b_id"), "full")
    changed = both.filter(F.col("tx_id").isNull() | F.col("b_id").isNull()
                          | ~F.col("category").eqNullSafe(F.col("b_category")))
    return log.unionByName(changed.select(
        at, F.coalesce("tx_id", "b_id").alias("tx_id"), "category",
        F.col("tx_id").isNull().alias("deleted")))


def retain_versions(log: DataFrame, keep: int = SNAPSHOTS_KEPT) -> DataFrame:
    """Keep the newest ``keep`` versions and fold the older ones into one.

    Every version that is kept gives the same overrides as before: what was in
    force just before them becomes one base version, numbered as the newest
    folded one.  The lowest kept version is one value (a top-k of the version
    list); the entries themselves are filtered and aggregated, never gathered.
    """
    log = _with_removals(log)
    newest = log.select("version").distinct().orderBy(F.desc("version")).limit(keep)
    first = newest.agg(F.min("version").alias("v")).first()["v"]
    if first is None:
        return log
    old = log.filter(F.col("version") < first)
    folded = old.agg(F.max("version").alias("v")).first()["v"]
    base = overrides_as_of(old, first - 1).select(
        F.lit(folded).cast("long").alias("version"), "tx_id", "category",
        F.lit(False).alias("deleted"))
    return log.filter(F.col("version") >= first).unionByName(base)


# ------------------------------------------------------------ vocabulary
def vocabulary_merge(vocab: DataFrame, new_names: DataFrame) -> DataFrame:
    """Add trimmed, lower-case names not already present (ignoring case);
    blanks are dropped; the result is sorted.  ``is_new`` marks additions."""
    old = (vocab.select(F.col(vocab.columns[0]).alias("category"))
           .filter(F.col("category").isNotNull() & (strip("category") != "")))
    cand = (new_names.select(F.lower(strip(new_names.columns[0])).alias("category"))
            .filter(F.col("category").isNotNull() & (F.col("category") != "")).distinct())
    added = cand.join(old.select(F.lower("category").alias("category")).distinct(),
                      "category", "left_anti")
    return (old.withColumn("is_new", F.lit(False))
            .unionByName(added.withColumn("is_new", F.lit(True)))
            .orderBy("category"))


def vocabulary_changed(before: DataFrame, after: DataFrame) -> bool:
    """The sorted lists differ (two-way ``exceptAll``; an action)."""
    a, b = before.select(before.columns[0]), after.select(after.columns[0])
    return not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())
