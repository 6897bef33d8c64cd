"""K1: incremental ingest with Structured Streaming.

New export files land in a folder; each micro-batch is parsed into ledger
rows, de-duplicated within itself (G1), stripped of rows whose duplicate key
is already known, and written to the ledger table.

Known keys live in a key index next to the ledger (``<ledger>_keys``), a set of
runs in levels.  A batch writes its keys as a run of level 0; whenever FAN_IN
runs of a level are full, they are merged into one run of the next level, as
digits carry in a counter of base FAN_IN.  So the batch number alone says which
runs hold all earlier keys (its digits): no list of runs is kept, and a batch
reads at most FAN_IN - 1 runs a level.  Runs live in ``level=L/slot=S``, with two
rounds of slots a level used in turn, so the folders stay as many however many
batches came.  Inside a run keys are cut into hash buckets (``_kb``), whatever the
accounts, and sorted by hash, with Bloom filters of the hashes: a batch reads only
the buckets its own keys fall in, a small one only the row groups that may hold its
hashes, and anti-joins them (null-safe on every key column).

Exactly once: batch ``N`` writes its rows to ``<ledger>/batch=N`` and its
keys to its own slot, both with overwrite, and reads runs of earlier batches only.
Merges that are due are made before it reads; their inputs are not overwritten
before FAN_IN more runs of that level are there, so making them again gives the same
run.  A batch re-run after a failure (at any point of any write) therefore rewrites
the same folders with the same rows; nothing is appended twice and nothing is lost.

A duplicate may arrive any time later, so there is no watermark and no
``dropDuplicatesWithinWatermark``: the ledger table itself is the state.
Optionally each batch's new rows are then auto-classified (D6) from the
learned prefix rules, as after an upload in the original.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kontor.operators.identity import dedup, dedup_key
from kontor.schema import LEDGER_COLUMNS


KEY_BUCKETS = 64           # folders of a run of the key index, whatever the accounts
FAN_IN = 8                 # runs of a level that are merged into one of the next
FEW_HASHES = 10            # keys of a batch that are looked up by their hashes


def _keyed(rows: DataFrame) -> DataFrame:
    k = rows.select("*", *dedup_key())
    kcols = [c for c in k.columns if c.startswith("_k_")]
    return (k.withColumn("_kh", F.xxhash64(*kcols))
            .withColumn("_kb", F.pmod(F.col("_kh"), F.lit(KEY_BUCKETS)).cast("int")))


def _key_cols(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_k_")]


def _slot(index: int) -> int:
    return index % (2 * FAN_IN)


def live_runs(batch_id: int) -> list[tuple[int, int]]:
    """(level, slot) of the runs that hold the keys of all batches before ``batch_id``."""
    out, level, n = [], 0, batch_id
    while n:
        out += [(level, _slot(i)) for i in range(n - n % FAN_IN, n)]
        level, n = level + 1, n // FAN_IN
    return out


def due_merges(batch_id: int) -> list[tuple[int, list[int], int]]:
    """Merges to make before ``batch_id``: (level, its slots, slot of the next level)."""
    out, level, n = [], 0, batch_id
    while n and n % FAN_IN == 0:
        out.append((level, [_slot(i) for i in range(n - FAN_IN, n)], _slot(n // FAN_IN - 1)))
        level, n = level + 1, n // FAN_IN
    return out


def _index_path(ledger_path: str) -> str:
    return ledger_path.rstrip("/") + "_keys"


def _read_runs(spark: SparkSession, keyed: DataFrame, ledger_path: str,
               runs: list[tuple[int, int]]) -> DataFrame:
    """Keys of some runs (none for one that holds no keys); the folder is made if need be."""
    schema = keyed.select(*_key_cols(keyed), "_kh", F.lit(0).alias("level"),
                          F.lit(0).alias("slot"), "_kb").schema
    (spark.createDataFrame([], schema).write.mode("ignore").partitionBy("level", "slot", "_kb")
     .parquet(_index_path(ledger_path)))
    stored = spark.read.schema(schema).parquet(_index_path(ledger_path))
    wanted = F.lit(False)
    for level in sorted({r[0] for r in runs}):
        slots = [s for lv, s in runs if lv == level]
        wanted = wanted | ((F.col("level") == level) & F.col("slot").isin(slots))
    return stored.filter(wanted)


def _write_run(keys: DataFrame, ledger_path: str, level: int, slot: int) -> None:
    (keys.repartitionByRange("_kb", "_kh").sortWithinPartitions("_kb", "_kh")
     .write.mode("overwrite").partitionBy("_kb")
     .option("parquet.bloom.filter.enabled#_kh", "true")
     .option("parquet.bloom.filter.adaptive.enabled", "true")
     .parquet(f"{_index_path(ledger_path)}/level={level}/slot={slot}"))


def merge_batch(spark: SparkSession, rows: DataFrame, ledger_path: str,
                batch_id: int) -> DataFrame:
    """The rows of a batch that are new to the ledger (first copy kept), with
    their key columns (``_k_*``), key hash (``_kh``) and bucket (``_kb``).

    Batches are numbered from 0 without gaps that hold keys, as the stream does.  ``rows``
    is read more than once (its buckets and hashes, then the anti-join); pass a deterministic or
    persisted DataFrame.
    """
    keyed = _keyed(dedup(rows.select(*LEDGER_COLUMNS)))
    for level, slots, target in due_merges(batch_id):
        merged = _read_runs(spark, keyed, ledger_path, [(level, s) for s in slots])
        _write_run(merged.drop("level", "slot"), ledger_path, level + 1, target)
    runs = live_runs(batch_id)
    if not runs:
        return keyed
    known = _read_runs(spark, keyed, ledger_path, runs)
    # duplicates have the hash of the row kept: hashes and buckets need no dedup
    hashed = _keyed(rows.select(*LEDGER_COLUMNS)).select("_kb", "_kh")
    buckets = sorted(r["_kb"] for r in hashed.select("_kb").distinct().collect())
    if len(buckets) <= FEW_HASHES:
        hashes = [r["_kh"] for r in hashed.select("_kh").distinct().limit(FEW_HASHES + 1).collect()]
        if len(hashes) <= FEW_HASHES:
            known = known.filter(F.col("_kh").isin(hashes))
    matches = known.filter(F.col("_kb").isin(buckets))
    cond = functools.reduce(lambda a, b: a & b, [keyed[c].eqNullSafe(matches[c])
                                                 for c in _key_cols(keyed) + ["_kb", "_kh"]])
    return keyed.join(matches, cond, "left_anti")


def append_batch(new: DataFrame, ledger_path: str, batch_id: int = 0) -> None:
    """Write a batch's new rows to ``<ledger>/batch=N`` and their keys to its slot of
    level 0 of the key index (overwrite: a re-run rewrites, never adds)."""
    (new.select(*LEDGER_COLUMNS).write.mode("overwrite")
     .parquet(f"{ledger_path.rstrip('/')}/batch={batch_id}"))
    _write_run(new.select(*_key_cols(new), "_kh", "_kb"), ledger_path, 0, _slot(batch_id))


def classify_new_rows(spark: SparkSession, new: DataFrame, rules_path: str,
                      overrides_path: str) -> None:
    """D6 after an upload: the batch's new rows that have no override take the
    category of their longest learned prefix; the results are appended to the
    overrides table (JSON lines).  The learned-rule table is maintained when
    overrides are saved (``operators.overrides.learn_prefix_rules``), not per
    batch, so a batch reads only the rules and the overrides."""
    from kontor.operators.identity import with_tx_id
    from kontor.operators.overrides import auto_classify
    from kontor.sources.json_io import (read_if_there, read_overrides_table,
                                        write_overrides_table)

    rows = with_tx_id(new.select(*LEDGER_COLUMNS))
    none = spark.createDataFrame([], "tx_id string, category string")
    ov = read_if_there(lambda: read_overrides_table(spark, overrides_path), none)
    got = auto_classify(rows, ov, spark.read.parquet(rules_path))
    write_overrides_table(got, overrides_path, mode="append")


def start_ingest(spark: SparkSession, source_dir: str, source_schema: str, ledger_path: str,
                 checkpoint_location: str, parse: Callable[[DataFrame], DataFrame],
                 fmt: str = "parquet", options: dict | None = None,
                 available_now: bool = True,
                 classify: tuple[str, str] | None = None) -> StreamingQuery:
    """Start the stream; ``parse`` maps the source rows of a batch to ledger rows.

    ``classify=(rules_path, overrides_path)`` adds D6 after each append: new
    rows are auto-classified with the stored learned prefix rules.
    """
    stream = (spark.readStream.format(fmt).schema(source_schema)
              .options(**(options or {})).load(source_dir))

    def each_batch(batch: DataFrame, epoch_id: int) -> None:
        # the parsed batch is read several times (bucket list, anti-join, two
        # appends): evaluate it once
        rows = parse(batch).persist()
        new = merge_batch(spark, rows, ledger_path, epoch_id).persist()
        try:
            append_batch(new, ledger_path, epoch_id)
            if classify is not None:
                classify_new_rows(spark, new, *classify)
        finally:
            new.unpersist()
            rows.unpersist()

    writer = (stream.writeStream.foreachBatch(each_batch)
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="1 minute")
    return writer.start()


def run_until_caught_up(q: StreamingQuery) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
