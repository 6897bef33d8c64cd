"""File-level sources: inventory (A21), extension filter (A23), source
preference (A17), and the scratch folder jobs write intermediate tables to."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.plans.lineage import checkpoint_dir
from kontor.schema import LEDGER_COLUMNS, LEDGER_SCHEMA

# ---- FIXED VALUES: accepted extensions per kind of export ----
CSV_EXTENSIONS = ["csv"]

# folders staged by the step that runs now
_staged: ContextVar[list[str]] = ContextVar("staged")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a job's intermediate files, inside the shared
    checkpoint folder (never a machine-local temp dir on a cluster)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/kontor-scratch/{name}-{uuid.uuid4().hex}"


# Spark deletes a job's shuffle files when the job has ended, not when the driver's JVM
# happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Staged tables are small for their rows: a task that read as many bytes as usual would sort
# (and spill) many millions of rows, and a few such tasks do not fill their last round.
STAGED_FILE_ROWS = 1 << 19
READ_SPLITS = "spark.sql.files.minPartitionNum"
SPLITS_PER_CORE = 4


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """The settings of a staged write, unless the session has its own."""
    own = {SHUFFLE_CLEANUP: "true",
           READ_SPLITS: str(SPLITS_PER_CORE * spark.sparkContext.defaultParallelism)}
    own = {k: v for k, v in own.items() if spark.conf.get(k, None) is None}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in own:
            spark.conf.unset(k)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write a derived input once (parquet, scratch folder) and read it back:
    what a pipeline does with an export it reads several times, instead of
    recomputing it at every reference.  The write's shuffle files go with its end."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _writing(spark):
        df.write.options(compression="zstd", maxRecordsPerFile=STAGED_FILE_ROWS).parquet(path)
    if (step := _staged.get(None)) is not None:
        step.append(path)
    return spark.read.parquet(path)


def stage_result(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``make()``, stored; the tables that it staged on the way, which nothing
    else reads, are deleted."""
    mine: list[str] = []
    outer = _staged.set(mine)
    try:
        df = make()
    finally:
        _staged.reset(outer)
    out = stage_table(df, name)
    for path in mine:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return out


# Rows of a side that grows with the data up to which it is broadcast.
BROADCAST_ROWS = 10_000


def counted(side: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """A join's side with one row per file, stored, and whether it is small enough for a
    broadcast.  Adaptive execution would find that out only after it has written the
    shuffle of the other side."""
    side = stage_table(side, name)
    return side, side.count() <= BROADCAST_ROWS


def extension_filter(paths: DataFrame, extensions: list[str], col: str = "path") -> DataFrame:
    """Case-insensitive suffix match (``*.xls*`` style)."""
    pattern = r"\.(" + "|".join(extensions) + r")$"
    return paths.filter(F.lower(F.col(col)).rlike(pattern))


def file_inventory(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Name and size in KB of each file in a folder, sorted by name.

    ``binaryFile`` with only path/length selected: the content column is
    pruned, so no file is read.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .load(folder).select("path", "length"))
    return (files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
                         (F.col("length") / 1024.0).alias("size_kb"))
            .orderBy("name"))


def folder_sizes(spark: SparkSession, folder: str, extensions: list[str]) -> DataFrame:
    """A21 for a folder of folders: KB of the files with one of ``extensions`` (A23) per
    sub-folder, ``(folder, size_kb)``.  No file is read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .load(folder).select("path", "length"))
    name = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder")
    return (extension_filter(files, extensions).groupBy(name)
            .agg((F.sum("length") / 1024.0).alias("size_kb")))


@dataclass(frozen=True)
class Source:
    """One configured export folder: ``slot`` groups alternatives (a real
    account and its demo stand-in); lower ``priority`` is preferred."""
    slot: str
    priority: int
    name: str
    raw: DataFrame                       # the folder's raw rows (cells, lines, CSV rows)
    file_col: str                        # column naming the file each raw row came from
    load: Callable[[DataFrame], DataFrame]  # raw rows -> ledger rows


def _preferred(spark: SparkSession, sources: list[Source]) -> dict[str, Source]:
    """Slot -> preferred source with files.  One job probes every source: a
    union of one-row (``LIMIT 1``) projections, so at most one row per source
    reaches the driver."""
    probes = [s.raw.select(F.lit(i).alias("i")).limit(1) for i, s in enumerate(sources)]
    union = probes[0]
    for p in probes[1:]:
        union = union.unionByName(p)
    present = {r["i"] for r in union.collect()}
    chosen: dict[str, Source] = {}
    for i, s in sorted(enumerate(sources), key=lambda t: (t[1].slot, t[1].priority)):
        if i in present and s.slot not in chosen:
            chosen[s.slot] = s
    return chosen


def choose_sources(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """Per slot, the preferred source among those that have files;
    slots where no source has files are skipped.

    The choice needs only "has any file": one job of ``LIMIT 1`` probes over
    the configured sources, decided on the driver.  ``(slot, priority, source,
    n_files)`` of the chosen sources; ``n_files`` is a distributed count of
    distinct file names, computed only for the chosen sources.
    """
    chosen = _preferred(spark, sources)
    counts = None
    for s in chosen.values():
        c = s.raw.agg(F.count_distinct(s.file_col).cast("long").alias("n_files")).select(
            F.lit(s.slot).alias("slot"), F.lit(s.priority).alias("priority"),
            F.lit(s.name).alias("source"), "n_files")
        counts = c if counts is None else counts.unionByName(c)
    if counts is None:
        return spark.createDataFrame([], "slot string, priority int, source string, n_files long")
    return counts


def load_all(spark: SparkSession, sources: list[Source], ordered: bool = False) -> DataFrame:
    """A17 + I1 + B2: the unified ledger of the chosen sources.

    The choice is a tiny table (one row per slot) brought to the driver to
    decide which loaders run; each chosen loader is a distributed job whose
    rows are stored, so that its shuffles and staged inputs are gone before the
    next one runs.
    ``ordered`` adds H1 (a global sort by date): only for presenting rows —
    aggregates do not need it, and the stored table is date-clustered by
    ``operators.ledger.write_ledger`` instead.
    """
    parts = [stage_result(spark, f"ledger-{s.name}",
                          lambda s=s: s.load(s.raw).select(*LEDGER_COLUMNS))
             for s in _preferred(spark, sources).values()]
    if not parts:
        return spark.createDataFrame([], LEDGER_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return ledger_order(out) if ordered else out


def ledger_order(df: DataFrame) -> DataFrame:
    """H1: ledger rows by date, ties in source order."""
    return df.orderBy("date", "src_file", "src_row")
