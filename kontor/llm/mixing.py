"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled (by a hash) and queue up; a document copy
finishes at the virtual time at which its source, served at a rate equal to
its weight, has delivered all words up to it.  Sorting all copies of all
sources by virtual finish time and cutting at the total budget of words gives
the mix: active sources share it by weight, and a source that may be repeated
no more leaves its share to the others.

Everything is DataFrame work.  Running sums never put a source into one task:
the shuffled order is cut into blocks by the leading bits of the hash, equal
in size whatever the sources; a block's start is the sum of the blocks before.

Nulls: a null text has no words; a null source is a source of its own, last.
Documents without words are never taken (``taken`` 0).  Repeated rows are
documents of their own: each gets a row.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.llm.common import Staged

# The weights of the sources in order, repeating, and the most
# times that a source's words may be used.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS,
                   share: float = 1.0) -> DataFrame:
    """Targets of the sources: (source, source_size) -> rank, weight, target, level.

    The budget is ``share`` of all words.  In order of ``max_epochs * size /
    weight`` sources fill up; while filled ones hold F words in all and the
    others weigh V together, the level is (budget - F) / V, and a target is
    the smaller of the source's limit and weight * level.  ``totals`` has one
    row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = len(weights)
    ranked = (totals.withColumn("rank", F.row_number().over(order) - 1)
              .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                                 (F.col("rank") % n + 1).cast("int")))
              .withColumn("limit", F.col("source_size").cast("double") * max_epochs))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding,
                                                      Window.unboundedFollowing)
    levels = (ranked
              .withColumn("full", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
              .withColumn("open", F.sum("weight").over(everything)
                          - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
              .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
              .withColumn("try", (F.col("budget") - F.col("full")) / F.col("open")))
    # the level is the first try at which the source in turn is not filled
    first = F.min(F.when(F.col("try") * F.col("weight") <= F.col("limit"),
                         F.struct(F.col("limit") / F.col("weight"), "rank", "try"))
                  ).over(everything)
    return (levels.withColumn("level", first["try"])
            .withColumn("target", F.when(F.col("level").isNull(), F.col("limit"))
                        .otherwise(F.least("limit", F.col("weight") * F.col("level"))))
            .select("source", "source_size", "rank", "weight", "target", "level", "budget"))


def mix(docs: DataFrame, size: str, source: str, key: str, row: str, weights=WEIGHTS,
        max_epochs: int = MAX_EPOCHS, share: float = 1.0) -> DataFrame:
    """Copies of the documents that the mix takes or leaves, and their targets.

    ``key`` is hashed for the shuffle (a document id) and ``row`` tells rows of
    one key apart.  Gives for every document row and epoch: the given columns,
    ``source_size``, ``target``, ``epoch``, ``finish`` (virtual time) and
    ``in_mix``.  ``docs`` has these four columns only.
    """
    staged = Staged(docs.sparkSession, "mix")
    rows = staged.write(docs.withColumn("h", F.xxhash64(key, F.lit("mix")))
                        .withColumn("src", F.struct(F.col(source))), "sizes")  # one null source
    totals = staged.write(rows.groupBy(F.col(source).alias("source")).agg(
        F.sum(size).alias("source_size"), F.count(F.lit(1)).alias("n")), "totals")
    targets = staged.write(source_targets(totals.drop("n"), weights, max_epochs, share),
                           "targets")
    # about as many blocks as rows in a block: neither grows in step with the input
    n_rows = totals.agg(F.sum("n")).first()[0] or 0
    bits = max(1, (2 * n_rows).bit_length() // 2)
    rows = rows.withColumn("block", F.shiftrightunsigned("h", 64 - bits))

    sums = rows.groupBy("src", "block").agg(F.sum(size).alias("s"))
    earlier = (Window.partitionBy("src").orderBy("block")
               .rowsBetween(Window.unboundedPreceding, -1))
    wanted = targets.select(F.struct("source").alias("t_src"), "source_size", "target", "weight",
                            "rank", "level")
    starts = (sums.withColumn("start", F.coalesce(F.sum("s").over(earlier), F.lit(0)))
              .join(wanted, F.col("src").eqNullSafe(F.col("t_src")))
              .drop("t_src", "s").withColumnsRenamed({"src": "s_src", "block": "s_block"}))
    inside = (Window.partitionBy("src", "block").orderBy("h", key, size, row)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = rows.withColumn("local", F.sum(size).over(inside))
    local = local.join(starts, (F.col("block") == F.col("s_block"))
                       & F.col("src").eqNullSafe(F.col("s_src")))

    copies = (local.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
              .withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("start")
                                     + F.col("local")) / F.col("weight"))
              # ranges of virtual time; well past the level comes one open range
              .withColumn("range", F.when(F.col("level") > 0, F.least(
                  F.floor(F.col("finish") / F.col("level") * (4 << bits)),
                  F.lit(8 << bits))).otherwise(F.lit(0)))
              .select(key, row, size, source, "h", "rank", "source_size", "target", "epoch",
                      "finish", "range"))
    copies = staged.write(copies, "copies")

    # the cut: ranges before it are in as a whole, in its own range the order decides
    budget = targets.agg(F.max("budget")).first()[0] or 0.0
    up_to = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = (copies.groupBy("range").agg(F.sum(size).alias("r_sum"))
              .withColumn("r_end", F.sum("r_sum").over(up_to)))
    cut = (ranges.filter(F.col("r_end") >= budget)
           .agg(F.min(F.struct("range", (F.col("r_end") - F.col("r_sum")).alias("before")))
                .alias("c")).select("c.*").first())
    if cut is None or cut["range"] is None:
        return copies.withColumn("in_mix", F.lit(True))
    place = F.struct("finish", "rank", "h", key, size, row, "epoch")
    order = (Window.partitionBy("range").orderBy(place)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = (copies.filter(F.col("range") == cut["range"])
            .withColumn("so_far", F.sum(size).over(order) + cut["before"])
            .filter(F.col("so_far") >= budget))
    last = edge.agg(F.min(place).alias("last")).first()["last"]
    types = copies.select(place.alias("p")).schema["p"].dataType
    last_place = F.struct(*[F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in types])
    return copies.withColumn("in_mix", place <= last_place)


def _sized(docs: DataFrame, key: str, text: str, source: str, *more) -> DataFrame:
    return docs.select(F.col(f"`{key}`").alias("d_key"), F.col(f"`{source}`").alias("d_source"),
                       word_count(F.col(f"`{text}`")).alias("d_size"),
                       F.monotonically_increasing_id().alias("d_row"), *more)


def taken_words(docs: DataFrame, key: str = "doc_id", text: str = "text",
                source: str = "source", **kw) -> DataFrame:
    """One row per document row: key, size, source_size, target, taken (words, repeats
    counted)."""
    got = mix(_sized(docs, key, text, source), "d_size", "d_source", "d_key", "d_row", **kw)
    words = F.when(F.col("in_mix"), F.col("d_size")).otherwise(F.lit(0))
    return (got.groupBy("d_key", "d_row")
            .agg(F.first("d_size").alias("size"), F.first("source_size").alias("source_size"),
                 F.first("target").alias("target"), F.sum(words).alias("taken"))
            .select(F.col("d_key").alias(key), "size", "source_size", "target", "taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    source: str = "source", **kw) -> DataFrame:
    """The documents of the mix with their own columns, one row per copy taken;
    documents without words are left out."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d_all")
    rows = Staged(docs.sparkSession, "mixed").write(
        _sized(docs, key, text, source, whole), "docs")
    got = mix(rows.drop("d_all"), "d_size", "d_source", "d_key", "d_row", **kw)
    times = (got.filter(F.col("in_mix") & (F.col("d_size") > 0)).groupBy("d_row")
             .agg(F.count(F.lit(1)).alias("d_times")))
    return (rows.join(times, "d_row")
            .withColumn("d_copy", F.explode(F.sequence(F.lit(1), F.col("d_times"))))
            .select("d_all.*"))
