"""Best-fit packing under conflicts.

Documents (as pieces of at most ``capacity`` words) go into bins of
``capacity`` words, longest first.  The open bins are ordered by what is left
in them, and each carries bitmaps: one of the duplicate clusters in it, and one
per allowed document of the same source.  A piece looks for the bin with the
least room that still holds it, and goes on to the next larger one while the
bitmaps conflict: two pieces of one duplicate cluster never share a bin, and a
bin holds at most ``per_source`` pieces of one source.

The rows are dealt into shards by a hash of the document, about ``SHARD_ROWS``
each, and each shard is packed by one task; a cluster or source of any size is
thus spread evenly.  Only ids and sizes are shuffled, not texts.

Nulls: a null text, like an empty one, has no words and takes no bin (one row
with bin null).  A null source is a source; a null cluster conflicts with
nothing.  Repeated rows are packed each.  Texts longer than a bin fill whole
bins, and their last piece is packed with others.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import Staged, ascii_lower
from kontor.llm.mixing import word_count

CAPACITY = 2048
PER_SOURCE = 2
SHARD_ROWS = 2000


class Bins:
    """Open bins ordered by residual; one integer marks the residuals in use."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]    # residual -> bins
        self.used = 0                                    # bit r: some bin has residual r
        self.clusters: list[int] = []                    # bitmap per bin
        self.sources: list[list[int]] = []               # bitmaps per bin, by number held
        self.count: list[int] = []

    def successor(self, least: int) -> int | None:
        """Smallest residual of at least ``least`` that some bin has."""
        above = self.used >> least
        return least + (above & -above).bit_length() - 1 if above else None

    def put(self, size: int, cluster: int, source: int) -> tuple[int, int]:
        """(bin, position) for a piece; ``cluster`` and ``source`` are bitmaps of one bit
        (0: no conflict)."""
        residual = self.successor(size)
        while residual is not None:
            for i, b in enumerate(self.at[residual]):
                if not (self.clusters[b] & cluster or self.sources[b][-1] & source):
                    del self.at[residual][i]
                    if not self.at[residual]:
                        self.used &= ~(1 << residual)
                    return self._into(b, residual - size, cluster, source)
            residual = self.successor(residual + 1)
        self.clusters.append(0)
        self.sources.append([0] * self.per_source)
        self.count.append(0)
        return self._into(len(self.count) - 1, self.capacity - size, cluster, source)

    def _into(self, b: int, left: int, cluster: int, source: int) -> tuple[int, int]:
        self.clusters[b] |= cluster
        planes = self.sources[b]
        for k, plane in enumerate(planes):               # the first plane without the bit
            if not plane & source:
                planes[k] = plane | source
                break
        if left:
            self.at[left].append(b)
            self.used |= 1 << left
        self.count[b] += 1
        return b, self.count[b] - 1


def pack_rows(rows: list[tuple], capacity: int, per_source: int) -> list[tuple]:
    """rows: (size, cluster, source), longest first, sizes 1 to ``capacity``.
    Gives (bin, position) for each."""
    bins = Bins(capacity, per_source)
    source_bit: dict = {}
    times: dict = {}
    for _, cluster, _ in rows:
        times[cluster] = times.get(cluster, 0) + 1
    # a cluster with one piece here cannot conflict and needs no bit
    cluster_bit = {c: i for i, c in enumerate(c for c, n in times.items()
                                              if n > 1 and c is not None)}
    out = []
    for size, cluster, source in rows:
        s = 1 << source_bit.setdefault(source, len(source_bit))
        c = 1 << cluster_bit[cluster] if cluster in cluster_bit else 0
        out.append(bins.put(size, c, s))
    return out


def pack(items: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE,
         shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``items`` has d_key, d_row, d_size, d_source, d_cluster (a long).

    One row per piece: the key and row, ``piece``, ``first_word`` (offset of the
    piece in its text), ``words``, ``bin`` (a string, null without words) and
    ``place`` (order in the bin).
    """
    staged = Staged(items.sparkSession, "packing")
    rows = staged.write(items, "items")
    shards = max(1, -(-rows.count() // shard_rows))
    last = F.greatest(F.ceil(F.col("d_size") / capacity), F.lit(1)).cast("long") - 1
    pieces = (rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
              .withColumn("first_word", F.col("piece") * F.lit(capacity))
              .withColumn("words", F.least(F.lit(capacity).cast("long"),
                                           F.col("d_size") - F.col("first_word"))))
    # whole-bin pieces share with nobody
    whole = F.col("words") == capacity
    full = pieces.filter(whole).select(
        "d_key", "d_row", "piece", "first_word", "words",
        F.concat(F.lit("w"), F.col("d_row"), F.lit("-"), F.col("piece")).alias("bin"),
        F.lit(0).cast("long").alias("place"))
    none = pieces.filter(F.col("words") == 0).select(
        "d_key", "d_row", "piece", "first_word", "words", F.lit(None).cast("string").alias("bin"),
        F.lit(None).cast("long").alias("place"))
    rest = (pieces.filter(~whole & (F.col("words") > 0))
            .withColumn("shard", F.pmod(F.xxhash64("d_key", "d_row", F.lit("shard")),
                                        F.lit(shards))))

    names = full.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("words", "descending"), ("d_key", "ascending"),
                               ("d_row", "ascending")])
        cols = [table.column(c).to_pylist() for c in ("words", "d_cluster", "d_source")]
        placed = pack_rows(list(zip(*cols)), capacity, per_source)
        shard = table.column("shard")[0].as_py()
        return pa.table([*(table.column(c) for c in ("d_key", "d_row", "piece", "first_word",
                                                     "words")),
                         pa.array([f"s{shard}-{b}" for b, _ in placed], pa.string()),
                         pa.array([p for _, p in placed], pa.int64())], names=names)

    packed = rest.groupBy("shard").applyInArrow(run, full.schema)
    return packed.unionByName(full).unionByName(none)


def text_cluster(text):
    """Cluster of exact copies: hash of the text with A-Z lowered and white space joined.

    Copies up to case and spacing share it; null and wordless texts have none.
    """
    plain = F.trim(F.regexp_replace(ascii_lower(text), r"[\x20\x09-\x0D]+", " "))
    return F.when(F.length(plain) > 0, F.xxhash64(plain))


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text",
                   source: str = "source", capacity: int = CAPACITY,
                   per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Packing of whole documents: ``key``, piece, first_word, words, source, bin, place."""
    items = docs.select(F.col(f"`{key}`").alias("d_key"),
                        F.monotonically_increasing_id().alias("d_row"),
                        word_count(F.col(f"`{text}`")).alias("d_size"),
                        F.col(f"`{source}`").alias("d_source"),
                        text_cluster(F.col(f"`{text}`")).alias("d_cluster"))
    return pack(items, capacity, per_source, shard_rows).select(
        F.col("d_key").alias(key), "piece", "first_word", "words", "bin", "place")
