"""Sharding by a minimax contiguous partition.

Documents with equal texts are one atomic group (a null text counts as the
empty one).  Groups stand in the order of their text's 64-bit hash, behind those
few that are larger than an equal share of the bytes, and every shard is a range
of that order.  The largest shard is as small as any such
partition allows: a binary search over the shard capacity, each candidate
checked greedily (a shard takes groups until the next would exceed the
capacity; a group larger than the capacity stands alone), and the order is cut
where the smallest feasible capacity allows.  Where it leaves room, cuts are
moved so that the shards are near equal.

The order is known by *cells*: ranges of hashes with their total and largest
group.  Two bounds of the capacity come from them, one with cells as
unbreakable, one with cells as divisible at will; only cells in which a cut can
still fall are split further, until both bounds agree.  So the search holds at
most ``MOST_CELLS`` pairs of numbers on the driver at a time for any number of
documents, its result is exact, and a row's shard follows from its hash and the
cuts alone, without a join.

Slots number the rows of a shard from 0.  Rows are dealt to blocks by a hash of
their place in a written table, so a group or id with a third of all rows is
numbered by many tasks.

Nulls: a null text has no bytes; null ids are ids.  Repeated rows each get a
slot.  Ties (texts whose hashes are equal) share a group.  Very long texts are
sizes like others.  Columns of other names do no harm.  An empty table gives no
rows; with fewer groups than shards some shards stay empty.  Reruns over the
same files agree.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.llm.common import Staged

SHARDS = 24
#: Bytes that a row weighs besides its text.
ROW_BYTES = 8
#: Leading bits of the first cells; cells that one round adds and splits, at most.
FIRST_BITS = 14
MOST_CELLS = 1 << 16
MOST_SPLIT = 1 << 12
#: A cell this part of a shard is split before the bounds are taken.
COARSE = 64


@dataclass(frozen=True)
class Cell:
    """Groups whose hash's ``bits`` leading bits are ``prefix``: their total and largest
    one, and the first and last hash (equal: one group)."""
    bits: int
    prefix: int
    total: int
    largest: int
    first: int
    last: int

    @property
    def atomic(self) -> bool:
        return self.first == self.last


class Order:
    """Cells in order with running totals, and greedy walks over them."""

    def __init__(self, cells: list[Cell], shards: int):
        self.cells, self.shards = cells, shards
        self.sums = [0, *accumulate(c.total for c in cells)]
        self.heavy = sorted({c.largest for c in cells})

    def reach(self, at: int, capacity: int) -> int:
        """The end of the shard that begins with cell ``at``, cells unbreakable; ``at``
        itself if a divisible cell does not fit."""
        if at == len(self.cells):
            return at
        cell = self.cells[at]
        if cell.total > capacity:
            return at + 1 if cell.atomic else at
        return bisect_right(self.sums, self.sums[at] + capacity) - 1

    def reach_back(self, end: int, capacity: int) -> int:
        """The first cell of the longest shard that ends before cell ``end``."""
        if end == 0:
            return 0
        cell = self.cells[end - 1]
        if cell.total > capacity:
            return end - 1 if cell.atomic else end
        return bisect_left(self.sums, self.sums[end] - capacity)

    def walk(self, capacity: int) -> list[int]:
        """Ends of the shards of the greedy walk."""
        ends, at = [], 0
        for _ in range(self.shards):
            at = self.reach(at, capacity)
            ends.append(at)
        return ends

    def fits(self, capacity: int) -> bool:
        return self.walk(capacity)[-1] == len(self.cells)

    def flow(self, capacity: int) -> list[int]:
        """Running totals that no real walk can pass: divisible cells may be cut anywhere,
        and a group in them that exceeds the capacity may stand alone anywhere."""
        out, x, whole = [], 0, self.sums[-1]
        for _ in range(self.shards):
            if x < whole:
                at = bisect_right(self.sums, x) - 1
                cell = self.cells[at]
                if cell.atomic and cell.total > capacity:
                    x = self.sums[at + 1]
                else:
                    end = x + max(capacity, cell.largest)
                    if end < whole:
                        at_end = bisect_right(self.sums, end) - 1
                        if self.cells[at_end].atomic:
                            end = max(self.sums[at_end], x)
                    x = min(end, whole)
            out.append(x)
        return out

    def flows(self, capacity: int) -> bool:
        return self.flow(capacity)[-1] >= self.sums[-1]

    def least(self, fits) -> int:
        """The smallest capacity that ``fits``, by binary search."""
        low, high = 0, self.sums[-1]
        while low < high:
            middle = (low + high) // 2
            if fits(middle):
                high = middle
            else:
                low = middle + 1
        return low

    def undecided(self) -> list[int]:
        """Divisible cells that a cut may still fall into; none if the capacity is known."""
        open_ = [i for i, c in enumerate(self.cells) if not c.atomic]
        low = self.least(self.flows)
        coarse = [i for i in open_ if self.cells[i].total * COARSE > low]
        if coarse:
            return coarse
        high = self.least(self.fits)
        if low == high:
            return []
        found: set[int] = set()
        for start, end in zip(self.walk(low), self.flow(high)):
            stop = bisect_left(self.sums, end)
            found.update(i for i in range(max(start - 1, 0), min(stop + 1, len(self.cells)))
                         if not self.cells[i].atomic)
        return sorted(found)

    def cuts(self) -> list[int]:
        """Ends of all shards but the last at the smallest feasible capacity, as even as
        the capacity lets them be."""
        capacity, n = self.least(self.fits), len(self.cells)
        alone = [c.total > capacity for c in self.cells]
        small = [*accumulate((0 if a else c.total for c, a in
                              zip(reversed(self.cells), reversed(alone))), initial=0)][::-1]
        large = [*accumulate(map(int, reversed(alone)), initial=0)][::-1]
        latest = [n]                      # where the last k shards may begin at the earliest
        for _ in range(self.shards - 1):
            latest.append(self.reach_back(latest[-1], capacity))
        out, at = [], 0
        for left in range(self.shards, 1, -1):
            high, low = self.reach(at, capacity), max(latest[left - 1], at)
            if at < n and alone[at]:
                at += 1
            elif at < n:
                share = small[at] / max(left - large[at], 1)
                best = bisect_left(self.sums, self.sums[at] + share)
                if best > at and self.sums[at] + share - self.sums[best - 1] \
                        < self.sums[min(best, n)] - self.sums[at] - share:
                    best -= 1
                at = min(max(best, low), high)
            out.append(at)
        return out


def _cells(groups: DataFrame, bits: int, prefixes: list[int] | None = None,
           above: int = 0) -> list[Cell]:
    """The cells of ``bits`` leading bits, of all groups or of those in cells of ``above``
    leading bits.  At most 2^FIRST_BITS or MOST_CELLS rows come back."""
    if prefixes is not None:
        groups = groups.filter(_leading("h", above).isin(prefixes))
    got = groups.groupBy(_leading("h", bits).alias("prefix")).agg(
        F.sum("bytes").alias("total"), F.max("bytes").alias("largest"),
        F.min("h").alias("first"), F.max("h").alias("last")).collect()
    return [Cell(bits, *row) for row in got]


def _leading(h: str, bits: int) -> Column:
    return F.shiftright(F.col(h), 64 - bits)


def heavy_groups(groups: DataFrame, shards: int) -> list[tuple[int, int]]:
    """(hash, bytes) of the groups larger than an equal share of what smaller ones leave:
    fewer than ``shards``, largest first."""
    rest = groups.agg(F.sum("bytes")).first()[0] or 0
    found: list[tuple[int, int]] = []
    for h, size in groups.orderBy(F.desc("bytes"), "h").select("h", "bytes").limit(shards).collect():
        if size * (shards - len(found)) <= rest or len(found) == shards - 1:
            break
        found.append((h, size))
        rest -= size
    return found


@dataclass(frozen=True)
class Cuts:
    """Shards of the heavy groups, by hash; the shard in which the other groups begin, and
    the first hashes of those after it (None: empty to the end)."""
    heavy: dict[int, int]
    base: int
    bounds: list[int | None]

    def shard(self, h: Column) -> Column:
        found = F.lit(self.base)
        for bound in self.bounds:
            if bound is not None:
                found = found + (h >= F.lit(bound)).cast("int")
        for own, shard in self.heavy.items():
            found = F.when(h == F.lit(own), F.lit(shard)).otherwise(found)
        return found


def minimax_cuts(groups: DataFrame, shards: int = SHARDS) -> Cuts:
    """Where the order of the groups is cut.  ``groups`` has one row per group: ``h`` (its
    place in the order, a long) and ``bytes``."""
    heavy = heavy_groups(groups, shards)
    head = [Cell(64, h, size, size, h, h) for h, size in heavy]
    others = groups.filter(~F.col("h").isin([h for h, _ in heavy])) if heavy else groups
    cells = sorted(_cells(others, FIRST_BITS), key=lambda c: c.first)
    while todo := Order(head + cells, shards).undecided():
        open_ = sorted((cells[i - len(head)] for i in todo), key=lambda c: -c.total)
        split = set(open_[:min(MOST_SPLIT, MOST_CELLS // 2)])
        more = max(1, (MOST_CELLS // len(split)).bit_length() - 1)
        finer = [c for c in cells if c not in split]
        for bits in sorted({c.bits for c in split}):
            prefixes = [c.prefix for c in split if c.bits == bits]
            finer += _cells(others, min(64, bits + more), prefixes, bits)
        cells = sorted(finer, key=lambda c: c.first)
    cuts = Order(head + cells, shards).cuts()
    n = len(head)
    return Cuts({h: bisect_right(cuts, i) for i, (h, _) in enumerate(heavy)},
                sum(c <= n for c in cuts),
                [cells[c - n].first if c - n < len(cells) else None for c in cuts if c > n])


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text",
                  shards: int = SHARDS, whole: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, shard, slot; with ``whole`` also
    ``doc``, a struct of all its columns."""
    staged = Staged(docs.sparkSession, "shards")
    raw = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if whole else []
    rows = staged.write(docs.select(
        F.col(f"`{key}`").alias("d_key"),
        (F.octet_length(raw).cast("long") + ROW_BYTES).alias("size"),
        F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("h"),
        F.monotonically_increasing_id().alias("row"), *kept), "rows")
    groups = staged.write(rows.groupBy("h").agg(F.sum("size").alias("bytes"),
                                                F.count(F.lit(1)).alias("n")), "groups")
    rows = rows.withColumn("shard", minimax_cuts(groups, shards).shard(F.col("h")))

    # about as many blocks as rows in a block: neither grows in step with the input
    n_rows = groups.agg(F.sum("n")).first()[0] or 0
    bits = max(1, (2 * n_rows).bit_length() // 2)
    rows = rows.withColumn("place", F.xxhash64("row")) \
        .withColumn("block", F.shiftrightunsigned("place", 64 - bits))
    before = (Window.partitionBy("shard").orderBy("block")
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = (rows.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    inside = Window.partitionBy("shard", "block").orderBy("place")
    return (rows.withColumn("local", F.row_number().over(inside) - 1)
            .join(starts, ["shard", "block"])
            .select(F.col("d_key").alias(key), "size", "text_crc32", "shard",
                    (F.col("start") + F.col("local")).cast("long").alias("slot"),
                    *(["doc"] if whole else [])))


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
                 shards: int = SHARDS, files_per_shard: int = 1) -> DataFrame:
    """Write all documents below ``path``, a folder for each shard, ``files_per_shard``
    files in it by ranges of slots; gives them back with ``shard`` and ``slot``."""
    placed = assign_shards(docs, key, text, shards, whole=True)
    rows = placed.select("doc.*", F.col("shard").alias("to_shard"),
                         F.col("slot").alias("to_slot")) \
        if {"shard", "slot"} & {c.lower() for c in docs.columns} \
        else placed.select("doc.*", "shard", "slot")
    shard, slot = rows.columns[-2:]
    (rows.repartitionByRange(shards * files_per_shard, shard, slot)
     .sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path))
    return docs.sparkSession.read.schema(rows.schema).parquet(path)
