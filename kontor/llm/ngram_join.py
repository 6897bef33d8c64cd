"""N-gram Jaccard join with count vectors in R-trees.

A document's set are its distinct word shingles (64-bit hashes).  Documents
with equal sets form a class; only classes are compared.  The shingles of a
set are hashed into groups (more for long sets), and the counts per group are a point.
Two sets share at most the sum of the coordinate minima of their points, so a
pair whose sum is too small for the wanted similarity cannot link.

1. Blocks: classes that share one of their first shingles (in one fixed order), as
   many as a linked pair cannot avoid sharing, and are close enough in size.  Blocks with
   the same classes count once; large ones are cut into tiles.
2. In each block an R-tree over the points answers which classes may link; a
   spanning set of these pairs comes out.  Their components hold every link.
3. In each component the surviving pairs are verified on the full sets, with
   an index from shingles to sets; a spanning set of the true links comes out.
4. The components of the true links are the result.

No step puts out more pairs than it has rows, and no group goes to one task
whole: components and blocks beyond a size are cut into tiles, each pair of
parts meeting in one tile.

Nulls and texts without words have an empty set and link with nothing (their
component is their own id).  Rows with equal ids are vertices of their own.
A component's id is its least id; null ids count only if there is no other.
Long texts are used whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import Staged, WordHasher, annotate, slices, text_bytes
from kontor.llm.components import components, small_side

#: Groups of the count vectors, and of those of sets of FINE_SHINGLES or more: long sets
#: of common words differ by chance in more groups.  The first divides the second.
GROUPS, FINE_GROUPS, FINE_SHINGLES = 256, 1024, 2048
LEAF, FANOUT = 32, 8
#: Points in a tile of a block; sets and shingles in a tile of a component.
TILE_POINTS = 2048
TILE_SETS, TILE_SHINGLES = 1024, 800_000

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts.  Words are parted by ASCII white
    space, and A-Z count as a-z.

    The leading six bits are smaller the longer a shingle's words are: long ones are
    rare, so the first shingles of a set in this order are seldom shared by chance."""

    def __init__(self, k: int):
        self.k, self.words = k, WordHasher(b" \t\n\x0b\x0c\r")

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        return [self._set(h, n) for h, n, _ in self.words.parts(texts)]

    def _set(self, h: np.ndarray, length: np.ndarray) -> np.ndarray:
        if not len(h):
            return h
        k = min(self.k, len(h))             # a shorter text is one shingle
        mixed = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            mixed = (mixed ^ h[i:len(h) - k + 1 + i]) * _MULTIPLY
            mixed ^= mixed >> np.uint64(29)
        sums = np.concatenate([[0], np.cumsum(length)])
        short = np.uint64(63) - np.minimum(sums[k:] - sums[:-k], 63).astype(np.uint64)
        mixed = (mixed >> np.uint64(6)) | (short << np.uint64(58))
        mixed.sort()
        return mixed[np.concatenate([[True], mixed[1:] != mixed[:-1]])]


def prefix_length(n: int, num: int, den: int) -> int:
    """How many of its n shingles a set must show so that it cannot miss a linked one."""
    return n - -(-n * num // den) + 1


def signature(s: np.ndarray, num: int, den: int) -> tuple[int, int, np.ndarray, bytes]:
    """Two halves of a digest of the set, its prefix, its point."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    first, second = np.frombuffer(d, np.int64).tolist()
    groups = GROUPS if len(s) < FINE_SHINGLES else FINE_GROUPS
    point = np.bincount((s >> np.uint64(7)).astype(np.int64) % groups, minlength=groups)
    return (first, second, s[:prefix_length(len(s), num, den)].view(np.int64),
            point.astype("<u2" if len(s) < 1 << 16 else "<u4").tobytes())


def points_of(packed: list[bytes]) -> np.ndarray:
    """Points as rows of an array, in fine groups if all of them have these."""
    points = [np.frombuffer(p, "<u4" if len(p) == 4 * FINE_GROUPS else "<u2").astype(np.int32)
              for p in packed]
    if len({len(p) for p in points}) > 1:       # a group is the sum of its fine groups
        points = [p.reshape(-1, GROUPS).sum(0) for p in points]
    return np.stack(points)


# ------------------------------------------------------------ inside one task
def spanning_links(n: int, neighbours) -> list[tuple[int, int]]:
    """A spanning forest of a graph of n nodes; ``neighbours(i)`` lists i's links.

    Only as many nodes are asked as are needed to know all components: a pair is
    settled when one of it was asked or both are joined, so the largest
    component is left alone as long as it is the largest.
    """
    group = list(range(n))
    members: dict[int, list[int]] = {i: [i] for i in range(n)}
    asked = np.zeros(n, bool)
    links = []

    def ask(i):
        asked[i] = True
        for j in neighbours(i):
            a, b = group[i], group[j]
            if a != b:
                links.append((i, j))
                if len(members[a]) < len(members[b]):
                    a, b = b, a
                for x in members[b]:
                    group[x] = a
                members[a] += members.pop(b)

    if n:
        ask(n // 2)
    while len(members) > 1:
        largest = max(members, key=lambda g: len(members[g]))
        todo = [i for g, m in members.items() if g != largest for i in m if not asked[i]]
        if not todo:
            break
        rest = members[largest][0]
        for i in todo[:max(1, len(todo) // 4)]:
            if group[i] != group[rest]:
                ask(i)
    return links


class RTree:
    """Points (rows of counts) with their sums, packed by splitting the widest coordinate.

    Every node keeps the coordinate maxima and the range of sums below it.
    """

    def __init__(self, points: np.ndarray, num: int, den: int):
        self.points, self.n = points, points.sum(1)
        self.num, self.den = num, den
        order = self._split(np.arange(len(points)))
        self.leaves = [order[i:i + LEAF] for i in range(0, len(order), LEAF)]
        level = [(self.points[x].max(0), self.n[x].min(), self.n[x].max()) for x in self.leaves]
        self.levels = [self._arrays(level)]
        while len(level) > FANOUT:
            level = [(np.max([x[0] for x in part], axis=0), min(x[1] for x in part),
                      max(x[2] for x in part))
                     for part in (level[i:i + FANOUT] for i in range(0, len(level), FANOUT))]
            self.levels.append(self._arrays(level))

    @staticmethod
    def _arrays(level):
        return (np.array([x[0] for x in level]), np.array([x[1] for x in level]),
                np.array([x[2] for x in level]))

    def _split(self, rows: np.ndarray) -> np.ndarray:
        if len(rows) <= LEAF:
            return rows
        own = self.points[rows]
        by = own[:, own.var(0).argmax()] if self.n[rows].min() * 2 > self.n[rows].max() \
            else self.n[rows]
        rows = rows[np.argsort(by, kind="stable")]
        half = -(-len(rows) // (2 * LEAF)) * LEAF
        return np.concatenate([self._split(rows[:half]), self._split(rows[half:])])

    def _fit(self, q, n, high, low_n, high_n):
        """Which boxes may hold a point that links with q: sizes, then coordinate minima."""
        least = np.maximum(low_n, -(-n * self.num // self.den))
        ok = (high_n * self.den >= n * self.num) & (low_n * self.num <= n * self.den)
        bound = np.minimum(q, high).sum(1)
        return ok & (bound * (self.num + self.den) >= self.num * (n + least))

    def query(self, i: int) -> np.ndarray:
        """Rows other than i whose bound allows a link with row i."""
        q, n = self.points[i], int(self.n[i])
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low_n, high_n = self.levels[depth]
            at = at[self._fit(q, n, high[at], low_n[at], high_n[at])]
            if depth:
                width = len(self.levels[depth - 1][1])
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < width]
        if not len(at):
            return at
        rows = np.concatenate([self.leaves[x] for x in at])
        rows = rows[self._fit(q, n, self.points[rows], self.n[rows], self.n[rows])]
        return rows[rows != i]


class SetIndex:
    """Exact similarity of sets through an index from shingles to sets."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.sizes = np.array([len(s) for s in sets])
        self.num, self.den = num, den
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        self.tokens = np.split(token, np.cumsum(self.sizes)[:-1])
        order = np.argsort(token, kind="stable")
        self.owners = owner[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(token))])

    def query(self, i: int) -> np.ndarray:
        t = self.tokens[i]
        lengths = self.starts[t + 1] - self.starts[t]
        where = np.repeat(self.starts[t] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        shared = np.bincount(self.owners[where + np.arange(lengths.sum())],
                             minlength=len(self.sizes))
        union = self.sizes[i] + self.sizes - shared
        hit = np.flatnonzero(self.den * shared >= self.num * union)
        return hit[hit != i]


def group_runs(batches, n_keys: int):
    """Groups of consecutive rows with equal first ``n_keys`` columns, across batches.
    The caller has bounded the groups."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(),
                batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            key = tuple(keys[:, s].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _emit(pairs: list[tuple[int, int]]):
    a, b = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                                      ["a", "b"])


def _links(n_keys: int, find):
    """Run ``find(table) -> pairs of cids`` on every group; pairs in batches, each once."""
    def run(batches):
        pairs: set[tuple[int, int]] = set()
        for table in group_runs(batches, n_keys):
            if table.num_rows > 1:
                pairs.update(find(table))
                if len(pairs) > 50_000:
                    yield _emit(sorted(pairs))
                    pairs = set()
        yield _emit(sorted(pairs))
    return run


def tiles(df: DataFrame, parts: str, member: str) -> DataFrame:
    """Deal the rows of a group into ``parts`` parts by a hash of ``member`` and copy each
    row to the tiles (i, j) of its part, so that any two rows of the group meet."""
    part = F.pmod(F.xxhash64(member, F.lit("tile")), F.col(parts))
    return (df.withColumn("part", part)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1)))
            .withColumn("tile_i", F.least("part", "other"))
            .withColumn("tile_j", F.greatest("part", "other"))
            .withColumnRenamed("part", "part_no").drop("other"))


# ------------------------------------------------------------ Spark jobs
def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3,
                       num: int = 90, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: ``key``, n_shingles, component_id (least key reachable).

    Documents link when den * |intersection| >= num * |union| of their ``k``-word shingles.
    ``key`` is a long.
    """
    spark = docs.sparkSession
    staged = Staged(spark, "ngrams")
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"))

    def sign():
        shingler = Shingler(k)

        def run(texts):
            sets = shingler(texts)
            rows = [signature(s, num, den) if len(s) else (0, 0, None, None) for s in sets]
            d1, d2, prefix, point = zip(*rows)
            return {"n": [len(s) for s in sets], "d1": d1, "d2": d2, "prefix": prefix,
                    "point": point}
        return run

    signed = annotate(plain, "t", sign, {"n": "long", "d1": "long", "d2": "long",
                                         "prefix": "array<long>", "point": "binary"}).drop("t")
    signed = staged.write(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
    documents = staged.write(signed.select("row", "id", "n", "d1", "d2"), "documents")
    filled = documents.filter(F.col("n") > 0)

    classes = staged.write(filled.groupBy("d1", "d2").agg(
        F.min("row").alias("cid"), F.min("id").alias("least_id")), "classes")
    heads = small_side(staged.write(classes.select(F.col("cid").alias("row")), "heads"))
    points = staged.write(signed.join(heads, "row").select(
        F.col("row").alias("cid"), "id", "d1", "d2", "n", "prefix", "point"), "points")
    staged.drop(signed)

    # blocks: shingles shown by several classes; equal sets of classes count once
    shown = points.select("cid", "n", F.explode("prefix").alias("block"))
    shared = small_side(staged.write(
        shown.groupBy("block").count().filter(F.col("count") > 1).select("block"), "shared"))
    shown = staged.write(shown.join(shared, "block"), "shown")
    same = (F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("cid")).alias("x"),
            F.sum(F.shiftright(F.xxhash64("cid", F.lit(1)), 24)).alias("s"))
    blocks = small_side(staged.write(
        shown.groupBy("block").agg(*same).groupBy("m", "x", "s")
        .agg(F.min("block").alias("block")).select("block"), "blocks"))
    # neighbouring size bands: sizes of linked sets differ by less than one band's factor
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num) * (1 + 1e-9)))
    member = (shown.join(blocks, "block").withColumn("own", band)
              .withColumn("band", F.explode(F.array(F.col("own"), F.col("own") + 1))))
    member = staged.write(member.select("block", "band", "own", "cid"), "members")
    cells = (member.groupBy("block", "band")
             .agg(*same, F.max(F.col("own") == F.col("band")).alias("has_own"))
             .filter((F.col("m") > 1) & F.col("has_own"))
             .groupBy("band", "m", "x", "s").agg(F.min("block").alias("block"))
             .select("block", "band", F.ceil(F.col("m") / TILE_POINTS).alias("parts")))
    tiled = tiles(member.join(cells, ["block", "band"]), "parts", "cid")
    tiled = (tiled.join(points.select("cid", "point"), "cid")
             .select("block", "band", "tile_i", "tile_j", "cid", "point"))

    def may_link(table):
        cid = table.column(4).to_numpy()
        tree = RTree(points_of(table.column(5).to_pylist()), num, den)
        return [(int(min(cid[a], cid[b])), int(max(cid[a], cid[b])))
                for a, b in spanning_links(len(cid), tree.query)]

    keys = ["block", "band", "tile_i", "tile_j"]
    maybe = staged.write(
        tiled.repartition(*keys).sortWithinPartitions(*keys)
        .mapInArrow(_links(4, may_link), "a long, b long").distinct(), "maybe")
    coarse = components(maybe)

    # verification on the full sets, component by component
    sizes = points.select(F.col("cid").alias("node"), "id", "d1", "d2", "n")
    inside = staged.write(coarse.join(sizes, "node").withColumnRenamed("node", "cid"), "coarse")
    parts = (inside.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
             .select("root", F.greatest(F.ceil(F.col("m") / TILE_SETS),
                                        F.ceil(F.col("s") / TILE_SHINGLES)).alias("parts")))
    wanted = staged.write(inside.select("cid", "root", "id", "d1", "d2").join(parts, "root"),
                          "wanted")
    texts = plain.join(small_side(wanted.withColumnRenamed("id", "wid")),
                       F.col("id").eqNullSafe(F.col("wid")))

    def sets_of(batches):
        shingler = Shingler(k)
        for batch in batches:
            for part in slices(batch, 0):
                keep, sets = [], []
                for i, (s, d1, d2) in enumerate(zip(shingler(text_bytes(part.column(0))),
                                                    part.column(1).to_pylist(),
                                                    part.column(2).to_pylist())):
                    # rows with an equal id but another set are not meant
                    if len(s) and signature(s, num, den)[:2] == (d1, d2):
                        keep.append(i)
                        sets.append(s.tobytes())
                kept = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [kept.column(3), kept.column(4), kept.column(5), pa.array(sets, pa.binary())],
                    ["cid", "root", "parts", "shingles"])

    sets = texts.select("t", "d1", "d2", "cid", "root", "parts").mapInArrow(
        sets_of, "cid long, root long, parts long, shingles binary")
    dealt = tiles(sets, "parts", "cid").select("root", "tile_i", "tile_j", "cid", "shingles")

    def do_link(table):
        cid, first = np.unique(table.column(3).to_numpy(), return_index=True)
        raw = table.column(4).take(pa.array(first)).to_pylist()
        index = SetIndex([np.frombuffer(x, np.uint64) for x in raw], num, den)
        return [(int(min(cid[a], cid[b])), int(max(cid[a], cid[b])))
                for a, b in spanning_links(len(cid), index.query)]

    keys = ["root", "tile_i", "tile_j"]
    links = staged.write(
        dealt.repartition(*keys).sortWithinPartitions(*keys)
        .mapInArrow(_links(3, do_link), "a long, b long").distinct(), "links")
    linked = components(links)

    # back to documents: the least id of each component, through the classes
    ids = classes.select(F.col("cid").alias("node"), "least_id", "d1", "d2") \
        .join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = ids.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = ids.join(least, "root").select("d1", "d2", "component_id")
    empty = documents.filter(F.col("n") == 0).select("id", "n", F.col("id").alias("component_id"))
    return (filled.select("id", "n", "d1", "d2").join(found, ["d1", "d2"])
            .select("id", "n", "component_id").unionByName(empty)
            .select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id"))


def keep_one(docs: DataFrame, text: str = "text", k: int = 5, num: int = 80,
             den: int = 100) -> DataFrame:
    """``docs`` with one document of each group of linked ones (the first row written)."""
    staged = Staged(docs.sparkSession, "dedup")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = staged.write(docs.select(F.monotonically_increasing_id().alias("row_id"),
                                    F.col(f"`{text}`").alias("row_text"), whole.alias("doc")),
                        "rows")
    got = jaccard_components(rows, "row_id", "row_text", k, num, den)
    gone = staged.write(got.filter(F.col("row_id") != F.col("component_id"))
                        .select("row_id"), "gone")
    return rows.join(small_side(gone), "row_id", "left_anti").select("doc.*")
