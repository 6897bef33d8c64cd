"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected to eight dimensions by random matrices, one per
table, and decoded to the nearest point of the E8 lattice (the union of D8 and
D8 shifted by one half).  A vector lies in its own cell of every table and
probes the neighbouring cells that are next nearest.  Vectors that meet in a
cell and have the same label are compared by cosine in double precision.

Equal vectors of a label are one class with a weight: classes are hashed and
compared, and links are counted by the weights, so a vector that many rows
repeat costs one row.

A pair may meet in several tables; it counts where it meets first, which both
vectors' cells tell.  Inside a cell a task counts links and keeps a spanning
set of them, so pairs are never put out one by one.  Cells with many vectors
are cut into tiles.

Vectors that are null, zero, or hold null or non-finite components, and rows
without a label, link with nothing.  Vectors of different lengths under one
label do not link.  Rows with equal ids are vectors of their own.  A component's id is
its least id (null ids count only if there is no other).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.llm.common import Staged
from kontor.llm.components import components
from kontor.llm.ngram_join import group_runs, spanning_links, tiles

TABLES = 8
PROBES = 6
SCALE = 1.2
#: Vectors of the largest label up to which TABLES and SCALE hold; cells get finer beyond.
COARSE_VECTORS = 200_000
LEAST_COSINE = 0.98
TILE_VECTORS = 1024
HOT_CLASSES = 200
SEED = 8


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two of +-1, or all +-1/2 with an even number of minus."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1, 1):
                for b in (-1, 1):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        signs = np.array([-1 if bits >> i & 1 else 1 for i in range(8)])
        if (signs < 0).sum() % 2 == 0:
            out.append(signs / 2)
    return np.array(out)


NEIGHBOURS = _minimal_vectors()


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: round, and where the sum is odd round the
    coordinate with the largest error the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    if len(odd):
        err = x[odd] - r[odd]
        worst = np.abs(err).argmax(1)
        e = err[np.arange(len(odd)), worst]
        r[odd, worst] += np.where(e >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest point of E8 for every row."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(1) < ((x - whole) ** 2).sum(1)
    return np.where(closer[:, None], half, whole)


_MIX = np.random.default_rng(SEED).integers(1, 1 << 62, 8, dtype=np.uint64) | np.uint64(1)


def cell_keys(points: np.ndarray, table: int) -> np.ndarray:
    """64-bit keys of lattice points; points that share one by chance are only compared more."""
    whole = np.rint(points * 2).astype(np.int64).astype(np.uint64)
    key = np.full(len(points), table + 1, np.uint64)
    for i in range(8):
        key = (key ^ (whole[:, i] * _MIX[i])) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE
          ) -> np.ndarray:
    """vectors x tables x (1 + probes): the own cell, then the probed ones."""
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    for t in range(tables):
        project = np.random.default_rng([SEED, t, unit.shape[1]]).normal(size=(unit.shape[1], 8))
        x = unit @ project * scale
        own = nearest_e8(x)
        out[:, t, 0] = cell_keys(own, t)
        gain = (x - own) @ NEIGHBOURS.T
        near = np.argpartition(-gain, probes - 1, axis=1)[:, :probes]
        for p in range(probes):
            out[:, t, 1 + p] = cell_keys(own + NEIGHBOURS[near[:, p]], t)
    return out


def lattice_of(n: int) -> tuple[int, float]:
    """Tables and scale for a largest label of ``n`` vectors.

    Unrelated vectors meet with a chance that falls with some 7th power of the scale, so a
    scale that grows with the 12th root of n keeps the comparisons a vector needs at about
    the square root of n; more tables make up for the links that finer cells miss.
    """
    finer = max(1.0, n / COARSE_VECTORS) ** (1 / 12)
    return math.ceil(TABLES * finer ** 1.5), SCALE * finer


def unit_vectors(values: list) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for those that link with nothing."""
    out = []
    for v in values:
        if not v or any(x is None for x in v):
            out.append(None)
            continue
        a = np.array(v, np.float64)
        largest = np.abs(a).max()
        if not np.isfinite(largest) or largest == 0 or np.isnan(a).any():
            out.append(None)
            continue
        a = a / largest                       # no overflow or underflow in the norm
        out.append(a / np.linalg.norm(a) + 0.0)     # no -0.0: equal vectors, equal bytes
    return out


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding",
                    label: str = "label", least: float = LEAST_COSINE, tables: int | None = None,
                    probes: int = PROBES, scale: float | None = None) -> DataFrame:
    """One row per row: key, n_links, component_id (least key reachable), kept.

    ``tables`` and ``scale`` follow from the distinct vectors of the largest label unless
    given.
    """
    spark = vectors.sparkSession
    staged = Staged(spark, "lattice")
    source = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("id"),
        F.xxhash64(F.col(f"`{label}`")).alias("label"),
        F.when(F.col(f"`{label}`").isNotNull(), F.col(f"`{vector}`")).alias("v"))

    def normalised(batches):
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                units = unit_vectors(part.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2),
                     pa.array([None if u is None else u.tobytes() for u in units], pa.binary())],
                    ["row", "id", "label", "unit"])

    points = staged.write(source.mapInArrow(normalised, T.StructType(
        [*source.schema.fields[:3], T.StructField("unit", T.BinaryType())])), "points")
    usable = points.filter(F.col("unit").isNotNull())
    if tables is None or scale is None:
        largest = (usable.groupBy("label").agg(F.approx_count_distinct(F.xxhash64("unit")).alias("n"))
                   .agg(F.max("n")).first()[0])
        wanted = lattice_of(largest or 0)
        tables, scale = tables or wanted[0], scale or wanted[1]
    # equal vectors of a label are one class from here on, counted on the map side first
    same = usable.groupBy("label", "unit").agg(
        F.min("row").alias("row"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("least"))

    names = [*same.columns, "size", "cells"]

    def hashed(batches):
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                raw = part.column(1).to_pylist()
                for size in sorted({len(u) for u in raw}):
                    at = [i for i, u in enumerate(raw) if len(u) == size]
                    unit = np.frombuffer(b"".join(raw[i] for i in at)).reshape(len(at), -1)
                    got = cells(unit, tables, probes, scale).reshape(len(at), -1)
                    yield pa.RecordBatch.from_arrays(
                        [c.take(pa.array(at)) for c in part.columns]
                        + [pa.array([size // 8] * len(at), pa.int64()),
                           pa.array(list(got), pa.list_(pa.int64()))],
                        names)

    classes = staged.write(same.mapInArrow(hashed, T.StructType(
        [*same.schema.fields, T.StructField("size", T.LongType()),
         T.StructField("cells", T.ArrayType(T.LongType()))])), "classes")

    # cells that some vector lies in and another one sees
    seen = classes.select("row", "label", "size", F.posexplode("cells").alias("p", "cell")) \
        .select("row", "label", "size", "cell", (F.col("p") % (1 + probes) == 0).alias("own"))
    used = (seen.groupBy("label", "size", "cell")
            .agg(F.count(F.lit(1)).alias("m"), F.max("own").alias("has_own"))
            .filter(F.col("has_own") & (F.col("m") > 1))
            .select("label", "size", "cell", F.ceil(F.col("m") / TILE_VECTORS).alias("parts")))
    meet = seen.join(used, ["label", "size", "cell"])
    dealt = (tiles(meet, "parts", "row")
             .select("label", "size", "cell", "tile_i", "tile_j", "row", "own", "part_no")
             .join(classes.select("row", "weight", "cells", "unit"), "row"))
    keys = ["label", "size", "cell", "tile_i", "tile_j"]
    width = 1 + probes

    def compare(table, counts, links):
        row = table.column("row").to_numpy()
        weight = table.column("weight").to_numpy()
        own = table.column("own").to_numpy(zero_copy_only=False)
        part = table.column("part_no").to_numpy()
        ti, tj = table.column("tile_i")[0].as_py(), table.column("tile_j")[0].as_py()
        unit = np.frombuffer(b"".join(table.column("unit").to_pylist())).reshape(len(row), -1)
        cell = np.stack(table.column("cells").to_numpy(zero_copy_only=False)) \
            .reshape(len(row), -1, width)
        this = int(np.flatnonzero((cell[0] == table.column("cell")[0].as_py()).any(1))[0])
        base = np.flatnonzero(own)
        near = [[] for _ in row]
        for s in range(0, len(row), 512):
            hit_q, hit_b = np.nonzero(unit[s:s + 512] @ unit[base].T >= least)
            q, b = hit_q + s, base[hit_b]
            ok = row[q] != row[b]
            if ti != tj:                            # pairs inside a part belong to tile (i, i)
                ok &= part[q] != part[b]
            q, b = q[ok], b[ok]
            # the pair counts once: in the first table where one sees the other's own cell,
            # seen from the smaller row if both do
            first = np.ones(len(q), bool)
            for t in range(this):
                first &= ~((cell[q, t] == cell[b, t, :1]).any(1)
                           | (cell[b, t] == cell[q, t, :1]).any(1))
            first &= (row[q] < row[b]) | ~(cell[b, this] == cell[q, this, :1]).any(1)
            for i, j in zip(q[first].tolist(), b[first].tolist()):
                near[i].append(j)
                near[j].append(i)
        for i, x in enumerate(near):
            if x:
                counts[int(row[i])] = counts.get(int(row[i]), 0) + int(weight[x].sum())
        if any(near):
            links.update((int(min(row[i], row[j])), int(max(row[i], row[j])))
                         for i, j in _forest(near))

    def run(batches):
        counts: dict[int, int] = {}
        links: set[tuple[int, int]] = set()
        for table in group_runs(batches, len(keys)):
            if table.num_rows > 1:
                compare(table, counts, links)
            if len(counts) + len(links) > 50_000:
                yield _rows(counts, links)
                counts, links = {}, set()
        yield _rows(counts, links)

    found = staged.write(
        dealt.select(*keys, "row", "weight", "own", "part_no", "cells", "unit").repartition(*keys)
        .sortWithinPartitions(*keys).mapInArrow(run, "a long, b long, n long"), "found")
    degree = found.filter(F.col("b").isNull()).groupBy("a").agg(F.sum("n").alias("n_links"))
    joined = components(found.filter(F.col("b").isNotNull()).select("a", "b").distinct())

    member = classes.select("row", "least").join(joined, F.col("node") == F.col("row"))
    least_id = member.groupBy("root").agg(F.min("least").alias("root_least"))
    member = member.join(least_id, "root").select(F.col("node"), "root_least")
    known = staged.write(
        classes.select("row", "label", "unit", "weight", "least")
        .join(degree, F.col("row") == F.col("a"), "left")
        .join(member, F.col("row") == F.col("node"), "left")
        .select("label", "unit", "weight",
                (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                F.when(F.col("node").isNull(), F.col("least")).otherwise(F.col("root_least"))
                .alias("component")), "known")

    # a class with more than 1 / HOT_CLASSES of the rows is looked up by broadcast: there are
    # fewer than HOT_CLASSES of them
    hot = F.col("weight") * HOT_CLASSES > points.count()
    by = ["label", "unit"]
    common = F.broadcast(known.filter(hot))
    out = (usable.join(common, by).select("id", "n_links", "component")
           .unionByName(usable.join(common, by, "left_anti").join(known.filter(~hot), by)
                        .select("id", "n_links", "component"))
           .unionByName(points.filter(F.col("unit").isNull()).select(
               "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))))
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), "n_links", component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _forest(near: list[list[int]]) -> list[tuple[int, int]]:
    return spanning_links(len(near), lambda i: near[i])


def _rows(counts: dict, links: set) -> pa.RecordBatch:
    """Counts as (row, null, n) and links as (a, b, null)."""
    a = [*counts, *(x for x, _ in links)]
    b = [None] * len(counts) + [y for _, y in links]
    n = [*counts.values()] + [None] * len(links)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)],
                                      ["a", "b", "n"])
