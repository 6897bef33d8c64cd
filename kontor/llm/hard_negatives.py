"""Hard negatives by rotated one-bit codes.

Vectors become whole numbers, floor(scale * x), and are rotated by one random
orthogonal matrix per dimension.  A vector r is coded by its signs: c is the
unit vector of its signs, and its alignment <r, c> is stored with it.  What the
code leaves, r - <r, c> c, is coded the same way again, LEVELS times in all; of
the rest only the norm is kept.

For an anchor q, whose rotated components are cut to PLANES bits, <c, q> follows
from popcounts of the code and the anchor's bit planes.  The sum over the levels
estimates <r, q>, and the Cauchy-Schwarz inequality bounds the error with
certainty: by the coded part's norm times the anchor's cutting error, plus the
rest's norm times the norm of the anchor's part across the last code.  Rows whose
interval cannot hold one of the wanted scores go; the others are scored by whole
numbers.  So results are exact, whatever the codes let through.

Work is cut into tiles of at most some ROW_BLOCK rows and ANCHOR_BLOCK anchors;
every anchor meets every row in one tile.  A tile gives only an anchor's best,
so no pair of a tile that does not count is ever put out.  The first pass finds
positives, the second negatives for the positives' scores.

Rows with a null label, a null or empty vector, or any null or non-finite
component take no part; neither do those with a component of 2^24 or more after
scaling, whose products might leave 64 bits.  Vectors of different lengths do not
meet.  Null ids rank last among equal scores and are no anchors.  Rows with equal
ids are rows of their own.  Empty tables give no rows; columns of other names do
no harm.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.llm.common import Staged
from kontor.llm.ngram_join import group_runs

LEVELS, PLANES = 4, 7
SCALE = 256
LIMIT = 1 << 24
ROW_BLOCK, ANCHOR_BLOCK = 8192, 4096
POSITIVES, NEGATIVES = 5, 3
#: A negative's score as a part of the positive's, in hundredths.
LOW, HIGH = 50, 95
SEED = 13


@functools.lru_cache(4)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def whole_numbers(values: list, scale: float = SCALE) -> list[np.ndarray | None]:
    """floor(scale * x) of each vector's components; None for those that take no part."""
    out = []
    for v in values:
        a = None
        if v and not any(x is None for x in v):
            a = np.floor(scale * np.array(v, np.float64))
            a = a.astype(np.int32) if np.all(np.abs(a) < LIMIT) else None   # false for NaN too
        out.append(a)
    return out


def packed_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    fill = -bits.shape[1] % 64
    bits = np.pad(bits, ((0, 0), (0, fill)))
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


class Codes:
    """Codes of a block of whole-number vectors (rows of ``v``)."""

    def __init__(self, v: np.ndarray, levels: int = LEVELS):
        self.v, dim = v, v.shape[1]
        r = v.astype(np.float64) @ rotation(dim)
        self.norm = np.linalg.norm(r, axis=1)
        rest = r.copy()
        self.words, self.align, self.ones = [], [], []
        for _ in range(levels):
            sign = rest >= 0
            c = np.where(sign, 1.0, -1.0) / np.sqrt(dim)
            a = (rest * c).sum(1)
            rest -= a[:, None] * c
            self.words.append(np.ascontiguousarray(packed_bits(sign).T))   # words x rows
            self.align.append(a)
            self.ones.append(sign.sum(1).astype(np.float64))
        self.coded = np.linalg.norm(r - rest, axis=1)
        self.rest = np.linalg.norm(rest, axis=1)


class Anchor:
    """A rotated anchor cut to bit planes: q is about low + step * u."""

    def __init__(self, v: np.ndarray):
        self.v = v.astype(np.int64)
        q = v.astype(np.float64) @ rotation(len(v))
        self.norm, self.dim = float(np.linalg.norm(q)), len(v)
        top = (1 << PLANES) - 1
        self.low = float(q.min())
        self.step = (float(q.max()) - self.low) / top or 1.0
        u = np.clip(np.rint((q - self.low) / self.step), 0, top).astype(np.int64)
        self.sum = float(u.sum())
        self.error = float(np.linalg.norm(q - self.low - self.step * u))
        bits = (u[None, :] >> np.arange(PLANES)[:, None] & 1).astype(bool)
        self.planes = packed_bits(bits)                                    # planes x words


_PLACE = (2.0 ** np.arange(PLANES)).astype(np.float32)


def intervals(codes: Codes, a: Anchor) -> tuple[np.ndarray, np.ndarray]:
    """For every row what its inner product with the anchor is about, and by how much it
    may differ at most."""
    about = np.zeros(len(codes.norm))
    for words, align, ones in zip(codes.words, codes.align, codes.ones):
        shared = np.zeros(len(about))
        for w, word in enumerate(words):
            count = np.bitwise_count(word[None, :] & a.planes[:, w, None])
            shared += _PLACE @ count.astype(np.float32)           # below 2^24: exact
        code = (a.low * (2 * ones - a.dim) + a.step * (2 * shared - a.sum)) / np.sqrt(a.dim)
        about += align * code
    along = np.maximum(np.abs(code) - a.error, 0)                 # of the anchor, by the last code
    across = np.sqrt(np.maximum(a.norm ** 2 - along ** 2, 0))
    slack = 1e-9 * codes.norm * a.norm + 1e-6                     # of floating point
    return about, codes.coded * a.error + codes.rest * across + slack


def best_in_windows(codes: Codes, a: Anchor, allowed: np.ndarray, order: np.ndarray,
                    windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """Per window (least, most) of scores the first k (row, score) among ``allowed`` rows:
    highest scores, ties by ``order``."""
    about, error = intervals(codes, a)
    low, high = about - error, about + error
    least = min(w[0] for w in windows)
    most = max(w[1] for w in windows)
    known: dict[int, int] = {}

    def score(rows: np.ndarray) -> np.ndarray:
        new = np.array([r for r in rows.tolist() if r not in known], np.int64)
        if len(new):
            known.update(zip(new.tolist(), (codes.v[new].astype(np.int64) @ a.v).tolist()))
        return np.array([known[r] for r in rows.tolist()], np.int64)

    open_ = np.flatnonzero(allowed & (high >= least) & (low <= most))
    out = []
    for lo, hi in windows:
        rows = open_[(high[open_] >= lo) & (low[open_] <= hi)]
        # a first look at some likely rows gives a score that the best k reach
        likely = rows[(about[rows] >= lo) & (about[rows] <= hi)]
        if len(likely) > 4 * k:
            likely = likely[np.argpartition(-about[likely], 4 * k)[:4 * k]]
        seen = score(likely)
        seen = np.sort(seen[(seen >= lo) & (seen <= hi)])[::-1]
        if len(seen) >= k:
            rows = rows[high[rows] >= seen[k - 1]]
        s = score(rows)
        inside = (s >= lo) & (s <= hi)
        rows, s = rows[inside], s[inside]
        first = np.lexsort((order[rows], -s))[:k]
        out.append(list(zip(rows[first].tolist(), s[first].tolist())))
    return out


ANY = (-(1 << 62), 1 << 62)


def score_window(positive: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Whole scores s with low * positive <= 100 * s <= high * positive."""
    return -(-low * positive // 100), high * positive // 100


def _column(table: pa.Table, name: str, rows: np.ndarray | None = None) -> np.ndarray:
    column = table.column(name)
    return (column if rows is None else column.take(pa.array(rows))).to_numpy(zero_copy_only=False)


def _vectors(table: pa.Table, rows: np.ndarray) -> np.ndarray:
    raw = table.column("v").take(pa.array(rows)).to_pylist()
    return np.frombuffer(b"".join(raw), np.int32).reshape(len(rows), -1)


def _tile(find, schema: pa.Schema):
    """Run ``find(rows, anchors)`` on every tile and put out what it yields."""
    def run(batches):
        out = []
        for table in group_runs(batches, 3):
            is_anchor = _column(table, "is_anchor")
            out += find(table, np.flatnonzero(~is_anchor), np.flatnonzero(is_anchor))
            if len(out) > 50_000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema)
    return run


def _block(table: pa.Table, rows: np.ndarray):
    """Codes, row numbers, labels, ids, and the order of ids of a tile's rows."""
    codes = Codes(_vectors(table, rows))
    row, label = _column(table, "row", rows), _column(table, "label", rows)
    ids = table.column("id").take(pa.array(rows))
    null, plain = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()
    order = np.empty(len(rows), np.int64)
    order[np.lexsort((row, plain, null))] = np.arange(len(rows))
    return codes, row, label, ids.to_pylist(), order


def _find_positives(k: int):
    def find(table, rows, anchors):
        out = []
        if not len(rows) or not len(anchors):
            return out
        codes, row, label, ids, order = _block(table, rows)
        for anchor, own, of, v in zip(_column(table, "row", anchors).tolist(),
                                      _column(table, "label", anchors).tolist(),
                                      table.column("id").take(pa.array(anchors)).to_pylist(),
                                      _vectors(table, anchors)):
            allowed = (label == own) & (row != anchor)
            if allowed.any():
                for i, s in best_in_windows(codes, Anchor(v), allowed, order, [ANY], k)[0]:
                    out.append({"anchor": anchor, "anchor_id": of, "row": int(row[i]),
                                "id": ids[i], "score": s})
        return out
    return find


def _find_negatives(k: int, low: int, high: int):
    def find(table, rows, anchors):
        out = []
        if not len(rows) or not len(anchors):
            return out
        codes, row, label, ids, order = _block(table, rows)
        wanted = table.column("scores").take(pa.array(anchors)).to_pylist()
        for anchor, own, scores, v in zip(_column(table, "row", anchors).tolist(),
                                          _column(table, "label", anchors).tolist(), wanted,
                                          _vectors(table, anchors)):
            windows = {s: w for s in set(scores)
                       if (w := score_window(s, low, high))[0] <= w[1]}
            allowed = label != own
            if windows and allowed.any():
                found = best_in_windows(codes, Anchor(v), allowed, order, [*windows.values()], k)
                for s, best in zip(windows, found):
                    out += [{"anchor": anchor, "positive_score": s, "row": int(row[i]),
                             "id": ids[i], "score": t} for i, t in best]
        return out
    return find


_POSITIVE = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("row", pa.int64()),
                       ("id", pa.int64()), ("score", pa.int64())])
_NEGATIVE = pa.schema([("anchor", pa.int64()), ("positive_score", pa.int64()),
                       ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
_TILE = ["dim", "rows_block", "anchors_block"]


def _meet(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Rows and anchors dealt to tiles: a row is copied for each block of anchors, an anchor
    for each block of rows."""
    row_blocks, anchor_blocks = -(-n_rows // ROW_BLOCK), -(-n_anchors // ANCHOR_BLOCK)

    def own(n):
        return F.pmod(F.xxhash64("row", F.lit("tile")), F.lit(n))

    def every(n):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    dealt = (rows.withColumn("scores", F.lit(None).cast("array<long>"))
             .withColumn("is_anchor", F.lit(False)).withColumn("rows_block", own(row_blocks))
             .withColumn("anchors_block", every(anchor_blocks)))
    asked = (anchors.withColumn("is_anchor", F.lit(True))
             .withColumn("anchors_block", own(anchor_blocks))
             .withColumn("rows_block", every(row_blocks)))
    columns = [*_TILE, "is_anchor", "row", "id", "label", "v", "scores"]
    return (dealt.select(*columns).unionByName(asked.select(*columns))
            .repartition(max(1, row_blocks * anchor_blocks), *_TILE).sortWithinPartitions(*_TILE))


def mine_hard_negatives(vectors: DataFrame, anchor: str, key: str = "vec_id",
                        vector: str = "embedding", label: str = "label",
                        positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
                        high: int = HIGH, scale: float = SCALE) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    Anchors are the rows whose boolean column ``anchor`` is true.  Their positives are the
    ``positives`` other rows of their label with the highest scores, the negatives of each
    the ``negatives`` rows of other labels with the highest scores s that satisfy
    low * positive_score <= 100 * s <= high * positive_score.
    """
    staged = Staged(vectors.sparkSession, "negatives")
    labelled = vectors.filter(F.col(f"`{label}`").isNotNull()).select(
        F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{label}`")).alias("label"),
        F.coalesce(F.col(f"`{anchor}`"), F.lit(False)).alias("asks"),
        F.col(f"`{vector}`").alias("x"))

    def numbers(batches):
        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                v = whole_numbers(part.column(3).to_pylist(), scale)
                at = [i for i, x in enumerate(v) if x is not None]
                kept = part.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns[:3], pa.array([len(v[i]) for i in at], pa.int64()),
                     pa.array([v[i].tobytes() for i in at], pa.binary())],
                    ["id", "label", "asks", "dim", "v"])

    rows = staged.write(
        labelled.mapInArrow(numbers, "id long, label long, asks boolean, dim long, v binary")
        .withColumn("row", F.monotonically_increasing_id()), "rows")
    asked = rows.filter("asks").withColumn("scores", F.lit(None).cast("array<long>"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("a")).first()
    best_first = [F.desc("score"), F.asc_nulls_last("id"), "row"]

    found = _meet(rows, asked, sizes["n"], sizes["a"]).mapInArrow(
        _tile(_find_positives(positives), _POSITIVE),
        "anchor long, anchor_id long, row long, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(*best_first))
    pairs = staged.write(found.withColumn("place", place).filter(F.col("place") <= positives),
                         "positives")

    scores = pairs.groupBy("anchor").agg(F.collect_set("score").alias("scores"))  # few a group
    asked = asked.drop("scores").join(scores.withColumnRenamed("anchor", "row"), "row")
    found = _meet(rows, asked, sizes["n"], sizes["a"]).mapInArrow(
        _tile(_find_negatives(negatives, low, high), _NEGATIVE),
        "anchor long, positive_score long, row long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "positive_score").orderBy(*best_first))
    best = (found.withColumn("rank", rank).filter(F.col("rank") <= negatives)
            .select("anchor", "positive_score", "rank", F.col("id").alias("negative_id"),
                    F.col("score").alias("negative_score")))
    return (pairs.select("anchor", "anchor_id", F.col("id").alias("positive_id"),
                         F.col("score").alias("positive_score"))
            .join(best, ["anchor", "positive_score"])
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                    "negative_score"))
