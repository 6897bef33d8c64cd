"""Ranked lexical search with bag deduplication.

Items are queries; documents are ranked for each by an integer BM25 score.

1. Documents are restricted to the items' vocabulary: a document's bag is the
   sorted term numbers with their frequencies, and its length is counted over
   all terms.  Documents, terms and document frequencies are counted over all
   documents.
2. Documents with equal bags and equal length factor m are one class.  They are
   grouped by a 128-bit hash of the bag together with m and the bag itself, so
   a class holds identical bags whatever the hash does.
3. Every class is scored once, for all items.  A task keeps for each item the
   ``top`` classes with the highest scores, equal scores by their least id: a
   class behind as many others cannot hold one of the ``top`` documents, as
   each of those has a document that ranks before all of its own.
4. The classes that win are expanded into their documents by ascending id, at
   most ``top`` of a class, and ranked.

Items are taken in slices of bounded text, so vocabulary and postings are small
whatever their number; every slice reads the documents once.

Terms: maximal runs of ASCII letters and digits and of all characters beyond
ASCII; only A-Z are lowered.  A null or empty text has no terms and is not
counted.  Null ids rank last among equal scores.  Repeated rows are documents
(or items) of their own.  Items without terms, or that no document matches, get
no rows; so do empty tables.  Texts are read whole, in pieces cut between
words.  Columns of other names do no harm.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.llm.common import Staged, annotate

# Fixed values of the score.
WEIGHT = 1000
GAIN, TF_UNIT, LENGTH_UNIT = 1_000_000_000, 1000, 20
FLAT, SLOPE = 50, 50            # m = FLAT + SLOPE * length / mean length

TOP = 50
#: Bytes of item texts in one slice; bytes of bags and number of rows that are broadcast.
SLICE_BYTES = 2 << 20
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 500_000
#: Bytes of a text split into words at once; (document, item) scores computed at once.
PIECE = 1 << 20
CELLS = 1 << 20

_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32
              for b in range(256))


def term_pieces(text: bytes):
    """The terms of a text, in lists."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):                      # on to the end of the word
            while end < len(text) and _KEEP[text[end]] != 32:
                end += 1
        yield text[at:end].translate(_KEEP).split()
        at = end


def item_terms(text: bytes) -> list[bytes]:
    """Distinct terms of an item, sorted."""
    return sorted({t for piece in term_pieces(text) for t in piece})


class Postings:
    """Which items of a slice ask for a term: items' numbers, term by term."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.rows = [row for row, _ in rows]
        terms = [item_terms(text) for _, text in rows]
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for x in terms for t in x}))}
        pairs = sorted((self.vocabulary[t], i) for i, x in enumerate(terms) for t in x)
        self.items = np.array([i for _, i in pairs], np.int64)
        n = len(self.vocabulary)
        self.starts = np.searchsorted(np.array([t for t, _ in pairs], np.int64), np.arange(n + 1))


def bag_of(text: bytes, vocabulary: dict[bytes, int]) -> tuple[int, bytes]:
    """Number of terms, and the bag: numbers of known terms ascending, then frequencies."""
    n, found = 0, Counter()
    for words in term_pieces(text):
        n += len(words)
        found.update(map(vocabulary.get, words))
    found.pop(None, None)
    ids = sorted(found)
    return n, np.array([*ids, *(found[i] for i in ids)], "<u4").tobytes()


def make_bags(vocabulary: dict[bytes, int]):
    def run(texts: list[bytes]) -> dict:
        lengths, bags = zip(*[bag_of(t, vocabulary) for t in texts]) if texts else ((), ())
        halves = [np.frombuffer(xxhash.xxh3_128_digest(b), np.int64).tolist() for b in bags]
        return {"n": lengths, "bag": bags, "h1": [h[0] for h in halves],
                "h2": [h[1] for h in halves]}
    return run


def count_terms(size: int):
    """Of the bags of a task: how many hold each term."""
    def run(batches):
        df = np.zeros(size, np.int64)
        for batch in batches:
            for bag in batch.column(0).to_pylist():
                ids = np.frombuffer(bag, "<u4")
                df[ids[:len(ids) // 2]] += 1
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], ["term", "df"])
    return run


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * df + 1)))


def score_bags(bags: list[bytes], m: np.ndarray, weights: np.ndarray, postings: Postings):
    """Scores of some bags for all items of a slice, in bounded parts: yields the first
    bag's number and an array bags x items."""
    step = max(1, CELLS // max(len(postings.rows), 1))
    for first in range(0, len(bags), step):
        part = [np.frombuffer(b, "<u4") for b in bags[first:first + step]]
        half = np.array([len(x) // 2 for x in part])
        ids = np.concatenate([x[:k] for x, k in zip(part, half)]).astype(np.int64)
        tf = np.concatenate([x[k:] for x, k in zip(part, half)]).astype(np.int64)
        bag = np.repeat(np.arange(len(part)), half)
        gain = (GAIN * tf) // (TF_UNIT * tf + LENGTH_UNIT * m[first:first + step][bag])
        value = weights[ids] * gain
        score = np.zeros(len(part) * len(postings.rows), np.int64)
        width = postings.starts[ids + 1] - postings.starts[ids]
        ends = np.cumsum(width)
        at = 0
        while at < len(ids):                     # postings of some terms at a time
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS)))
            w = width[at:to]
            begin = postings.starts[ids[at:to]] - (np.cumsum(w) - w)
            where = np.repeat(begin, w) + np.arange(w.sum())
            cell = np.repeat(bag[at:to] * len(postings.rows), w) + postings.items[where]
            np.add.at(score, cell, np.repeat(value[at:to], w))
            at = to
        yield first, score.reshape(len(part), -1)


class Best:
    """The best classes of a task for each item: highest score, then least id, nulls last."""

    def __init__(self, items: int, top: int):
        self.items, self.top = items, top
        self.least = np.zeros(items, np.int64)       # scores below it are not among the best
        self.held: list[np.ndarray] = []             # item, score, id is null, id, class
        self.size = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray, cids: np.ndarray):
        bag, item = np.nonzero((scores >= self.least) & (scores > 0))
        if len(bag):
            self.held.append(np.stack([item, scores[bag, item], null[bag], ids[bag], cids[bag]]))
            self.size += len(bag)
            if self.size > 4 * self.top * self.items + CELLS:
                self.prune()

    def prune(self) -> np.ndarray:
        if not self.held:
            return np.zeros((5, 0), np.int64)
        rows = np.concatenate(self.held, axis=1)
        rows = rows[:, np.lexsort((rows[4], rows[3], rows[2], -rows[1], rows[0]))]
        item = rows[0]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = rows[:, place == self.top - 1]
        self.least[last[0]] = last[1]
        rows = rows[:, place < self.top]
        self.held, self.size = [rows], rows.shape[1]
        return rows


def _best_classes(postings: Postings, weights: np.ndarray, top: int):
    def run(batches):
        best = Best(len(postings.rows), top)
        for batch in batches:
            if batch.num_rows:
                cid, m, bag, least = (batch.column(i) for i in range(4))
                m, cid = m.to_numpy(), cid.to_numpy()
                null = least.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                least = least.fill_null(0).to_numpy()
                for first, scores in score_bags(bag.to_pylist(), m, weights, postings):
                    s = slice(first, first + len(scores))
                    best.add(scores, least[s], null[s], cid[s])
        item, score, null, least, cid = best.prune()
        rows = np.array(postings.rows, np.int64)[item]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows), pa.array(cid), pa.array(least, mask=null.astype(bool)),
             pa.array(score)], ["item", "cid", "least_id", "score"])
    return run


def _first(df: DataFrame, keys: list[str], order: list, top: int, spread: str) -> DataFrame:
    """The first ``top`` rows of each key: of parts by a hash of ``spread``, then of all."""
    part = F.pmod(F.xxhash64(spread, F.lit("part")), F.lit(32))
    for window in (Window.partitionBy(*keys, part), Window.partitionBy(*keys)):
        df = (df.withColumn("place", F.row_number().over(window.orderBy(*order)))
              .filter(F.col("place") <= top))
    return df


def _checked(df: DataFrame, size: int | None = None) -> DataFrame:
    """``df``, a written table, with a broadcast hint if its counted rows (and ``size`` in
    bytes) allow it; a larger one is left to a shuffle join."""
    if size is not None and size > BROADCAST_BYTES:
        return df
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
           item_key: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """One row per item and document found: item key, rank, key, score; the ``top`` best
    of each item row.  ``key`` is a long."""
    spark = docs.sparkSession
    staged = Staged(spark, "search")
    asked = staged.write(items.select(
        F.monotonically_increasing_id().alias("item"), F.col(f"`{item_key}`").alias("item_key"),
        F.col(f"`{item_text}`").alias("t")), "items")
    size = asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    slices = -(-size // SLICE_BYTES)
    number = F.pmod(F.xxhash64("item"), F.lit(max(slices, 1)))
    found = None
    for i in range(slices):
        part = asked.filter(number == i).filter(F.octet_length("t") > 0)
        postings = Postings([(r["item"], r["t"].encode()) for r in
                             part.select("item", "t").orderBy("item").collect()])
        if postings.vocabulary:
            one = _search_slice(docs, key, text, postings, top, staged)
            found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "item long, id long, score long, rank int")
    return (found.join(_checked(asked.select("item", "item_key")), "item")
            .select(F.col("item_key").alias(item_key), "rank", F.col("id").alias(key), "score"))


def _search_slice(docs: DataFrame, key: str, text: str, postings: Postings, top: int,
                  staged: Staged) -> DataFrame:
    """(item, id, score, rank) for the items of one slice."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(postings.vocabulary)
    plain = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("t"))
    bags = staged.write(annotate(
        plain, "t", lambda: make_bags(vocabulary.value),
        {"n": "long", "h1": "long", "h2": "long", "bag": "binary"}).drop("t")
        .filter(F.col("n") > 0).withColumn("row", F.monotonically_increasing_id()), "bags")
    vocabulary.destroy()
    counts = bags.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = counts["docs"], counts["terms"] or 1
    df = np.zeros(len(postings.vocabulary), np.int64)
    for term, n in (bags.select("bag").mapInArrow(count_terms(len(df)), "term long, df long")
                    .groupBy("term").agg(F.sum("df")).collect()):      # a row a term
        df[term] = n
    weights = np.array([term_weight(n_docs, int(x)) for x in df], np.int64)

    m = F.expr(f"cast(cast({SLOPE} * cast(n as decimal(38,0)) * {n_docs} as decimal(38,0)) "
               f"div {n_terms} as bigint) + {FLAT}")
    bags = bags.filter(F.length("bag") > 0).withColumn("m", m)
    same = ["h1", "h2", "m", "bag"]
    classes = staged.write(bags.groupBy(*same).agg(
        F.min("id").alias("least_id"), F.min("row").alias("cid")), "classes")
    best = staged.write(classes.select("cid", "m", "bag", "least_id").mapInArrow(
        _best_classes(postings, weights, top),
        "item long, cid long, least_id long, score long"), "best")
    best = staged.write(_first(
        best, ["item"], [F.desc("score"), F.asc_nulls_last("least_id"), "cid"], top, "cid")
        .drop("place", "least_id"), "winners")

    # the documents of the classes that won: at most ``top`` an item
    won = staged.write(classes.join(_checked(best.select("cid").distinct()), "cid")
                       .select("cid", *same), "won")
    bytes_won = won.agg(F.sum(F.length("bag"))).first()[0] or 0
    members = (bags.join(_checked(won.select("h1").distinct()), "h1", "left_semi")
               .join(_checked(won, bytes_won), same).select("cid", "id", "row"))
    members = _first(members, ["cid"], [F.asc_nulls_last("id"), "row"], top, "row").drop("place")
    ranked = members.join(_checked(best), "cid")
    last = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return (_first(ranked, ["item"], [F.desc("score"), F.asc_nulls_last("id"), "row"], top, "row")
            .withColumn("rank", F.row_number().over(last)).select("item", "id", "score", "rank"))
