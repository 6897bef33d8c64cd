"""Ranked search against scores computed document by document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kontor.llm import ranked_search as R

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs, items, top=50):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 100 - 50 + (50 * sum(bag.values()) * n_docs) // total
            score = 0
            for t in set(terms(text)) & set(bag):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, rank, i, -s) for rank, (s, _, i) in enumerate(scored[:top], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs],
                              "doc_id long, text string, rank int, bag string")
    q = spark.createDataFrame(items, "item_id long, text string")
    got = R.search(d, q, **kw)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def corpus(seed, n=300, words=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)]
    return [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 30)))) for i in range(n)]


def test_equals_brute_force(spark):
    docs = corpus(1) + [(1000 + i, "W1 w2, w3") for i in range(120)]     # more copies than ranks
    items = [(i, f"w{i} w{i + 1} W{i + 1} zzz") for i in range(10)] + [(99, "w1 w2 w3")]
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    assert len([r for r in want if r[0] == 99 and r[2] >= 1000]) == 50


@pytest.mark.parametrize("top", [1, 3])
def test_few_ranks_and_small_parts(spark, monkeypatch, top):
    monkeypatch.setattr(R, "CELLS", 8)
    monkeypatch.setattr(R, "SLICE_BYTES", 20)                            # several slices
    monkeypatch.setattr(R, "BROADCAST_ROWS", 2)                          # shuffle joins
    docs, items = corpus(2, 80, 12), [(i, f"w{i} w{(i * 5) % 12}") for i in range(8)]
    assert run(spark, docs, items, top=top) == brute(docs, items, top)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "...!"), (None, "alpha beta"), (4, "ALPHA beta"), (4, "alpha beta"),
            (5, "ñandú Ñ ñ İ"), (6, "x" * 50), (7, "alpha " * 5000 + "beta"), (8, "a_b`c{d~e\x7ff@g")]
    items = [(1, "alpha Beta"), (1, "alpha"), (2, None), (3, ""), (4, "ñ ÑANDÚ"), (5, "?"), (None, "b c d f"),
             (6, "unknown")]
    assert run(spark, docs, items) == brute(docs, [(i, t or "") for i, t in items])
    assert run(spark, [], items) == [] == run(spark, docs, [])


def test_long_texts_are_cut_between_words(monkeypatch):
    text = ("Ab1-cd " * 50 + "é" * 30 + ".z").encode()
    whole = [t for p in R.term_pieces(text) for t in p]
    monkeypatch.setattr(R, "PIECE", 7)
    assert [t for p in R.term_pieces(text) for t in p] == whole
    assert [w.decode() for w in whole] == terms(text.decode())


def test_best_keeps_ties_by_least_id():
    best = R.Best(1, 3)
    for ids in ([9, 7], [8, 1], [5, 6]):
        best.add(np.full((2, 1), 4), np.array(ids), np.zeros(2, np.int64), np.array(ids))
        best.prune()
    assert best.prune()[4].tolist() == [1, 5, 6]


def test_query_and_sql(spark, duck):
    from kontor.llm.queries import SQL, op12_ranked_search
    got = sorted(map(tuple, op12_ranked_search(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(duck.execute(SQL["op12_ranked_search"]).fetchall())
    assert len(got) > 500
