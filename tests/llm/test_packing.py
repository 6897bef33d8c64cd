"""Packing against a plain best-fit search, and its promises on tables."""

import random

from kontor.llm import packing as P


def brute(rows, capacity, per_source):
    """Best fit by looking at every bin; among equal rooms the one that got that room first."""
    bins, out, clock = [], [], 0
    for size, cluster, source in rows:
        fit = [b for b in bins if b["left"] >= size
               and not (cluster is not None and cluster in b["clusters"])
               and b["sources"].count(source) < per_source]
        if fit:
            b = min(fit, key=lambda x: (x["left"], x["since"]))
        else:
            b = {"left": capacity, "clusters": [], "sources": [], "no": len(bins), "n": 0}
            bins.append(b)
        clock += 1
        b["left"] -= size
        b["since"] = clock
        b["clusters"].append(cluster)
        b["sources"].append(source)
        out.append((b["no"], b["n"]))
        b["n"] += 1
    return out


def test_same_bins_as_a_search_over_all():
    rng = random.Random(3)
    for _ in range(60):
        cap = rng.choice((10, 50, 200))
        rows = sorted([(rng.randrange(1, cap), rng.choice([None, *range(rng.randrange(1, 40))]),
                        rng.choice("aaabcd") if rng.random() < .9 else None)
                       for _ in range(rng.randrange(0, 150))], key=lambda r: -r[0])
        k = rng.choice((1, 2, 3))
        assert P.pack_rows(rows, cap, k) == brute(rows, cap, k)


def pack(spark, docs, **kw):
    df = spark.createDataFrame([(*d, "x") for d in docs],
                               "doc_id long, text string, source string, bin string")
    return P.pack_documents(df, **kw).collect()


def check(rows, docs, capacity, per_source):
    text = {i: (t, s) for i, t, s in docs}
    words: dict = {}
    bins: dict = {}
    for r in rows:
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + r["words"]
        if r["bin"] is None:
            assert r["words"] == 0
        else:
            bins.setdefault(r["bin"], []).append(r)
    assert words == {i: len((t or "").split()) for i, t, _ in docs}
    for members in bins.values():
        assert sum(r["words"] for r in members) <= capacity
        assert sorted(r["place"] for r in members) == list(range(len(members)))
        if members[0]["words"] < capacity:
            sources = [text[r["doc_id"]][1] for r in members]
            assert max(sources.count(s) for s in sources) <= per_source
            clusters = [" ".join(text[r["doc_id"]][0].lower().split()) for r in members]
            assert len(set(clusters)) == len(clusters)
    return bins


def test_tables_hot_source_and_copies(spark):
    rng = random.Random(4)
    docs = [(i, "w%d " % rng.randrange(30) * rng.randrange(0, 90), rng.choice(["hot"] * 5 + ["a", "b", None]))
            for i in range(900)]
    docs += [(i, "Same text  of all" if i % 2 else "same TEXT of\tall", "hot" if i % 3 else "c")
             for i in range(1000, 1200)]
    docs += [(2000, "long " * 1001, "a"), (2001, None, None), (2002, "", "a")]
    bins = check(pack(spark, docs, capacity=100, per_source=2, shard_rows=300), docs, 100, 2)
    words = sum(r["words"] for b in bins.values() for r in b)
    assert len(bins) * 100 < 2 * words


def test_edge_cases(spark):
    assert pack(spark, []) == []
    assert [(r["words"], r["bin"]) for r in pack(spark, [(1, None, None)])] == [(0, None)]
    same = pack(spark, [(7, "a b", "s")] * 3)
    assert len({r["bin"] for r in same}) == 3
    exact = pack(spark, [(1, "a b", "s"), (None, "c", None)], capacity=2)
    assert sorted(r["words"] for r in exact) == [1, 2]


def test_query_places_every_word(spark):
    from kontor.llm.queries import op5_best_fit_packing
    from tests.conftest import SMALL
    docs = [(r["doc_id"], r["text"], r["source"])
            for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    check(op5_best_fit_packing(spark, SMALL).collect(), docs, P.CAPACITY, P.PER_SOURCE)
