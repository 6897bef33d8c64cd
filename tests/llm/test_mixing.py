"""The mix against a plain event-by-event version."""

import random
import re

from kontor.llm import mixing as M


def targets(sizes: dict) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    order += [None] if None in sizes else []
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, out, open_ = float(sum(sizes.values())), {}, set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = 3.0 * sizes[s]
            open_.discard(s)
        left = float(sum(sizes.values())) - sum(out.values())
    return out


def check(rows, docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    by_source: dict = {}
    for _, t, s in docs:
        by_source[s] = by_source.get(s, 0) + size(t)
    want = targets(by_source)
    assert sorted((r["doc_id"], r["size"]) for r in rows) == sorted((i, size(t)) for i, t, _ in docs)
    source = {i: s for i, _, s in docs}
    taken: dict = {}
    for r in rows:
        s = source[r["doc_id"]]
        assert r["source_size"] == by_source[s]
        assert abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[s] = taken.get(s, 0) + r["taken"]
    longest = max([size(t) for _, t, _ in docs], default=0)
    for s, words in taken.items():
        assert abs(words - want[s]) <= longest + 1, (s, words, want[s])
    total = sum(by_source.values())
    if total:
        assert 0 <= sum(taken.values()) - total < longest


def make(n, sources, seed):
    rng = random.Random(seed)
    return [(i, "w " * rng.randrange(0, 60), rng.choice(sources)) for i in range(n)]


def run(spark, docs):
    df = spark.createDataFrame([(*d, 7) for d in docs],
                               "doc_id long, text string, source string, size int")
    return M.taken_words(df).collect()


def test_shares_follow_the_weights(spark):
    docs = make(3000, ["a", "b", "c", "d", None, "Z", "é"], 1)
    check(run(spark, docs), docs)


def test_small_source_is_capped_and_hot_source_shares(spark):
    docs = make(1500, ["big"] * 30 + ["a", "b"], 2)
    check(run(spark, docs), docs)


def test_reruns_agree_whatever_the_partitions(spark):
    docs = make(400, ["a", "b"], 3)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    a = sorted(M.taken_words(df.repartition(7)).collect())
    b = sorted(M.taken_words(df.coalesce(1)).collect())
    assert a == b


def test_edge_cases(spark):
    assert run(spark, []) == []
    docs = [(1, None, None), (2, "", "a"), (3, " \t\n", "a")]
    assert [(r["size"], r["taken"]) for r in run(spark, docs)] == [(0, 0)] * 3
    docs = [(1, "one", "a")]
    assert [(r["target"], r["taken"]) for r in run(spark, docs)] == [(1.0, 1)]
    same = spark.createDataFrame([(5, "a b c", "s")] * 4 + [(None, "x", "t")],
                                 "doc_id long, text string, source string")
    rows = M.taken_words(same).collect()
    assert len(rows) == 5 and sum(r["taken"] for r in rows) >= 13


def test_word_pattern(spark):
    from pyspark.sql import functions as F
    texts = [None, "", "a b", " x y", "a\x0b\x0c\x1cb", " lead", "é\r\nü"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(
        M.word_count(F.col("t")).alias("n"))
    assert [r["n"] for r in df.collect()] == [
        len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for t in texts]


def test_mixed_documents_repeat_what_is_taken(spark):
    docs = make(300, ["a", "b", "c"], 4)
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in M.taken_words(df).collect() if r["size"]}
    got = M.mixed_documents(df)
    assert got.columns == df.columns
    times: dict = {}
    for r in got.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert times == {i: n for i, n in taken.items() if n}
