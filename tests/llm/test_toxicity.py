"""Held-out accuracy, the network's parts, and inputs without texts or labels."""

import random
import zlib

import numpy as np

from kontor.llm import toxicity as X


def brute_scores(model, texts):
    """Scores by explicit loops over windows."""
    out = []
    for words in texts:
        pad = max(f.shape[0] for f in model.filters)
        seq = [0] * pad + list(words) + [0] * pad
        best = []
        for f in model.filters:
            w = f.shape[0]
            emb = [sum(model.embed[1 + at[0]] for row in X.rows_of(np.array(x))
                       if len(at := np.flatnonzero(model.known == row)))
                   + np.zeros(X.DIM) for x in seq + [0] * w]
            resp = [sum(emb[i + j] @ f[j] for j in range(w)) for i in range(len(seq))]
            best.extend(np.max(resp, axis=0))
        logit = np.maximum(np.array(best) + model.bias, 0) @ model.out + model.out_bias
        out.append(1 / (1 + np.exp(-logit)))
    return np.array(out)


def small_model(seed=1):
    rng = random.Random(seed)
    good, bad = [f"w{i}" for i in range(300)], ["vile", "nasty"]
    hasher = X.Hasher()
    texts = []
    for i in range(400):
        words = [rng.choice(good) for _ in range(rng.randrange(5, 60))]
        if i % 2:
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words).encode())
    return X.train(hasher(texts), np.array([i % 2 for i in range(400)], np.float32)), hasher


def test_scores_equal_a_plain_convolution_and_long_texts_are_scored_in_parts():
    model, hasher = small_model()
    texts = hasher([t.encode() for t in ("", "w1 vile w2", "w1", "w3 w4 w5 w6 nasty", "VILE!")])
    table = model.table()
    got = X.scores(model, table, texts)
    assert np.allclose(got, brute_scores(model, texts), atol=1e-5)
    assert got[1] > 0.5 > got[2] and got[3] > 0.5 and got[4] > 0.5
    rng = random.Random(5)
    for n in (51, 600, 3001):                 # no period: windows at the cuts differ from others
        for extra in ([], ["vile", "nasty"]):
            words = [f"w{rng.randrange(300)}" for _ in range(n)]
            words[n // 2:n // 2] = extra
            long, = hasher([" ".join(words).encode()])
            whole = X.scores(model, table, [long])[0]
            for room in (1, 2, 7, 50, 64, n, 10 * n):
                assert X.long_score(model, table, long, room)[0] == whole


def test_threshold_maximises_f1():
    rng = np.random.default_rng(0)
    for _ in range(50):
        v, y = rng.integers(0, 12, 30) / 12, rng.integers(0, 2, 30)
        if not 0 < y.sum() < 30:
            continue
        f1 = lambda t: 2 * (y[v >= t]).sum() / max(1, (v >= t).sum() + y.sum())
        assert f1(X.best_threshold(v, y)) >= max(f1(t) for t in np.unique(v)) - 1e-12


def frames(spark, rows, labels):
    return (spark.createDataFrame([(*r, 1.0) for r in rows],
                                  "doc_id long, text string, lang string, score double"),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_no_labels_and_empty_table(spark):
    docs, labels = frames(spark, [(1, "a b", "en"), (2, None, None), (None, "", "en")], [])
    model = X.fit(docs, labels)
    assert [r["score"] for r in X.score_toxicity(docs, model).collect()] == [0.0] * 3
    assert X.reject_toxic(docs, model).count() == 3
    docs, labels = frames(spark, [], [])
    assert X.score_toxicity(docs, X.fit(docs, labels)).count() == 0


def test_sample_is_bounded_in_bytes(spark):
    rows = [(i, f"w{i} " * 50 + ("vile" if i % 2 else "fine"), "en") for i in range(80)]
    docs, labels = frames(spark, [*rows, (900, "huge " * 400_000, "en")],
                          [*((i, i % 2) for i in range(80)), (900, 1)])
    model = X.fit(docs, labels, most_bytes=100_000)
    huge, = X.Hasher()([b"huge"])
    assert model.prior is None and not np.isin(X.rows_of(huge), model.known).any()
    assert X.fit(docs, labels, most_bytes=0).prior == 0.0


def test_held_out_rows_and_null_labels_are_never_learned_from(spark):
    ids = list(range(60))
    held = [i for i in ids if zlib.crc32(str(i).encode()) % 5 == 0]
    docs, labels = frames(spark, [(i, f"t{i}", "en") for i in ids],
                          [(i, 1 if i in held else 0) for i in ids] + [(None, 1), (3, None), (3, 0)])
    model = X.fit(docs, labels)
    assert model.prior == 0.0               # every label 1 is held out
    got = docs.select("doc_id", X.held_out("doc_id").alias("h")).collect()
    assert [r["doc_id"] for r in got if r["h"]] == held
    null = spark.createDataFrame([(None,)], "doc_id long").select(X.held_out("doc_id").alias("h"))
    assert null.first()["h"] is False


def test_long_null_and_equal_texts(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        words = [f"w{rng.randrange(200)}" for _ in range(30)] + (["vile"] if i % 3 == 0 else [])
        rows.append((i, " ".join(words), "en" if i % 2 else None))
        labels.append((i, int(i % 3 == 0)))
    rows += [(1000, "w1 " * 200_000 + "vile", "en"), (1001, None, "en"), (1002, "", "fr"),
             (1003, "w5 vile", "fr"), (1003, "w5 vile", "en")]
    docs, lab = frames(spark, rows, labels)
    model = X.fit(docs, lab)
    got = {}
    for r in X.score_toxicity(docs, model).collect():
        assert 0 <= r["score"] <= 1
        assert got.setdefault(r["doc_id"], r["score"]) == r["score"]
    assert got[1000] > 0.5 and got[1003] > 0.5 and got[1001] == got[1002] < 0.5
    kept = {r["doc_id"] for r in X.reject_toxic(docs, model).collect()}
    assert not kept & {1000, 1003} and {1001, 1002} <= kept


def test_every_labelled_text_is_learned_from(spark):
    from pyspark.sql import functions as F
    last = {r["id"] for r in spark.range(5000).filter(~X.held_out("id"))
            .orderBy(F.xxhash64("id", F.lit("train")).desc()).limit(60).collect()}
    rows = [(i, f"w{i % 40} " + ("late" if i in last else "fine" if i % 20 else "vile"), "en")
            for i in range(5000)]
    big = [i for i in range(6000, 6060) if zlib.crc32(str(i).encode()) % 5]
    rows += [(i, "huge " + "x" * 700_000, "en") for i in big[:20]]
    docs, labels = frames(spark, rows, [(r[0], int("vile" in r[1])) for r in rows])
    model = X.fit(docs, labels)
    for word in (b"late", b"huge", b"vile"):
        assert np.isin(X.rows_of(X.Hasher()([word])[0]), model.known).all(), word
    got = X.scores(model, model.table(), X.Hasher()([b"w1 vile", b"w1 fine", b"w1 late", b"huge"]))
    assert got[0] > 0.5 > max(got[1:])


def test_parts_are_averaged_and_reruns_agree(spark, monkeypatch):
    monkeypatch.setattr(X, "PART_TEXTS", 100)
    monkeypatch.setattr(X, "BATCHES", 60)
    rng = random.Random(8)
    rows = [(i, " ".join([f"w{rng.randrange(50)}" for _ in range(20)] + ["vile"] * (i % 2)), "en")
            for i in range(400)]
    docs, labels = frames(spark, rows, [(i, i % 2) for i in range(400)])
    one, two = X.fit(docs, labels), X.fit(docs.repartition(3), labels.repartition(7))
    assert np.array_equal(one.known, two.known) and np.array_equal(one.embed, two.embed)
    assert one.out_bias == two.out_bias and one.thresholds == two.thresholds
    got = X.scores(one, one.table(), X.Hasher()([r[1].encode() for r in rows]))
    assert np.mean((got >= 0.5) == (np.arange(400) % 2 == 1)) > 0.95


def test_cuts_over_a_table_are_those_in_memory(spark):
    rng = np.random.default_rng(3)
    rows = [(float(v), int(rng.random() < v), lang) for lang in ("en", "de", None)
            for v in np.round(np.clip(rng.random(200), 0.001, 0.999), 2 + (lang == "de")).clip(0.01, 0.99)]
    scored = spark.createDataFrame(rows, "score double, y int, lang string")
    cuts = X.best_cuts(X.Staged(spark, "test"), scored)
    assert cuts.keys() == {None, "en", "de"}
    for lang, (n, hits, top, below) in cuts.items():
        v, y = (np.array(x) for x in zip(*[r[:2] for r in rows if lang in (None, r[2])]))
        assert (n, hits) == (len(y), y.sum()) and (top + below) / 2 == X.best_threshold(v, y)


def test_winners_do_not_depend_on_the_room(monkeypatch):
    rng = np.random.default_rng(4)
    table = rng.normal(size=(30, sum(X.WIDTHS) * X.FILTERS)).astype(np.float32)
    table[0] = 0
    texts = [rng.integers(0, 30, n) for n in (0, 1, 4, 60, 7, 200, 3)]
    best, won = X.winners(table, texts)
    for room in (1, 2, 5, 61):
        monkeypatch.setattr(X, "ROOM", room)
        b, w = X.winners(table, texts)
        assert np.array_equal(b, best) and all(map(np.array_equal, w, won))


def test_held_out_accuracy(spark):
    from kontor.llm.queries import op4_toxicity_cnn
    big = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in op4_toxicity_cnn(spark, big).collect()}
    truth = [(r["doc_id"], r["toxic"]) for r in spark.read.parquet(f"{big}/labels.parquet").collect()]
    test = [(rows[i]["predicted"], y) for i, y in truth if rows[i]["held_out"]]
    assert len(test) > 300
    assert np.mean([p == y for p, y in test]) > 0.95
    # some 350 toxic texts to learn from here, so words of single texts are missed; over
    # the tables of the check tool held-out recall is 0.97
    assert np.mean([p for p, y in test if y]) > 0.6
    assert np.mean([p for p, y in test if not y]) < 0.01
