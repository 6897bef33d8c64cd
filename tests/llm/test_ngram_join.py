"""The join against all pairs of Python sets; the tree, the index and the forest alone."""

import random
import re

import numpy as np

from kontor.llm import ngram_join as N
from kontor.llm.components import components


def shingles(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", low)
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in links:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    owners: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            owners.setdefault(x, []).append(i)
    shared: dict = {}
    for o in owners.values():
        for x, a in enumerate(o):
            for b in o[x + 1:]:
                shared[a, b] = shared.get((a, b), 0) + 1
    links = [(a, b) for (a, b), c in shared.items()
             if den * c >= num * (len(sets[a]) + len(sets[b]) - c)]
    root = roots(len(rows), links)
    least: dict = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, len(s), least.get(r)) for (i, _), s, r in zip(rows, sets, root)),
                  key=str)


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            at = rng.randrange(len(w))
            if rng.random() < .5:
                w[at] = f"e{rng.randrange(10 ** 6)}"
            else:
                del w[at]
        out.append(" ".join(w))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    texts = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(120)]
    for _ in range(6):
        base = [word() for _ in range(rng.randrange(20, 200))]
        texts += variants(rng, base, rng.randrange(2, 25), 4)
    shared = " ".join(word() for _ in range(40))
    texts += [shared + " " + " ".join(word() for _ in range(rng.randrange(5, 60)))
              for _ in range(60)]
    texts += ["Copy of ME", "copy OF me", "copy of me", "a", "A", "a b", "", None, " \t", None]
    texts += ["x y z " * 50, "x y z " * 70]
    return [(i, t) for i, t in enumerate(texts)]


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 0) for r in rows],
                               "doc_id long, text string, component_id int")
    got = N.jaccard_components(df, **kw)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_same_components_as_all_pairs(spark):
    rows = corpus(1)
    assert run(spark, rows) == brute(rows, 3, 90, 100)


def test_five_words_and_small_tiles(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE_POINTS", 6)
    monkeypatch.setattr(N, "TILE_SETS", 5)
    rows = corpus(2)
    assert run(spark, rows, k=5, num=80, den=100) == brute(rows, 5, 80, 100)


def test_repeated_and_null_ids(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (5, "p q r s"), (3, "p q r s"), (None, "a b c d"),
            (None, "only null"), (None, "only null"), (None, None), (9, "")]
    assert run(spark, rows) == brute(rows, 3, 90, 100)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_keep_one_keeps_columns_and_one_of_each_group(spark):
    rows = corpus(3)
    df = spark.createDataFrame([(i, t, "l") for i, t in rows], "doc_id long, text string, row string")
    got = N.keep_one(df)
    assert got.columns == df.columns
    kept = {r["doc_id"] for r in got.collect()}
    groups: dict = {}
    for i, n, c in brute(rows, 5, 80, 100):
        groups.setdefault(c if n else ("empty", i), []).append(i)
    assert all(len(kept & set(g)) == 1 for g in groups.values())


def test_tree_bound_loses_no_link_and_prunes():
    rng = random.Random(4)
    rows = corpus(4)
    shingler = N.Shingler(3)
    sets = [s for s in shingler([(t or "").encode() for _, t in rows]) if len(s)]
    points = N.points_of([N.signature(s, 90, 100)[3] for s in sets])
    tree, index = N.RTree(points, 90, 100), N.SetIndex(sets, 90, 100)
    plain = [set(s.tolist()) for s in sets]
    asked = 0
    for i in rng.sample(range(len(sets)), 120):
        want = {j for j in range(len(sets)) if j != i and 100 * len(plain[i] & plain[j])
                >= 90 * len(plain[i] | plain[j])}
        may = set(tree.query(i).tolist())
        assert want == set(index.query(i).tolist())
        assert want <= may
        assert may == {j for j in range(len(sets)) if j != i and tree._fit(
            points[i], int(tree.n[i]), points[j:j + 1], tree.n[j:j + 1], tree.n[j:j + 1])[0]}
        asked += len(may)
    assert asked < 120 * len(sets) / 4


def test_forest_spans_exactly_the_components():
    rng = random.Random(5)
    for _ in range(200):
        n = rng.randrange(0, 30)
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(0, 40))] if n else []
        near = [[b if a == i else a for a, b in links if i in (a, b) and a != b] for i in range(n)]
        asked = []
        got = N.spanning_links(n, lambda i: asked.append(i) or near[i])
        assert [x for x in _norm(roots(n, got))] == [x for x in _norm(roots(n, links))]
        assert len(asked) == len(set(asked)) and len(got) <= max(0, n - 1)


def _norm(root):
    first: dict = {}
    return [first.setdefault(r, i) for i, r in enumerate(root)]


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)]
    links += [(700 + i, 700 + (i + 1) % 9) for i in range(9)] + [(3, 3), (1, 2), (2, 1), (1, 2)]
    rng.shuffle(links)
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    nodes = sorted({x for p in links if p[0] != p[1] for x in p})
    at = {x: i for i, x in enumerate(nodes)}
    want = roots(len(nodes), [(at[a], at[b]) for a, b in links if a != b])
    least: dict = {}
    for x, r in zip(nodes, want):
        least.setdefault(r, x)
    assert got == {x: least[r] for x, r in zip(nodes, want)}


def test_points_of_short_and_long_sets_compare():
    rng = np.random.default_rng(7)
    a = np.unique(rng.integers(0, 1 << 63, N.FINE_SHINGLES + 50, dtype=np.uint64))
    for size in (N.FINE_SHINGLES - 1, N.FINE_SHINGLES, 70_000):
        b = np.unique(np.concatenate([a[:size], rng.integers(0, 1 << 63, max(0, size - len(a)),
                                                             dtype=np.uint64)]))
        points = N.points_of([N.signature(s, 80, 100)[3] for s in (a, b)])
        assert points.sum(1).tolist() == [len(a), len(b)]
        assert np.minimum(*points).sum() >= len(np.intersect1d(a, b))
