"""Lattice decoding by search, and links against all pairs."""

import itertools
import random

import numpy as np

from kontor.llm import lattice as V
from kontor.llm.ngram_join import tiles
from tests.llm.test_ngram_join import roots


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 8)) * 1.5
    got = V.nearest_e8(x)
    for p, g in zip(x, got):
        base = np.floor(p)
        best = np.inf
        for shift in (0.0, 0.5):
            for step in itertools.product((0, 1), repeat=8):
                c = np.floor(p - shift) + shift + np.array(step)
                if (c - shift).sum() % 2 == 0:
                    best = min(best, ((p - c) ** 2).sum())
        assert ((p - g) ** 2).sum() <= best + 1e-9, base
        assert (2 * g % 1 == 0).all() and (len(set((g % 1).tolist())) == 1)


def test_neighbours_are_lattice_points():
    assert len(V.NEIGHBOURS) == 240 and np.allclose((V.NEIGHBOURS ** 2).sum(1), 2)
    assert np.allclose(V.nearest_e8(V.NEIGHBOURS + 0.01), V.NEIGHBOURS)


def brute(rows):
    units = V.unit_vectors([v for _, v, _ in rows])
    links = [(a, b) for a in range(len(rows)) for b in range(a)
             if rows[a][2] is not None and rows[a][2] == rows[b][2]
             and units[a] is not None and units[b] is not None
             and len(units[a]) == len(units[b]) and units[a] @ units[b] >= V.LEAST_COSINE]
    degree = [0] * len(rows)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    root = roots(len(rows), links)
    least: dict = {}
    for (i, _, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, d, least.get(r), i is not None and least.get(r) == i)
                   for (i, _, _), d, r in zip(rows, degree, root)), key=str), links


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "c") for r in rows],
                               "vec_id long, embedding array<float>, label int, kept string")
    got = V.near_duplicates(df, **kw)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def vectors(seed, n=60, dim=64):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        c = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 12))):
            out.append((c + rng.normal(size=dim) * rng.choice([0, .05, .1, .12])).astype(float).tolist())
    random.Random(seed).shuffle(out)
    return out


def test_counts_and_components_equal_all_pairs(spark, monkeypatch):
    rows = [(i, v, i % 2) for i, v in enumerate(vectors(1))]
    want, links = brute(rows)
    assert len(links) > 100
    assert run(spark, rows) == want
    monkeypatch.setattr(V, "TILE_VECTORS", 5)       # tiles count every pair once too
    assert run(spark, rows) == want


def test_odd_vectors_and_labels(spark):
    v = vectors(2, 1)[0]
    nan, inf = float("nan"), float("inf")
    rows = [(1, v, 0), (2, [2 * x for x in v], 0), (3, v, 1), (4, v, None), (5, None, 0),
            (6, [0.0] * 64, 0), (7, [nan] * 64, 0), (8, [inf, *v[1:]], 0), (9, [None, *v[1:]], 0),
            (10, [], 0), (11, v[:5], 0), (12, v[:5], 0), (None, v, 0), (1, v, 0), (None, [1.0], 7),
            (20, [1e30, 1e30], 2), (21, [1e-30, 1e-30], 2)]
    assert run(spark, rows) == brute(rows)[0]


def test_many_copies_of_one_vector(spark, monkeypatch):
    """Copies are one row of the comparison: 20,000 of them, and no cell is cut into tiles."""
    rng = np.random.default_rng(7)
    v = [float(x) for x in rng.normal(size=16)]
    near = [x + 0.01 for x in v]
    rows = [(i, [2.0 * x for x in v] if i % 2 else v, 0) for i in range(20_000)]
    rows += [(-1, near, 0), (20_001, near, 0), (20_002, [-x for x in v], 0), (20_003, v, 1)]
    dealt = []
    monkeypatch.setattr(V, "tiles", lambda df, *a: dealt.append(df.count()) or tiles(df, *a))
    got = {i: (n, c, k) for i, n, c, k in run(spark, rows)}
    assert dealt[0] < 200
    assert got[-1] == (20_001, -1, True) and got[20_001] == (20_001, -1, False)
    assert got[20_002] == (0, 20_002, True) and got[20_003] == (0, 20_003, True)
    assert all(got[i] == (20_001, -1, False) for i in range(20_000))


def test_finer_cells_keep_the_links():
    """Pairs at the least cosine, in the cells that labels of up to 10^9 vectors get."""
    rng = np.random.default_rng(5)
    for dim in (16, 64, 384):
        x = rng.normal(size=(500, dim))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        o = rng.normal(size=x.shape)
        o -= (o * x).sum(1, keepdims=True) * x
        o /= np.linalg.norm(o, axis=1, keepdims=True)
        y = V.LEAST_COSINE * x + np.sqrt(1 - V.LEAST_COSINE ** 2) * o
        for n in (0, 10 ** 6, 10 ** 7, 10 ** 8, 10 ** 9):
            a, b = (V.cells(z, *V.lattice_of(n)[:1], scale=V.lattice_of(n)[1]) for z in (x, y))
            met = ((a == b[:, :, :1]).any(2) | (b == a[:, :, :1]).any(2)).any(1).mean()
            print(dim, n, V.lattice_of(n), met)
            assert met >= 0.95


def test_empty_table(spark):
    assert run(spark, []) == []


def test_recall_on_the_given_table(spark):
    import pyarrow.parquet as pq
    from kontor.llm.queries import op9_lattice_near_dups
    d = "/root/testdata/sf0.1"
    t = pq.read_table(f"{d}/embeddings.parquet").to_pydict()
    unit = np.stack(V.unit_vectors(t["embedding"]))
    label = np.array(t["label"])
    want = sum(int((unit[label == x] @ unit[label == x].T >= V.LEAST_COSINE).sum() - (label == x).sum())
               for x in set(t["label"]))
    got = sum(r["n_links"] for r in op9_lattice_near_dups(spark, d).collect())
    assert 0.9 * want <= got <= want
