"""Hard negatives against all pairs; intervals against exact products."""

import numpy as np
import pytest

from kontor.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, ask boolean, score int"


@pytest.mark.parametrize("dim, levels", [(1, 1), (5, 2), (64, 1), (64, 4), (200, 3)])
def test_intervals_hold_every_product(dim, levels):
    rng = np.random.default_rng(dim)
    v = np.floor(rng.normal(size=(300, dim)) * rng.choice([1, 60, 9000], size=(300, 1)))
    v[:3] = 0
    v = v.astype(np.int32)
    codes = H.Codes(v, levels)
    for q in [*v[:20], v[0], np.full(dim, 7, np.int32)]:
        about, error = H.intervals(codes, H.Anchor(q))
        exact = v.astype(np.int64) @ q.astype(np.int64)
        assert (np.abs(exact - about) <= error).all()
    if dim == 64 and levels == 4:                # and they say something
        assert np.median(error / (codes.norm * np.linalg.norm(q) + 1)) < 0.25


def test_popcounts_are_products_with_codes():
    rng = np.random.default_rng(0)
    v = rng.integers(-99, 99, (50, 70)).astype(np.int32)
    codes, a = H.Codes(v, 1), H.Anchor(v[0])
    r = v @ H.rotation(70)
    q = r[0]
    u = np.rint((q - a.low) / a.step)
    c = np.where(r >= 0, 1, -1) / np.sqrt(70)
    about, _ = H.intervals(codes, a)
    assert np.allclose(about, (r * c).sum(1) * (c @ (a.low + a.step * u)))
    assert np.allclose(H.rotation(70) @ H.rotation(70).T, np.eye(70))


def brute(rows, positives=5, negatives=3):
    part = []
    for i, v, label, ask in rows:
        if label is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        part.append((i, [int(np.floor(256 * x)) for x in v], label, ask))

    def ranked(a, others):
        scored = [(sum(x * y for x, y in zip(a[1], b[1])), b) for b in others]
        return sorted(scored, key=lambda s: (-s[0], s[1][0] is None, s[1][0] or 0))

    out = []
    for n, a in enumerate(part):
        if not a[3]:
            continue
        others = [b for m, b in enumerate(part) if m != n and len(b[1]) == len(a[1])]
        same = ranked(a, [b for b in others if b[2] == a[2]])[:positives]
        other = ranked(a, [b for b in others if b[2] != a[2]])
        for p, pos in same:
            hit = [(s, b) for s, b in other if 50 * p <= 100 * s <= 95 * p][:negatives]
            out += [(a[0], pos[0], r, b[0], p, s) for r, (s, b) in enumerate(hit, 1)]
    return sorted(out, key=str)


def run(spark, rows, **kw):
    got = H.mine_hard_negatives(spark.createDataFrame([(*r, 3) for r in rows], SCHEMA), "ask", **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                           "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def vectors(seed, n=200, dim=64, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dim))
    v = centre[rng.integers(6, size=n)] * rng.choice([0, .5, 1], (n, 1)) + rng.normal(size=(n, dim)) * .7
    v = v / np.linalg.norm(v, axis=1)[:, None]
    return [(i, v[i].tolist(), int(rng.integers(labels)), i % 9 == 0) for i in range(n)]


def test_equals_all_pairs(spark, monkeypatch):
    rows = vectors(1)
    rows += [(300 + i, rows[0][1], i % 2, False) for i in range(8)]          # ties
    want = brute(rows)
    assert len(want) > 150
    assert run(spark, rows) == want
    monkeypatch.setattr(H, "ROW_BLOCK", 40)                                  # many tiles
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 7)
    assert run(spark, rows) == want


def test_odd_rows(spark):
    v, nan, inf = vectors(2, 1)[0][1], float("nan"), float("inf")
    w = [x * 0.8 for x in v]
    rows = [(1, v, 0, True), (2, v, 0, False), (3, w, 1, False), (4, w, None, True), (5, None, 0, True),
            (6, [0.0] * 64, 0, True), (7, [nan] * 64, 1, False), (8, [inf, *v[1:]], 1, False),
            (9, [None, *v[1:]], 1, False), (10, [], 0, True), (11, v[:5], 0, True), (12, v[:5], 0, False),
            (13, w[:5], 1, False), (None, w, 1, None), (None, w, 2, False), (1, v, 0, True),
            (14, [-x for x in v], 0, True), (15, w, 1, False), (15, w, 1, False)]
    assert run(spark, rows) == brute(rows)
    rows = [(1, [1e30, 1.0], 0, True), (2, [1.0, 1.0], 0, False), (3, [0.8, 0.8], 1, False)]
    assert run(spark, rows) == []
    assert run(spark, []) == []


def test_query_and_sql(spark, duck):
    from kontor.llm.queries import SQL, op13_hard_negatives
    got = sorted(map(tuple, op13_hard_negatives(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(duck.execute(SQL["op13_hard_negatives"]).fetchall()) and got
