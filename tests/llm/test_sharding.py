"""Sharding against an exhaustive search over all contiguous partitions."""

import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kontor.llm import sharding as S

SCHEMA = "doc_id long, text string, size string, shard int"


def smallest_largest(sizes, shards):
    """The smallest largest part over all contiguous partitions, by dynamic programming."""
    n = len(sizes)
    sums = [0, *itertools.accumulate(sizes)]
    best = [0] + [10 ** 18] * n
    for _ in range(shards):
        best = [min(max(best[j], sums[i] - sums[j]) for j in range(i + 1)) for i in range(n + 1)]
    return best[n]


@pytest.mark.parametrize("seed", range(30))
def test_cuts_are_minimax(seed):
    rng = random.Random(seed)
    n, shards = rng.randint(1, 40), rng.randint(1, 8)
    sizes = [rng.choice([1, 2, 3, 8, 50, 400]) if seed % 2 else rng.randint(1, 9)
             for _ in range(n)]
    order = S.Order([S.Cell(64, i, s, s, i, i) for i, s in enumerate(sizes)], shards)
    ends = [*order.cuts(), n]
    parts = [sum(sizes[a:b]) for a, b in zip([0, *ends], ends)]
    assert len(parts) == shards and sum(parts) == sum(sizes)
    assert max(parts) == smallest_largest(sizes, shards)


def test_even_where_the_capacity_leaves_room():
    order = S.Order([S.Cell(64, i, 1, 1, i, i) for i in range(9)], 4)
    assert order.cuts() == [2, 4, 7]              # 2, 2, 3, 2, not 3, 3, 3, 0
    sizes = [1] * 20 + [100] + [1] * 20           # the large group stands alone
    order = S.Order([S.Cell(64, i, s, s, i, i) for i, s in enumerate(sizes)], 5)
    assert order.cuts() == [10, 20, 21, 31]


@pytest.mark.parametrize("first, most, biggest", [(3, 16, 700), (5, 32, 9000), (14, 1 << 16, 9000)])
def test_refined_cells_give_the_same_capacity(spark, monkeypatch, first, most, biggest):
    monkeypatch.setattr(S, "FIRST_BITS", first)
    monkeypatch.setattr(S, "MOST_CELLS", most)
    rng = random.Random(first)
    rows = sorted((rng.getrandbits(64) - (1 << 63), rng.choice([9, 30, 31, 700]))
                  for _ in range(60))
    rows[17] = rows[17][0], biggest
    rows += [(rows[-1][0] + 1, 5), (rows[-1][0] + 2, 6)]      # neighbours differ in few bits
    groups = spark.createDataFrame(rows, "h long, bytes long")
    cuts = S.minimax_cuts(groups, 6)
    assert cuts.base + len(cuts.bounds) == 5
    parts = [0] * 6
    for h, size, shard in groups.select("h", "bytes", cuts.shard(F.col("h"))).collect():
        parts[shard] += size
    heavy = dict(S.heavy_groups(groups, 6))
    assert bool(heavy) == (biggest > 700) and set(heavy) == set(cuts.heavy)
    rows = [*heavy.items(), *((h, s) for h, s in rows if h not in heavy)]
    assert max(parts) == smallest_largest([s for _, s in rows], 6)


def check(rows, got, shards):
    assert len(got) == len(rows)
    where, slots, sizes = {}, {}, [0] * shards
    for (key, text), g in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r[0], r[1])))):
        assert 0 <= g[4] < shards
    for key, text, size, crc, shard, slot in got:
        raw = (text or "").encode()
        assert (size, crc) == (len(raw) + 8, zlib.crc32(raw))
        assert where.setdefault(raw, shard) == shard
        slots.setdefault(shard, []).append(slot)
        sizes[shard] += size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def run(spark, rows, shards=24):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], SCHEMA)
    got = S.assign_shards(df, shards=shards, whole=True)
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "doc"]
    return [(r[0], r["doc"]["text"], r[1], r[2], r[3], r[4]) for r in got.collect()]


def test_odd_rows(spark):
    rows = [(1, "a"), (1, "a"), (2, None), (None, ""), (None, None), (3, "ñ" * 10), (4, "z" * 3000)]
    rows += [(i, "w" * (i % 13)) for i in range(100)] + [(9, "same")] * 50
    sizes = check(rows, run(spark, rows, 4), 4)
    assert sum(sizes) == sum(len((t or "").encode()) + 8 for _, t in rows)
    assert run(spark, []) == []
    one = run(spark, [(5, "x")])
    assert [r[2:] for r in one] == [(9, zlib.crc32(b"x"), one[0][4], 0)]


def test_one_group_with_a_third_of_all_rows(spark):
    rng = random.Random(3)
    rows = [(i, "copy " * 20) for i in range(1500)]
    rows += [(i, str(rng.random()) * rng.randint(1, 9)) for i in range(3000)]
    got = run(spark, rows)
    sizes = check(rows, got, 24)
    hot = 1500 * 108
    rest = sum(sizes) - hot
    assert max(sizes) == hot and sorted(sizes)[-2] <= rest / 23 + 200
    assert min(sizes) >= rest / 23 * 0.9
    assert sorted(got, key=str) == sorted(run(spark, rows), key=str)


def test_query_and_files(spark, tmp_path):
    from kontor.llm.queries import op11_minimax_shards
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = op11_minimax_shards(spark, d)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    text = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    out = got.collect()
    assert {(r["law"], r["grown_shard"]) for r in out} == {("bytes", None)}
    check([(k, t) for k, t in text.items()],
          [(r[0], text[r[0]], r[1], r[2], r[4], r[5]) for r in out], 24)
    back = S.write_shards(docs, str(tmp_path / "out"))
    assert sorted(map(str, back.drop("shard", "slot").collect())) == sorted(map(str, docs.collect()))
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in back.collect()} \
        == {(r["doc_id"], r["shard"], r["slot"]) for r in out}
