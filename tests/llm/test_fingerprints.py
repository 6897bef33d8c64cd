"""Chunking against a byte-by-byte version; neighbours against a sorted list."""

import hashlib
import random

import numpy as np
import xxhash

from kontor.llm import fingerprints as P

RNG = random.Random(9)


def words(n):
    return " ".join("".join(RNG.choice("abcdefgé你") for _ in range(RNG.randrange(1, 9)))
                    for _ in range(n))


def slow_chunks(data: bytes) -> dict:
    out, start = {}, 0
    while start < len(data):
        end = min(start + P.MOST, len(data))
        for stop in range(start + P.LEAST, end):
            h = 0
            for b in data[max(0, stop - 16):stop]:
                h = (h * 2 + int(P.GEAR[b])) % (1 << 32)
            bits = P.STRICT_BITS if stop - start < P.WANTED else P.LOOSE_BITS
            if h >> (32 - bits) == 0:
                end = stop
                break
        piece = data[start:end]
        out[xxhash.xxh64_intdigest(piece)] = len(piece)
        start = end
    return out


def test_chunks_equal_the_slow_way_alone_and_together():
    texts = [b"", b"a", words(400).encode(), b"x" * 3000, words(30).encode(), b"", words(900).encode()]
    want = [slow_chunks(t) for t in texts]
    assert P.chunk_sets(texts) == want
    assert [P.chunk_sets([t])[0] for t in texts] == want


def test_insertion_moves_chunks_along():
    text = words(3000).encode()
    a, b = P.chunk_sets([text, b"inserted words " + text])
    assert P.likeness(a, b) > 0.97
    assert P.likeness(a, P.chunk_sets([words(3000).encode()])[0]) < 0.05


def test_short_texts_that_keep_half_are_alike(spark):
    rows = [(i, " ".join(words(1) for _ in range(10 + i % 51))) for i in range(306)]
    got = [r for r in run(spark, rows)]
    near = {r[0]: r[5] for r in got}
    for least, most, zeros, mean in ((10, 20, 0.3, 0.2), (20, 40, 0.02, 0.35), (40, 61, 0, 0.4)):
        some = [near[i] for i in near if least <= 10 + i % 51 < most]
        assert sum(x == 0 for x in some) <= zeros * len(some)
        assert sum(some) / len(some) > mean
    assert sum(r[6] for r in got) / len(got) < 0.01


def test_likeness_edges():
    a = {1: 10, 2: 30}
    assert P.likeness(a, {2: 30, 3: 5}) == 0.75
    assert (P.likeness({}, {}), P.likeness({}, a), P.likeness(a, {})) == (1.0, 0.0, 0.0)


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (k, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        edit = t[:len(t) - half] + nxt[:half]
        own, changed, following = P.chunk_sets([t.encode(), edit.encode(), nxt.encode()])
        out.append((k, len(t), hashlib.sha256(edit.encode()).hexdigest(),
                    P.fingerprint_text(own), P.fingerprint_text(changed),
                    P.likeness(own, changed), P.likeness(own, following)))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "c") for r in rows],
                               "doc_id long, text string, fingerprint string")
    got = P.compare_neighbours(df)
    assert got.columns == P.NAMES
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_neighbours_across_blocks_and_gaps(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ROWS", 7)
    ids = RNG.sample(range(-10 ** 9, 10 ** 9), 150)
    rows = [(i, words(RNG.randrange(0, 120))) for i in ids]
    rows += [(ids[0], rows[0][1]), (ids[1], "other text"), (10 ** 10, None), (10 ** 10 + 1, "")]
    rows += [(None, "null id"), (None, "null id too")]
    assert run(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert run(spark, []) == []
    for rows in ([(1, "alone " * 40)], [(None, "a b c d")], [(None, "x"), (None, "y z")],
                 [(1, None), (2, None)], [(3, "long " * 60_000), (2, "s")]):
        assert run(spark, rows) == brute(rows)


def test_query(spark):
    from kontor.llm.queries import op8_chunk_fingerprints
    from tests.conftest import SMALL
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in op8_chunk_fingerprints(spark, SMALL).collect()), key=str)
    assert got == brute(docs)


def test_fingerprint_column(spark):
    df = spark.createDataFrame([("same text here",), ("same text here",), (None,)], "text string")
    a, b, c = [r["fingerprint"] for r in P.fingerprint(df).collect()]
    assert a == b and c == ""


def test_gear_is_fixed():
    assert P.GEAR.dtype == np.uint32 and len(set(P.GEAR.tolist())) == 256
