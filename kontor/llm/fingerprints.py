"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes; a chunk ends where its leading bits are
zero.  Chunking is normalised: up to the wanted size more bits must be zero,
beyond it fewer, with a smallest and a largest size.  Ends depend on the bytes
before them only, so an insertion moves them along.  A fingerprint is the set
of the chunks' digests with their lengths; the likeness of A to B is the share
of A's length that lies in chunks that B has too.

Nulls and empty texts have the empty fingerprint (""); its likeness to the
empty one is 1, to others 0, and the others' to it 0.  Equal texts have equal
fingerprints.  Long texts are chunked whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kontor.llm.common import annotate, slices

# Fine enough that texts of a few words have several chunks; LEAST is the reach of the hash.
LEAST, WANTED, MOST = 16, 24, 64
STRICT_BITS, LOOSE_BITS = 5, 2
GEAR = np.random.default_rng(20240229).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Documents in a block of neighbours, on average, and the most blocks.
BLOCK_ROWS = 1000
MOST_BLOCKS = 20_000


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """At every byte the gear hash of it and the 15 bytes before (shift by one and add)."""
    h = GEAR[data]
    for width in (1, 2, 4, 8):
        older = h[:-width] << np.uint32(width)
        h = h.copy()
        h[width:] += older
    return h



def chunk_sets(texts: list[bytes]) -> list[dict[int, int]]:
    """Per text its chunks as digest -> length.  All texts are hashed in one array: the
    first chunk end considered is LEAST bytes into a text, past its neighbour's influence."""
    joined = b"".join(texts)
    if not joined:
        return [{} for _ in texts]
    lead = gear_hashes(np.frombuffer(joined, np.uint8)) >> np.uint32(32 - STRICT_BITS)
    loose = (np.flatnonzero(lead < (1 << (STRICT_BITS - LOOSE_BITS))) + 1).tolist()
    strict = (np.flatnonzero(lead == 0) + 1).tolist()
    out, at = [], 0
    n_strict, n_loose = len(strict), len(loose)
    i = j = 0
    for text in texts:
        end, got = at + len(text), {}
        while at < end:
            cut = min(at + MOST, end)
            i = bisect_left(strict, at + LEAST, i)
            if i < n_strict and strict[i] < min(at + WANTED, cut):
                cut = strict[i]
            else:
                j = bisect_left(loose, at + WANTED, j)
                if j < n_loose and loose[j] < cut:
                    cut = loose[j]
            piece = joined[at:cut]
            got[xxhash.xxh64_intdigest(piece)] = cut - at
            at = cut
        out.append(got)
    return out


def fingerprint_text(chunks: dict[int, int]) -> str:
    return ",".join([f"{d:016x}:{n}" for d, n in sorted(chunks.items())])


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of the length of ``a`` in chunks that ``b`` has too."""
    whole = sum(a.values())
    if not whole:
        return 0.0 if b else 1.0
    return sum([n for d, n in a.items() if d in b]) / whole


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` and ``n_chunks``."""
    def run(texts):
        sets = chunk_sets(texts)
        return {"fingerprint": [fingerprint_text(s) for s in sets],
                "n_chunks": [len(s) for s in sets]}

    return annotate(docs, text, lambda: run, {"fingerprint": "string", "n_chunks": "long"})


# ------------------------------------------------------------ neighbours in id order
def _bounds(docs: DataFrame, key: str) -> list[int]:
    """Ids at which blocks of the descending order start, largest first; ids of the table."""
    n = docs.count()
    blocks = min(MOST_BLOCKS, max(1, -(-n // BLOCK_ROWS)))
    marks = [i / blocks for i in range(1, blocks + 1)]
    got = docs.agg(F.percentile_approx(key, marks, max(10_000, 10 * blocks)).alias("b"),
                   F.max(key).alias("m")).first()
    return sorted({*(got["b"] or []), *([got["m"]] if got["m"] is not None else [])},
                  reverse=True)


def with_next(docs: DataFrame, key: str, text: str, bounds: list[int]) -> DataFrame:
    """Rows dealt to blocks of neighbours: (block, ahead, key, text).

    Block i holds the ids from bound i down to above bound i + 1, null ids the
    last.  The rows at a bound also go to the block before (the first ones to
    the last block), marked ``ahead``, so each block has what follows it.
    """
    up = np.array(bounds[::-1], np.int64)
    n = max(1, len(bounds))

    @F.pandas_udf("array<long>")
    def blocks(ids: pd.Series) -> pd.Series:
        out = []
        for x in ids.array:
            if x is None or pd.isna(x):
                # a table of null ids only is its own neighbour
                out.append([n - 1] if len(up) else [0, -1])
                continue
            at = int(np.searchsorted(up, int(x)))              # first bound >= id
            own = n - 1 - at
            out.append([own, -1 - (own - 1) % n] if up[at] == int(x) else [own])
        return pd.Series(out)

    return (docs.select(F.col(f"`{key}`").cast("long").alias("k"),
                        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
            .withColumn("b", F.explode(blocks(F.col("k"))))
            .select(F.when(F.col("b") >= 0, F.col("b")).otherwise(-1 - F.col("b")).alias("block"),
                    (F.col("b") < 0).alias("ahead"), "k", "t"))


def edited_text(text: str, following: str) -> str:
    """The last half (rounded down) of ``text`` replaced by as much of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
          "edited_fingerprint string, near_edited double, near_next double")
NAMES = [f.split()[0] for f in RESULT.split(", ")]


def compare_neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document against its edited text and against the next document in
    descending ``key`` (equal keys by text, null keys last; after the last, the first)."""
    dealt = (with_next(docs, key, text, _bounds(docs.select(F.col(f"`{key}`").alias("k")), "k"))
             .repartition("block")
             .sortWithinPartitions("block", "ahead", F.col("k").desc_nulls_last(), "t"))

    def finish(pairs):
        """pairs: (id, text, following text, chunks, chunks of the following text)."""
        edits = [edited_text(t, nt).encode() for _, t, nt, _, _ in pairs]
        cols = [[] for _ in NAMES]
        for (k, t, _, own, following), edit, changed in zip(pairs, edits, chunk_sets(edits)):
            for col, value in zip(cols, (k, len(t), hashlib.sha256(edit).hexdigest(),
                                         fingerprint_text(own), fingerprint_text(changed),
                                         likeness(own, changed), likeness(own, following))):
                col.append(value)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(),
                 pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], NAMES)

    def run(batches):
        last = None                     # (block, id, text, chunks) of the row still open
        for batch in batches:
            for part in slices(batch, 3):
                texts = part.column(3).to_pylist()
                sets = chunk_sets([t.encode() for t in texts])
                pairs = []
                for block, ahead, k, t, chunks in zip(
                        part.column(0).to_pylist(), part.column(1).to_pylist(),
                        part.column(2).to_pylist(), texts, sets):
                    if last is not None and last[0] == block:
                        pairs.append((last[1], last[2], t, last[3], chunks))
                    last = None if ahead else (block, k, t, chunks)
                if pairs:
                    yield finish(pairs)

    return dealt.mapInArrow(run, RESULT)
