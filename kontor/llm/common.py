"""Helpers shared by the operators: row annotation over Arrow, staged tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kontor.plans.lineage import checkpoint_dir

ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
         "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
SPARK = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(),
         "string": T.StringType(), "binary": T.BinaryType(), "boolean": T.BooleanType(),
         "array<long>": T.ArrayType(T.LongType())}

# Bytes of text handed to one call of an annotating function.  A single longer
# text is one call of its own; nothing is cut.
SLICE_BYTES = 4 << 20

# ASCII letters to lower case, every other byte as it is (for bytes.translate).
ASCII_WORD_BYTES = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, by: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch where the texts of column ``by`` reach ``limit`` bytes."""
    sizes = pa.compute.binary_length(batch.column(by)).fill_null(0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def annotate(df: DataFrame, text: str, make: Callable[[], Callable], fields: dict[str, str],
             keep_where: str | None = None) -> DataFrame:
    """Every row of ``df`` with the columns ``fields`` (name -> type) added.

    ``make()`` is called once per task and gives a function from a list of
    texts (UTF-8 bytes, null as empty) to a dict of columns.  A column of
    ``df`` with the name of a new one is replaced.  ``keep_where`` names a
    boolean result; rows where it is false go.
    """
    new = {n.lower() for n in fields}
    kept = [c for c in df.columns if c.lower() not in new]
    schema = T.StructType([df.schema[c] for c in kept]
                          + [T.StructField(n, SPARK[t]) for n, t in fields.items()])
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text"))
    n_kept = len(kept)

    def run(batches):
        fn = make()
        for batch in batches:
            for part in slices(batch, n_kept):
                got = fn(text_bytes(part.column(n_kept)))
                arrays = [part.column(i) for i in range(n_kept)]
                arrays += [pa.array(got[n], ARROW[t]) for n, t in fields.items()]
                out = pa.RecordBatch.from_arrays(arrays, [*kept, *fields])
                yield out.filter(pa.array(got[keep_where], pa.bool_())) if keep_where else out

    return source.mapInArrow(run, schema)


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z, nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or plain path, usable in tasks."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path)


def remove(path: str) -> None:
    """Delete a staged folder that no later step reads."""
    try:
        fs, p = open_fs(path)
        fs.delete_dir(p)
    except (OSError, pa.ArrowInvalid):
        pass   # only scratch space; the folder's owner clears it with the rest


class Staged:
    """Tables written between the steps of one operator, in the shared folder.

    A written table freezes its rows and survives lost executors.
    ``drop(df)`` deletes one as soon as nothing reads it any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def write(self, df: DataFrame, step: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.name}-{step}")
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if (found := self.paths.pop(id(t), None)) is not None:
                remove(found[1])


class WordHasher:
    """64-bit hashes of the words of many texts at once, in numpy.

    Bytes in ``separators`` part words; A-Z count as a-z.  A word's hash is a
    polynomial over its bytes (a random value per byte, odd base, modulo 2^64)
    taken from running sums, mixed with its length.  It does not depend on
    what stands around the word.
    """

    PIECE = 1 << 20          # bytes hashed in one pass; a piece ends between words

    LEAD = 5                 # bytes of a word's beginning

    def __init__(self, separators: bytes, leads: bool = False):
        self.leads = leads
        rng = np.random.default_rng(64)
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.value[65:91] = self.value[97:123]
        self.apart = np.zeros(256, bool)
        self.apart[list(separators)] = True
        self.base = 0x9E3779B97F4A7C15
        self.power = self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.power) < n:
            n = 1 << (n - 1).bit_length()
            steps = np.full(n - 1, self.base, np.uint64)
            self.power = np.concatenate([np.ones(1, np.uint64), np.cumprod(steps, dtype=np.uint64)])
            steps[:] = pow(self.base, -1, 1 << 64)
            self.inverse = np.concatenate([np.ones(1, np.uint64),
                                           np.cumprod(steps, dtype=np.uint64)])

    def _piece(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hashes, lengths, hashes of the first LEAD bytes, and starts of the words of one
        array of bytes."""
        self._reach(len(data) + 1)
        inside = np.concatenate([[False], ~self.apart[data], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
            self.value[data] * self.power[:len(data)], dtype=np.uint64)])
        length = ends - starts
        lead = (self._hash(sums, starts, np.minimum(length, self.LEAD)) if self.leads
                else np.empty(len(starts), np.uint64))
        return self._hash(sums, starts, length), length, lead, starts

    def _hash(self, sums: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
        h = (sums[starts + length] - sums[starts]) * self.inverse[starts]
        h ^= length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xFF51AFD7ED558CCD)):
            h ^= h >> np.uint64(shift)
            h *= np.uint64(factor)
        return h ^ (h >> np.uint64(32))

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        """One array of word hashes per text."""
        return [h for h, _, _ in self.parts(texts)]

    def parts(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Word hashes, lengths in bytes, and hashes of the first bytes, per text."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held: list[bytes] = []
        size = 0

        def flush():
            nonlocal held, size
            if held:
                gap = bytes([int(np.flatnonzero(self.apart)[0])])
                data = np.frombuffer(gap.join(held), np.uint8)
                *columns, starts = self._piece(data)
                begins = np.cumsum([0, *[len(t) + 1 for t in held[:-1]]])
                cut = np.searchsorted(starts, begins[1:])
                out.extend(zip(*[np.split(c, cut) for c in columns]))
            held, size = [], 0

        for t in texts:
            if size + len(t) > self.PIECE:
                flush()
            if len(t) > self.PIECE:
                out.append(self._long(np.frombuffer(t, np.uint8)))
            else:
                held.append(t)
                size += len(t) + 1
        flush()
        return out

    def _long(self, data: np.ndarray) -> tuple[np.ndarray, ...]:
        """A text beyond one piece: cut at separators (a longer word stays whole)."""
        cuts = np.flatnonzero(self.apart[data])
        parts, at = [], 0
        while at < len(data):
            i = int(np.searchsorted(cuts, at + self.PIECE, "right")) - 1
            if i < 0 or cuts[i] <= at:
                i += 1                              # the first separator behind the word
            end = int(cuts[i]) + 1 if i < len(cuts) else len(data)
            if len(data) - at <= self.PIECE:
                end = len(data)
            parts.append(self._piece(data[at:end])[:3])
            at = end
        return tuple(np.concatenate(x) for x in zip(*parts))
