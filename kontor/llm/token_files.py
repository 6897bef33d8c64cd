"""Token-id files: independent zstandard frames with a trailing seek table.

A file holds the ids of its documents, one after the other, as little-endian
unsigned 32-bit integers, cut every ``FRAME_IDS`` ids into zstandard frames
that decompress on their own.  Behind them stand two skippable frames, so that
any zstandard tool can read the file:

* the document table (compressed): ids and token counts of the documents;
* the seek table of the public seekable format: compressed size, size and
  checksum (low half of XXH64 of the content) of every frame, then the number
  of frames, a descriptor byte and the closing magic number.

A reader takes the tables from the end of the file and decompresses only the
frames that hold the requested documents, checking each frame's checksum.

Nulls: a null text is empty; every document has at least its end id.  Null
document ids come first and are kept as null.  Rows with equal ids follow each
other by text.  A document of any length may span frames.  An empty table
gives no files and no rows.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kontor.llm.common import Staged, open_fs, scratch_path, slices

FRAME_IDS = 1 << 16
LEVEL = 3

# Fixed values of the public formats.
DOCUMENTS_MAGIC, SEEK_MAGIC, END_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80                     # descriptor: entries carry checksums
ENTRY, FOOTER, HEAD = struct.Struct("<III"), struct.Struct("<IBI"), struct.Struct("<II")


class TokenFileWriter:
    def __init__(self, stream):
        self.stream, self.frames = stream, []
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)
        self.pending = bytearray()
        self.ids, self.missing, self.counts = [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """One document: its ids as little-endian 32-bit integers."""
        self.ids.append(doc_id or 0)
        self.missing.append(doc_id is None)
        self.counts.append(len(ids) // 4)
        self.pending += ids
        while len(self.pending) >= 4 * FRAME_IDS:
            self._frame(bytes(self.pending[:4 * FRAME_IDS]))
            del self.pending[:4 * FRAME_IDS]

    def _frame(self, raw: bytes) -> None:
        packed = self.zstd.compress(raw)
        self.stream.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.pending:
            self._frame(bytes(self.pending))
        table = self.zstd.compress(
            struct.pack("<Q", len(self.ids)) + np.array(self.ids, "<i8").tobytes()
            + np.array(self.counts, "<u8").tobytes() + np.packbits(self.missing).tobytes())
        self.stream.write(HEAD.pack(DOCUMENTS_MAGIC, len(table)) + table)
        # the table is a frame of the file too, without content for the seekable format
        entries = b"".join(ENTRY.pack(*f) for f in
                           [*self.frames, (HEAD.size + len(table), 0,
                                           xxhash.xxh64_intdigest(table) & 0xFFFFFFFF)])
        self.stream.write(HEAD.pack(SEEK_MAGIC, len(entries) + FOOTER.size) + entries
                          + FOOTER.pack(len(self.frames) + 1, CHECKSUMS, END_MAGIC))


class TokenFileReader:
    """Random access to the documents of one file."""

    def __init__(self, file, size: int):
        self.file, self.zstd = file, zstandard.ZstdDecompressor()
        n, flags, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != END_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        start = size - FOOTER.size - n * ENTRY.size
        raw = self._at(start, n * ENTRY.size)
        entries = np.frombuffer(raw, "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.raw_sizes, self.sums = entries[:-1].T
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.raw_offsets = np.concatenate([[0], np.cumsum(self.raw_sizes)])
        table = self._at(int(self.offsets[-1]) + HEAD.size, int(entries[-1, 0]) - HEAD.size)
        if xxhash.xxh64_intdigest(table) & 0xFFFFFFFF != entries[-1, 2]:
            raise ValueError("checksum of the document table differs")
        table = self.zstd.decompress(table)
        count, = struct.unpack_from("<Q", table)
        self.doc_ids = np.frombuffer(table, "<i8", count, 8)
        self.counts = np.frombuffer(table, "<u8", count, 8 + 8 * count).astype(np.int64)
        self.missing = np.unpackbits(np.frombuffer(table, np.uint8, -1, 8 + 16 * count),
                                     count=count).astype(bool)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.frame_no, self.frame_raw = -1, b""

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def frame(self, i: int) -> bytes:
        if i != self.frame_no:
            raw = self.zstd.decompress(self._at(int(self.offsets[i]), int(self.sizes[i])),
                                       max_output_size=int(self.raw_sizes[i]))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[i]:
                raise ValueError(f"checksum of frame {i} differs")
            self.frame_no, self.frame_raw = i, raw
        return self.frame_raw

    def parts(self, doc: int):
        """The bytes of document number ``doc``, frame by frame."""
        at, end = 4 * int(self.starts[doc]), 4 * int(self.starts[doc + 1])
        i = int(np.searchsorted(self.raw_offsets, at, "right")) - 1
        while at < end:
            base = int(self.raw_offsets[i])
            yield self.frame(i)[at - base:end - base]
            i += 1
            at = int(self.raw_offsets[i])

    def read(self, doc: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.parts(doc)), "<u4")


# ------------------------------------------------------------ tokenizing
_INSIDE_SPACE = re.compile(r"\s (?:\s|\Z)")
_MARKS = frozenset(".,;:!?")


def byte_letters() -> dict[int, str]:
    """The characters that byte-level tokenizers use for bytes: printable ones stand for
    themselves, the others for the characters from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts, through the tokenizers library, with a cache of pieces.

    A byte-level tokenizer that cuts words with their leading space never joins
    what stands before a space with what follows, unless the space is inside
    (or at the end of) a run of white space.  So a text is encoded piece by
    piece, from space to space, and pieces seen before come from a bounded
    cache.  Texts where a space stands inside such a run, or that hold a special
    token's string, are encoded as one piece.
    """

    def __init__(self, path: str, remember: int = 350_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = str.maketrans(byte_letters())
        self.remember = remember
        self.plain: dict[str, bytes] = {}       # pieces without a leading space
        self.spaced: dict[str, bytes] = {}      # pieces with one, which the key leaves out
        self.old_plain: dict[str, bytes] = {}
        self.old_spaced: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str, space: bool) -> bytes:
        """Ids of a piece: known, put together from smaller pieces, or encoded."""
        cache, old = (self.spaced, self.old_spaced) if space else (self.plain, self.old_plain)
        got = cache.get(piece)
        if got is not None:
            return got
        got = old.get(piece)
        if got is None:
            if piece.isalpha() and max(piece) < "\u0250":
                # Latin letters are one word to the tokenizer: straight to its model
                word = (" " + piece if space else piece).encode().decode("latin-1")
                got = array("I", [t.id for t in self.tokenizer.model.tokenize(
                    word.translate(self.letters))]).tobytes()
            elif "\n" in piece:
                # a line break between two words is a token of its own
                a, _, b = piece.partition("\n")
                if a and b and not a[-1].isspace() and not b[0].isspace():
                    got = self._piece(a, space) + self._piece("\n", False) + self._piece(b, False)
            elif piece[-1:] in _MARKS and piece[:-1].isalpha() and max(piece) < "\u0250":
                # so is a closing mark behind letters
                got = self._piece(piece[:-1], space) + self._piece(piece[-1], False)
            if got is None:
                got = self._whole(" " + piece if space else piece)
        if len(piece) < 64:
            cache[piece] = got
        return got

    def _text(self, text: str) -> bytes:
        if _INSIDE_SPACE.search(text) or any([s in text for s in self.special]):
            return self._whole(text)
        parts = text.split(" ")
        got = list(map(self.spaced.get, parts))
        got[0] = self._piece(parts[0], False)
        if None in got:
            got = [self._piece(p, True) if g is None else g for p, g in zip(parts, got)]
        return b"".join(got)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            out.append(self._text(t))
            if len(self.spaced) + len(self.plain) > self.remember:    # the older ones go
                self.old_plain, self.old_spaced = self.plain, self.spaced
                self.plain, self.spaced = {}, {}
        return out


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The worker's encoder; its cache serves all tasks that the worker runs."""
    return Encoder(path)


# ------------------------------------------------------------ Spark jobs
def write_token_files(docs: DataFrame, folder: str, vocabulary: str, key: str = "doc_id",
                      text: str = "text", end_id: int = 0) -> DataFrame:
    """Encode all texts and write them to ``folder`` in ascending order of ``key``.

    Gives the list of files (written to the shared folder): file, part (their
    order), docs, tokens.  The rows are range-partitioned, every task writes one
    file under a name of its own, and only files of tasks that finished are
    listed, so a repeated task does no harm.
    """
    def run(batches):
        part = TaskContext.get().partitionId()
        encode = encoder(vocabulary)
        end = struct.pack("<I", end_id)
        path, writer, stream, total = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok", None, None, 0
        for batch in batches:
            for rows in slices(batch, 1):
                if writer is None:
                    fs, inner = open_fs(path)
                    fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                    stream = fs.open_output_stream(inner)
                    writer = TokenFileWriter(stream)
                texts = [t or "" for t in rows.column(1).to_pylist()]
                for doc_id, ids in zip(rows.column(0).to_pylist(), encode(texts)):
                    writer.add(doc_id, ids + end)
                    total += len(ids) // 4 + 1
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({
                "part": [part], "file": [path], "docs": [len(writer.counts)], "tokens": [total]})

    ordered = (docs.select(F.col(f"`{key}`").cast("long").alias("k"),
                           F.col(f"`{text}`").alias("t"))
               .repartitionByRange("k").sortWithinPartitions("k", "t"))
    files = ordered.mapInArrow(run, "part long, file string, docs long, tokens long")
    return Staged(docs.sparkSession, "token-files").write(files, "list")


def scan_token_files(files: DataFrame) -> DataFrame:
    """Read whole files back: doc_id, start (ids of all documents before, over all
    files), n_tokens, ids_crc32, file, doc_no (number in its file)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # a row a file
    listed = (files.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
              .repartitionByRange(max(1, min(files.count(), 10_000)), "part"))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                fs, inner = open_fs(row["file"])
                with fs.open_input_file(inner) as f:
                    reader = TokenFileReader(f, f.size())
                    n = len(reader.counts)
                    crc = np.zeros(n, np.int64)
                    for i in range(n):
                        c = 0
                        for part in reader.parts(i):
                            c = zlib.crc32(part, c)
                        crc[i] = c
                    yield pa.RecordBatch.from_arrays([
                        pa.array(reader.doc_ids, pa.int64(), mask=reader.missing),
                        pa.array(row["first"] + reader.starts[:-1], pa.int64()),
                        pa.array(reader.counts, pa.int64()), pa.array(crc, pa.int64()),
                        pa.array([row["file"]] * n, pa.string()),
                        pa.array(np.arange(n), pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "file", "doc_no"])

    return listed.select("part", "file", "first").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string, doc_no long")


def read_documents(wanted: DataFrame) -> DataFrame:
    """Ids of single documents: ``wanted`` has file and doc_no; adds doc_id and ids.
    Only the frames that hold them are read."""
    def run(batches):
        for batch in batches:
            rows = sorted(batch.to_pylist(), key=lambda r: (r["file"], r["doc_no"]))
            file = reader = stream = None
            for r in rows:
                if r["file"] != file:
                    fs, inner = open_fs(file := r["file"])
                    stream = fs.open_input_file(inner)
                    reader = TokenFileReader(stream, stream.size())
                i = r["doc_no"]
                yield pa.RecordBatch.from_pydict(
                    {"file": [file], "doc_no": [i],
                     "doc_id": [None if reader.missing[i] else int(reader.doc_ids[i])],
                     "ids": [reader.read(i).astype(np.int64).tolist()]},
                    schema=pa.schema([("file", pa.string()), ("doc_no", pa.int64()),
                                      ("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    return wanted.select("file", "doc_no").repartition("file").mapInArrow(
        run, "file string, doc_no long, doc_id long, ids array<long>")


def token_digest(docs: DataFrame, vocabulary: str, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """Write all documents to a fresh folder in the shared folder and read the files back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    files = write_token_files(docs, folder, vocabulary, key, text)
    return scan_token_files(files).select("doc_id", "start", "n_tokens", "ids_crc32")
