"""Token files against the tokenizer itself; random access, checksums, plain zstandard reading."""

import io
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from kontor.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "a", " a", "a ", "  a  b   c\n \nd", "x\t y \n", "ends \n ", "<|endoftext|> a b",
         "tab\tand\x0bvt \x0c\x1c \x1d x", "nbsp   x   y", "it's we'll\n\nDon't 12 345!",
         "été ñandú 你好 世界 🙂 🙂", "word " * 30_000, "same", "same"]


def plain(texts):
    tok = Tokenizer.from_file(PATH)
    return [tok.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def test_pieces_encode_as_the_whole_text():
    enc = T.Encoder(PATH, remember=5)
    for _ in range(2):
        got = enc([t or "" for t in TEXTS])
        assert [np.frombuffer(x, "<u4").tolist() + [0] for x in got] == plain(TEXTS)


def test_files_round_trip(spark, tmp_path):
    n = len(TEXTS)
    df = spark.createDataFrame([(n - i, t, 1) for i, t in enumerate(TEXTS)]
                               + [(None, "null id", 2)], "doc_id long, text string, start int")
    files = T.write_token_files(df, f"file://{tmp_path}", PATH)
    rows = sorted(T.scan_token_files(files).collect(), key=lambda r: r["start"])
    want = plain(["null id", *TEXTS[::-1]])
    assert [r["doc_id"] for r in rows] == [None, *range(1, n + 1)]
    assert [r["n_tokens"] for r in rows] == [len(x) for x in want]
    assert [r["start"] for r in rows] == np.cumsum([0, *[len(x) for x in want[:-1]]]).tolist()
    assert [r["ids_crc32"] for r in rows] == \
        [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]
    picked = [r for r in rows if r["doc_id"] in (1, 3, n)]
    some = T.read_documents(spark.createDataFrame(
        [(r["file"], r["doc_no"]) for r in picked], "file string, doc_no long")).collect()
    assert {r["doc_id"]: r["ids"] for r in some} == {i: want[i] for i in (1, 3, n)}


def test_reader_touches_only_needed_frames_and_checks_them():
    buf = io.BytesIO()
    w = T.TokenFileWriter(buf)
    docs = [np.full(n, i, "<u4") for i, n in enumerate((10, T.FRAME_IDS * 2 + 5, 3, 0, 70_000))]
    for i, d in enumerate(docs):
        w.add(i, d.tobytes())
    w.close()
    raw = buf.getvalue()
    reader = T.TokenFileReader(io.BytesIO(raw), len(raw))
    for i, d in enumerate(docs):
        assert reader.read(i).tolist() == d.tolist()
    seen = []
    inner = reader.frame
    reader.frame = lambda i: seen.append(i) or inner(i)
    reader.read(2)
    assert seen == [2]
    # any zstandard reader decompresses the file: the tables are skippable frames
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True)
    assert whole.read() == b"".join(d.tobytes() for d in docs)
    broken = bytearray(raw)
    broken[9] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        T.TokenFileReader(io.BytesIO(bytes(broken)), len(raw)).read(0)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.token_digest(df, PATH).count() == 0


def test_query(spark):
    from kontor.llm.queries import op2_token_files
    from tests.conftest import SMALL
    docs = sorted((r["doc_id"], r["text"]) for r in
                  spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    want = plain([t for _, t in docs])
    got = sorted(op2_token_files(spark, SMALL).collect())
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == \
        [(i, len(x)) for (i, _), x in zip(docs, want)]
    assert [r["ids_crc32"] for r in got] == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in want]
