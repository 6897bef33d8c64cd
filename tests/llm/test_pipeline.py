"""Every stage of the pipeline on its own input, and the whole run."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from kontor.llm import secrets as S
from tests.conftest import SMALL
from tests.llm.test_ngram_join import brute as all_pairs
from tests.llm.test_packing import check as check_bins
from tests.llm.test_secrets import brute as secret_spans

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def odd(spark):
    return spark.createDataFrame(
        [(1, None, None, None, None, "e"), (None, "", "en", "a", 0, "e"),
         (2, "a b c d e f g", "en", "a", 13, "e"), (2, "a b c d e f g", "en", "a", 13, "e"),
         (3, "long text " * 30_000, "en", "b", 300_000, "e"), (4, "token=abcdef1", "xx", "a", 13, "e")],
        "doc_id long, text string, lang string, source string, n_chars long, row string")


def test_stages_keep_columns_and_take_odd_rows(spark):
    for df in (odd(spark), odd(spark).limit(0)):
        for name, stage in C.STAGES:
            got = stage(spark, df, SMALL)
            n = got.count()
            if name != "packing":
                assert got.columns == df.columns, name
                assert n <= 3 * df.count()


def test_toxic_documents_go_and_clean_ones_stay(spark, docs):
    big = "/root/testdata/sf0.1"
    whole = spark.read.parquet(f"{big}/documents.parquet")
    kept = {r["doc_id"] for r in C.drop_toxic(spark, whole, big).select("doc_id").collect()}
    truth = spark.read.parquet(f"{big}/labels.parquet").collect()
    toxic = [r["doc_id"] not in kept for r in truth if r["toxic"]]
    clean = [r["doc_id"] in kept for r in truth if not r["toxic"]]
    assert sum(toxic) > 0.9 * len(toxic) and sum(clean) > 0.97 * len(clean)


def test_one_document_of_each_group_stays(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = {r["doc_id"] for r in C.drop_near_duplicates(spark, docs, SMALL).collect()}
    groups: dict = {}
    for i, n, c in all_pairs(rows, 5, 80, 100):
        groups.setdefault(c, []).append(i)
    assert all(len(kept & set(g)) == 1 for g in groups.values())


def test_secrets_are_masked_and_all_documents_stay(spark, docs):
    before = {r["doc_id"]: r for r in docs.collect()}
    after = {r["doc_id"]: r for r in C.mask_secrets(spark, docs, SMALL).collect()}
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert secret_spans(r["text"]) == "" and r["n_chars"] == len(r["text"])
        if not secret_spans(before[i]["text"]) and r["text"] != before[i]["text"]:
            assert "[secret]" in r["text"]


def test_mix_and_packing(spark, docs):
    mixed = C.mix_sources(spark, docs, SMALL)
    assert mixed.columns == COLUMNS
    words = sum(len(r["text"].split()) for r in mixed.collect())
    total = sum(len(r["text"].split()) for r in docs.collect())
    assert total <= words < total + 30_000
    rows = C.pack_bins(spark, docs, SMALL).collect()
    from kontor.llm.packing import CAPACITY, PER_SOURCE
    check_bins(rows, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()],
               CAPACITY, PER_SOURCE)


def test_whole_run(spark):
    got = C.run(spark, SMALL)
    assert got.columns == ["doc_id", "piece", "first_word", "words", "bin", "place"]
    worst = got.groupBy("bin").agg(F.sum("words").alias("w")).agg(F.max("w")).first()[0]
    assert 0 < worst <= 2048


def test_grammar_of_redaction_is_reused(spark):
    random.seed(1)
    g = S.fit({}, [])
    df = odd(spark)
    assert S.redact_secrets(df, grammar=g).filter(F.col("text").contains("[secret]")).count() == 1
