"""Corpus pipeline: toxicity, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows to the shared folder and reads them again for the next one.
All stages but the last return the columns of ``documents``.

Null and empty texts score as texts without words, link with nothing, hold no secrets and
are never taken by the mix; null sources and languages are values of their own, and of rows
without an id none is learned from.  Of linked documents the first row written stays, so of
exact copies and repeated rows one.  Columns beyond those of ``documents`` pass every stage
but the last.  An empty table gives empty stages.

ORACLE_SQL is None: a trained model, inferred automata and best-fit packing are
not SQL; tests compare every stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontor.llm import mixing, ngram_join, packing, secrets, toxicity
from kontor.llm.common import Staged
from kontor.sources.tables import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below their language's threshold; the model learns from the
    labelled ones among ``docs``."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles with Jaccard 0.8 or more."""
    return ngram_join.keep_one(docs, k=5, num=80, den=100)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark."""
    masked = secrets.redact_secrets(docs)
    return masked.withColumn("n_chars", F.when(
        F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the weighted mix, repeated as often as it takes them."""
    return mixing.mixed_documents(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in bins of 2,048 words; copies of one text never share a bin."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from the table ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    staged, before = Staged(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = staged.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            staged.drop(before)
        before = docs
    return docs
