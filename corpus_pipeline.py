"""Corpus pipeline: quality, near duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Its result is
written as Parquet and read again as the next stage's docs. All but the last return the columns of
``documents``; the last returns the token ids of each document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockwatch.llm import bpe, decontaminate, near, pii, quality
from blockwatch.llm.common import prepare, table, written


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant, fitted on the labelled ones, does not reject."""
    prepare(spark)
    model = quality.fit(quality.features(docs), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each class of near copies."""
    prepare(spark)
    return near.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    prepare(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each personal span replaced by the name of its kind; n_chars follows."""
    prepare(spark)
    return pii.redact(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of the decoded text."""
    prepare(spark)
    coded = bpe.encode(docs, bpe.vocabulary(), keep=["doc_id"])
    return coded.select("row.doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", keep_good_quality),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", drop_benchmark),
    ("pii", redact_personal),
    ("bpe", encode_texts),
]

#: SQL has neither the classifier nor the encoder: tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
