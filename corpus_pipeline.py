"""A corpus pipeline over `documents`: keep good texts, one of each group of near copies and no
benchmark passages, replace personal data and encode the rest.

Each stage takes the rows that the stage before kept. Null ids and texts, empty tables and other
columns are handled as the operators say; all stages but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsflow.llm import bpe, common, decontaminate, nearcopies, pii, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.7; the model learns from the same folds as the query."""
    learned = F.col("doc_id").isNotNull() & (common.fold("doc_id", 4) != 2)
    model = quality.train(docs.filter(learned), common.table(spark, sf_dir, "labels").filter(learned))
    return quality.keep_good(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies: five-word shingles, similarity 0.8 or more."""
    return nearcopies.keep_first(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data and secrets; n_chars follows the text."""
    columns = docs.columns
    out = pii.pseudonymised(docs, pii.QUERY_KEY)
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of every document."""
    return bpe.digests(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("private", replace_private),
    ("encode", encode),
]

#: The first stage is a learned model, which SQL cannot express; the tests compare with plain code.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
