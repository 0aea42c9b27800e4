"""Corpus pipeline over ``documents``: toxic texts go, then exact copies, near copies and contaminated texts; what is
kept is tokenised.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. ``run`` writes each stage to the shared folder and reads it again, so a lost executor costs one stage at
most. A document with a null id counts as a document of its own; a null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolift.llm import bpe, decontaminate, exact_dedup, ngram_join, queries, toxicity
from promolift.llm.common import drop_paths, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under the threshold."""
    return toxicity.without_toxic(queries.toxicity_model(spark, sf_dir), docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by near-copy links the one with the smallest id."""
    return ngram_join.keep_least(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, as the query of the operator returns them."""
    return bpe.round_trip(docs, queries.vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe", tokenise),
]

#: The first stage is a learned classifier and the last one a tokeniser, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, paths = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs, path = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_paths(spark, paths)
        paths = [path]
    return docs
