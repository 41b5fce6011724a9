"""A corpus pipeline of five of the training-data operators: toxicity, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each and reads it again for the next.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timberline.llm import bpe, exact_dedup, jaccard_join, mixing, toxicity
from timberline.llm.common import table, written
from timberline.llm.queries import vocabulary

#: Shares of the tokens that the labelled domains get once toxic documents are gone.
TARGETS = {"good": 0.9, "poor": 0.1}


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal without white space, the longest stays."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each component of texts that share 0.8 of their five-word n-grams stays."""
    return jaccard_join.keep_one(docs, k=5, num=80, den=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of domains that are short of their target are repeated; each stays once at least."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), TARGETS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.encode_decode(docs, vocabulary(), keep_ids=True)


STAGES = [("toxicity", reject_toxic), ("exact_dedup", drop_copies), ("ngram_jaccard_join", drop_near_copies), ("soft_mixing", mix), ("bpe", encode)]

#: The classifiers and the encoding have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
