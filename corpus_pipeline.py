"""The corpus pipeline: language ID, quality, near-duplicates, mixing, then tokens.

Each stage takes (spark, docs, sf_dir) and gets all that the stage before it kept. All but the last return
the columns of ``docs`` as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import langid, mixing, quality
from tidegrid.llm.bpe import encode_documents
from tidegrid.llm.common import new_path, read_table
from tidegrid.llm.nearcopies import keep_one_of_each_group
from tidegrid.llm.queries import byte_bpe_path

#: Only texts that have nothing in common with any profile are rejected, and those without a letter: how high clean texts score depends on the script.
LEAST_LANGUAGE_SCORE = 0.0


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; the profiles are learned from the stage's own input."""
    return langid.keep_identified(docs, langid.learn_from_documents(docs), LEAST_LANGUAGE_SCORE)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine predicts to be good, learned from the labelled ones of the stage's input."""
    return quality.keep_good(docs, quality.learn(docs, read_table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles of similarity 0.8 or more, found by SimHash fingerprints and Golay-code keys."""
    return keep_one_of_each_group(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, each document as often as it is taken; the rows of an output shard lie in pieces of its shuffled order."""
    return mixing.draw(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with their digests and that of the decoded text."""
    return encode_documents(docs, byte_bpe_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", dedup_stage),
    ("source_mixing", mixing_stage),
    ("bpe_encode_decode", token_stage),
]

#: SQL cannot express the learned stages; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
