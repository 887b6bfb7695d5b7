"""A corpus pipeline: each stage works on all that the stage before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auditlens.llm import decontaminate, quality_rules, simhash_dedup, source_mixing, token_files
from auditlens.llm.queries import END_ID, TOKENIZER
from auditlens.llm.tables import documents, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.kept_documents(docs, quality_rules.trusted_ids(documents(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontaminate.clean_documents(docs, documents(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source are repeated or left out until the source has its target of words."""
    return source_mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token files, and what is read back from them."""
    return token_files.round_trip(docs, TOKENIZER, END_ID)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("simhash_dedup", near_duplicates),
    ("decontaminate", decontamination),
    ("source_mixing", mixing),
    ("token_files", tokens),
]

#: The stages use trained weights, a tokenizer and iterations that SQL cannot express; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
