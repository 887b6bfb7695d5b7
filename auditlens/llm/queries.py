"""The operators of this folder as named queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from auditlens.llm import (
    centroid_clusters,
    contextual_pii,
    decontaminate,
    license_scan,
    lm_scoring,
    merkle_manifest,
    quality_rules,
    secret_scan,
    simhash_dedup,
    source_mixing,
    substring_dedup,
    suffix_dedup,
    token_files,
)
from auditlens.llm.tables import documents

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def op1(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.dedup_windows(documents(spark, folder))


def op2(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, folder), documents(spark, folder, "benchmark"))


def op3(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan_licenses(documents(spark, folder))


def op4(spark: SparkSession, folder: str) -> DataFrame:
    mixed = source_mixing.mixing_copies(documents(spark, folder))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op5(spark: SparkSession, folder: str) -> DataFrame:
    trusted = quality_rules.trusted_ids(documents(spark, folder, "labels"))
    return quality_rules.quality_verdicts(documents(spark, folder), trusted)


def op6(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.simhash_groups(documents(spark, folder))


def op7(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.round_trip(documents(spark, folder), TOKENIZER, END_ID)


def op8(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.dedup_bytes(documents(spark, folder))


def op9(spark: SparkSession, folder: str) -> DataFrame:
    return contextual_pii.pii_digest(contextual_pii.find_pii(documents(spark, folder)))


def op10(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_digest(secret_scan.find_secrets(documents(spark, folder)))


def op11(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return merkle_manifest.manifest(docs, merkle_manifest.without_breaks(docs))


def op12(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score_texts(documents(spark, folder), lm_scoring.not_every_tenth())


def op13(spark: SparkSession, folder: str) -> DataFrame:
    return centroid_clusters.cluster_vectors(documents(spark, folder, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": op1,
    "op2_decontaminate": op2,
    "op3_license_scan": op3,
    "op4_source_mixing": op4,
    "op5_quality_rules": op5,
    "op6_simhash_dedup": op6,
    "op7_token_files": op7,
    "op8_suffix_dedup": op8,
    "op9_contextual_pii": op9,
    "op10_secret_scan": op10,
    "op11_merkle_manifest": op11,
    "op12_lm_scoring": op12,
    "op13_centroid_clusters": op13,
}
#: What SQL can express; the others are tested against brute force.
ORACLE: dict[str, str] = {"op3_license_scan": license_scan.oracle_sql()}
