"""Trusted documents that the quality model has not seen are kept, whatever the size of the table."""

from __future__ import annotations

import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from auditlens.llm import quality_rules


@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_held_out_documents_are_kept(spark, size):
    folder = FOLDER.replace("0.001", size)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").repartition(8).cache()
    held = labels.where("doc_id % 5 = 2").select("doc_id", "quality")
    trusted = quality_rules.trusted_ids(labels.where("doc_id % 5 <> 2"))
    once = docs.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n = 1")
    judged = quality_rules.quality_verdicts(docs, trusted).join(held, "doc_id").where("not base_failed")
    judged = judged.join(once.select("doc_id"), "doc_id").collect()
    good = [r["kept"] for r in judged if r["quality"] == 1]
    poor = [r["kept"] for r in judged if r["quality"] == 0]
    print(size, len(good) - sum(good), "good rejected of", len(good), "and poor kept", sum(poor), "of", len(poor))
    assert sum(good) >= 0.95 * len(good) and sum(poor) <= 0.3 * len(poor)
