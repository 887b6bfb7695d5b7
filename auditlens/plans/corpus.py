"""The library's input tables, derived row by row from the given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.operators.agents import DISPLAY_TYPES
from auditlens.plans.samples import (
    ATTACKS,
    CODE,
    DIRECTORIES,
    FILE_NAMES,
    FRAMEWORK_REQUESTS,
    RISK_OVERRIDES,
    TOOLS,
)

from auditlens.sources.tables import read_text_table

ACTION_TYPES = (*DISPLAY_TYPES, "custom_step")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_text_table(spark, f"{folder}/{name}.parquet")


def pick(values: Sequence[str], index: Column) -> Column:
    """The value at `index` (from 0) of a constant list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values)).cast("int") + 1)


def code_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """project, path, code, doc_id: a code sample, then the whole document as text or as comments."""
    docs = text_table(spark, folder, "documents")
    as_comment = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n# ")))
    body = F.when(F.col("doc_id") % 2 == 1, F.col("text")).otherwise(as_comment)
    return docs.select(
        F.col("source").alias("project"),
        F.concat("source", F.lit("/pkg/f"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        F.concat(pick(CODE, F.col("doc_id")), F.lit("\n"), body).alias("code"),
        "doc_id",
    )


def path_list(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    names = [F.replace(F.lit(n), F.lit("{}"), F.col("doc_id").cast("string")) for n in FILE_NAMES]
    name = F.element_at(F.array(*names), (F.col("doc_id") % len(names)).cast("int") + 1)
    return docs.select(
        F.col("source").alias("project"),
        name.alias("name"),
        F.explode(F.array(*[F.lit(d) for d in DIRECTORIES])).alias("dir"),
    ).select("project", F.concat("dir", "name").alias("path"))


def messages(spark: SparkSession, folder: str) -> DataFrame:
    return attach_attacks(text_table(spark, folder, "conversations"))


def attach_attacks(conversations: DataFrame) -> DataFrame:
    attack = pick(ATTACKS, F.col("conv_id") * 7 + F.col("turn"))
    return conversations.select("conv_id", "turn", "role", F.concat("text", F.lit(" "), attack).alias("text"))


def tool_calls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_id").alias("call_id"),
        F.col("event_type").alias("action_type"),
        pick(TOOLS, F.col("event_id")).alias("tool_name"),
        pick(RISK_OVERRIDES, F.col("event_id")).alias("risk_override"),
    )


def agents(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer is an agent; those beyond the users of the event log have no events."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        F.concat(F.lit("agent-"), key.cast("string")).alias("id"),
        F.when(key % 5 != 0, F.concat(F.lit("Agent "), key.cast("string"))).alias("name"),
        F.when(key % 3 != 0, pick(FRAMEWORK_REQUESTS, key)).alias("framework"),
        F.when(key % 4 != 0, F.lit("active")).when(key % 8 == 0, F.lit("idle")).alias("status"),
    )


def agent_events(spark: SparkSession, folder: str, spread_out: bool = False) -> DataFrame:
    """The event log; `spread_out` for work that costs much per row, such as hashing."""
    return shape_events((text_table if spread_out else table)(spark, folder, "events"))


def shape_events(events: DataFrame) -> DataFrame:
    key = F.col("event_id")
    return events.select(
        key.alias("id"),
        F.concat(F.lit("agent-"), F.col("user_id").cast("string")).alias("agent_id"),
        pick(ACTION_TYPES, key).alias("action_type"),
        F.when(key % 3 == 0, F.concat(F.lit("did "), "event_type")).when(key % 3 == 1, F.lit("")).alias(
            "human_summary"
        ),
        F.when(key % 4 == 0, F.col("props")).when(key % 4 == 1, F.lit("")).alias("raw_action"),
        "ts",
        F.when(key % 6 != 0, pick(("low", "medium", "high"), key)).alias("risk_score"),
        F.when(key % 7 != 0, F.get_json_object("props", "$.k").cast("long")).alias("tokens_used"),
        F.when(key % 9 != 0, F.col("value")).alias("cost_usd"),
        F.when(key % 5 != 0, key * 37 % 5000).alias("duration_ms"),
        F.when(key % 10 != 0, F.sha2(key.cast("string"), 256)).alias("chain_hash"),
    )


def scan_history(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    total = (12 + key % 6).cast("int")
    return table(spark, folder, "orders").select(
        F.concat(F.lit("project-"), (F.col("o_custkey") % 20).cast("string")).alias("project"),
        key.alias("scan_id"),
        F.col("o_orderdate").alias("scanned_at"),
        (key * 7 % (total + 1)).cast("int").alias("passing"),
        total.alias("total"),
    )


def model_results(spark: SparkSession, folder: str) -> DataFrame:
    """A model analysis for the code of every labelled document, one per code hash."""
    labelled = code_corpus(spark, folder).join(table(spark, folder, "labels"), "doc_id")
    return labelled.groupBy(F.sha2("code", 256).alias("code_hash")).agg(
        F.max(
            F.concat(
                F.lit("quality "),
                F.coalesce(F.col("quality").cast("string"), F.lit("?")),
                F.lit(", toxic "),
                F.coalesce(F.col("toxic").cast("string"), F.lit("?")),
            )
        ).alias("analysis")
    )


def fix_requests(spark: SparkSession, folder: str) -> DataFrame:
    """One fix request per document; some ask for an article that is not covered."""
    key = F.col("doc_id")
    articles = F.array(*[F.lit(a) for a in (9, 10, 11, 12, 13, 14, 15)])
    return table(spark, folder, "documents").select(
        "doc_id",
        F.element_at(articles, (key % 7).cast("int") + 1).alias("article"),
        pick(FRAMEWORK_REQUESTS, key).alias("framework"),
    )
