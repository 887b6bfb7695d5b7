"""Agents, events and other tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from auditlens.session import dealt

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("agent_id", T.StringType()),
        T.StructField("action_type", T.StringType()),
        T.StructField("human_summary", T.StringType()),
        T.StructField("raw_action", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("risk_score", T.StringType()),
        T.StructField("tokens_used", T.LongType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("chain_hash", T.StringType()),
    ]
)


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """A table with source code or other long text, read in the splits that the session sets."""
    return dealt(spark.read.parquet(path))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event log.  The schema is given, so no file is opened to find it."""
    return spark.read.schema(EVENT_SCHEMA).parquet(path)


def read_agents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, name string, framework string, status string").parquet(path)
