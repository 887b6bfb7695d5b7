"""Scan history per project: list, trend and latest score.

History rows are (project, scan_id, scanned_at, passing, total); scan_id breaks
ties between scans of one moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.operators.ordering import with_previous
from auditlens.sources.commits import CommittedTable

HISTORY_SCHEMA = "project string, scan_id long, scanned_at timestamp_ntz, passing int, total int"


def score_text() -> Column:
    return F.concat_ws("/", F.col("passing"), F.col("total"))


def ratio() -> Column:
    return F.round(F.col("passing").cast("double") / F.nullif(F.col("total"), F.lit(0)), 4)


def history_list(history: DataFrame, limit: int | None = None) -> DataFrame:
    """Scans, newest first; all of them unless a limit is given."""
    rows = history.select("project", "scan_id", "scanned_at", score_text().alias("score"), ratio().alias("score_ratio"))
    ordered = rows.orderBy(F.col("scanned_at").desc(), F.col("scan_id").desc())
    return ordered if limit is None else ordered.limit(limit)


def history_trend(history: DataFrame) -> DataFrame:
    """Each scan against the project's scan before it: delta and direction."""
    rows = history.select("project", "scan_id", "scanned_at", ratio().alias("score_ratio"))
    linked = with_previous(rows, "project", ["scanned_at", "scan_id"], {"previous_ratio": "score_ratio"})
    delta = F.round(F.col("score_ratio") - F.col("previous_ratio"), 4)
    return linked.select(
        "project",
        "scan_id",
        "scanned_at",
        "score_ratio",
        "previous_ratio",
        delta.alias("delta"),
        F.when(~F.col("has_previous"), "first")
        .when(delta > 0, "improving")
        .when(delta < 0, "declining")
        .otherwise("stable")
        .alias("direction"),
    )


def history_score(history: DataFrame) -> DataFrame:
    """The latest scan of every project."""
    newest = F.struct("scanned_at", "scan_id")
    last = history.groupBy("project").agg(
        F.max_by(F.struct("scan_id", "scanned_at", "passing", "total"), newest).alias("last"),
        F.count(F.lit(1)).alias("scans"),
    )
    return last.select("project", "last.*", "scans").select(
        "project", "scan_id", "scanned_at", score_text().alias("score"), ratio().alias("score_ratio"), "scans"
    )


def history_rows(scanned: DataFrame, project: str, scan_id: Column, scanned_at: Column) -> DataFrame:
    """Scan results as rows to append to the history."""
    return scanned.select(
        F.col(project).alias("project"),
        scan_id.alias("scan_id"),
        scanned_at.alias("scanned_at"),
        "passing",
        F.col("total_checks").alias("total"),
    )


def append_history(rows: DataFrame, root: str) -> int:
    """Append scans in one commit and return its version; writers at the same time lose nothing."""
    return CommittedTable(rows.sparkSession, root).append(rows.select("project", "scan_id", "scanned_at", "passing", "total"))


def read_history(spark: SparkSession, root: str, as_of: int | None = None, schema=HISTORY_SCHEMA) -> DataFrame:
    """The history, or what it was at a version."""
    return CommittedTable(spark, root).read(schema, as_of)


def compliance_history(history: DataFrame, action: str = "list") -> DataFrame:
    """`trend`, `score`, or the list of scans for any other action."""
    views = {"trend": history_trend, "score": history_score}
    return views.get(action.lower(), history_list)(history)
