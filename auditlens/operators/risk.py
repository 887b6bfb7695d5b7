"""Risk levels of tool names, and the approval decision that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.functions.rules import RISK_ADVICE, RISK_KEYWORDS


def _first_match(tool: Column) -> Column:
    """(level, keyword) of the first keyword found; null when there is none."""
    name = F.lower(tool)
    tests = [
        F.when(
            name.contains(word), F.struct(F.lit(level).alias("level"), F.lit(word).alias("keyword"))
        )
        for level, words in RISK_KEYWORDS.items()
        for word in words
    ]
    return F.coalesce(*tests)


def advice(level: Column) -> Column:
    """Recommendation for a level; the map is constant, so no join is needed."""
    texts = F.create_map(*[F.lit(x) for pair in RISK_ADVICE.items() for x in pair])
    return F.element_at(texts, level)


def risk_recommendation(df: DataFrame, level: str = "risk_level") -> DataFrame:
    """Add `recommendation` for an existing level column."""
    return df.withColumn(
        "recommendation", F.when(F.col(level).isNotNull(), F.coalesce(advice(F.col(level)), F.lit("Review manually.")))
    )


def classify_risk(df: DataFrame, tool: str = "tool_name") -> DataFrame:
    """Add risk_level, matched_keyword and recommendation; no shuffle."""
    matched = df.withColumn("__risk", _first_match(F.col(tool)))
    known = F.col(tool).isNotNull()
    levelled = matched.select(
        *df.columns,
        F.when(known, F.coalesce(F.col("__risk.level"), F.lit("UNKNOWN"))).alias("risk_level"),
        F.col("__risk.keyword").alias("matched_keyword"),
    )
    return levelled.withColumn("recommendation", advice(F.col("risk_level")))


# What a level means for an action about to run.  These names and texts are this
# library's own; they follow the advice given per level.
DECISIONS: dict[str, tuple[str, str, str]] = {
    "CRITICAL": ("requires_approval", "ConsentGate:CRITICAL", "Obtain human approval before every execution"),
    "HIGH": ("requires_approval", "ConsentGate:HIGH", "Obtain human approval or enable strict audit logging"),
    "MEDIUM": ("allowed_with_logging", "AuditLedger", "Log the action with full context"),
    "LOW": ("allowed", "StandardLogging", "Standard logging is sufficient"),
    "UNKNOWN": ("manual_review", "ManualReview", "Review the tool and assign a risk level"),
}


def validate_actions(
    df: DataFrame, tool: str = "tool_name", override: str = "risk_override"
) -> DataFrame:
    """Add effective_risk, approval_status, required_policy and remediation.

    A non-empty override replaces the level found from the tool name; a level
    outside the known ones is sent to manual review.
    """
    classified = classify_risk(df, tool).withColumn(
        "effective_risk", F.coalesce(F.upper(F.nullif(F.trim(F.col(override)), F.lit(""))), F.col("risk_level"))
    )
    out = classified
    for i, name in enumerate(("approval_status", "required_policy", "remediation")):
        table = F.create_map(*[F.lit(x) for level, row in DECISIONS.items() for x in (level, row[i])])
        out = out.withColumn(
            name,
            F.when(
                F.col("effective_risk").isNotNull(),
                F.coalesce(F.element_at(table, F.col("effective_risk")), F.lit(DECISIONS["UNKNOWN"][i])),
            ),
        )
    return out.drop("recommendation")
