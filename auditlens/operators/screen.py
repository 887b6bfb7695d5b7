"""Prompt-injection screening of free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.functions.rules import BLOCK_THRESHOLD, INJECTION_RULES
from auditlens.operators.findings import explode_in_order
from auditlens.operators.signals import code_text, prepare


def detected_patterns() -> Column:
    """Matched rules in rule order, as an array of (pattern, weight)."""
    hits = [
        F.when(rule.on(code_text()), F.struct(F.lit(name).alias("pattern"), F.lit(weight).alias("weight")))
        for name, weight, rule in INJECTION_RULES
    ]
    return F.array_compact(F.array(*hits))


def check_injection(df: DataFrame, text: str = "text") -> DataFrame:
    """Add detected_patterns, confidence, would_block, pattern_count and verdict.

    A projection of stateless columns: no shuffle, and the same on a stream.
    Null text gives null results.
    """
    known = F.col(text).isNotNull()
    found = prepare(df, text, bare=False).select(
        *df.columns, F.when(known, detected_patterns()).alias("detected_patterns")
    )
    weights = F.transform("detected_patterns", lambda p: p["weight"])
    scored = found.withColumn(
        "confidence", F.when(known, F.round(F.coalesce(F.array_max(weights), F.lit(0.0)), 2))
    )
    return scored.withColumns(
        {
            "would_block": F.col("confidence") >= BLOCK_THRESHOLD,
            "pattern_count": F.size("detected_patterns"),
            "verdict": F.when(F.col("confidence") >= BLOCK_THRESHOLD, "BLOCKED")
            .when(F.size("detected_patterns") > 0, "SUSPICIOUS")
            .when(known, "CLEAN"),
        }
    )


def injection_hits(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per matched rule: `ord` (from 0), `pattern`, `weight`."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    rows = explode_in_order(check_injection(df, text), keep, "detected_patterns", "hit")
    return rows.select(
        *keep, "ord", F.col("hit.pattern").alias("pattern"), F.col("hit.weight").alias("weight")
    )


def top_patterns(screened: DataFrame, keep: list[str], n: int = 3) -> DataFrame:
    """The first `n` matched rules of each row, in rule order."""
    return screened.select(*keep, F.slice("detected_patterns", 1, n).alias("top_patterns"))


def verdict_counts(screened: DataFrame, by: list[str]) -> DataFrame:
    """Verdict totals per group; a partial aggregate before the shuffle."""
    return screened.groupBy(*by).agg(
        *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("BLOCKED", "SUSPICIOUS", "CLEAN")],
        F.count(F.lit(1)).alias("messages"),
    )
