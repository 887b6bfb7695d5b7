"""The seventeen article checks: signal columns in, findings out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.functions.text import half_even_percent, percent
from auditlens.operators.signals import SIGNALS, frameworks_column, with_signals

FINDING_FIELDS = ("article", "name", "status", "severity", "evidence", "fix_hint")
# Articles and their short titles.
ARTICLES: dict[int, str] = {
    9: "Risk Management",
    10: "Data Governance",
    11: "Technical Documentation",
    12: "Record-Keeping",
    14: "Human Oversight",
    15: "Accuracy, Robustness & Cybersecurity",
}


def _finding(article: int, name: str, status: Column, severity: Column, evidence: Column, hint: str) -> Column:
    values = (F.lit(article), F.lit(name), status, severity, evidence, F.lit(hint))
    return F.struct(*[v.alias(f) for v, f in zip(values, FINDING_FIELDS, strict=True)])


def _present(
    article: int,
    name: str,
    ok: Column,
    severities: tuple[str, str],
    evidence: tuple[str, str],
    hint: str,
    miss: str = "warn",
) -> Column:
    """A check with two outcomes; severities and evidence are (found, missing)."""

    def pick(yes: str, no: str) -> Column:
        return F.when(ok, F.lit(yes)).otherwise(F.lit(no))

    return _finding(article, name, pick("pass", miss), pick(*severities), pick(*evidence), hint)


def finding_columns() -> dict[str, tuple[Column | None, Column]]:
    """Check name -> (condition for the row to exist, finding); in reporting order.

    Names, evidence and fix texts are fixed values.
    """
    s = F.col
    limits = s("limit_strong") | (
        s("ai_context") & F.when(s("tokens_unbounded"), s("limit_rate")).otherwise(s("limit_weak"))
    )
    tracing = s("trace_import") | (s("trace_usage") & s("ai_import"))
    doc_pct = percent(s("n_documented"), s("n_defs"))
    typed_pct = percent(s("n_typed"), s("n_functions"))
    defended = s("defence_strong") | s("defence_moderate")

    def coverage(part: str, whole: str, text: str) -> Column:
        return F.concat(
            s(part).cast("string"),
            F.lit("/"),
            s(whole).cast("string"),
            F.lit(text),
            half_even_percent(s(part), s(whole)),
            F.lit("%)"),
        )

    return {
        "art9_llm_errors": (
            s("llm_call") & s("ai_construct"),
            _present(
                9,
                "LLM call error handling",
                s("try_except"),
                ("LOW", "HIGH"),
                ("LLM calls wrapped in try/except", "LLM calls found without error handling"),
                "Wrap LLM API calls in try/except to handle failures gracefully",
                miss="fail",
            ),
        ),
        "art9_fallback": (
            None,
            _present(
                9,
                "Fallback/recovery patterns",
                s("fallback"),
                ("MEDIUM", "MEDIUM"),
                ("Fallback/retry patterns detected", "No fallback or retry patterns found"),
                "Add fallback logic for LLM failures (retry, default response, alternative model)",
            ),
        ),
        "art10_input_validation": (
            s("ai_context"),
            _present(
                10,
                "Input validation / schema enforcement",
                s("input_schema"),
                ("MEDIUM", "MEDIUM"),
                (
                    "Input validation detected (Pydantic/dataclass/TypedDict)",
                    "No structured input validation found",
                ),
                "Use Pydantic models or dataclasses to validate inputs before LLM calls",
            ),
        ),
        "art10_pii": (
            None,
            _present(
                10,
                "PII handling",
                s("pii"),
                ("LOW", "HIGH"),
                ("PII-aware patterns found", "No PII detection or masking patterns found"),
                "Add PII detection before sending data to LLM providers",
            ),
        ),
        "art11_docstrings": (
            s("n_defs") > 0,
            _finding(
                11,
                "Code documentation (docstrings)",
                F.when(doc_pct >= 60, "pass").when(doc_pct >= 30, "warn").otherwise("fail"),
                F.when(doc_pct < 30, "MEDIUM").otherwise("LOW"),
                coverage("n_documented", "n_defs", " public functions/classes have docstrings ("),
                "Add docstrings to public functions explaining purpose and parameters",
            ),
        ),
        "art11_type_hints": (
            s("n_functions") > 0,
            _finding(
                11,
                "Type annotations",
                F.when(typed_pct >= 50, "pass").when(typed_pct >= 20, "warn").otherwise("fail"),
                F.lit("LOW"),
                coverage("n_typed", "n_functions", " public functions have type hints ("),
                "Add type hints to function signatures",
            ),
        ),
        "art12_logging": (
            None,
            _finding(
                12,
                "Application logging",
                F.when(~s("log_import"), "fail").when(s("log_call"), "pass").otherwise("warn"),
                F.when(~s("log_import"), "HIGH").when(s("log_call"), "LOW").otherwise("MEDIUM"),
                F.when(~s("log_import"), "No logging framework found")
                .when(s("log_call"), "Logging framework imported and actively used")
                .otherwise("Logging imported but no log calls found - logging may be unused"),
                "Add import logging and log key decisions, errors, and LLM interactions",
            ),
        ),
        "art12_tracing": (
            None,
            _present(
                12,
                "Tracing / observability",
                tracing,
                ("MEDIUM", "MEDIUM"),
                (
                    "Tracing/observability integration found",
                    "No tracing or observability integration detected",
                ),
                "Add OpenTelemetry, LangSmith, or similar to track AI decisions",
            ),
        ),
        "art12_audit": (
            None,
            _present(
                12,
                "Agent action audit trail",
                s("audit"),
                ("MEDIUM", "MEDIUM"),
                ("Action-level audit logging found", "No action-level audit trail detected"),
                "Log every agent action with user_id, timestamp, action_type, and target",
            ),
        ),
        "art14_hitl": (
            None,
            _present(
                14,
                "Human-in-the-loop patterns",
                s("hitl"),
                ("LOW", "HIGH"),
                ("Human oversight patterns found", "No human approval gates detected"),
                "Add human approval gates for high-risk actions",
            ),
        ),
        "art14_limits": (
            None,
            _present(
                14,
                "Usage limits / budget controls",
                limits,
                ("MEDIUM", "MEDIUM"),
                ("Rate limiting or budget controls found", "No rate limiting or budget controls detected"),
                "Set max_tokens, max_iterations, or budget limits to prevent runaway agents",
            ),
        ),
        "art14_identity": (
            None,
            _present(
                14,
                "Agent-to-user identity binding",
                s("identity"),
                ("MEDIUM", "MEDIUM"),
                ("User identity binding found", "Agent actions not tied to authorizing user"),
                "Track user_id alongside every agent action",
            ),
        ),
        "art14_boundaries": (
            None,
            _present(
                14,
                "Agent action boundaries",
                s("boundary"),
                ("MEDIUM", "MEDIUM"),
                ("Action boundary controls found", "Agent has unrestricted tool access"),
                "Define allowed_tools or action boundaries to limit agent capabilities",
            ),
        ),
        "art15_injection_defense": (
            None,
            _finding(
                15,
                "Prompt injection defense",
                F.when(defended, "pass").otherwise("warn"),
                F.when(defended, "LOW").when(s("defence_weak"), "MEDIUM").otherwise("HIGH"),
                F.when(s("defence_strong"), "Injection defense library imported and instantiated")
                .when(s("defence_moderate"), "Custom injection defense implementation detected")
                .when(
                    s("defence_weak"),
                    "Security-related terms found in code but no active defense implementation",
                )
                .otherwise("No prompt injection defense detected"),
                "Add input sanitization or guardrails to detect prompt injection",
            ),
        ),
        "art15_output": (
            None,
            _present(
                15,
                "LLM output validation",
                s("output"),
                ("MEDIUM", "MEDIUM"),
                ("Output validation/parsing found", "No structured output validation detected"),
                "Use output parsers to validate LLM responses before acting on them",
            ),
        ),
        "art15_retry": (
            None,
            _present(
                15,
                "Retry / backoff logic",
                s("retry"),
                ("LOW", "LOW"),
                ("Retry/backoff patterns found", "No retry or backoff logic detected"),
                "Add retry with exponential backoff for LLM API calls",
            ),
        ),
        "art15_unsafe_input": (
            s("unsafe_input"),
            _finding(
                15,
                "Unsafe input handling",
                F.lit("warn"),
                F.lit("HIGH"),
                F.lit("Raw user input may be injected directly into prompts"),
                "Validate and sanitize user input before injecting into LLM prompts",
            ),
        ),
    }


# Which signals each check reads, so that running one check scans for nothing else.
CHECK_SIGNALS: dict[str, tuple[str, ...]] = {
    "art9_llm_errors": ("llm_call", "ai_construct", "try_except"),
    "art9_fallback": ("fallback",),
    "art10_input_validation": ("ai_context", "input_schema"),
    "art10_pii": ("pii",),
    "art11_docstrings": ("n_defs", "n_documented"),
    "art11_type_hints": ("n_functions", "n_typed"),
    "art12_logging": ("log_import", "log_call"),
    "art12_tracing": ("trace_import", "trace_usage", "ai_import"),
    "art12_audit": ("audit",),
    "art14_hitl": ("hitl",),
    "art14_limits": ("limit_strong", "limit_weak", "limit_rate", "tokens_unbounded", "ai_context"),
    "art14_identity": ("identity",),
    "art14_boundaries": ("boundary",),
    "art15_injection_defense": ("defence_strong", "defence_moderate", "defence_weak"),
    "art15_output": ("output",),
    "art15_retry": ("retry",),
    "art15_unsafe_input": ("unsafe_input",),
}
CHECKS = tuple(CHECK_SIGNALS)


def findings_array() -> Column:
    rows = [
        finding if emitted is None else F.when(emitted, finding)
        for emitted, finding in finding_columns().values()
    ]
    return F.array_compact(F.array(*rows))


def findings_from_signals(signals: DataFrame, keep: list[str]) -> DataFrame:
    """Turn signal columns into frameworks, trust flag and the ordered findings array."""
    known = F.col("fallback").isNotNull()
    return signals.select(
        *keep,
        F.when(known, frameworks_column()).alias("frameworks"),
        F.col("trust_layer").alias("trust_layer_detected"),
        F.when(known, findings_array()).alias("findings"),
    )


def with_summary(scanned: DataFrame) -> DataFrame:
    """Add total, passing, warnings, failing and the score text; no shuffle."""

    def having(status: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["status"] == status))

    counted = scanned.withColumns(
        {
            "total_checks": F.size("findings"),
            "passing": having("pass"),
            "warnings": having("warn"),
            "failing": having("fail"),
        }
    )
    return counted.withColumn("score", F.concat_ws("/", F.col("passing"), F.col("total_checks")))


def scan_code(df: DataFrame, code: str = "code", keep: list[str] | None = None) -> DataFrame:
    """Scan every row of source text; one output row per input row, no shuffle."""
    keep = [c for c in df.columns if c != code] if keep is None else keep
    return with_summary(findings_from_signals(with_signals(df, code, SIGNALS), keep))


def explode_findings(scanned: DataFrame, keep: list[str]) -> DataFrame:
    """One row per finding with its position `ord` (from 0)."""
    rows = explode_in_order(scanned, keep, "findings", "finding")
    return rows.select(*keep, "ord", *[F.col("finding")[f].alias(f) for f in FINDING_FIELDS])


def explode_in_order(df: DataFrame, keep: list[str], items: str, item: str) -> DataFrame:
    """One row per array item with its position `ord`; rows without items are left out.

    Written as an outer explode: for a plain one Spark adds a filter on the array's
    size and moves it below the projection, which would evaluate every rule again.
    """
    exploded = df.select(*keep, F.posexplode_outer(items).alias("ord", item))
    return exploded.where(F.col("ord").isNotNull())


def run_check(df: DataFrame, check: str, code: str = "code", keep: list[str] | None = None) -> DataFrame:
    """Run a single check; rows for which it does not apply are left out."""
    keep = [c for c in df.columns if c != code] if keep is None else keep
    emitted, finding = finding_columns()[check]
    rows = with_signals(df.where(F.col(code).isNotNull()), code, CHECK_SIGNALS[check])
    # In the row, as a filter would be moved below the projection and count everything again.
    found = rows.select(*keep, F.when(F.lit(True) if emitted is None else emitted, F.array(finding)).alias("found"))
    return explode_in_order(found, keep, "found", "finding").select(
        *keep, *[F.col("finding")[f].alias(f) for f in FINDING_FIELDS]
    )


def top_findings(scanned: DataFrame, keep: list[str]) -> DataFrame:
    """The findings worth showing first, in finding order.

    A failure is shown while fewer than four rows are shown, a warning while fewer
    than five are; whether a row is shown depends on the rows already taken, so the
    array is folded in order instead of ranked.
    """
    empty = F.slice(F.col("findings"), 1, 0)

    def take(shown: Column, f: Column) -> Column:
        fail = (f["status"] == "fail") & (F.size(shown) < 4)
        warn = (f["status"] == "warn") & (F.size(shown) < 5)
        return F.when(fail | warn, F.concat(shown, F.array(f))).otherwise(shown)

    return scanned.select(*keep, F.aggregate("findings", empty, take).alias("shown"))
