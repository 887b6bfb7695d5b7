"""Topic packs over code: data protection and fairness.

A topic has words that show the matter arises (`risk`) and words that show it is
handled (`safeguard`).  Topics are given; the word lists are this library's own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.functions.matching import Words
from auditlens.operators.signals import code_text, prepare


@dataclass(frozen=True)
class Topic:
    name: str
    risk: tuple[str, ...]
    safeguard: tuple[str, ...]
    hint: str


GDPR: tuple[Topic, ...] = (
    Topic(
        "consent",
        ("email", "phone", "address", "personal_data", "user_data"),
        ("consent", "opt_in", "lawful_basis"),
        "Record consent or another lawful basis before personal data is processed",
    ),
    Topic(
        "retention",
        ("save(", "insert", "to_parquet", "to_csv", "persist"),
        ("retention", "expire", "ttl", "purge"),
        "Give stored personal data a retention period",
    ),
    Topic(
        "erasure",
        ("save(", "insert", "user_data", "personal_data"),
        ("erase", "forget_user", "delete_user", "right_to_erasure"),
        "Provide a way to erase one person's data",
    ),
    Topic(
        "processing_agreements",
        ("openai", "anthropic", "requests.post", "third_party"),
        ("data_processing_agreement", "dpa_", "sub_processor", "processor_agreement"),
        "Keep a processing agreement for every external processor",
    ),
    Topic(
        "cross_border_transfer",
        ("openai", "anthropic", "us-east", "requests.post"),
        ("adequacy", "standard_contractual_clauses", "data_residency", "eu-west"),
        "Check where data is sent and on which safeguard",
    ),
)
BIAS: tuple[Topic, ...] = (
    Topic(
        "disparate_impact",
        ("score", "approve", "reject", "rank"),
        ("disparate_impact", "four_fifths", "adverse_impact"),
        "Measure outcome rates per group",
    ),
    Topic(
        "training_data_bias",
        (".fit(", "train_test_split", "fine_tune", "dataset"),
        ("class_weight", "resample", "stratify", "data_balance"),
        "Check training data for missing or over-represented groups",
    ),
    Topic(
        "protected_attributes",
        ("gender", "ethnicity", "religion", "disability", "age_group"),
        ("drop_protected", "sensitive_features", "protected_attribute"),
        "Handle protected attributes on purpose, not as plain features",
    ),
    Topic(
        "fairness_metrics",
        ("predict(", "accuracy", "classifier"),
        ("fairlearn", "aif360", "demographic_parity", "equalized_odds"),
        "Report fairness metrics beside accuracy",
    ),
    Topic(
        "mitigation",
        ("predict(", "classifier", "model.fit"),
        ("reweigh", "debias", "mitigat", "threshold_optimizer"),
        "Add a mitigation step where metrics differ between groups",
    ),
)


def run_pack(df: DataFrame, pack: tuple[Topic, ...], keep: list[str], code: str = "code") -> DataFrame:
    """One row per unit and topic: status pass, warn or not_applicable; no shuffle."""
    prepared = prepare(df, code, bare=False)
    flags = prepared.select(
        *keep,
        F.col("__code").isNotNull().alias("__known"),
        *[Words(t.risk, fold=True).on(code_text()).alias(f"risk_{t.name}") for t in pack],
        *[Words(t.safeguard, fold=True).on(code_text()).alias(f"safe_{t.name}") for t in pack],
    )
    rows = [
        F.struct(
            F.lit(i).alias("ord"),
            F.lit(t.name).alias("topic"),
            F.when(F.col(f"safe_{t.name}"), "pass")
            .when(F.col(f"risk_{t.name}"), "warn")
            .otherwise("not_applicable")
            .alias("status"),
            F.lit(t.hint).alias("fix_hint"),
        )
        for i, t in enumerate(pack)
    ]
    return (
        flags.where("__known").select(*keep, F.explode(F.array(*rows)).alias("r")).select(*keep, "r.*")
    )


def scan_gdpr(df: DataFrame, keep: list[str], code: str = "code") -> DataFrame:
    return run_pack(df, GDPR, keep, code)


def scan_bias(df: DataFrame, keep: list[str], code: str = "code") -> DataFrame:
    return run_pack(df, BIAS, keep, code)
