"""Reports per code unit, rendered in the row that holds the findings: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.functions.guidance import (
    DEFAULT_PRODUCT,
    TEMPLATE_ALIASES,
    TEMPLATE_FRAMEWORKS,
    TrustProduct,
)
from auditlens.operators.findings import ARTICLES, explode_in_order


def _of_article(article: int) -> Column:
    return F.filter("findings", lambda f: f["article"] == article)


def findings_by_article(scanned: DataFrame, keep: list[str]) -> DataFrame:
    """One row per unit and article, articles ascending, with its findings in order."""
    groups = [
        F.struct(F.lit(a).alias("article"), F.lit(t).alias("title"), _of_article(a).alias("items"))
        for a, t in ARTICLES.items()
    ]
    filled = F.filter(F.array(*groups), lambda g: F.size(g["items"]) > 0)
    rows = explode_in_order(scanned.select(*keep, filled.alias("groups")), keep, "groups", "g")
    return rows.select(
        *keep,
        F.col("g.article").alias("article"),
        F.col("g.title").alias("title"),
        F.col("g.items").alias("findings"),
        F.size("g.items").alias("checks"),
        F.size(F.filter("g.items", lambda f: f["status"] == "pass")).alias("passing"),
    )


def _finding_lines(f: Column) -> Column:
    # The layout of a finding in the report.
    return F.concat(
        F.lit("- **["),
        F.upper(f["status"]),
        F.lit("]** "),
        f["name"],
        F.lit(" (Severity: "),
        f["severity"],
        F.lit(")\n  - "),
        f["evidence"],
        F.lit("\n  - Fix: "),
        f["fix_hint"],
    )


def report_text(product: TrustProduct = DEFAULT_PRODUCT, generator: str = "auditlens") -> Column:
    """Markdown text from frameworks, trust flag, findings and summary columns."""
    first = F.coalesce(F.try_element_at("frameworks", F.lit(1)), F.lit("langchain"))
    # The wording and layout of the report.
    head = [
        F.lit("# EU AI Act Compliance Report"),
        F.lit(f"\n**Generated by**: {generator}"),
        F.concat(
            F.lit("**Frameworks detected**: "),
            F.coalesce(F.nullif(F.array_join("frameworks", ", "), F.lit("")), F.lit("None detected")),
        ),
        F.concat(
            F.lit("**Trust layer present**: "), F.when(F.col("trust_layer_detected"), "Yes").otherwise("No")
        ),
        F.concat(
            F.lit("**Compliance score**: "),
            F.col("score"),
            F.lit(" ("),
            F.col("passing").cast("string"),
            F.lit(" passing, "),
            F.col("warnings").cast("string"),
            F.lit(" warnings, "),
            F.col("failing").cast("string"),
            F.lit(" failing)"),
        ),
    ]
    sections = []
    for article, title in ARTICLES.items():
        items = _of_article(article)
        body = F.array_join(F.transform(items, _finding_lines), "\n")
        sections.append(
            F.when(F.size(items) > 0, F.concat(F.lit(f"\n## Article {article} - {title}\n\n"), body))
        )
    lookup = F.coalesce(
        F.element_at(F.create_map(*[F.lit(x) for p in TEMPLATE_ALIASES.items() for x in p]), first), first
    )
    install = F.when(
        lookup.isin(*TEMPLATE_FRAMEWORKS), F.concat(F.lit(f"pip install {product.package}["), lookup, F.lit("]"))
    ).otherwise(F.lit(f"pip install {product.package}"))
    next_step = F.when(
        ~F.col("trust_layer_detected"),
        F.concat(
            F.lit("\n## Recommended Next Step\n\nInstall the trust layer for "),
            first,
            F.lit(":\n```\n"),
            install,
            F.lit("\n```"),
        ),
    )
    return F.concat_ws("\n", *head, *sections, next_step)


def compliance_report(
    scanned: DataFrame,
    keep: list[str],
    product: TrustProduct = DEFAULT_PRODUCT,
    generator: str = "auditlens",
) -> DataFrame:
    return scanned.select(
        *keep, F.when(F.col("findings").isNotNull(), report_text(product, generator)).alias("report")
    )
