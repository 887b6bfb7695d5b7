"""Findings and code joined to fixes, integration templates and explanations.

The dimension tables are constants of at most thirty rows, so their broadcast is
bounded; the large side is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.functions.guidance import (
    DEFAULT_PRODUCT,
    EXPLANATIONS,
    FIXES,
    TEMPLATE_ALIASES,
    TEMPLATE_FRAMEWORKS,
    TEMPLATE_TIP,
    TrustProduct,
)
from auditlens.functions.matching import S
from auditlens.operators.findings import ARTICLES, scan_code
from auditlens.operators.signals import detect_framework


def fix_table(spark: SparkSession) -> DataFrame:
    rows = [(a, ARTICLES[a], f, text) for a, fixes in FIXES.items() for f, text in fixes.items()]
    return spark.createDataFrame(rows, "article int, title string, framework string, fix string")


def template_table(spark: SparkSession, product: TrustProduct = DEFAULT_PRODUCT) -> DataFrame:
    return spark.createDataFrame(
        product.template_rows(), "framework string, package string, install string, code string"
    )


def explanation_table(spark: SparkSession) -> DataFrame:
    rows = [(a, t, s, list(r), list(c)) for a, (t, s, r, c) in EXPLANATIONS.items()]
    return spark.createDataFrame(
        rows,
        "article int, title string, summary string, requirements array<string>, components array<string>",
    )


def _unsupported(article: Column) -> Column:
    supported = ", ".join(str(a) for a in ARTICLES)
    return F.concat(F.lit("Article "), article.cast("string"), F.lit(f" not covered. Supported: {supported}"))


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, rf"\A{S}+|{S}+\z", "")


def _alias(framework: Column, aliases: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.element_at(table, framework), framework)


def suggest_fix(df: DataFrame, article: str = "article", framework: str = "framework") -> DataFrame:
    """Add title, fix_framework, fix_recommendations and error.

    The framework's own fix wins; otherwise the article's default.  An empty or
    null framework asks for the default; an unknown article is an error.
    """
    table = fix_table(df.sparkSession)
    own = F.broadcast(
        table.select(
            F.col("article").alias("__a"), F.col("framework").alias("__f"), F.col("fix").alias("__own")
        )
    )
    default = F.broadcast(
        table.where(F.col("framework") == "default").select(
            F.col("article").alias("__d"), F.col("title").alias("__title"), F.col("fix").alias("__default")
        )
    )
    given = F.nullif(F.col(framework), F.lit(""))
    asked = df.withColumn(
        "fix_framework", F.when(given.isNull(), F.lit("default")).otherwise(F.lower(_strip(F.col(framework))))
    )
    joined = asked.join(
        own, (F.col(article) == F.col("__a")) & (F.col("fix_framework") == F.col("__f")), "left"
    ).join(default, F.col(article) == F.col("__d"), "left")
    covered = F.col("__d").isNotNull()
    return joined.select(
        *df.columns,
        F.when(covered, F.col("fix_framework")).alias("fix_framework"),
        F.col("__title").alias("title"),
        F.coalesce("__own", "__default").alias("fix_recommendations"),
        F.when(~covered, _unsupported(F.col(article))).alias("error"),
    )


def with_trust_info(
    fixes: DataFrame, framework: str = "fix_framework", product: TrustProduct = DEFAULT_PRODUCT
) -> DataFrame:
    """Add trust_package and trust_install where the framework has a template, else nulls."""
    info = F.broadcast(
        template_table(fixes.sparkSession, product).select(
            F.col("framework").alias("__f"),
            F.col("package").alias("trust_package"),
            F.col("install").alias("trust_install"),
        )
    )
    lookup = _alias(F.col(framework), {"rag": TEMPLATE_ALIASES["rag"]})
    return fixes.withColumn("__l", lookup).join(info, F.col("__l") == F.col("__f"), "left").drop("__l", "__f")


def instructions(install: Column, product: TrustProduct = DEFAULT_PRODUCT) -> Column:
    return F.concat(
        F.lit("1. Install: "),
        install,
        F.lit(
            "\n2. Add the trust layer imports and setup shown above"
            "\n3. The trust layer automatically handles:"
            "\n   - HMAC-SHA256 tamper-evident audit logging (Article 12)"
            "\n   - ConsentGate for high-risk actions (Article 14)"
            "\n   - DataVault PII tokenization (Article 10)"
            f"\n4. Run '{product.scan_command}' to verify compliance improvement"
        ),
    )


def add_trust_layer(
    df: DataFrame,
    code: str = "code",
    framework: str = "framework",
    product: TrustProduct = DEFAULT_PRODUCT,
) -> DataFrame:
    """Add the integration template for each code unit, or an error.

    Without a given framework the first one detected in the code is used.  The
    code itself stays in its column, unchanged.
    """
    # The code is looked at only where no framework is given.
    unasked = F.nullif(F.col(framework), F.lit("")).isNull()
    detected = detect_framework(df.withColumn("__code", F.when(unasked, F.col(code))), "__code")
    first = F.coalesce(F.try_element_at("frameworks", F.lit(1)), F.lit(""))
    asked = detected.withColumn("__asked", F.coalesce(F.nullif(F.col(framework), F.lit("")), first))
    spelled = F.regexp_replace(F.lower("__asked"), "[-_ ]", "")
    table = F.broadcast(
        template_table(df.sparkSession, product).select(
            F.col("framework").alias("trust_framework"),
            F.col("package").alias("trust_package"),
            F.col("install").alias("install_command"),
            F.col("code").alias("trust_layer_code"),
        )
    )
    joined = asked.withColumn("__key", _alias(spelled, TEMPLATE_ALIASES)).join(
        table, F.col("__key") == F.col("trust_framework"), "left"
    )
    unknown = F.concat(F.lit("Framework '"), F.col("__asked"), F.lit("' not recognized."))
    missing = F.col("trust_framework").isNull()
    return joined.select(
        *df.columns,
        "trust_framework",
        "trust_package",
        "install_command",
        "trust_layer_code",
        F.when(~missing, instructions(F.col("install_command"), product)).alias("instructions"),
        F.when(missing, unknown).alias("error"),
        F.when(missing, F.lit(", ".join(TEMPLATE_FRAMEWORKS))).alias("supported"),
        F.when(missing, F.lit(TEMPLATE_TIP)).alias("tip"),
    )


def explain_article(df: DataFrame, article: str = "article") -> DataFrame:
    """Add title, summary, requirements, components, or an error for an unknown article."""
    table = F.broadcast(explanation_table(df.sparkSession).withColumnRenamed("article", "__a"))
    return df.join(table, F.col(article) == F.col("__a"), "left").select(
        *df.columns,
        "title",
        "summary",
        "requirements",
        "components",
        F.when(F.col("__a").isNull(), _unsupported(F.col(article))).alias("error"),
    )


def model_or_rules(df: DataFrame, model_results: DataFrame, keep: list[str], code: str = "code") -> DataFrame:
    """The rule scan of each code unit with the model's analysis where one exists.

    `model_results` has code_hash (SHA-256 of the code, unique) and analysis.  Spark
    broadcasts it when its measured size allows; otherwise the sorted join splits a
    code hash shared by very many units at run time.
    """
    hashed = df.withColumn("code_hash", F.sha2(code, 256))
    scanned = scan_code(hashed, code, [*keep, "code_hash"])
    joined = scanned.join(model_results.select("code_hash", "analysis"), "code_hash", "left")
    return joined.withColumn(
        "source", F.when(F.col("analysis").isNotNull(), "model").otherwise("rule-based (no model analysis)")
    )
