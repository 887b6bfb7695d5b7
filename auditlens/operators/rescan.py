"""Scans that judge only what is new: results are kept by content and rule version.

A unit's result depends on its code and on the rules alone.  Results are stored under the hash
of the code and a version of the rules, in a table that grows by commits; a scan looks its
units up and evaluates rules only for code it has not seen under these rules.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.functions import rules
from auditlens.operators.findings import scan_code
from auditlens.session import cut_lineage
from auditlens.sources.commits import CommittedTable


def rules_version() -> str:
    """Changes with any word or pattern of the rules that a scan applies."""
    tables = (rules.FRAMEWORKS, rules.TRUST_LAYER, rules.CODE_SIGNALS, rules.HALF_SIGNALS, rules.BARE_SIGNALS)
    return hashlib.sha256(repr(tables).encode()).hexdigest()[:16]


def content_key(code: Column) -> Column:
    return F.coalesce(F.sha2(code, 256), F.lit("none"))


def _scanned(units: DataFrame, version: str) -> DataFrame:
    return scan_code(units, keep=["content"]).withColumn("rules", F.lit(version))


def scan_changed(files: DataFrame, root: str, keep: list[str], version: str | None = None) -> DataFrame:
    """What `scan_code` gives for the units, with the columns `keep`; new results are added to the table at `root`.

    Units are looked up by narrow rows.  The code of new ones alone is read again, once per
    distinct content; without new ones no rule is evaluated.  Two scans at a time may both
    judge a unit; either result counts.
    """
    version = version or rules_version()
    spark = files.sparkSession
    table = CommittedTable(spark, root)
    marked = files.withColumn("content", content_key(F.col("code")))
    schema = _scanned(marked.limit(0), version).schema
    known = table.read(schema).where(F.col("rules") == version)
    wanted = marked.select("content").distinct().join(known.select("content"), "content", "left_anti")
    new = cut_lineage(wanted)
    if not new.isEmpty():
        texts = marked.select("content", "code").join(new, "content", "left_semi").dropDuplicates(["content"])
        table.append(_scanned(texts, version))
        known = table.read(schema).where(F.col("rules") == version)
    results = known.drop("rules").dropDuplicates(["content"])
    return marked.select(*keep, "content").join(results, "content").drop("content")
