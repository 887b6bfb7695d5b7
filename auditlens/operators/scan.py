"""Scans that begin at files or directories."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.operators.findings import scan_code
from auditlens.operators.projects import file_lines, project_files, project_scan_merged
from auditlens.sources.python_files import read_files, read_projects


def scan_files(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Scan each named file on its own; a missing file gives an error instead of findings."""
    return scan_code(read_files(spark, paths), keep=["path", "lines", "error"])


def scan_projects(directories: DataFrame) -> DataFrame:
    """Scan each directory (project, path) as one merged text, with its first files or an error.

    A project may have a null name.  The text is not kept: the scan and the file list each
    read the files where they lie.  `project_file_list` lists all files.
    """
    rows = read_projects(directories)
    files = rows.where(F.col("path").isNotNull()).select("project", "path", "code")
    listed = project_files(files).withColumnRenamed("project", "listed")
    scanned = project_scan_merged(files)
    both = scanned.join(listed, scanned["project"].eqNullSafe(listed["listed"])).drop("listed")
    errors = rows.where(F.col("path").isNull()).select("project", "error", F.lit(0).cast("long").alias("files_scanned"))
    found = both.unionByName(errors, allowMissingColumns=True).withColumnRenamed("project", "found")
    named = directories.select("project", F.col("path").alias("directory"))
    return named.join(found, named["project"].eqNullSafe(found["found"])).drop("found")


def project_file_list(directories: DataFrame) -> DataFrame:
    """(project, file, lines) of every file below each directory, as long rows without a cap."""
    rows = read_projects(directories)
    return file_lines(rows.where(F.col("path").isNotNull()).select("project", "path", "code"))
