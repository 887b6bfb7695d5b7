"""Python source files of project directories, listed and read by the executors.

Spark's own file listing hides names that begin with `_` or `.`, such as
`__init__.py`, and cannot drop malformed bytes, so both steps are small functions
over a table of directories.  The driver sees neither names nor text: the tree is
walked one level per round, each round spread over all tasks.  A directory is a path
that every executor sees, or the address of a store (`hdfs://`, `s3://`, `file://`).
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.functions.text import count_lines
from auditlens.session import cut_lineage

# Directory names that are not entered.
SKIPPED_DIRECTORIES = (
    "node_modules",
    ".git",
    "__pycache__",
    ".venv",
    "venv",
    "env",
    ".env",
    ".tox",
    ".mypy_cache",
    ".pytest_cache",
    "dist",
    "build",
    "egg-info",
    ".eggs",
    "site-packages",
    "deprecated",
    "archived",
)
SKIPPED_SUFFIX = ".egg-info"
BATCH_BYTES = 32 * 1024 * 1024
NAMES_PER_BATCH = 20_000
FILES_PER_TASK = 500


def is_skipped(name: str) -> bool:
    return name in SKIPPED_DIRECTORIES or name.endswith(SKIPPED_SUFFIX)


def keeps_path(path: Column) -> Column:
    """For a table of paths relative to their project: a Python file in no skipped directory."""
    names = "|".join(n.replace(".", r"\.") for n in SKIPPED_DIRECTORIES)
    return path.endswith(".py") & ~path.rlike(rf"(?:\A|/)(?:{names}|[^/]*\.egg-info)/")


def _entries(directory: str) -> Iterator[tuple[str, str, bool]]:
    """(name, path, is a directory to enter) of what a directory holds."""
    if "://" in directory:
        store, inner = fs.FileSystem.from_uri(directory)
        for info in store.get_file_info(fs.FileSelector(inner)):
            yield info.base_name, f"{directory.rstrip('/')}/{info.base_name}", info.type == fs.FileType.Directory
        return
    with os.scandir(directory) as entries:
        for e in entries:
            if not (e.is_symlink() and e.is_dir()):
                yield e.name, e.path, e.is_dir()


def _text_of(path: str) -> str:
    if "://" in path:
        store, inner = fs.FileSystem.from_uri(path)
        with store.open_input_file(inner) as f:
            text = f.read().decode("utf-8", "ignore")
        return text.replace("\r\n", "\n").replace("\r", "\n")
    with open(path, encoding="utf-8", errors="ignore") as f:
        return f.read()


def _exists(path: str) -> bool:
    if "://" in path:
        store, inner = fs.FileSystem.from_uri(path)
        return store.get_file_info(inner).type == fs.FileType.Directory
    return os.path.isdir(path)


def _shown(path: str, root: str | None) -> str:
    """A path as seen from its project's directory."""
    return path if not root else path[len(root.rstrip("/")) + 1 :] if "://" in root else os.path.relpath(path, root)


def _list_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["project", "root", "path", "is_dir"]
    rows: list[tuple] = []
    for batch in batches:
        for project, root, directory in zip(batch["project"], batch["root"], batch["path"], strict=True):
            try:
                for name, path, is_dir in _entries(directory):
                    if not is_skipped(name) if is_dir else name.endswith(".py"):
                        rows.append((project, root, path, is_dir))
                    if len(rows) >= NAMES_PER_BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            except OSError:
                continue
    yield pd.DataFrame(rows, columns=columns)


def _read_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["project", "path", "code", "error"]
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for project, root, path in zip(batch["project"], batch["root"], batch["path"], strict=True):
            shown = _shown(path, root)
            try:
                code, error = _text_of(path), None
            except FileNotFoundError:
                code, error = None, f"File not found: {path}"
            except OSError as problem:
                code, error = None, str(problem)
            rows.append((project, shown, code, error))
            size += len(code or "")
            if size >= BATCH_BYTES:
                yield pd.DataFrame(rows, columns=columns)
                rows, size = [], 0
    yield pd.DataFrame(rows, columns=columns)


def _is_directory(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(exists=[_exists(p) for p in batch["path"]])


_LISTED = "project string, root string, path string, is_dir boolean"
_READ = "project string, path string, code string, error string"


def _read(files: DataFrame) -> DataFrame:
    # Names are short but files are not: a fixed number keeps the partitions from being merged.
    cores = files.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, files.count() // FILES_PER_TASK + 1)
    spread = files.select("project", "root", "path").repartition(tasks, "path")
    return spread.mapInPandas(_read_all, _READ).withColumn("lines", count_lines(F.col("code")))


def read_files(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """The named files: project (null), path, code, error, lines."""
    rows = spark.createDataFrame([(None, None, p) for p in paths], "project string, root string, path string")
    return _read(rows)


def read_projects(directories: DataFrame) -> DataFrame:
    """All Python files below each directory: project, path, code, error, lines.

    `directories` has project and path.  A directory that is missing or holds no
    Python file gives one row with an error and no path.
    """
    roots = directories.select("project", "path").mapInPandas(
        _is_directory, "project string, path string, exists boolean"
    )
    roots = cut_lineage(roots)
    level = roots.where("exists").select("project", F.col("path").alias("root"), "path")
    files: DataFrame | None = None
    tasks = directories.sparkSession.sparkContext.defaultParallelism
    while True:
        listed = cut_lineage(level.repartition(tasks, "path").mapInPandas(_list_level, _LISTED))
        found = listed.where("not is_dir").drop("is_dir")
        files = found if files is None else files.unionByName(found)
        level = listed.where("is_dir").drop("is_dir")
        if level.isEmpty():
            break
    missing = roots.where("not exists").select(
        "project", F.concat(F.lit("Directory not found: "), "path").alias("error")
    )
    # One row per project that has files, made within each task before the shuffle.
    with_files = files.select("project").distinct()
    empty = (
        roots.where("exists")
        .join(with_files, "project", "left_anti")
        .select("project", F.concat(F.lit("No Python files found in "), "path").alias("error"))
    )
    return _read(files).unionByName(missing.unionByName(empty), allowMissingColumns=True)
