"""Source trees as a Spark data source: `spark.read.format("source_tree").load(root)`.

Each directory below the root is a project.  Nothing is listed before the query runs;
then the tree is listed once, filters on `project` and `path` decide which directories
are entered, and files are put into partitions of about equal bytes.  Once LISTED_NAMES
names are held, no further directory is listed in advance: the ones left are walked by the
tasks, so what the driver holds is bounded by that number and by one directory's files.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
)

from auditlens.functions.text import count_lines
from auditlens.sources.python_files import BATCH_BYTES, _text_of, is_skipped

PARTITION_BYTES = 64 * 1024 * 1024
#: What a file costs beside its bytes, as in Spark's own reading of many small files.
OPEN_BYTES = 64 * 1024
LISTED_NAMES = 1_000_000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_SCHEMA = "project string, path string, bytes long, code string, error string"


@dataclass
class Entry:
    """A file or directory: its place below the root, its size, and whether it is a directory."""

    place: str
    size: int
    is_dir: bool


@dataclass
class Bundle(InputPartition):
    entries: list[Entry]


def listed(root: str, place: str) -> Iterator[Entry]:
    """The Python files of a directory, and the directories to enter."""
    here = f"{root}/{place}" if place else root
    inside = f"{place}/" if place else ""
    if "://" in here:
        store, inner = fs.FileSystem.from_uri(here)
        for info in store.get_file_info(fs.FileSelector(inner)):
            is_dir = info.type == fs.FileType.Directory
            if not is_skipped(info.base_name) if is_dir else info.base_name.endswith(".py"):
                yield Entry(inside + info.base_name, info.size or 0, is_dir)
        return
    with os.scandir(here) as entries:
        for e in entries:
            is_dir = e.is_dir()
            if is_dir and (e.is_symlink() or is_skipped(e.name)):
                continue
            if is_dir or e.name.endswith(".py"):
                yield Entry(inside + e.name, 0 if is_dir else e.stat(follow_symlinks=False).st_size, is_dir)


def parts_of(place: str) -> tuple[str | None, str]:
    """(project, path within it); a file right below the root has no project."""
    project, slash, path = place.partition("/")
    return (project, path) if slash else (None, place)


class TreeReader(DataSourceReader):
    """Reads the files of a tree that pass the filters pushed to it."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.with_code = options.get("code", "true").lower() == "true"
        self.target = int(options.get("partitionBytes", PARTITION_BYTES))
        self.most = int(options.get("listedNames", LISTED_NAMES))
        self.projects: set[str] | None = None
        self.in_project = False
        self.prefixes: list[str] = []
        self.exact: str | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes equality and IN on the project, and equality and prefixes on the path; gives back the rest."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("project",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else {*f.value}
                self.projects = wanted if self.projects is None else self.projects & wanted
            elif column == ("project",) and isinstance(f, IsNotNull):
                self.in_project = True
            elif column == ("path",) and isinstance(f, StringStartsWith):
                self.prefixes.append(f.value)
            elif column == ("path",) and isinstance(f, EqualTo) and self.exact in (None, f.value):
                self.exact = f.value
            elif not (column == ("path",) and isinstance(f, IsNotNull)):
                yield f

    def _enters(self, place: str) -> bool:
        """Whether a directory may hold files that pass."""
        project, _, path = place.partition("/")
        if self.projects is not None and project not in self.projects:
            return False
        inside = f"{path}/" if path else ""
        starts = all(inside.startswith(p) or p.startswith(inside) for p in self.prefixes)
        return starts and (self.exact is None or self.exact.startswith(inside))

    def _takes(self, place: str) -> bool:
        project, path = parts_of(place)
        if project is None and (self.in_project or self.projects is not None):
            return False
        if self.projects is not None and project not in self.projects:
            return False
        return all(path.startswith(p) for p in self.prefixes) and self.exact in (None, path)

    def _inside(self, place: str) -> Iterator[Entry]:
        """What a directory holds that passes; one that is not readable holds nothing."""
        try:
            for e in listed(self.root, place):
                if self._enters(e.place) if e.is_dir else self._takes(e.place):
                    yield e
        except OSError:
            if not place:
                raise

    def partitions(self) -> list[Bundle]:
        waiting, files, names = deque([""]), [], 0
        while waiting and names < self.most:
            for e in self._inside(waiting.popleft()):
                names += 1
                if e.is_dir:
                    waiting.append(e.place)
                else:
                    files.append(e)
        bundles, held, total = [], [], 0
        for e in files:
            if held and total + e.size + OPEN_BYTES > self.target:
                bundles.append(Bundle(held))
                held, total = [], 0
            held.append(e)
            total += e.size + OPEN_BYTES
        if held:
            bundles.append(Bundle(held))
        bundles += [Bundle([Entry(place, 0, True)]) for place in waiting]
        return bundles or [Bundle([])]

    def _files(self, entries: list[Entry]) -> Iterator[Entry]:
        waiting = deque(entries)
        while waiting:
            e = waiting.popleft()
            if e.is_dir:
                waiting.extendleft(self._inside(e.place))
            else:
                yield e

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("project", pa.string()), ("path", pa.string()), ("bytes", pa.int64()), ("code", pa.string()), ("error", pa.string())]
        )
        rows: list[tuple] = []
        size = 0
        for e in self._files(partition.entries):
            code = error = None
            if self.with_code:
                try:
                    code = _text_of(f"{self.root}/{e.place}")
                except OSError as problem:
                    error = str(problem)
            rows.append((*parts_of(e.place), e.size, code, error))
            size += len(code or "") + len(e.place)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class TreeSource(DataSource):
    """Options: path (the root), code (false: names and sizes only), partitionBytes, listedNames."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def read_tree(spark: SparkSession, root: str, code: bool = True, **options: int) -> DataFrame:
    """The Python files of all projects below root: project, path, bytes, code, error, lines.

    The session is set to push filters to Python data sources.  Files right below root
    have a null project; without `code`, no file is opened and code and lines are null.
    """
    spark.dataSource.register(TreeSource)
    spark.conf.set(PUSHDOWN, "true")
    named = {k: str(v) for k, v in options.items()}
    found = spark.read.format("source_tree").options(code=str(code).lower(), **named).load(root)
    return found.withColumn("lines", count_lines(F.col("code")))
