"""Source trees as a data source: the same files as the walk, filters in the listing, even partitions."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringEndsWith, StringStartsWith

from auditlens.sources import python_files
from auditlens.sources.tree_source import OPEN_BYTES, TreeReader, read_tree


@pytest.fixture
def root(tmp_path):
    for project, count in {"one": 30, "two": 5, "build2": 3}.items():
        for n in range(count):
            path = tmp_path / project / f"pkg{n % 3}" / f"f{n}.py"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(b"x = 1\r\n" * n)
    (tmp_path / "one" / "venv" / "deep").mkdir(parents=True)
    (tmp_path / "one" / "venv" / "deep" / "no.py").write_text("no")
    (tmp_path / "one" / "bad.py").write_bytes(b"ok\xff\nend")
    (tmp_path / "one" / "note.txt").write_text("no")
    (tmp_path / "loose.py").write_text("a\nb\n")
    os.symlink(tmp_path / "gone", tmp_path / "two" / "broken.py")
    return str(tmp_path)


def test_same_files_as_the_walk(spark, root):
    names = ["one", "two", "build2"]
    dirs = spark.createDataFrame([(n, f"{root}/{n}") for n in names], "project string, path string")
    walked = {(r["project"], r["path"], r["code"], r["lines"]) for r in python_files.read_projects(dirs).collect()}
    for address in (root, f"file://{root}"):
        rows = read_tree(spark, address).where("project is not null").collect()
        # A store does not show a link to nothing; the walk by path gives it an error.
        shown = walked if address == root else {w for w in walked if w[1] != "broken.py"}
        assert {(r["project"], r["path"], r["code"], r["lines"]) for r in rows} == shown
        assert len(rows) == len(shown)
    (broken,) = read_tree(spark, root).where("path = 'broken.py'").collect()
    assert broken["code"] is None and "broken.py" in broken["error"]


def test_files_below_the_root_have_no_project(spark, root):
    (row,) = read_tree(spark, root).where("project is null").collect()
    assert (row["path"], row["lines"], row["bytes"]) == ("loose.py", 2, 4)


def test_nothing_is_listed_before_the_query_runs(spark, root, tmp_path):
    found = read_tree(spark, root, code=False)
    before = found.count()
    (tmp_path / "late").mkdir()
    (tmp_path / "late" / "z.py").write_text("z")
    assert read_tree(spark, root, code=False).count() == before + 1
    with pytest.raises(Exception, match="absent"):
        read_tree(spark, f"{root}/absent").count()


@pytest.mark.parametrize(
    "condition",
    [
        "project = 'two'",
        "project in ('two', 'build2') and path like 'pkg1/%'",
        "path = 'pkg0/f3.py'",
        "path like 'pkg%' and path like 'pkg2/f2%'",
        "path like '%9.py'",
        "project = 'one' and project = 'two'",
        "path = 'pkg0/f3.py' and path = 'pkg0/f0.py'",
        "project = 'absent'",
        "project = 'one' or path = 'loose.py'",
    ],
)
def test_filters_keep_their_meaning(spark, root, condition):
    every = spark.createDataFrame(read_tree(spark, root).collect(), read_tree(spark, root).schema)
    wanted = sorted(every.where(condition).select(F.coalesce("project", F.lit("")), "path").collect())
    got = sorted(read_tree(spark, root).where(condition).select(F.coalesce("project", F.lit("")), "path").collect())
    assert got == wanted


def test_filters_are_taken_by_the_listing(spark, root):
    reader = TreeReader({"path": root})
    ends = StringEndsWith(("path",), "4.py")
    rest = reader.pushFilters([EqualTo(("project",), "one"), StringStartsWith(("path",), "pkg1/"), ends])
    assert list(rest) == [ends]
    places = [e.place for b in reader.partitions() for e in b.entries]
    assert places and all(p.startswith("one/pkg1/") for p in places)
    assert not reader._enters("two") and not reader._enters("one/pkg2") and reader._enters("one")
    none = TreeReader({"path": root})
    assert list(none.pushFilters([In(("project",), ())])) == []
    assert [b.entries for b in none.partitions()] == [[]]
    plan = read_tree(spark, root).where("project = 'two'")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and " Filter (" not in plan


def test_partitions_are_even_in_bytes(tmp_path):
    for n in range(200):
        path = tmp_path / "p" / f"f{n}.py"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"#" * (100_000 if n % 50 == 0 else 10))
    target = 1_000_000
    bundles = TreeReader({"path": str(tmp_path), "partitionBytes": str(target)}).partitions()
    weights = [sum(e.size + OPEN_BYTES for e in b.entries) for b in bundles]
    assert sum(len(b.entries) for b in bundles) == 200
    assert max(weights) <= target and min(weights[:-1]) >= target - 100_000 - OPEN_BYTES


@pytest.mark.parametrize("most", [1, 2, 5, 12])
def test_directories_beyond_the_listed_names_are_walked_by_tasks(spark, root, most):
    wanted = sorted((r["project"] or "", r["path"], r["lines"]) for r in read_tree(spark, root).where("error is null").collect())
    bundles = TreeReader({"path": root, "listedNames": str(most)}).partitions()
    assert any(e.is_dir for b in bundles for e in b.entries)
    some = read_tree(spark, root, listedNames=most).where("error is null")
    assert sorted((r["project"] or "", r["path"], r["lines"]) for r in some.collect()) == wanted
    assert some.where("project = 'two' and path like 'pkg1/%'").count() == 2


def test_an_empty_tree(spark, tmp_path):
    assert read_tree(spark, str(tmp_path)).collect() == []
