"""Scans that judge new code only."""

from __future__ import annotations

from auditlens.operators import findings, rescan
from auditlens.sources.commits import CommittedTable

UNITS = [("p", f"{i}.py", f"import openai\nx = {i % 7}\ntry:\n  client.run()\nexcept E:\n  pass\n") for i in range(20)] + [("p", "n.py", None)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "project string, path string, code string")


def plain(df):
    return sorted((r.asDict(True) for r in df.collect()), key=lambda r: r["path"])


def test_equals_a_scan(spark, tmp_path):
    files = frame(spark, UNITS)
    expected = plain(findings.scan_code(files))
    assert plain(rescan.scan_changed(files.limit(5), str(tmp_path), ["project", "path"])) == expected[:0] + plain(findings.scan_code(files.limit(5)))
    assert plain(rescan.scan_changed(files, str(tmp_path), ["project", "path"])) == expected


def test_unchanged_code_is_not_judged(spark, tmp_path, monkeypatch):
    files, root = frame(spark, UNITS), str(tmp_path)
    first = plain(rescan.scan_changed(files, root, ["project", "path"]))
    table = CommittedTable(spark, root)
    assert table.latest() == 1 and table.read(None).count() == 8  # distinct contents
    judged = []
    original = rescan._scanned
    monkeypatch.setattr(rescan, "_scanned", lambda units, version: judged.append(units) or original(units, version))
    again = rescan.scan_changed(files, root, ["project", "path"])
    assert len(judged) == 1  # for the schema alone, of no rows
    assert "rlike" not in again._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plain(again) == first and table.latest() == 1
    changed = frame(spark, [*UNITS[:-2], ("p", "19.py", "import logging\n"), UNITS[-1]])
    assert plain(rescan.scan_changed(changed, root, ["project", "path"])) == plain(findings.scan_code(changed))
    assert table.latest() == 2 and table.read(None).count() == 9


def test_other_rules_judge_again(spark, tmp_path):
    files, root = frame(spark, UNITS[:3]), str(tmp_path)
    for version in ("a", "b", "a"):
        rescan.scan_changed(files, root, ["path"], version).collect()
    assert CommittedTable(spark, root).latest() == 2
