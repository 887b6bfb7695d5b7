"""Reading source trees and bytes, writing results, streams."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from auditlens.operators import findings, scan, screen
from auditlens.sources import python_files, sinks
from auditlens.sources.binary import decode_source
from auditlens.streaming import agent_totals, screening


def tree(root):
    texts = {
        "a.py": "x = 1\r\ny = 2\r",
        "__init__.py": "",
        "_private.py": "p",
        ".github/h.py": "h",
        "pkg/deep/er/b.py": "b\n",
        "pkg/note.txt": "no",
        "pkg/c.PY": "no",
        "pkg/d.pyc": "no",
        "venv/e.py": "no",
        "pkg/build/f.py": "no",
        "x.egg-info/g.py": "no",
        "venv2/h.py": "yes",
    }
    for name, text in texts.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (root / "bad.py").write_bytes(b"ok\xff\xc3(\n\xe2\x82end")


def test_read_projects(spark, tmp_path):
    tree(tmp_path / "one")
    (tmp_path / "build" / "in").mkdir(parents=True)
    (tmp_path / "build" / "z.py").write_text("root is never skipped")
    (tmp_path / "none").mkdir()
    dirs = spark.createDataFrame(
        [(n, str(tmp_path / n)) for n in ("one", "build", "none", "gone")], "project string, path string"
    )
    rows = python_files.read_projects(dirs).collect()
    one = {r["path"]: r for r in rows if r["project"] == "one"}
    assert set(one) == {
        "a.py", "__init__.py", "_private.py", ".github/h.py", "pkg/deep/er/b.py", "venv2/h.py", "bad.py",
    }
    assert one["a.py"]["code"] == "x = 1\ny = 2\n" and one["a.py"]["lines"] == 2
    assert one["bad.py"]["code"] == "ok(\nend"
    assert one["__init__.py"]["lines"] == 0
    assert [r["path"] for r in rows if r["project"] == "build"] == ["z.py"]
    errors = {r["project"]: r["error"] for r in rows if r["error"]}
    assert errors == {
        "none": f"No Python files found in {tmp_path / 'none'}",
        "gone": f"Directory not found: {tmp_path / 'gone'}",
    }
    scanned = {r["project"]: r for r in scan.scan_projects(dirs).collect()}
    assert scanned["one"]["files_scanned"] == 7 and len(scanned["one"]["files"]) == 7
    assert scanned["one"]["score"] == "0/12" and scanned["one"]["directory"] == str(tmp_path / "one")
    assert scanned["none"]["error"].startswith("No Python files") and scanned["none"]["files_scanned"] == 0
    assert scanned["gone"]["error"].startswith("Directory not found") and scanned["gone"]["findings"] is None


def test_read_single_files(spark, tmp_path):
    (tmp_path / "a.py").write_text("def f():\n    pass\n")
    rows = python_files.read_files(spark, [str(tmp_path / "a.py"), str(tmp_path / "b.py")]).collect()
    got = {r["path"].rsplit("/", 1)[1]: r for r in rows}
    assert got["a.py"]["lines"] == 2 and got["a.py"]["error"] is None
    assert got["b.py"]["error"] == f"File not found: {tmp_path / 'b.py'}"
    scanned = {r["path"]: r for r in scan.scan_files(spark, [str(tmp_path / "a.py"), str(tmp_path / "b.py")]).collect()}
    assert scanned[str(tmp_path / "a.py")]["lines"] == 2
    assert scanned[str(tmp_path / "a.py")]["failing"] == 3
    assert scanned[str(tmp_path / "b.py")]["findings"] is None


def test_path_filter_agrees_with_the_walk(spark):
    paths = ["a.py", "a.PY", "venv/a.py", "x/venv/a.py", "x/venv2/a.py", ".github/a.py", "p.egg-info/a.py", "build.py", "egg-info/q.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").where(python_files.keeps_path(F.col("path")))
    assert [r["path"] for r in df.collect()] == ["a.py", "x/venv2/a.py", ".github/a.py", "build.py"]


def test_decode(spark):
    df = spark.createDataFrame([(bytearray(b"a\xff\r\nb\xc3\xa9\r"),), (None,)], "content binary")
    assert [r["code"] for r in decode_source(df).collect()] == ["a\nbé\n", None]


def test_decode_any_bytes_without_python(spark):
    draw = random.Random(5)
    pieces = [b"a", b"\r", b"\n", b"\xc3\xa9", "\u4e2d\U0001f600\ufffd".encode(), b"\xed\xa0\x80", b"\xc0\x80", b"\xf4\x90\x80\x80", b"\xe2\x82"]
    texts = [b"".join(draw.choice([*pieces, bytes([draw.randrange(256)])]) for _ in range(draw.randrange(40))) for _ in range(3000)]
    texts += [bytes([a, b, c]) for a in (0xE0, 0xED, 0xF0, 0xF4, 0xC1) for b in range(256) for c in (0x41, 0x80, 0xBF)]
    texts.append("\u4e2d line\r\n".encode() * 200_000 + b"\xff")
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "i int, content binary")
    found = decode_source(df)
    for i, _, code in found.collect():
        assert code == texts[i].decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")
    # No batch of whole texts in a Python worker.
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()


def test_json_and_reports(spark, tmp_path):
    from auditlens.operators import report

    df = spark.createDataFrame([("p", "a.py", "import openai\n")], "project string, path string, code string")
    scanned = findings.scan_code(df)
    text = sinks.with_json(scanned, ["path"]).first()["json"]
    parsed = json.loads(text)
    assert parsed["frameworks"] == ["openai"] and "\n" in text
    assert [f["name"] for f in parsed["findings"]] == [f["name"] for f in scanned.first()["findings"]]
    sinks.write_json(scanned, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first()["score"] == parsed["score"]
    reports = report.compliance_report(scanned, ["project"])
    sinks.write_reports(reports, str(tmp_path / "reports"), by="project")
    (written,) = (tmp_path / "reports" / "project=p").glob("*.txt")
    assert written.read_text().startswith("# EU AI Act Compliance Report\n")
    assert "Install the trust layer for openai:" in written.read_text()


def test_trees_in_a_store(spark, tmp_path):
    """Addresses go through the store's own reader: same files, same text as by path."""
    from auditlens.sources.python_files import read_files, read_projects
    from auditlens.sources.sinks import write_files

    files = [("a.py", "x = 1\r\ny = 2"), ("sub/b.py", None), ("venv/c.py", "no"), ("sub/d.txt", "no")]
    root = f"file://{tmp_path}/tree"
    write_files(spark.createDataFrame(files, "path string, code string"), root)
    found = []
    for address in (root, f"{tmp_path}/tree"):
        rows = read_projects(spark.createDataFrame([("p", address), ("q", f"{address}-not")], "project string, path string"))
        found.append(sorted((r["project"], r["path"] or "", r["code"], r["lines"]) for r in rows.collect()))
    assert found[0] == found[1] == [("p", "a.py", "x = 1\ny = 2", 2), ("p", "sub/b.py", "", 0), ("q", "", None, None)]
    row = read_files(spark, [f"{root}/none.py"]).first()
    assert row["error"] == f"File not found: {root}/none.py"


def test_streams_equal_batches(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    talks = spark.read.parquet(f"{folder}/conversations.parquet")
    incoming = str(tmp_path / "in")
    talks.repartition(5).write.parquet(incoming)
    stream = spark.readStream.schema(talks.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    screening.start_screening(stream, out, state, once=True).awaitTermination()
    key = ["conv_id", "turn", "verdict", "confidence"]
    batch = screen.check_injection(talks).select(*key)
    assert sorted(spark.read.parquet(out).select(*key).collect()) == sorted(batch.collect())

    from auditlens.operators.agents import agent_stats
    from auditlens.plans import corpus

    events = corpus.agent_events(spark, folder)
    log = str(tmp_path / "log")
    events.repartition(4).write.parquet(log)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(log)
    totals = str(tmp_path / "totals")
    agent_totals.start_agent_stats(stream, totals, str(tmp_path / "state2"), once=True).awaitTermination()
    cols = ["agent_id", "total_events", "total_tokens", "last_event"]
    assert sorted(agent_totals.read_agent_stats(spark, totals).select(*cols).collect()) == sorted(agent_stats(events).select(*cols).collect())
