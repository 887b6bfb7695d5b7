"""The manifest against a tree built in plain Python, small blocks included."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from auditlens.llm import merkle_manifest as mm
from auditlens.llm.queries import op11
from tests.llm.conftest import FOLDER, frame


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fanout=3):
    """(root, siblings of every node as (left, right) by level)."""
    at, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a - a % fanout : a - a % fanout + fanout]
            proofs[i].append(("".join(run[: a % fanout]), "".join(run[a % fanout + 1 :])))
            at[i] = a // fanout
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def brute(rows):
    """rows: (recorded values, present values), the first two being id and source."""
    by_source = {}
    for old, new in rows:
        by_source.setdefault(old[1], []).append((old[0] is not None, old[0] or 0, leaf(old), leaf(new)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([x[2] for x in sorted(by_source[s])]) for s in order}
    root, tops = climb([trees[s][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for x, proof in zip(sorted(by_source[s]), trees[s][1]):
            node = x[3]
            for left, right in proof + tops[n]:
                node = H(left, node, right)
            proved = H(*(a + b for a, b in proof + tops[n]))
            out.append((x[1] if x[0] else None, x[2], trees[s][0], root, proved, node, node == root))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, given):
    rows = []
    for r in given.select(*mm.LEAF_COLUMNS).collect():
        text = r["text"]
        if text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        rows.append((tuple(r), (*tuple(r)[:4], text)))
    result = op11(spark, FOLDER)
    assert found(result) == brute(rows)
    assert {r["verified"] for r in result.select("verified").collect()} == {True, False}


@pytest.mark.parametrize("levels", [0, 1, 2])
@pytest.mark.parametrize("n", [1, 3, 4, 28, 83])
def test_blocks_of_every_size(spark, levels, n):
    """One hot source over many blocks beside sources of one row, for butterflies of several rounds."""
    values = [(i, "hot" if i < n else f"s{i % 4}", "en", i, f"text {i}") for i in range(n + 5)]
    docs = spark.createDataFrame(values, "doc_id long, source string, lang string, n_chars long, text string")
    assert found(mm.manifest(docs, levels=levels)) == brute([(v, v) for v in values])


def test_hard_rows(spark, hard):
    """Null and empty values, a null source, repeated ids and rows, very long texts, clashing columns."""
    docs = hard.withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.col("source")))
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") != 4, F.floor(F.col("doc_id") / 2)).cast("long"))
    docs = docs.unionAll(docs).withColumn("leaf", F.lit("x")).withColumn("root", F.lit(1)).withColumn("a.b", F.lit(2))
    rows = [tuple(r) for r in docs.select(*mm.LEAF_COLUMNS).collect()]
    assert found(mm.manifest(docs)) == brute([(r, r) for r in rows])


def test_null_differs_from_empty(spark):
    docs = frame(spark, [None, "", "-"])
    assert len({r["leaf"] for r in mm.manifest(docs.withColumn("doc_id", F.lit(1))).collect()}) == 3


def test_empty_table(spark, empty):
    assert mm.manifest(empty).collect() == []


def test_tampering_with_any_column_is_seen(spark, given):
    docs = given.limit(50)
    for c in ("lang", "source", "n_chars"):
        changed = [F.lit("9") if x == c else F.col(x) for x in mm.LEAF_COLUMNS]
        assert not any(r["verified"] for r in mm.manifest(docs, changed).collect())
    assert all(r["verified"] for r in mm.manifest(docs).collect())
