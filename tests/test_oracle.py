"""Every registered query against its SQL on the smallest given tables."""

from __future__ import annotations

import pytest
from compare import connect, differences

from __spark_entry__ import LLM_QUERIES, entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
SQL = oracle_sql()
OWN = [name for name in queries() if name not in LLM_QUERIES]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(OWN) <= set(SQL) <= set(queries())


@pytest.mark.parametrize("name", OWN)
def test_matches_sql(spark, con, name):
    assert differences(spark, con, name, queries()[name], SQL[name], FOLDER) is None


def test_entry(spark):
    rows = entry(spark).collect()
    assert {r["role"] for r in rows} >= {"user", "assistant"}
    assert all(r["messages"] == r["blocked"] + r["suspicious"] + r["clean"] for r in rows)


def test_every_check_meets_both_outcomes(spark):
    """The planted samples exercise each check: it is not always the same status."""
    from auditlens.operators import findings
    from auditlens.plans import corpus

    docs = corpus.code_corpus(spark, "/root/testdata/sf0.01").select("project", "path", "code")
    long = findings.explode_findings(findings.scan_code(docs), ["path"])
    seen: dict[str, set[str]] = {}
    for r in long.select("name", "status").distinct().collect():
        seen.setdefault(r["name"], set()).add(r["status"])
    single = {name for name, statuses in seen.items() if len(statuses) < 2}
    assert single == {"Unsafe input handling"}
    assert len(seen) == 17
