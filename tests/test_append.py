"""Appending to a chained log, and numbers that a digest must tell apart."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auditlens.functions.hashing import exact_number
from auditlens.operators import agents, chain, projects
from auditlens.sources.tables import EVENT_SCHEMA

KEY = b"k"
BASE = datetime(2024, 1, 1)


def events(spark, rows):
    """rows: (id, agent, minutes, cost)"""
    made = [
        (i, a, "llm_call", None, "raw", BASE + timedelta(minutes=m), "low", 1, cost, 2, None) for i, a, m, cost in rows
    ]
    return spark.createDataFrame(made, EVENT_SCHEMA)


def chained(df):
    return chain.build_chain(df, KEY, keep=df.columns).select(df.columns)


def verdicts(df):
    return {r["scope"]: r["valid"] for r in chain.verify_agents(df, KEY).collect()}


@pytest.fixture(scope="module")
def stored(spark):
    return chained(events(spark, [(i, "ab"[i % 2], i, i / 7) for i in range(40)])).cache()


def test_chain_stays_valid_after_an_append(spark, stored):
    new = events(spark, [(100 + i, "abc"[i % 3], 100 + i, None) for i in range(9)])
    whole = stored.unionByName(chain.extend_chain(stored, new, KEY))
    assert verdicts(whole) == {"a": True, "b": True, "c": True}
    assert sorted(whole.select("id", "chain_hash").collect()) == sorted(
        chained(whole.drop("chain_hash").withColumn("chain_hash", F.lit(None).cast("string"))).select("id", "chain_hash").collect()
    )
    edited = whole.withColumn("cost_usd", F.when(F.col("id") == 39, 9.0).otherwise(F.col("cost_usd")))
    assert verdicts(edited) == {"a": True, "b": False, "c": True}


def test_control_events_are_linked(spark, stored):
    registry = spark.createDataFrame([("a", None, None, None)], "id string, name string, framework string, status string")
    requests = spark.createDataFrame(
        [(900, "a", "pause", datetime(2025, 1, 1))], "id long, agent_id string, action string, ts timestamp_ntz"
    )
    made = chain.extend_chain(stored, agents.control_events(requests, registry), KEY)
    assert verdicts(stored.unionByName(made.select(stored.columns)))["a"] is True


def test_an_event_in_the_past_cannot_be_appended(spark, stored):
    late = events(spark, [(500, "a", 1, None)])
    with pytest.raises(Exception, match="not later than the last stored event"):
        chain.extend_chain(stored, late, KEY).collect()


def test_numbers_keep_every_bit_and_never_fail(spark):
    values = [math.nan, math.inf, -math.inf, 0.0, 1e300, -1e300, 1e-9, 1e-7, 4e-7, 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308]
    for k in range(-30, 31):
        values += [x for p in (2.0**k, 10.0**k, 256.0**k) for x in (p, math.nextafter(p, 0), math.nextafter(p, math.inf), -p)]
    values += [None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    texts = {r["i"]: r["t"] for r in rows.select("i", exact_number(F.col("v")).alias("t")).collect()}
    assert texts[0] == "NaN" and texts[len(values) - 1] is None
    finite = {v for v in values if v is not None and not math.isnan(v)}
    assert len({texts[i] for i, v in enumerate(values) if v in finite}) == len(finite)
    for i, v in enumerate(values):
        if texts[i] and ":" in texts[i]:
            k, m = map(int, texts[i].split(":"))
            assert math.ldexp(m, 8 * k - 53) == v


def test_tiny_and_broken_costs_are_protected(spark):
    log = chained(events(spark, [(i, "a", i, c) for i, c in enumerate([1e-7, math.nan, math.inf, 1e300, 1e14])]))
    assert verdicts(log) == {"a": True}
    for cost in (4e-7, math.nan):
        assert verdicts(log.withColumn("cost_usd", F.when(F.col("id") == 0, cost).otherwise(F.col("cost_usd")))) == {"a": False}


def test_files_without_a_project_are_one_project(spark):
    files = [("a.py", "import openai\nclient.chat.completions.create(1)\n"), ("b.py", "open = '''\nx\n'''\nimport logging\nlogging.info(1)\n")]
    named = spark.createDataFrame([("p", *f) for f in files], "project string, path string, code string")
    unnamed = named.withColumn("project", F.lit(None).cast("string"))
    both = projects.project_scan_merged(named.unionByName(unnamed)).collect()
    assert {r["project"] for r in both} == {"p", None}
    assert both[0].asDict() | {"project": 0} == both[1].asDict() | {"project": 0}
    listed = {r["project"]: (r["files_scanned"], len(r["files"])) for r in projects.project_files(unnamed).collect()}
    assert listed == {None: (2, 2)}


def test_totals_of_one_agent_or_not_found(spark, stored):
    registry = spark.createDataFrame([("a", None, None, None), ("z", None, None, None)], "id string, name string, framework string, status string")
    asked = spark.createDataFrame([("a",), ("z",), ("ghost",)], "agent_id string")
    got = {r["agent_id"]: (r["total_events"], r["error"]) for r in agents.agent_stats_lookups(registry, stored, asked).collect()}
    assert got == {"a": (20, None), "z": (0, None), "ghost": (None, "Agent 'ghost' not found")}
