"""Chains, ordering, pages and status of the agent log."""

from __future__ import annotations

import hashlib
import hmac
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from auditlens.functions.hashing import hmac_sha256, key_pads
from auditlens.operators import agents, chain, history, ordering
from auditlens.operators.ordering import with_position, with_previous
from auditlens.sources.tables import EVENT_SCHEMA

KEY = b"a test key"


def events(spark, per_agent: dict[str, int]):
    start = datetime(2024, 1, 1)
    rows, i = [], 0
    for agent, n in per_agent.items():
        for k in range(n):
            rows.append((i, agent, "llm_call", None, f"raw {k}", start + timedelta(seconds=k // 3), "low", k, 0.25 * k, 5, None))
            i += 1
    return spark.createDataFrame(rows, EVENT_SCHEMA).repartition(4, "id")


@pytest.fixture(scope="module")
def log(spark):
    plain = events(spark, {"hot": 400, "b": 20, "single": 1}).drop("chain_hash")
    linked = plain.join(chain.build_chain(plain, KEY), ["agent_id", "ts", "id"]).select(*[f.name for f in EVENT_SCHEMA])
    return linked.cache()


def verdicts(df):
    return {r["scope"]: r["valid"] for r in chain.verify_agents(df, KEY).collect()}


def test_intact_chain(spark, log):
    assert verdicts(log) == {"hot": True, "b": True, "single": True}
    row = chain.verify_chain(log, KEY).first()
    assert (row["valid"], row["scope"], row["message"]) == (True, "all", "Chain intact")
    assert chain.verify_chain(log, KEY, "b").first()["scope"] == "b"
    assert chain.verify_chain(log.where("false"), KEY).first()["valid"] is True


def test_another_key_breaks_every_link(spark, log):
    assert chain.chain_breaks(log, b"another").count() == log.count()


def test_edit_breaks_the_event_and_its_successor(spark, log):
    edited = log.withColumn("tokens_used", F.when(F.col("id") == 100, 9999).otherwise(F.col("tokens_used")))
    assert sorted(r["id"] for r in chain.chain_breaks(edited, KEY).collect()) == [100, 101]
    assert verdicts(edited) == {"hot": False, "b": True, "single": True}
    assert chain.verify_chain(edited, KEY).first()["message"] == "Chain broken - possible tampering detected"


def test_deleted_event_breaks_its_successor(spark, log):
    assert [r["id"] for r in chain.chain_breaks(log.where("id <> 100"), KEY).collect()] == [101]
    assert [r["id"] for r in chain.chain_breaks(log.where("id <> 0"), KEY).collect()] == [1]


def test_swapped_events_break(spark, log):
    swapped = log.withColumn("id", F.when(F.col("id") == 30, 31).when(F.col("id") == 31, 30).otherwise(F.col("id")))
    assert {30, 31} <= {r["id"] for r in chain.chain_breaks(swapped, KEY).collect()}


def test_cut_off_tail_cannot_be_seen(spark, log):
    assert verdicts(log.where("id < 390 or id >= 400"))["hot"] is True


def test_hmac_equals_python(spark):
    for key in (b"k", b"x" * 64, b"long" * 40):
        df = spark.createDataFrame([("",), ("message é",)], "m string")
        for r in df.select("m", hmac_sha256(F.col("m"), key_pads(spark, key)).alias("h")).collect():
            assert r["h"] == hmac.new(key, r["m"].encode(), hashlib.sha256).hexdigest()


def test_key_is_not_printed_in_plans(spark, log):
    plan = chain.chain_breaks(log, b"very secret key")._jdf.queryExecution().toString()
    pads = bytes(b ^ 0x36 for b in b"very secret key")
    assert "very secret key" not in plan
    assert pads.hex().upper() not in plan.upper()


def test_positions_are_dense_and_ordered(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("v"), F.lit("same").alias("k"))
    rows = with_position(df, ["k", "v"]).collect()
    assert sorted((r["position"], r["v"]) for r in rows) == [(i + 1, i) for i in range(5000)]


def test_hot_key_is_spread_over_tasks(spark):
    df = spark.range(0, 4000, 1, 8).select(F.col("id").alias("v"), F.lit("same").alias("k"))
    sizes = with_position(df, ["k", "v"]).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 3 and max(r["count"] for r in sizes) < 2500


def test_previous_row(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("a", 5, "y"), ("b", 3, "z")], "k string, n int, v string")
    got = {(r["k"], r["n"]): (r["has_previous"], r["p"]) for r in with_previous(df, "k", ["n"], {"p": "v"}).collect()}
    assert got == {("a", 1): (False, None), ("a", 2): (True, None), ("a", 5): (True, "x"), ("b", 3): (False, None)}


def test_previous_row_in_keys_that_are_cut(spark, monkeypatch):
    """Large and small keys, null keys and null places: as a window over the whole key gives it."""
    monkeypatch.setattr(ordering, "SLICE_ROWS", 50)
    key = F.when(F.col("id") % 3 != 0, F.lit("hot")).when(F.col("id") % 2 == 0, (F.col("id") % 40).cast("string"))
    df = spark.range(0, 3000, 1, 5).select(
        key.alias("k"), F.when(F.col("id") % 50 != 0, F.col("id") * 7919 % 700).alias("n"), F.col("id").alias("i"),
        F.when(F.col("id") % 7 != 0, F.col("id")).alias("v"),
    )
    whole = Window.partitionBy("k").orderBy("n", "i")
    expected = df.withColumns({"p": F.lag("v").over(whole), "has_previous": F.lag(F.lit(True), 1, False).over(whole)})
    found = with_previous(df, "k", ["n", "i"], {"p": "v"})
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))


def test_rows_of_small_keys_are_shuffled_once(spark):
    df = spark.range(0, 3000, 1, 5).select((F.col("id") % 400).cast("string").alias("k"), F.col("id").alias("v"))
    linked = with_previous(df, "k", ["v"], {"p": "v"})
    linked.collect()
    final = linked._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Exchange hashpartitioning") == 1 and "Join" not in final


def test_pages_follow_each_other(spark, log):
    """Also where many events share a time and an id."""
    same = log.withColumns({"id": F.floor(F.col("id") / 7), "ts": F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")})
    for events in (log, same):
        ordered = events.where("agent_id = 'hot'").orderBy(
            F.col("ts").desc(), F.col("id").desc(), *[F.col(c) for c in events.columns if c not in ("ts", "id")]
        )
        everything = agents.project_events(ordered).collect()
        pages = [agents.event_page(events, agent="hot", limit=45, offset=o).collect() for o in range(0, 400, 45)]
        assert [r for p in pages for r in p] == everything
    assert len(agents.event_page(log, agent="hot", limit=25, offset=390).collect()) == 10
    assert agents.event_page(log, agent="hot", limit=25, offset=400).collect() == []


def test_control_events_and_status(spark, tmp_path):
    from auditlens.sources.sinks import append_events
    from auditlens.sources.tables import read_events

    registry = spark.createDataFrame(
        [("hot", None, None, None), ("b", "B", "openai", "idle"), ("c", "C", "rag", "active")],
        "id string, name string, framework string, status string",
    )
    path = str(tmp_path / "log")
    append_events(events(spark, {"hot": 5, "b": 2}), path)
    requests = spark.createDataFrame(
        [
            (901, "hot", "pause", datetime(2024, 2, 1)),
            (902, "hot", "resume", datetime(2024, 2, 2)),
            (903, "b", "pause", datetime(2024, 2, 1)),
            (904, "ghost", "pause", datetime(2024, 2, 1)),
        ],
        "id long, agent_id string, action string, ts timestamp_ntz",
    )
    append_events(agents.control_events(requests, registry), path)
    log = read_events(spark, path)
    assert log.count() == 10
    paused = log.where("id = 903").first()
    assert paused["human_summary"] == "Agent 'b' paused from dashboard" and paused["risk_score"] == "medium"
    status = {r["id"]: r["status"] for r in agents.agent_status(registry, log).collect()}
    assert status == {"hot": "active", "b": "paused", "c": "active"}
    totals = {r["id"]: r for r in agents.agents_with_stats(registry, log).collect()}
    assert totals["c"]["total_events"] == 0 and totals["hot"]["name"] == "hot"
    assert agents.health_totals(registry, log).first().asDict() == {"status": "ok", "agents": 3, "events": 10}


def test_descriptions_and_defaults(spark):
    rows = [
        (1, "a", "web_search", None, "", datetime(2024, 1, 1), None, None, None, None, None),
        (2, "a", "other", "", "raw", datetime(2024, 1, 1), "high", 3, 0.5, 4, "0123456789abcdef0123"),
    ]
    first, second = agents.project_events(spark.createDataFrame(rows, EVENT_SCHEMA)).orderBy("id").collect()
    assert (first["description"], first["type"], first["risk"], first["hash"]) == ("web_search", "web-search", "low", "")
    assert (first["tokens"], first["cost"], first["duration"]) == (0, 0.0, 0)
    assert (second["description"], second["type"], second["hash"]) == ("raw", "tool-use", "0123456789abcdef")


def test_history(spark):
    rows = [("p", 1, datetime(2024, 1, 1), 3, 12), ("p", 2, datetime(2024, 1, 2), 6, 12), ("p", 3, datetime(2024, 1, 2), 5, 12)]
    df = spark.createDataFrame(rows, "project string, scan_id long, scanned_at timestamp_ntz, passing int, total int")
    trend = {r["scan_id"]: (r["delta"], r["direction"]) for r in history.history_trend(df).collect()}
    assert trend == {1: (None, "first"), 2: (0.25, "improving"), 3: (-0.0833, "declining")}
    assert [r["scan_id"] for r in history.history_list(df, 2).collect()] == [3, 2]
    last = history.history_score(df).first()
    assert (last["scan_id"], last["score"], last["scans"]) == (3, "5/12", 3)
