"""Appends by heads, anchors that show a cut-off tail, pages from the index, and concurrent writers."""

from __future__ import annotations

import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from auditlens.operators import agents, chain, chain_log, history, ordering
from auditlens.operators.chain_log import ChainLog
from auditlens.sources import commits
from auditlens.sources.commits import CommittedTable
from auditlens.sources.tables import EVENT_SCHEMA

KEY = b"k"
BASE = datetime(2024, 1, 1)


def events(spark, rows):
    """rows: (id, agent, minutes)"""
    made = [(i, a, "llm_call", None, "raw", BASE + timedelta(minutes=m), "low", 1, i / 7, 2, None) for i, a, m in rows]
    return spark.createDataFrame(made, EVENT_SCHEMA)


BATCHES = [
    [(i, "ab"[i % 2], i) for i in range(40)],
    [(100 + i, "abc"[i % 3], 100 + i // 2) for i in range(30)],
    [(200 + i, "c", 200 + i) for i in range(5)] + [(300, None, 300), (301, None, 301)],
]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    log = ChainLog(spark, str(tmp_path_factory.mktemp("log")), KEY)
    for rows in BATCHES:
        assert log.append(events(spark, rows)).count() == 0
    return log


def verdicts(df):
    return {r["scope"]: (r["events"], r["anchored"], r["valid"]) for r in df.collect()}


INTACT = {"a": (30, 30, True), "b": (30, 30, True), "c": (15, 15, True), None: (2, 2, True)}


def test_equals_a_full_rebuild(spark, log):
    whole = events(spark, [r for b in BATCHES for r in b])
    built = chain.build_chain(whole, KEY, keep=whole.columns)
    assert sorted(built.select("id", "chain_hash").collect()) == sorted(log.events().select("id", "chain_hash").collect())
    heads = {r["agent_id"]: (r["events"], r["last_id"], r["version"]) for r in log.heads().collect()}
    assert heads == {"a": (30, 127, 2), "b": (30, 128, 2), "c": (15, 204, 3), None: (2, 301, 3)}


def test_an_append_reads_heads_and_not_the_log(spark, log):
    """The plan of the links has the new rows and the heads as its only sources."""
    rows = chain_log.cut_lineage(events(spark, [(900, "a", 900)]).drop("chain_hash"))
    read = []
    original = log._read
    log._read = lambda kind, schema, parts: read.append(kind) or original(kind, schema, parts)
    try:
        log._write(rows, log.table.latest() + 1)
    finally:
        del log._read
    assert set(read) == {"heads"}


def test_late_events_are_returned(spark, tmp_path):
    log = ChainLog(spark, str(tmp_path), KEY)
    log.append(events(spark, [(5, "a", 50), (6, "b", 10)]))
    late = log.append(events(spark, [(1, "a", 1), (5, "a", 50), (7, "a", 60), (8, "b", 20), (9, "new", 0)]))
    assert sorted((r["id"], r["error"]) for r in late.collect()) == [
        (i, f"not later than the last stored event of its agent: event {i}") for i in (1, 5)
    ]
    assert sorted(r["id"] for r in log.events().collect()) == [5, 6, 7, 8, 9]
    assert all(r["valid"] for r in log.verify().collect())


def test_intact(log):
    assert verdicts(log.verify()) == INTACT
    assert verdicts(log.verify(after=2)) == {"c": (5, 5, True), None: (2, 2, True)}
    assert verdicts(log.verify(as_of=1)) == {"a": (20, 20, True), "b": (20, 20, True)}


@pytest.mark.parametrize(
    ("change", "broken"),
    [
        (lambda e: e.where("id <> 204"), {"c": (14, 15, False)}),  # the end of an agent
        (lambda e: e.where("id < 200 or id >= 300"), {"c": (10, 15, False)}),  # an agent's share of an append
        (lambda e: e.where("agent_id <> 'b' or agent_id is null"), {"b": (0, 30, False)}),  # an agent
        (lambda e: e.where("id <> 0"), {"a": (29, 30, False)}),  # the beginning
        (lambda e: e.withColumn("tokens_used", F.when(F.col("id") == 301, 9).otherwise(F.col("tokens_used"))), {None: (2, 2, False)}),
        (lambda e: e.withColumn("chain_hash", F.when(F.col("id") != 7, F.col("chain_hash"))), {"b": (30, 30, False)}),
        (lambda e: e.unionByName(e.where("id = 3")), {"b": (31, 30, False)}),
    ],
)
def test_changed_logs(log, change, broken):
    assert verdicts(log.verify(change(log.events()))) == INTACT | broken


def test_a_valid_but_shorter_chain_is_seen(spark, log):
    """The plain chain finds nothing wrong with it."""
    cut = log.events().where("id not in (203, 204)")
    assert all(r["valid"] for r in chain.verify_agents(cut.drop("version"), KEY).collect())
    assert verdicts(log.verify(cut))["c"] == (13, 15, False)


def test_anchors_cannot_be_made_without_the_key(spark, log, tmp_path):
    assert not any(r["valid"] for r in ChainLog(spark, log.table.root, b"other").verify().collect())


def test_seal_shows_removed_appends(log):
    assert len({log.seal(as_of=v) for v in (1, 2, 3)}) == 3 and log.seal() == log.seal(as_of=3)


def test_tries_of_every_depth_tell_hashes_apart(spark):
    rows = spark.range(3000).select(F.lit("u").alias("unit"), F.sha2(F.col("id").cast("string"), 256).alias("chain_hash"))
    for depth in (0, 1, 2):
        root = [r["root"] for r in chain_log.trie_roots(rows, "unit", depth).collect()]
        assert len(root) == 1
        for other in (rows.limit(2999), rows.unionAll(rows.limit(1)), rows.withColumn("chain_hash", F.reverse("chain_hash"))):
            assert chain_log.trie_roots(other, "unit", depth).first()["root"] != root[0]
    assert [chain_log._depth(n) for n in (0, 256, 257, 4096, 4097)] == [0, 0, 1, 1, 2]


def test_pages_open_few_files(spark, tmp_path):
    log = ChainLog(spark, str(tmp_path), KEY)
    for b in range(3):
        log.append(events(spark, [(b * 1000 + i, "ab"[i % 2], b * 1000 + i) for i in range(400)]))
    whole = log.events().drop("version")
    for offset, limit in ((0, 10), (395, 10), (1190, 30), (1200, 5), (777, 0)):
        assert log.page(limit, offset).collect() == agents.event_page(whole, limit=limit, offset=offset).collect()
    files, _ = log.page_files(10, 640)
    assert len(files) <= 2
    # Appends that overlap in time are read together and still in order.
    log.append(events(spark, [(9000 + i, "d", 500 + 3 * i) for i in range(200)]))
    whole = log.events().drop("version")
    for offset in (0, 300, 700, 1390):
        assert log.page(20, offset).collect() == agents.event_page(whole, limit=20, offset=offset).collect()


def test_control_in_one_step(spark, tmp_path):
    log = ChainLog(spark, str(tmp_path), KEY)
    log.append(events(spark, [(1, "a", 1)]))
    registry = spark.createDataFrame([("a", None, None, None)], "id string, name string, framework string, status string")
    requests = spark.createDataFrame(
        [(900, "a", "pause", datetime(2025, 1, 1)), (901, "ghost", "pause", datetime(2025, 1, 1))],
        "id long, agent_id string, action string, ts timestamp_ntz",
    )
    log.control(requests, registry)
    status = agents.agent_status(registry, log.events()).first()
    assert status["status"] == "paused" and verdicts(log.verify()) == {"a": (2, 2, True)}


def test_heads_are_written_whole_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(chain_log, "HEADS_EVERY", 2)
    log = ChainLog(spark, str(tmp_path), KEY)
    for i, agent in enumerate("aabca"):
        log.append(events(spark, [(i, agent, i)]))
    assert [p["full"] for p in log.table.parts()] == [False, True, False, True, False]
    assert {r["agent_id"]: r["events"] for r in log.heads().collect()} == {"a": 3, "b": 1, "c": 1}


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "SNAPSHOT", 3)
    rows = [spark.createDataFrame([("p", 10 * w + i, BASE + timedelta(days=i), 1, 2)], history.HISTORY_SCHEMA) for w in range(2) for i in range(4)]

    def work(mine):
        for df in mine:
            history.append_history(df, str(tmp_path))

    threads = [threading.Thread(target=work, args=(rows[4 * w : 4 * w + 4],)) for w in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    table = CommittedTable(spark, str(tmp_path))
    assert table.latest() == 8
    assert sorted(r["scan_id"] for r in history.read_history(spark, str(tmp_path)).collect()) == [0, 1, 2, 3, 10, 11, 12, 13]
    sizes = [history.read_history(spark, str(tmp_path), as_of=v).count() for v in range(9)]
    assert sizes == list(range(9))


def test_two_writers_of_one_chain(spark, tmp_path):
    """The one that comes second links its events to those of the first."""
    log = ChainLog(spark, str(tmp_path), KEY)
    log.append(events(spark, [(0, "a", 0)]))
    other, taken = ChainLog(spark, str(tmp_path), KEY), []
    original = log.table.commit

    def late(version, added):
        if not taken:
            taken.append(other.append(events(spark, [(1, "a", 1), (2, "b", 1)])))
        return original(version, added)

    log.table.commit = late
    log.append(events(spark, [(5, "a", 5), (6, "b", 6)]))
    assert verdicts(log.verify()) == {"a": (3, 3, True), "b": (2, 2, True)}
    assert log.table.latest() == 3


def test_keys_are_sized_without_the_heads(spark, tmp_path, monkeypatch):
    """An append joins its rows with the heads to link them, and not once more to count them."""
    plans = []
    large_keys = ordering._large_keys
    monkeypatch.setattr(
        ordering, "_large_keys", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or large_keys(df)
    )
    log = ChainLog(spark, str(tmp_path), KEY)
    for rows in BATCHES:
        log.append(events(spark, rows))
    assert len(plans) == len(BATCHES) and not any("Join" in p for p in plans)
    assert verdicts(log.verify()) == INTACT


def test_a_unit_in_several_pieces(spark, tmp_path, monkeypatch):
    """Links, counts and openings of agents that are cut into slices, events without a time included."""
    monkeypatch.setattr(ordering, "SLICE_ROWS", 8)
    log = ChainLog(spark, str(tmp_path), KEY)
    first = events(spark, [(i, "ab"[i % 4 == 0], i) for i in range(80)])
    timeless = events(spark, [(i, "a", 0) for i in range(500, 503)]).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    log.append(first.unionByName(timeless))
    log.append(events(spark, [(100 + i, "ab"[i % 4 == 0], 100 + i) for i in range(60)]))
    assert verdicts(log.verify()) == {"a": (108, 108, True), "b": (35, 35, True)}
    for i, broken in ((500, "a"), (2, "a"), (41, "a"), (101, "a"), (159, "a"), (0, "b"), (100, "b")):
        edited = log.events().withColumn("raw_action", F.when(F.col("id") == i, "x").otherwise(F.col("raw_action")))
        assert {a for a, v in verdicts(log.verify(edited)).items() if not v[2]} == {broken}, i
    lost = verdicts(log.verify(log.events().where("id <> 41")))
    assert lost == {"a": (107, 108, False), "b": (35, 35, True)}
