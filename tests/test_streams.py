"""Streams that repeat, come late or run long, against the batch operators."""

from __future__ import annotations

from datetime import datetime, timedelta
from shutil import copyfile

from auditlens.operators import agents
from auditlens.plans import queries
from auditlens.sources.tables import EVENT_SCHEMA
from auditlens.streaming import agent_status, agent_totals

BASE = datetime(2024, 1, 1)


def rows(ids):
    actions = ("llm_call", "kill_switch", "resumed", "tool_use")
    return [(i, "abc"[i % 3], actions[i % 4], None, None, BASE + timedelta(minutes=i * 37 % 100), "low", i, 0.5, 2, None) for i in ids]


def stream(spark, folder):
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def add(spark, folder, ids):
    spark.createDataFrame(rows(ids), EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def totals(df):
    return sorted(tuple(r) for r in df.select("agent_id", "total_events", "total_tokens", "total_cost", "last_event").collect())


def test_replayed_events_count_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for ids in (range(0, 20), range(10, 30), range(0, 30)):
        add(spark, source, ids)
        agent_totals.start_agent_stats(stream(spark, source), out, state, once=True).awaitTermination()
    whole = spark.createDataFrame(rows(range(30)), EVENT_SCHEMA)
    assert totals(agent_totals.read_agent_stats(spark, out)) == totals(agents.agent_stats(whole))


def test_a_reader_opens_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(agent_totals, "COMPACT_EVERY", 3)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for i in range(10):
        add(spark, source, range(5 * i, 5 * i + 5))
    agent_totals.start_agent_stats(stream(spark, source), out, state, once=True).awaitTermination()
    whole, batches = agent_totals.folders_read(spark, out)
    assert whole == 8 and len(batches) <= 3
    assert len(list((tmp_path / "out").iterdir())) <= 8
    log = spark.createDataFrame(rows(range(50)), EVENT_SCHEMA)
    assert totals(agent_totals.read_agent_stats(spark, out)) == totals(agents.agent_stats(log))


def test_status_follows_late_control_events(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    registry = spark.createDataFrame([(x, None, None, None) for x in "abcd"], "id string, name string, framework string, status string")
    for ids in (range(20, 40), range(0, 20), range(35, 50)):
        add(spark, source, ids)
        agent_status.start_agent_status(stream(spark, source), out, state, once=True).awaitTermination()
    whole = spark.createDataFrame(rows(range(50)), EVENT_SCHEMA)
    expected = sorted(map(tuple, agents.agent_status(registry, whole).collect()))
    assert sorted(map(tuple, agent_status.read_agent_status(spark, out, registry).collect())) == expected


def test_stream_queries_read_tables_of_one_file_and_of_many(spark, tmp_path):
    texts = [(i // 3, i % 3, "user", f"text {i}") for i in range(40)]
    arriving = spark.createDataFrame(texts, "conv_id long, turn long, role string, text string")
    logged = spark.range(60).selectExpr(
        "id AS event_id", "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "id % 7 AS user_id",
        "'view' AS event_type", "id * 0.25D AS value", "concat('{\"k\": ', id, '}') AS props",
    )
    many, single = tmp_path / "many", tmp_path / "single"
    single.mkdir()
    for name, table in (("conversations", arriving), ("events", logged)):
        table.repartition(3).write.parquet(str(many / f"{name}.parquet"))
        table.coalesce(1).write.parquet(str(tmp_path / name))
        copyfile(next((tmp_path / name).glob("part-*.parquet")), single / f"{name}.parquet")
    for folder in (str(many), str(single)):
        for streamed, batch in ((queries.s1, queries.b3), (queries.s2, queries.g7)):
            found, expected = streamed(spark, folder), batch(spark, folder)
            rows_found = sorted(map(repr, found.collect()))
            assert rows_found and rows_found == sorted(map(repr, expected.select(*found.columns).collect()))
