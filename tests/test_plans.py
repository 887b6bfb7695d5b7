"""The plans that keep these queries cheap on large tables."""

from __future__ import annotations

import re

import pytest

from auditlens.operators import agents, findings, projects
from auditlens.plans import corpus
from auditlens.plans.queries import QUERIES
from auditlens.sources.tables import read_events

FOLDER = "/root/testdata/sf0.001"
PER_ROW = [
    "b1_detect_framework",
    "b2_detect_trust_layer",
    "b3_check_injection",
    "b5_classify_risk",
    "b7_event_type_map",
    "b11_strip_comments_docstrings",
    "g1_scan_summary",
    "g6_compliance_report",
    "j1_fix_join",
    "j2_remediation_join",
    "j4_explain_join",
    "x1_gdpr_rules",
    "r14_art15_injection_defense",
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text: str) -> list[str]:
    """Shuffles other than the first spreading of a small input file, and broadcasts."""
    return [e for e in re.findall(r"(?<!Broadcast)Exchange \w+", text) if "RoundRobin" not in e]


@pytest.mark.parametrize("name", PER_ROW)
def test_work_on_single_rows_is_not_shuffled(spark, name):
    assert shuffles(plan(QUERIES[name](spark, FOLDER))) == []


def test_rules_run_once_per_row(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "2000")
    docs = corpus.code_corpus(spark, FOLDER).select("project", "path", "code")
    scanned = plan(findings.scan_code(docs))
    signals = plan(findings.with_signals(docs))
    long = plan(findings.explode_findings(findings.scan_code(docs), ["path"]))
    once = scanned.count("RLIKE")
    assert once == signals.count("RLIKE")
    assert long.count("RLIKE") <= once


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    corpus.agent_events(spark, FOLDER).write.parquet(str(tmp_path / "log"))
    log = read_events(spark, str(tmp_path / "log"))
    text = plan(agents.filter_events(log, "agent-3", "llm_call").select("id"))
    pushed = text[text.index("PushedFilters:") :]
    assert "EqualTo(agent_id,agent-3)" in pushed and "EqualTo(action_type,llm_" in pushed
    assert "ReadSchema: struct<id:bigint,agent_id:string,action_type:string>" in text
    stats = plan(agents.agent_stats(log))
    assert "human_summary" not in stats and "partial_sum" in stats


def test_dimensions_are_broadcast_and_facts_are_not_moved(spark):
    text = plan(QUERIES["j1_fix_join"](spark, FOLDER))
    assert text.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in text


def test_rollup_moves_signals_only(spark):
    docs = corpus.code_corpus(spark, FOLDER).select("project", "path", "code")
    text = plan(projects.project_scan_rollup(docs))
    assert "partial_bool_or" in text or "partial_max" in text
    exchange = next(line for line in text.splitlines() if "Exchange hashpartitioning" in line)
    assert "code" not in exchange


def test_first_files_are_limited_before_the_shuffle(spark):
    docs = corpus.code_corpus(spark, FOLDER).select("project", "path", "code")
    text = plan(projects.project_files(docs))
    assert "WindowGroupLimit" in text and text.index("Final") < text.index("Partial")


def test_page_is_read_between_its_keys(spark, tmp_path):
    corpus.agent_events(spark, FOLDER).write.parquet(str(tmp_path / "log"))
    log = read_events(spark, str(tmp_path / "log"))
    text = plan(agents.event_page(log, limit=10, offset=500))
    assert "TakeOrderedAndProject" in text and "GreaterThanOrEqual(ts" in text


def test_neighbours_need_no_join_of_rows(spark):
    from auditlens.operators.ordering import with_previous

    events = corpus.agent_events(spark, FOLDER).select("agent_id", "ts", "id")
    text = plan(with_previous(events, "agent_id", ["ts", "id"], {"before": "id"}))
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text


def test_sums_by_piece_move_and_sort_nothing(spark):
    from pyspark.sql import functions as F

    from auditlens.operators.ordering import PIECE, with_previous

    events = corpus.agent_events(spark, FOLDER).select("agent_id", "ts", "id")
    linked = with_previous(events, "agent_id", ["ts", "id"], {"before": "id"}, pieces=True)
    # As a text is among the sums, they are made of sorted rows.
    summed = linked.groupBy(*PIECE).agg(F.first("agent_id"), F.max("before"), F.bool_and("has_previous"))
    before, after = plan(linked), plan(summed)
    assert "SortAggregate" in after
    assert len(re.findall(r"\bSort \[", after)) == len(re.findall(r"\bSort \[", before))
    assert len(shuffles(after)) == len(shuffles(before))


def test_code_is_read_only_where_no_framework_is_given(spark):
    text = plan(QUERIES["j2_remediation_join"](spark, FOLDER))
    assert "CASE WHEN isnull(nullif(framework" in text.replace("#", " #").replace(" #", "#").replace("`", "") or "__code" in text


def test_definitions_are_counted_twice_at_most(spark):
    """Once for all and once for the documented ones; not again to decide whether the check applies."""
    for name in ("r5_art11_docstrings", "r6_art11_type_hints"):
        assert plan(QUERIES[name](spark, FOLDER)).count("regexp_count") <= 2


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from auditlens.session import shared_folder

    def session(master):
        context = SimpleNamespace(
            master=master, getConf=lambda: SimpleNamespace(get=lambda k: None), getCheckpointDir=lambda: None
        )
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d=None: d))

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(session(master))
    assert shared_folder(session("local[4]")) == shared_folder(session("local"))


def test_hot_code_hash_is_split(spark):
    """Copies of one file beyond a third of all rows, and results too many to broadcast."""
    from pyspark.sql import functions as F

    from auditlens.operators import remediation

    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in conf if spark.conf.get(k, None) is not None}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        files = spark.range(0, 6000, 1, 8).select(
            F.col("id").cast("string").alias("path"),
            F.when(F.col("id") % 2 == 0, "import openai\n").otherwise(F.concat(F.lit("x = "), F.col("id"))).alias("code"),
        )
        results = files.select(F.sha2("code", 256).alias("code_hash"), F.lit("seen").alias("analysis")).distinct()
        joined = remediation.model_or_rules(files, results, ["path"])
        rows = joined.collect()
        assert len(rows) == 6000 and {r["source"] for r in rows} == {"model"}
        assert "skew=true" in plan(joined)
    finally:
        for k in conf:
            spark.conf.unset(k) if k not in before else spark.conf.set(k, before[k])
