"""Every operator as a named query over the given tables, with flat columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.functions.text import count_lines
from auditlens.operators import (
    agents,
    chain,
    findings,
    history,
    projects,
    remediation,
    report,
    rescan,
    risk,
    rulepacks,
    screen,
    signals,
)
from auditlens.operators.chain_log import ChainLog
from auditlens.plans import corpus, oracle
from auditlens.session import cut_lineage, is_folder, remove_folder, shared_folder
from auditlens.sources import python_files, sinks, tables
from auditlens.sources.binary import decode_source
from auditlens.sources.tree_source import read_tree
from auditlens.streaming import agent_status, agent_totals, screening

Query = Callable[[SparkSession, str], DataFrame]
UNIT = ["project", "path"]
KEY = oracle.KEY


def _joined(name: str, sep: str = ",") -> Column:
    return F.array_join(name, sep).alias(name)


def _finding_texts(name: str = "findings") -> Column:
    text = F.transform(
        name, lambda f: F.concat_ws(":", f["status"], f["severity"], f["name"], f["evidence"])
    )
    return F.array_join(text, "|").alias(name)


def _flat_scan(scanned: DataFrame, keep: list[str]) -> DataFrame:
    return scanned.select(
        *keep,
        _joined("frameworks"),
        "trust_layer_detected",
        "total_checks",
        "passing",
        "warnings",
        "failing",
        "score",
        _finding_texts(),
    )


def _code(spark: SparkSession, d: str) -> DataFrame:
    return corpus.code_corpus(spark, d).select(*UNIT, "code")


def _scanned(spark: SparkSession, d: str) -> DataFrame:
    return findings.scan_code(_code(spark, d))


def _round_trip(
    spark: SparkSession, write: Callable[[str], None], read: Callable[[str], DataFrame]
) -> DataFrame:
    """What `read` finds in a folder of the shared storage that `write` has filled; the folder goes afterwards."""
    folder = f"{shared_folder(spark)}/trip-{uuid.uuid4()}"
    write(folder)
    back = cut_lineage(read(folder))
    remove_folder(spark, folder)
    return back


def a1(spark: SparkSession, d: str) -> DataFrame:
    return corpus.path_list(spark, d).where(python_files.keeps_path(F.col("path")))


def a2(spark: SparkSession, d: str) -> DataFrame:
    return _code(spark, d).select(*UNIT, count_lines(F.col("code")).cast("long").alias("lines"))


def _project_tree(spark: SparkSession, d: str) -> DataFrame:
    """The corpus written as source trees, a tenth of it into a folder that is not entered, and read back."""
    kept = F.when(F.col("doc_id") % 10 == 3, "node_modules/f").otherwise("pkg/f")
    files = corpus.code_corpus(spark, d).select(
        F.concat("project", F.lit("/"), kept, F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), "code"
    )
    projects_named = corpus.table(spark, d, "documents").select(F.col("source").alias("project")).distinct()

    def read(folder: str) -> DataFrame:
        return python_files.read_projects(
            projects_named.select("project", F.concat(F.lit(f"{folder}/"), "project").alias("path"))
        )

    return _round_trip(spark, lambda folder: sinks.write_files(files, folder), read)


def a1_tree(spark: SparkSession, d: str) -> DataFrame:
    """The files found; a project of which no file is kept has an error row with its folder, left out here."""
    return _project_tree(spark, d).where("path is not null").select("project", "path", "error")


def a2_tree(spark: SparkSession, d: str) -> DataFrame:
    found = _project_tree(spark, d).where("path is not null")
    return found.select("project", "path", F.col("lines").cast("long").alias("lines"))


def a1_source(spark: SparkSession, d: str) -> DataFrame:
    """The corpus written as trees, and all of it read back by one query through the data source."""
    kept = F.when(F.col("doc_id") % 10 == 3, "node_modules/f").otherwise("pkg/f")
    files = corpus.code_corpus(spark, d).select(
        F.concat("project", F.lit("/"), kept, F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), "code"
    )
    found = _round_trip(
        spark, lambda folder: sinks.write_files(files, folder), lambda folder: read_tree(spark, folder)
    )
    return found.select("project", "path", "bytes", F.col("lines").cast("long").alias("lines"), "error")


def a3(spark: SparkSession, d: str) -> DataFrame:
    broken = F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"), F.unhex(F.lit("C328E282410D0A42")))
    files = corpus.table(spark, d, "documents").select("doc_id", broken.alias("content"))
    return decode_source(files, "content", "code").select("doc_id", "code")


def a4(spark: SparkSession, d: str) -> DataFrame:
    return _flat_scan(_scanned(spark, d), UNIT)


def a5(spark: SparkSession, d: str) -> DataFrame:
    log = _round_trip(
        spark, lambda p: sinks.append_events(corpus.agent_events(spark, d), p), lambda p: tables.read_events(spark, p)
    )
    return log.select("id", "agent_id", "action_type", "ts", "tokens_used", "cost_usd", "duration_ms")


def a6(spark: SparkSession, d: str) -> DataFrame:
    scanned = _scanned(spark, d)
    back = _round_trip(
        spark, lambda p: sinks.write_json(scanned, p), lambda p: spark.read.schema(scanned.schema).json(p)
    )
    rows = back.select(*UNIT, "score", "passing", "trust_layer_detected")
    return sinks.with_json(rows, UNIT, pretty=False)


def a7(spark: SparkSession, d: str) -> DataFrame:
    reports = report.compliance_report(_scanned(spark, d), UNIT)
    return _round_trip(spark, lambda p: sinks.write_reports(reports, p), spark.read.parquet)


def _control_events(spark: SparkSession, d: str) -> DataFrame:
    registry = corpus.agents(spark, d)
    # Even customers are paused and odd ones resumed; those of nation 0 ask under an unknown name.
    requests = corpus.table(spark, d, "customer").select(
        (F.col("c_custkey") + 1_000_000_000).alias("id"),
        F.concat(
            F.when(F.col("c_nationkey") == 0, "ghost-").otherwise("agent-"), F.col("c_custkey").cast("string")
        ).alias("agent_id"),
        F.when(F.col("c_custkey") % 2 == 0, "pause").otherwise("resume").alias("action"),
        F.lit("2024-03-01 00:00:00").cast("timestamp_ntz").alias("ts"),
    )
    return agents.control_events(requests, registry)


def _appended(spark: SparkSession, d: str) -> DataFrame:
    """The chained log after control events were linked and appended to its files."""

    def write(path: str) -> None:
        sinks.append_events(_chained(spark, d), path)
        stored = tables.read_events(spark, path)
        sinks.append_events(cut_lineage(chain.extend_chain(stored, _control_events(spark, d), KEY)), path)

    return _round_trip(spark, write, lambda path: tables.read_events(spark, path))


def a8(spark: SparkSession, d: str) -> DataFrame:
    shown = ("id", "agent_id", "action_type", "human_summary", "raw_action", "ts", "risk_score", "chain_hash")
    return _appended(spark, d).select(*shown)


def _log(spark: SparkSession, d: str, path: str) -> ChainLog:
    """The event log appended in two parts, the earlier half of its time first."""
    log, events = ChainLog(spark, path, KEY), corpus.agent_events(spark, d).drop("chain_hash")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    middle = events.agg(F.floor((F.min(at) + F.max(at)) / 2)).first()[0]
    for part in (at <= middle, at > middle):
        log.append(events.where(part))
    return log


def a8_heads(spark: SparkSession, d: str) -> DataFrame:
    """The log chained append by append, from heads alone, pause and resume requests included."""
    shown = ("id", "agent_id", "action_type", "human_summary", "raw_action", "ts", "risk_score", "chain_hash")
    write = lambda path: _log(spark, d, path).append(_control_events(spark, d))
    return _round_trip(spark, write, lambda path: ChainLog(spark, path, KEY).events()).select(*shown)


def a4_changed(spark: SparkSession, d: str) -> DataFrame:
    """A scan of all units after one of half of them, whose results are looked up."""
    units = corpus.code_corpus(spark, d)

    def write(path: str) -> None:
        rescan.scan_changed(units.where("doc_id % 2 = 0"), path, UNIT)

    both = _round_trip(spark, write, lambda path: rescan.scan_changed(units, path, UNIT))
    return _flat_scan(both, UNIT)


def b1(spark: SparkSession, d: str) -> DataFrame:
    return signals.detect_framework(_code(spark, d)).select(*UNIT, _joined("frameworks"))


def b2(spark: SparkSession, d: str) -> DataFrame:
    return signals.detect_trust_layer(_code(spark, d)).select(*UNIT, "trust_layer_detected")


def _screened(spark: SparkSession, d: str) -> DataFrame:
    return screen.check_injection(corpus.messages(spark, d))


def _flat_screen(screened: DataFrame) -> DataFrame:
    return screened.select(
        "conv_id",
        "turn",
        F.array_join(F.col("detected_patterns.pattern"), ",").alias("patterns"),
        "confidence",
        "would_block",
        "pattern_count",
        "verdict",
    )


def b3(spark: SparkSession, d: str) -> DataFrame:
    return _flat_screen(_screened(spark, d))


def b4(spark: SparkSession, d: str) -> DataFrame:
    return screen.injection_hits(corpus.messages(spark, d), keep=["conv_id", "turn"])


def b5(spark: SparkSession, d: str) -> DataFrame:
    return risk.classify_risk(corpus.tool_calls(spark, d)).select(
        "call_id", "tool_name", "risk_level", "matched_keyword"
    )


def b6(spark: SparkSession, d: str) -> DataFrame:
    return risk.classify_risk(corpus.tool_calls(spark, d)).select("call_id", "risk_level", "recommendation")


def b7(spark: SparkSession, d: str) -> DataFrame:
    return agents.with_display_type(corpus.agent_events(spark, d)).select("id", "action_type", "type")


def b8(spark: SparkSession, d: str) -> DataFrame:
    return agents.project_events(corpus.agent_events(spark, d))


def b9(spark: SparkSession, d: str) -> DataFrame:
    chosen = agents.filter_events(corpus.agent_events(spark, d), "agent-7", "llm_call")
    return chosen.select("id", "agent_id", "action_type", "ts")


def b10(spark: SparkSession, d: str) -> DataFrame:
    wanted = corpus.table(spark, d, "events").select(
        F.col("event_id").alias("request"), F.concat(F.lit("agent-"), F.col("user_id").cast("string")).alias("agent_id")
    )
    return agents.agent_lookups(corpus.agents(spark, d), wanted)


def b13(spark: SparkSession, d: str) -> DataFrame:
    wanted = corpus.table(spark, d, "customer").select(
        F.col("c_custkey").alias("request"),
        F.concat(
            F.when(F.col("c_nationkey") == 0, "ghost-").otherwise("agent-"), F.col("c_custkey").cast("string")
        ).alias("agent_id"),
    )
    found = agents.agent_stats_lookups(corpus.agents(spark, d), corpus.agent_events(spark, d), wanted)
    return found.withColumn("total_cost", F.round("total_cost", 4))


def b11(spark: SparkSession, d: str) -> DataFrame:
    return signals.strip_comments_docstrings(_code(spark, d)).select(*UNIT, "bare_code")


def b12(spark: SparkSession, d: str) -> DataFrame:
    return signals.ai_context_flags(_code(spark, d)).select(*UNIT, "ai_import", "ai_construct", "ai_context")


def _check(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return findings.run_check(_code(spark, d), name)

    return run


def j1(spark: SparkSession, d: str) -> DataFrame:
    return remediation.suggest_fix(corpus.fix_requests(spark, d))


def j2(spark: SparkSession, d: str) -> DataFrame:
    named = corpus.code_corpus(spark, d).withColumn(
        "framework",
        F.when(F.col("doc_id") % 2 == 0, "").otherwise(corpus.pick(corpus.FRAMEWORK_REQUESTS, F.col("doc_id"))),
    )
    return remediation.add_trust_layer(named.drop("doc_id")).drop("code")


def j3(spark: SparkSession, d: str) -> DataFrame:
    return remediation.with_trust_info(j1(spark, d)).select(
        "doc_id", "article", "fix_framework", "trust_package", "trust_install"
    )


def j4(spark: SparkSession, d: str) -> DataFrame:
    explained = remediation.explain_article(corpus.fix_requests(spark, d).drop("framework"))
    return explained.select(
        "doc_id", "article", "title", "summary", _joined("requirements", "; "), _joined("components", "; "), "error"
    )


def _open_findings(spark: SparkSession, d: str) -> DataFrame:
    """Findings of the scan that did not pass, with the first framework of their unit."""
    scanned = _scanned(spark, d).withColumn("framework", F.try_element_at("frameworks", F.lit(1)))
    long = findings.explode_findings(scanned, [*UNIT, "framework"]).where(F.col("status") != "pass")
    return long.select(*UNIT, "framework", "article", "name")


def j1_findings(spark: SparkSession, d: str) -> DataFrame:
    return remediation.suggest_fix(_open_findings(spark, d))


def j3_findings(spark: SparkSession, d: str) -> DataFrame:
    informed = remediation.with_trust_info(j1_findings(spark, d))
    return informed.select(*UNIT, "article", "name", "fix_framework", "trust_package", "trust_install")


def j4_findings(spark: SparkSession, d: str) -> DataFrame:
    explained = remediation.explain_article(_open_findings(spark, d).drop("framework"))
    return explained.select(
        *UNIT, "article", "name", "title", "summary", _joined("requirements", "; "), _joined("components", "; ")
    )


def j5(spark: SparkSession, d: str) -> DataFrame:
    listed = agents.agents_with_stats(corpus.agents(spark, d), corpus.agent_events(spark, d))
    return listed.withColumn("total_cost", F.round("total_cost", 4))


def j6(spark: SparkSession, d: str) -> DataFrame:
    both = remediation.model_or_rules(_code(spark, d), corpus.model_results(spark, d), UNIT)
    return both.select(*UNIT, "source", "analysis", "score")


def g1(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(spark, d).select(*UNIT, "total_checks", "passing", "warnings", "failing", "score")


def g2(spark: SparkSession, d: str) -> DataFrame:
    return _flat_scan(projects.project_scan_merged(_code(spark, d)), ["project"])


def g3(spark: SparkSession, d: str) -> DataFrame:
    return _flat_scan(projects.project_scan_rollup(_code(spark, d)), ["project"])


def g4(spark: SparkSession, d: str) -> DataFrame:
    listed = projects.project_files(_code(spark, d))
    files = F.transform("files", lambda f: F.concat_ws("=", f["file"], f["lines"].cast("string")))
    return listed.select("project", "files_scanned", F.array_join(files, ",").alias("files"))


def g5(spark: SparkSession, d: str) -> DataFrame:
    grouped = report.findings_by_article(_scanned(spark, d), UNIT)
    return grouped.select(*UNIT, "article", "title", "checks", "passing", _finding_texts())


def g6(spark: SparkSession, d: str) -> DataFrame:
    return report.compliance_report(_scanned(spark, d), UNIT)


def g7(spark: SparkSession, d: str) -> DataFrame:
    return agents.agent_stats(corpus.agent_events(spark, d)).withColumn("total_cost", F.round("total_cost", 4))


def g8(spark: SparkSession, d: str) -> DataFrame:
    return agents.health_totals(corpus.agents(spark, d), corpus.agent_events(spark, d))


def _chained(spark: SparkSession, d: str) -> DataFrame:
    events = corpus.agent_events(spark, d, spread_out=True).drop("chain_hash")
    return chain.build_chain(events, KEY, keep=events.columns)


def _tampered(spark: SparkSession, d: str) -> DataFrame:
    """A chained log in which some costs were raised and some hashes wiped afterwards."""
    return _chained(spark, d).withColumns(
        {
            "cost_usd": F.when(
                F.col("id") % 997 == 0, F.coalesce("cost_usd", F.lit(0.0)) + 1
            ).otherwise(F.col("cost_usd")),
            "chain_hash": F.when(F.col("id") % 1009 != 5, F.col("chain_hash")),
        }
    )


def w1(spark: SparkSession, d: str) -> DataFrame:
    return chain.verify_agents(_tampered(spark, d), KEY)


def w1_all(spark: SparkSession, d: str) -> DataFrame:
    return chain.verify_chain(_chained(spark, d), KEY)


def w2(spark: SparkSession, d: str) -> DataFrame:
    return chain.chain_breaks(_tampered(spark, d), KEY).select("agent_id", "id")


def w3(spark: SparkSession, d: str) -> DataFrame:
    return chain.build_chain(corpus.agent_events(spark, d, spread_out=True), KEY).select("agent_id", "id", "chain_hash")


def w5(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on the log after an append: as it was written, and with some costs raised later."""
    log = _appended(spark, d)
    edited = log.withColumn(
        "cost_usd",
        F.when(F.col("id") % 997 == 0, F.coalesce("cost_usd", F.lit(0.0)) + 1).otherwise(F.col("cost_usd")),
    )
    intact = chain.verify_agents(log, KEY).withColumn("log", F.lit("intact"))
    return intact.unionByName(chain.verify_agents(edited, KEY).withColumn("log", F.lit("edited")))


def w6(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on a log that has lost the last event of every third agent."""

    def read(path: str) -> DataFrame:
        log = ChainLog(spark, path, KEY)
        third = F.substring("agent_id", 7, 20).cast("long") % 3 == 0
        last = log.heads().where(third).select("agent_id", F.col("last_ts").alias("ts"), F.col("last_id").alias("id"))
        # Times come first, as they tell rows apart soonest where the join sorts them.
        return log.verify(log.events().join(last, ["ts", "id", "agent_id"], "left_anti"))

    return _round_trip(spark, lambda path: _log(spark, d, path), read)


def w7(spark: SparkSession, d: str) -> DataFrame:
    """The status of every agent, kept while events arrive."""
    registry = corpus.agents(spark, d)

    def write(out: str) -> None:
        arriving = corpus.shape_events(_stream(spark, d, "events"))
        agent_status.start_agent_status(arriving, f"{out}/rows", f"{out}/state", once=True).awaitTermination()

    return _round_trip(spark, write, lambda out: agent_status.read_agent_status(spark, f"{out}/rows", registry))


def w4(spark: SparkSession, d: str) -> DataFrame:
    return agents.agent_status(corpus.agents(spark, d), corpus.agent_events(spark, d))


def l1(spark: SparkSession, d: str) -> DataFrame:
    return agents.event_page(corpus.agent_events(spark, d))


def l1_deep(spark: SparkSession, d: str) -> DataFrame:
    return agents.event_page(corpus.agent_events(spark, d), limit=50, offset=9_970)


def l1_log(spark: SparkSession, d: str) -> DataFrame:
    """A page of the stored log, from the files that its index names."""
    read = lambda path: ChainLog(spark, path, KEY).page(50, 470)
    return _round_trip(spark, lambda path: _log(spark, d, path), read).drop("hash")


def l1_repeated(spark: SparkSession, d: str) -> DataFrame:
    """A page that begins and ends among events of one time and id."""
    events = corpus.agent_events(spark, d).withColumns(
        {"id": F.floor(F.col("id") / 4), "ts": F.date_trunc("day", "ts").cast("timestamp_ntz")}
    )
    return agents.event_page(events, limit=50, offset=7)


def l2(spark: SparkSession, d: str) -> DataFrame:
    long = findings.explode_findings(_scanned(spark, d), UNIT)
    totals = long.groupBy("article").agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("status") == "pass").alias("passing")
    )
    return totals.orderBy("article")


def l3(spark: SparkSession, d: str) -> DataFrame:
    return findings.top_findings(_scanned(spark, d), UNIT).select(*UNIT, _finding_texts("shown"))


def l4(spark: SparkSession, d: str) -> DataFrame:
    top = screen.top_patterns(_screened(spark, d), ["conv_id", "turn"])
    return top.select("conv_id", "turn", F.array_join(F.col("top_patterns.pattern"), ",").alias("top_patterns"))


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table as a stream of its files, of which there may be one or a folder full."""
    path, reader = f"{d}/{name}.parquet", spark.readStream.schema(corpus.table(spark, d, name).schema)
    # A stream reads folders; the filter goes by the names of files, so it serves a table of one file only.
    return reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def s1(spark: SparkSession, d: str) -> DataFrame:
    def write(out: str) -> None:
        arriving = corpus.attach_attacks(_stream(spark, d, "conversations"))
        screening.start_screening(arriving, f"{out}/rows", f"{out}/state", once=True).awaitTermination()

    return _flat_screen(_round_trip(spark, write, lambda out: spark.read.parquet(f"{out}/rows")))


def s2(spark: SparkSession, d: str) -> DataFrame:
    def write(out: str) -> None:
        arriving = corpus.shape_events(_stream(spark, d, "events"))
        agent_totals.start_agent_stats(arriving, f"{out}/rows", f"{out}/state", once=True).awaitTermination()

    totals = _round_trip(spark, write, lambda out: agent_totals.read_agent_stats(spark, f"{out}/rows"))
    return totals.withColumn("total_cost", F.round("total_cost", 4))


def s3(spark: SparkSession, d: str) -> DataFrame:
    """Totals of a stream in which every event arrives twice."""

    def write(out: str) -> None:
        twice = [corpus.shape_events(_stream(spark, d, "events")) for _ in range(2)]
        totals = agent_totals.start_agent_stats(
            twice[0].unionAll(twice[1]), f"{out}/rows", f"{out}/state", once=True, delay="3650 days"
        )
        totals.awaitTermination()

    totals = _round_trip(spark, write, lambda out: agent_totals.read_agent_stats(spark, f"{out}/rows"))
    return totals.withColumn("total_cost", F.round("total_cost", 4))


def x1(spark: SparkSession, d: str) -> DataFrame:
    return rulepacks.scan_gdpr(_code(spark, d), UNIT).select(*UNIT, "topic", "status")


def x2(spark: SparkSession, d: str) -> DataFrame:
    return rulepacks.scan_bias(_code(spark, d), UNIT).select(*UNIT, "topic", "status")


def x3(spark: SparkSession, d: str) -> DataFrame:
    return risk.validate_actions(corpus.tool_calls(spark, d)).select(
        "call_id", "effective_risk", "approval_status", "required_policy", "remediation"
    )


def x4(spark: SparkSession, d: str) -> DataFrame:
    return history.history_list(corpus.scan_history(spark, d))


def x7(spark: SparkSession, d: str) -> DataFrame:
    """The history as it was before the last commit to it."""
    scans = corpus.scan_history(spark, d)

    def write(path: str) -> None:
        for part in ("scan_id % 3 <> 0", "scan_id % 3 = 0"):
            history.append_history(scans.where(part), path)

    return history.history_list(
        _round_trip(spark, write, lambda path: history.read_history(spark, path, as_of=1, schema=scans.schema))
    )


def x5(spark: SparkSession, d: str) -> DataFrame:
    return history.history_trend(corpus.scan_history(spark, d))


def x6(spark: SparkSession, d: str) -> DataFrame:
    return history.history_score(corpus.scan_history(spark, d))


def verdicts_by_role(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: injection verdicts of every message, counted by the role that wrote it."""
    return screen.verdict_counts(_screened(spark, d), ["role"])


CHECK_IDS = {name: f"r{i}_{name}" for i, name in enumerate(findings.CHECKS, start=1)}

QUERIES: dict[str, Query] = {
    "verdicts_by_role": verdicts_by_role,
    "a1_scan_project_files": a1,
    "a1_source_tree": a1_source,
    "a2_scan_file_read": a2,
    "a1_project_tree": a1_tree,
    "a2_project_tree_lines": a2_tree,
    "a3_read_tolerant_utf8": a3,
    "a4_scan_code_table": a4,
    "a5_event_source": a5,
    "a6_json_sink": a6,
    "a7_report_sink": a7,
    "a8_append_control_event": a8,
    "a8_append_by_heads": a8_heads,
    "a4_scan_changed": a4_changed,
    "b1_detect_framework": b1,
    "b2_detect_trust_layer": b2,
    "b3_check_injection": b3,
    "b4_injection_hits_long": b4,
    "b5_classify_risk": b5,
    "b6_risk_recommendation": b6,
    "b7_event_type_map": b7,
    "b8_event_projection": b8,
    "b9_event_filter": b9,
    "b10_agent_lookup": b10,
    "b11_strip_comments_docstrings": b11,
    "b12_ai_context_flag": b12,
    "b13_agent_stats_lookup": b13,
    **{key: _check(name) for name, key in CHECK_IDS.items()},
    "j1_fix_join": j1,
    "j2_remediation_join": j2,
    "j3_trust_info_join": j3,
    "j4_explain_join": j4,
    "j1_fix_findings": j1_findings,
    "j3_trust_findings": j3_findings,
    "j4_explain_findings": j4_findings,
    "j5_agents_with_stats": j5,
    "j6_model_or_rules": j6,
    "g1_scan_summary": g1,
    "g2_project_scan_merged": g2,
    "g3_project_scan_rollup": g3,
    "g4_project_files": g4,
    "g5_findings_by_article": g5,
    "g6_compliance_report": g6,
    "g7_agent_stats": g7,
    "g8_health_totals": g8,
    "w1_verify_chain": w1,
    "w1_verify_chain_all": w1_all,
    "w2_chain_breaks": w2,
    "w3_build_chain": w3,
    "w4_agent_status": w4,
    "w5_verify_after_append": w5,
    "w6_truncated_log": w6,
    "w7_agent_status_online": w7,
    "l1_event_page": l1,
    "l1_event_page_repeated": l1_repeated,
    "l1_event_page_deep": l1_deep,
    "l1_event_page_log": l1_log,
    "l2_article_sort": l2,
    "l3_top_findings": l3,
    "l4_top_patterns": l4,
    "s1_stream_screen": s1,
    "s2_stream_agent_stats": s2,
    "s3_stream_replayed": s3,
    "x1_gdpr_rules": x1,
    "x2_bias_rules": x2,
    "x3_validate_actions": x3,
    "x4_history_list": x4,
    "x5_history_trend": x5,
    "x6_history_score": x6,
    "x7_history_as_of": x7,
}
