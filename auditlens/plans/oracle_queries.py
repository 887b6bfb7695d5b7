"""SQL text per registered query."""

from __future__ import annotations

from auditlens.plans import oracle as o
from auditlens.plans.samples import DIRECTORIES, FILE_NAMES

# Directory names that are not entered.
_SKIPPED = (
    "node_modules",
    ".git",
    "__pycache__",
    ".venv",
    "venv",
    "env",
    ".env",
    ".tox",
    ".mypy_cache",
    ".pytest_cache",
    "dist",
    "build",
    "egg-info",
    ".eggs",
    "site-packages",
    "deprecated",
    "archived",
)

_GDPR = {
    "consent": ("email|phone|address|personal_data|user_data", "consent|opt_in|lawful_basis"),
    "retention": (r"save\(|insert|to_parquet|to_csv|persist", "retention|expire|ttl|purge"),
    "erasure": (r"save\(|insert|user_data|personal_data", "erase|forget_user|delete_user|right_to_erasure"),
    "processing_agreements": (
        r"openai|anthropic|requests\.post|third_party",
        "data_processing_agreement|dpa_|sub_processor|processor_agreement",
    ),
    "cross_border_transfer": (
        r"openai|anthropic|us-east|requests\.post",
        "adequacy|standard_contractual_clauses|data_residency|eu-west",
    ),
}
_BIAS = {
    "disparate_impact": ("score|approve|reject|rank", "disparate_impact|four_fifths|adverse_impact"),
    "training_data_bias": (
        r"\.fit\(|train_test_split|fine_tune|dataset",
        "class_weight|resample|stratify|data_balance",
    ),
    "protected_attributes": (
        "gender|ethnicity|religion|disability|age_group",
        "drop_protected|sensitive_features|protected_attribute",
    ),
    "fairness_metrics": (
        r"predict\(|accuracy|classifier",
        "fairlearn|aif360|demographic_parity|equalized_odds",
    ),
    "mitigation": (r"predict\(|classifier|model\.fit", "reweigh|debias|mitigat|threshold_optimizer"),
}


def _pack(topics: dict[str, tuple[str, str]]) -> str:
    parts = [
        f"SELECT project, path, '{t}' AS topic, CASE WHEN {o.hit('code', '(?i)' + safe)} THEN 'pass' "
        f"WHEN {o.hit('code', '(?i)' + risk)} THEN 'warn' ELSE 'not_applicable' END AS status FROM corpus"
        for t, (risk, safe) in topics.items()
    ]
    return f"WITH {o.CORPUS} " + " UNION ALL ".join(parts)


_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_LINES = (
    f"len(regexp_extract_all(code, '{_BREAK}')) + CASE WHEN code <> '' AND NOT "
    rf"regexp_matches(code, '[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]\z') THEN 1 ELSE 0 END"
)
_STATS = (
    "stats AS (SELECT agent_id, count(*) AS total_events, coalesce(sum(tokens_used), 0)::BIGINT AS total_tokens, "
    "coalesce(sum(cost_usd), 0) AS total_cost, max(ts) AS last_event FROM agent_events GROUP BY agent_id)"
)
_EVENT_VIEW = (
    "id, agent_id AS agent, coalesce("
    + "CASE action_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in o.DISPLAY.items())
    + " END, 'tool-use') AS type, coalesce(nullif(human_summary, ''), nullif(raw_action, ''), action_type) AS description, "
    'ts AS "timestamp", coalesce(risk_score, \'low\') AS risk, substr(coalesce(chain_hash, \'\'), 1, 16) AS hash, '
    "coalesce(tokens_used, 0) AS tokens, coalesce(cost_usd, 0) AS cost, coalesce(duration_ms, 0) AS duration"
)
_FLAT_SCREEN = (
    "conv_id, turn, array_to_string(list_transform(hits, lambda h: h.pattern), ',') AS patterns, confidence, "
    "would_block, pattern_count, verdict"
)
_RATIO = "round(passing::DOUBLE / nullif(total, 0), 4)"
_DECISION = {
    "CRITICAL": (
        "requires_approval",
        "ConsentGate:CRITICAL",
        "Obtain human approval before every execution",
    ),
    "HIGH": (
        "requires_approval",
        "ConsentGate:HIGH",
        "Obtain human approval or enable strict audit logging",
    ),
    "MEDIUM": ("allowed_with_logging", "AuditLedger", "Log the action with full context"),
    "LOW": ("allowed", "StandardLogging", "Standard logging is sufficient"),
}
_REVIEW = ("manual_review", "ManualReview", "Review the tool and assign a risk level")


def _decision(i: int) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in _DECISION.items())
    return f"CASE effective_risk {whens} ELSE '{_REVIEW[i]}' END"


def _check(i: int) -> str:
    select = o.finding_select(i, "project, path").replace(f", {i} AS ord", "")
    return o.SIGNALS + select


_TOP = (
    # Shown rows so far decide; the fold keeps the texts and their number.
    "list_reduce(list_prepend({'n': 0, 'r': [], 's': '', 't': ''}, "
    "list_transform(items, lambda f: {'n': 0, 'r': CAST([] AS VARCHAR[]), 's': f.s, 't': f.t})), "
    "lambda a, f: CASE WHEN (f.s = 'fail' AND a.n < 4) OR (f.s = 'warn' AND a.n < 5) "
    "THEN {'n': a.n + 1, 'r': list_append(a.r, f.t), 's': '', 't': ''} ELSE a END)"
)

ORACLE: dict[str, str] = {
    "verdicts_by_role": o.screening()
    + "SELECT role, count(*) FILTER (verdict = 'BLOCKED') AS blocked, count(*) FILTER (verdict = 'SUSPICIOUS') AS suspicious, "
    "count(*) FILTER (verdict = 'CLEAN') AS clean, count(*) AS messages FROM res GROUP BY role",
    "a1_scan_project_files": "WITH named AS (SELECT source AS project, "
    f"replace({o.pick(FILE_NAMES, 'doc_id')}, '{{}}', doc_id::VARCHAR) AS name, "
    f"unnest([{', '.join(o.lit(d) for d in DIRECTORIES)}]) AS dir FROM documents) "
    "SELECT project, dir || name AS path FROM named WHERE ends_with(name, '.py') AND NOT list_bool_or(list_transform("
    f"string_split(dir, '/'), lambda p: p IN ({', '.join(o.lit(n) for n in _SKIPPED)}) OR ends_with(p, '.egg-info')))",
    "a2_scan_file_read": f"WITH {o.CORPUS} SELECT project, path, {_LINES} AS lines FROM corpus",
    "a1_project_tree": "SELECT source AS project, 'pkg/f' || doc_id || '.py' AS path, CAST(NULL AS VARCHAR) AS error "
    "FROM documents WHERE doc_id % 10 <> 3",
    "a1_source_tree": f"WITH {o.CORPUS} SELECT project, 'pkg/f' || doc_id || '.py' AS path, "
    f"octet_length(encode(code)) AS bytes, {_LINES} AS lines, CAST(NULL AS VARCHAR) AS error "
    "FROM corpus WHERE doc_id % 10 <> 3",
    "a2_project_tree_lines": f"WITH {o.CORPUS} SELECT project, 'pkg/f' || doc_id || '.py' AS path, {_LINES} AS lines "
    "FROM corpus WHERE doc_id % 10 <> 3",
    "a3_read_tolerant_utf8": "SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) "
    "|| '(A' || chr(10) || 'B' AS code FROM documents",
    "a4_scan_code_table": o.SCAN + f"SELECT project, path, {o.RESULT} FROM res",
    "a5_event_source": f"WITH {o.EVENTS} SELECT id, agent_id, action_type, ts, tokens_used, cost_usd, duration_ms FROM agent_events",
    "a6_json_sink": o.SCAN
    + "SELECT project, path, to_json({'project': project, 'path': path, 'score': score, 'passing': passing, "
    "'trust_layer_detected': trust_layer_detected})::VARCHAR AS json FROM res",
    "a7_report_sink": o.report(),
    "a8_append_control_event": o.APPENDED
    + "SELECT id, agent_id, action_type, human_summary, raw_action, ts, risk_score, expected_hash AS chain_hash FROM linked",
    "b1_detect_framework": o.SIGNALS
    + f"SELECT project, path, array_to_string({o.FRAMEWORK_LIST}, ',') AS frameworks FROM sig",
    "b2_detect_trust_layer": o.SIGNALS + "SELECT project, path, trust AS trust_layer_detected FROM sig",
    "b3_check_injection": o.screening() + f"SELECT {_FLAT_SCREEN} FROM res",
    "b4_injection_hits_long": o.screening()
    + ", n AS (SELECT conv_id, turn, unnest(range(len(hits))) AS ord, hits FROM res) "
    "SELECT conv_id, turn, ord::INTEGER AS ord, hits[ord + 1].pattern AS pattern, hits[ord + 1].weight AS weight FROM n",
    "b5_classify_risk": f"WITH {o.TOOL_CALLS} SELECT call_id, tool_name, {o.risk_case('tool_name', 'level')} AS risk_level, "
    f"{o.risk_case('tool_name', 'keyword')} AS matched_keyword FROM tool_calls",
    "b6_risk_recommendation": f"WITH {o.TOOL_CALLS}, l AS (SELECT call_id, {o.risk_case('tool_name', 'level')} AS risk_level "
    f"FROM tool_calls) SELECT call_id, risk_level, {o.advice_case('risk_level')} AS recommendation FROM l",
    "b7_event_type_map": f"WITH {o.EVENTS} SELECT id, action_type, coalesce(CASE action_type "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in o.DISPLAY.items())
    + " END, 'tool-use') AS type FROM agent_events",
    "b8_event_projection": f"WITH {o.EVENTS} SELECT {_EVENT_VIEW} FROM agent_events",
    "b9_event_filter": f"WITH {o.EVENTS} SELECT id, agent_id, action_type, ts FROM agent_events "
    "WHERE agent_id = 'agent-7' AND action_type = 'llm_call'",
    "b10_agent_lookup": f"WITH {o.AGENTS} SELECT event_id AS request, 'agent-' || user_id AS agent_id, name, framework, "
    "CASE WHEN a.id IS NULL THEN 'Agent ''agent-' || user_id || ''' not found' END AS error "
    "FROM events e LEFT JOIN agents a ON a.id = 'agent-' || e.user_id",
    "b13_agent_stats_lookup": f"WITH {o.EVENTS}, {o.AGENTS}, {_STATS}, req AS (SELECT c_custkey AS request, "
    "CASE WHEN c_nationkey = 0 THEN 'ghost-' ELSE 'agent-' END || c_custkey AS agent_id FROM customer) "
    "SELECT request, r.agent_id, CASE WHEN a.id IS NOT NULL THEN coalesce(total_events, 0) END AS total_events, "
    "CASE WHEN a.id IS NOT NULL THEN coalesce(total_tokens, 0) END AS total_tokens, "
    "CASE WHEN a.id IS NOT NULL THEN round(coalesce(total_cost, 0), 4) END AS total_cost, last_event, "
    "CASE WHEN a.id IS NULL THEN 'Agent ''' || r.agent_id || ''' not found' END AS error "
    "FROM req r LEFT JOIN agents a ON a.id = r.agent_id LEFT JOIN stats s ON s.agent_id = a.id",
    "b11_strip_comments_docstrings": f"WITH {o.CORPUS} SELECT project, path, {o.bare()} AS bare_code FROM corpus",
    "b12_ai_context_flag": o.SIGNALS
    + "SELECT project, path, ai_imp AS ai_import, ai_new AS ai_construct, ai_chat AS ai_context FROM sig",
    **{f"r{i + 1}_{f[0]}": _check(i) for i, f in enumerate(o.FINDINGS)},
    "j1_fix_join": o.FIXED + "SELECT * FROM fixed",
    "j2_remediation_join": o.trust_layer(),
    "j3_trust_info_join": o.FIXED
    + "SELECT doc_id, f.article, fix_framework, t.package AS trust_package, t.install AS trust_install FROM fixed f "
    "LEFT JOIN templates t ON t.framework = CASE fix_framework WHEN 'rag' THEN 'haystack' ELSE fix_framework END",
    "j4_explain_join": f"WITH {o.REQUESTS}, {o.EXPLAIN_TABLE} SELECT doc_id, a.article, title, summary, requirements, "
    f"components, CASE WHEN e.article IS NULL THEN {o.NOT_COVERED} END AS error "
    "FROM requests a LEFT JOIN explained e ON a.article = e.article",
    "j1_fix_findings": o.OPEN + "SELECT * FROM fixed",
    "j3_trust_findings": o.OPEN
    + "SELECT project, path, f.article, f.name, fix_framework, t.package AS trust_package, t.install AS trust_install "
    "FROM fixed f LEFT JOIN templates t ON t.framework = CASE fix_framework WHEN 'rag' THEN 'haystack' ELSE fix_framework END",
    "j4_explain_findings": o.OPEN
    + "SELECT project, path, p.article, p.name, e.title, summary, requirements, components FROM open p "
    "JOIN explained e ON p.article = e.article",
    "j5_agents_with_stats": f"WITH {o.EVENTS}, {o.AGENTS}, {_STATS} SELECT id, coalesce(name, id) AS name, "
    "coalesce(framework, 'custom') AS framework, coalesce(status, 'active') AS status, "
    "coalesce(total_events, 0) AS total_events, coalesce(total_tokens, 0) AS total_tokens, "
    "round(coalesce(total_cost, 0), 4) AS total_cost, last_event FROM agents LEFT JOIN stats ON id = agent_id",
    "j6_model_or_rules": o.SCAN
    + ", model AS (SELECT sha256(code) AS h, max('quality ' || coalesce(quality::VARCHAR, '?') || ', toxic ' || "
    "coalesce(toxic::VARCHAR, '?')) AS analysis FROM corpus JOIN labels USING (doc_id) GROUP BY 1) "
    "SELECT project, path, CASE WHEN analysis IS NULL THEN 'rule-based (no model analysis)' ELSE 'model' END AS source, "
    "analysis, score FROM res JOIN corpus c USING (project, path) LEFT JOIN model ON sha256(c.code) = h",
    "g1_scan_summary": o.SCAN
    + "SELECT project, path, total_checks, passing, warnings, failing, score FROM res",
    "g2_project_scan_merged": o.MERGED + f"SELECT project, {o.RESULT} FROM res",
    "g3_project_scan_rollup": o.rollup() + f"SELECT project, {o.RESULT} FROM res",
    "g4_project_files": f"WITH {o.CORPUS}, l AS (SELECT project, path, {_LINES} AS lines, "
    "row_number() OVER (PARTITION BY project ORDER BY path) AS rn FROM corpus) SELECT project, count(*) AS files_scanned, "
    "string_agg(path || '=' || lines, ',' ORDER BY path) FILTER (rn <= 20) AS files FROM l GROUP BY project",
    "g5_findings_by_article": o.SCAN
    + "SELECT project, path, article, CASE article "
    + " ".join(f"WHEN {a} THEN {o.lit(t)}" for a, t in o.TITLES.items())
    + " END AS title, count(*)::INTEGER AS checks, count(*) FILTER (status = 'pass')::INTEGER AS passing, "
    "string_agg(status || ':' || severity || ':' || name || ':' || evidence, '|' ORDER BY ord) AS findings "
    "FROM fnd GROUP BY project, path, article",
    "g6_compliance_report": o.report(),
    "g7_agent_stats": f"WITH {o.EVENTS}, {_STATS} SELECT agent_id, total_events, total_tokens, "
    "round(total_cost, 4) AS total_cost, last_event FROM stats",
    "g8_health_totals": f"WITH {o.EVENTS}, {o.AGENTS} SELECT 'ok' AS status, (SELECT count(*) FROM agents) AS agents, "
    "(SELECT count(*) FROM agent_events WHERE agent_id IN (SELECT id FROM agents)) AS events",
    "w1_verify_chain": o.TAMPERED
    + "SELECT agent_id AS scope, count(*) AS events, count(*) FILTER (NOT ok) AS broken, bool_and(ok) AS valid, "
    "CASE WHEN bool_and(ok) THEN 'Chain intact' ELSE 'Chain broken - possible tampering detected' END AS message "
    "FROM checked GROUP BY agent_id",
    "w1_verify_chain_all": f"WITH {o.EVENTS}, linked AS ({o.links('agent_events')}), again AS ("
    + o.links("(SELECT * EXCLUDE (digest, expected_hash, chain_hash), expected_hash AS chain_hash FROM linked)")
    + "), v AS (SELECT bool_and(chain_hash IS NOT DISTINCT FROM expected_hash) AS ok FROM again) SELECT 'all' AS scope, "
    "ok AS valid, CASE WHEN ok THEN 'Chain intact' ELSE 'Chain broken - possible tampering detected' END AS message FROM v",
    "w2_chain_breaks": o.TAMPERED + "SELECT agent_id, id FROM checked WHERE NOT ok",
    "w3_build_chain": f"WITH {o.EVENTS}, linked AS ({o.links('agent_events')}) "
    "SELECT agent_id, id, expected_hash AS chain_hash FROM linked",
    "w4_agent_status": f"WITH {o.EVENTS}, {o.AGENTS}, ctl AS (SELECT agent_id, action_type, ts, "
    "row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, id DESC) AS rn FROM agent_events "
    "WHERE action_type IN ('kill_switch', 'resumed')) SELECT a.id, coalesce(CASE c.action_type WHEN 'kill_switch' THEN "
    "'paused' WHEN 'resumed' THEN 'active' END, a.status, 'active') AS status, c.ts AS changed_at "
    "FROM agents a LEFT JOIN ctl c ON c.agent_id = a.id AND rn = 1",
    "w5_verify_after_append": o.AFTER_APPEND
    + "SELECT log, agent_id AS scope, count(*) AS events, count(*) FILTER (NOT ok) AS broken, bool_and(ok) AS valid, "
    "CASE WHEN bool_and(ok) THEN 'Chain intact' ELSE 'Chain broken - possible tampering detected' END AS message "
    "FROM checked GROUP BY log, agent_id",
    "l1_event_page_repeated": f"WITH {o.EVENTS}, coarse AS (SELECT * REPLACE (CAST(id // 4 AS BIGINT) AS id, "
    "date_trunc('day', ts)::TIMESTAMP AS ts) FROM agent_events), page AS (SELECT * FROM coarse ORDER BY ts DESC, id DESC, "
    "agent_id NULLS FIRST, action_type NULLS FIRST, human_summary NULLS FIRST, raw_action NULLS FIRST, "
    "risk_score NULLS FIRST, tokens_used NULLS FIRST, cost_usd NULLS FIRST, duration_ms NULLS FIRST, "
    f"chain_hash NULLS FIRST LIMIT 50 OFFSET 7) SELECT {_EVENT_VIEW} FROM page",
    "l1_event_page": f"WITH {o.EVENTS}, page AS (SELECT * FROM agent_events ORDER BY ts DESC, id DESC LIMIT 100) "
    f"SELECT {_EVENT_VIEW} FROM page",
    "l1_event_page_deep": f"WITH {o.EVENTS}, page AS (SELECT * FROM agent_events ORDER BY ts DESC, id DESC "
    f"LIMIT 50 OFFSET 9970) SELECT {_EVENT_VIEW} FROM page",
    "l2_article_sort": o.SCAN
    + "SELECT article, count(*) AS checks, count(*) FILTER (status = 'pass') AS passing FROM fnd GROUP BY article ORDER BY article",
    "l3_top_findings": o.SCAN
    + ", li AS (SELECT project, path, list({'s': status, 't': status || ':' || severity || ':' || name || ':' || evidence} "
    f"ORDER BY ord) AS items FROM fnd GROUP BY project, path) SELECT project, path, array_to_string(({_TOP}).r, '|') AS shown FROM li",
    "l4_top_patterns": o.screening()
    + "SELECT conv_id, turn, array_to_string(list_transform(hits[1:3], lambda h: h.pattern), ',') AS top_patterns FROM res",
    "s1_stream_screen": o.screening() + f"SELECT {_FLAT_SCREEN} FROM res",
    "s2_stream_agent_stats": f"WITH {o.EVENTS}, {_STATS} SELECT agent_id, total_events, total_tokens, "
    "round(total_cost, 4) AS total_cost, last_event FROM stats",
    "x1_gdpr_rules": _pack(_GDPR),
    "x2_bias_rules": _pack(_BIAS),
    "x3_validate_actions": f"WITH {o.TOOL_CALLS}, e AS (SELECT call_id, coalesce(nullif(upper(trim(risk_override)), ''), "
    f"{o.risk_case('tool_name', 'level')}) AS effective_risk FROM tool_calls) SELECT call_id, effective_risk, "
    f"{_decision(0)} AS approval_status, {_decision(1)} AS required_policy, {_decision(2)} AS remediation FROM e",
    "x4_history_list": f"WITH {o.HISTORY} SELECT project, scan_id, scanned_at, passing || '/' || total AS score, "
    f"{_RATIO} AS score_ratio FROM history ORDER BY scanned_at DESC, scan_id DESC",
    "x5_history_trend": f"WITH {o.HISTORY}, r AS (SELECT project, scan_id, scanned_at, {_RATIO} AS score_ratio FROM history), "
    "p AS (SELECT *, lag(score_ratio) OVER w AS previous_ratio, row_number() OVER w AS rn FROM r "
    "WINDOW w AS (PARTITION BY project ORDER BY scanned_at, scan_id)) SELECT project, scan_id, scanned_at, score_ratio, "
    "previous_ratio, round(score_ratio - previous_ratio, 4) AS delta, CASE WHEN rn = 1 THEN 'first' "
    "WHEN round(score_ratio - previous_ratio, 4) > 0 THEN 'improving' WHEN round(score_ratio - previous_ratio, 4) < 0 "
    "THEN 'declining' ELSE 'stable' END AS direction FROM p",
    "x6_history_score": f"WITH {o.HISTORY}, n AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY scanned_at DESC, "
    "scan_id DESC) AS rn, count(*) OVER (PARTITION BY project) AS scans FROM history) SELECT project, scan_id, scanned_at, "
    f"passing || '/' || total AS score, {_RATIO} AS score_ratio, scans FROM n WHERE rn = 1",
}
_MESSAGE = "CASE WHEN {} THEN 'Chain intact' ELSE 'Chain broken - possible tampering detected' END AS message"
ORACLE |= {
    "a4_scan_changed": ORACLE["a4_scan_code_table"],
    "a8_append_by_heads": ORACLE["a8_append_control_event"],
    "w6_truncated_log": f"WITH {o.EVENTS}, r AS (SELECT agent_id, CAST(substr(agent_id, 7) AS BIGINT) % 3 = 0 AS cut, "
    "row_number() OVER (PARTITION BY agent_id ORDER BY ts DESC, id DESC) AS rn FROM agent_events), "
    "v AS (SELECT agent_id AS scope, count(*) FILTER (NOT (cut AND rn = 1)) AS events, count(*) AS anchored, "
    f"NOT bool_or(cut) AS valid FROM r GROUP BY agent_id) SELECT *, {_MESSAGE.format('valid')} FROM v",
    "w7_agent_status_online": ORACLE["w4_agent_status"],
    "l1_event_page_log": f"WITH {o.EVENTS}, page AS (SELECT * FROM agent_events ORDER BY ts DESC, id DESC "
    f"LIMIT 50 OFFSET 470) SELECT * EXCLUDE (hash) FROM (SELECT {_EVENT_VIEW} FROM page)",
    "s3_stream_replayed": ORACLE["s2_stream_agent_stats"],
    "x7_history_as_of": ORACLE["x4_history_list"].replace(" FROM history ", " FROM history WHERE scan_id % 3 <> 0 "),
}
