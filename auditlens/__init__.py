"""Compliance and agent-audit analytics on Spark DataFrames."""

from auditlens.operators.agents import (
    agent_lookup,
    agent_stats,
    agent_status,
    agents_with_stats,
    control_events,
    event_page,
    health_totals,
)
from auditlens.operators.chain import build_chain, chain_breaks, verify_agents, verify_chain
from auditlens.operators.findings import explode_findings, run_check, scan_code, top_findings
from auditlens.operators.history import compliance_history
from auditlens.operators.projects import project_files, project_scan_merged, project_scan_rollup
from auditlens.operators.remediation import (
    add_trust_layer,
    explain_article,
    model_or_rules,
    suggest_fix,
    with_trust_info,
)
from auditlens.operators.report import compliance_report, findings_by_article
from auditlens.operators.risk import classify_risk, validate_actions
from auditlens.operators.rulepacks import scan_bias, scan_gdpr
from auditlens.operators.scan import scan_files, scan_projects
from auditlens.operators.screen import check_injection, injection_hits
from auditlens.operators.signals import detect_framework, detect_trust_layer

__all__ = [
    "add_trust_layer",
    "agent_lookup",
    "agent_stats",
    "agent_status",
    "agents_with_stats",
    "build_chain",
    "chain_breaks",
    "check_injection",
    "classify_risk",
    "compliance_history",
    "compliance_report",
    "control_events",
    "detect_framework",
    "detect_trust_layer",
    "event_page",
    "explain_article",
    "explode_findings",
    "findings_by_article",
    "health_totals",
    "injection_hits",
    "model_or_rules",
    "project_files",
    "project_scan_merged",
    "project_scan_rollup",
    "run_check",
    "scan_bias",
    "scan_code",
    "scan_files",
    "scan_gdpr",
    "scan_projects",
    "suggest_fix",
    "top_findings",
    "validate_actions",
    "verify_agents",
    "verify_chain",
    "with_trust_info",
]
