"""The agent registry and its event log: filters, projections, statistics, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.operators.ordering import with_position

# Logged action types and the type they are shown as.
DISPLAY_TYPES: dict[str, str] = {
    "llm_call": "llm-call",
    "llm_error": "llm-call",
    "tool_use": "tool-use",
    "tool_error": "tool-use",
    "api_call": "api-request",
    "email_sent": "email",
    "file_access": "file",
    "database": "database",
    "web_search": "web-search",
    "function_call": "tool-use",
    "chain_end": "tool-use",
    "chain_error": "tool-use",
    "agent_action": "tool-use",
    "agent_finish": "tool-use",
    "retrieval": "database",
    "analysis": "llm-call",
    "decision": "llm-call",
    "error": "api-request",
    "kill_switch": "api-request",
    "resumed": "api-request",
    "session_end": "tool-use",
    "ticket_received": "api-request",
}
DEFAULT_DISPLAY_TYPE = "tool-use"
CONTROL_STATUS = {"kill_switch": "paused", "resumed": "active"}
EVENT_FIELDS = (
    "id",
    "agent_id",
    "action_type",
    "human_summary",
    "raw_action",
    "ts",
    "risk_score",
    "tokens_used",
    "cost_usd",
    "duration_ms",
    "chain_hash",
)


def display_type(action: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in DISPLAY_TYPES.items() for x in pair])
    return F.coalesce(F.element_at(table, action), F.lit(DEFAULT_DISPLAY_TYPE))


def with_display_type(events: DataFrame) -> DataFrame:
    return events.withColumn("type", display_type(F.col("action_type")))


def project_events(events: DataFrame) -> DataFrame:
    """The shape a dashboard shows: first non-empty description, short hash, defaults for nulls."""
    return events.select(
        "id",
        F.col("agent_id").alias("agent"),
        display_type(F.col("action_type")).alias("type"),
        F.coalesce(
            F.nullif("human_summary", F.lit("")), F.nullif("raw_action", F.lit("")), "action_type"
        ).alias("description"),
        F.col("ts").alias("timestamp"),
        F.coalesce("risk_score", F.lit("low")).alias("risk"),
        F.substring(F.coalesce("chain_hash", F.lit("")), 1, 16).alias("hash"),
        F.coalesce("tokens_used", F.lit(0)).alias("tokens"),
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost"),
        F.coalesce("duration_ms", F.lit(0)).alias("duration"),
    )


def filter_events(events: DataFrame, agent: str | None = None, action_type: str | None = None) -> DataFrame:
    """Both filters are optional equalities and reach the scan."""
    if agent is not None:
        events = events.where(F.col("agent_id") == agent)
    if action_type is not None:
        events = events.where(F.col("action_type") == action_type)
    return events


def event_page(
    events: DataFrame,
    agent: str | None = None,
    action_type: str | None = None,
    limit: int = 100,
    offset: int = 0,
) -> DataFrame:
    """One page of projected events, newest first (time, then id, both descending).

    The page is found by row position among narrow (ts, id) rows, however deep it lies;
    then only events between its first and last key are read.  Events that share a key
    follow in the order of their other fields, so pages neither overlap nor leave gaps.
    """
    chosen = filter_events(events, agent, action_type)
    placed = with_position(chosen.select("ts", "id"), ["ts", "id"])
    key = F.struct("ts", "id")
    last = placed.agg(F.max("position")).scalar()
    low, high = last - F.lit(offset + limit) + 1, last - F.lit(offset)
    ends = placed.where(F.col("position").between(low, high)).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    bounds = ends.first()  # two keys
    if limit <= 0 or bounds["high"] is None:
        return project_events(chosen.limit(0))
    first, final = (F.struct(*[F.lit(bounds[b][c]).alias(c) for c in ("ts", "id")]) for b in ("low", "high"))
    # Rows of the newest key that belong to the page before this one.
    skipped = placed.agg(F.count_if(key > final).alias("above")).first()
    within = chosen.where(
        F.col("ts").between(F.lit(bounds["low"]["ts"]), F.lit(bounds["high"]["ts"])) & (key >= first) & (key <= final)
    )
    ties = [F.col(c) for c in chosen.columns if c not in ("ts", "id")]
    ordered = within.orderBy(F.col("ts").desc(), F.col("id").desc(), *ties)
    page = ordered.offset(max(0, offset - skipped["above"])).limit(limit)
    return project_events(page)


def agent_lookup(agents: DataFrame, agent_id: str) -> DataFrame:
    """The agent with this id; no row means it is not known."""
    return agents.where(F.col("id") == agent_id)


def agent_lookups(agents: DataFrame, requests: DataFrame) -> DataFrame:
    """Many lookups at once: each request with the agent found or an error text."""
    known = agents.select(F.col("id").alias("agent_id"), "name", "framework", F.lit(True).alias("__known"))
    joined = requests.join(known, "agent_id", "left")
    missing = F.concat(F.lit("Agent '"), F.col("agent_id"), F.lit("' not found"))
    return joined.select(
        *requests.columns, "name", "framework", F.when(F.col("__known").isNull(), missing).alias("error")
    )


def agent_stats(events: DataFrame) -> DataFrame:
    """Totals per agent; aggregated within each task before the shuffle."""
    return events.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("total_events"),
        F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost"),
        F.max("ts").alias("last_event"),
    )


def agent_stats_lookups(agents: DataFrame, events: DataFrame, requests: DataFrame) -> DataFrame:
    """Many requests for one agent's totals: each with the totals, or an error text for an unknown agent."""
    totals = agents_with_stats(agents, events).select(
        F.col("id").alias("agent_id"),
        "total_events",
        "total_tokens",
        "total_cost",
        "last_event",
        F.lit(True).alias("__known"),
    )
    missing = F.concat(F.lit("Agent '"), F.col("agent_id"), F.lit("' not found"))
    return requests.join(totals, "agent_id", "left").select(
        *requests.columns,
        "total_events",
        "total_tokens",
        "total_cost",
        "last_event",
        F.when(F.col("__known").isNull(), missing).alias("error"),
    )


def agents_with_stats(agents: DataFrame, events: DataFrame) -> DataFrame:
    """Every agent with its totals; zeros when it has no events.

    Events are reduced to one row per agent before the join.
    """
    stats = agent_stats(events).withColumnRenamed("agent_id", "id")
    return agents.join(stats, "id", "left").select(
        "id",
        F.coalesce("name", "id").alias("name"),
        F.coalesce("framework", F.lit("custom")).alias("framework"),
        F.coalesce("status", F.lit("active")).alias("status"),
        F.coalesce("total_events", F.lit(0)).alias("total_events"),
        F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
        F.coalesce("total_cost", F.lit(0.0)).alias("total_cost"),
        "last_event",
    )


def health_totals(agents: DataFrame, events: DataFrame) -> DataFrame:
    """One row: number of agents and of events that belong to a known agent."""
    return agents_with_stats(agents, events).agg(
        F.lit("ok").alias("status"),
        F.count(F.lit(1)).alias("agents"),
        F.coalesce(F.sum("total_events"), F.lit(0)).alias("events"),
    )


def agent_status(agents: DataFrame, events: DataFrame) -> DataFrame:
    """Current status: that of the last control event, else the stored one, else active."""
    control = events.where(F.col("action_type").isin(*CONTROL_STATUS))
    last = control.groupBy(F.col("agent_id").alias("id")).agg(
        F.max_by("action_type", F.struct("ts", F.col("id"))).alias("last_control"),
        F.max("ts").alias("changed_at"),
    )
    return with_status(agents, last)


def with_status(agents: DataFrame, last: DataFrame) -> DataFrame:
    """Registered agents with the status that their last control event (id, last_control, changed_at) gives."""
    table = F.create_map(*[F.lit(x) for pair in CONTROL_STATUS.items() for x in pair])
    return agents.join(last, "id", "left").select(
        "id",
        F.coalesce(F.element_at(table, F.col("last_control")), "status", F.lit("active")).alias("status"),
        "changed_at",
    )


def control_events(requests: DataFrame, agents: DataFrame) -> DataFrame:
    """Pause and resume requests as event rows, for an append to the log.

    `requests` has id, agent_id, action (`pause` or `resume`) and ts.  Requests for
    unknown agents make no event.  Status is never stored; it follows from the log.
    In a chained log, link the events with `chain.extend_chain` before the append.
    """
    known = agents.select(F.col("id").alias("agent_id"))
    valid = requests.join(known, "agent_id", "left_semi")
    pausing = F.col("action") == "pause"
    # The texts of control events.
    verb = F.when(pausing, "paused").otherwise("resumed")
    columns = {
        "action_type": F.when(pausing, "kill_switch").otherwise("resumed"),
        "human_summary": F.concat(
            F.lit("Agent '"), F.col("agent_id"), F.lit("' "), verb, F.lit(" from dashboard")
        ),
        "raw_action": F.concat(F.lit("Agent "), verb, F.lit(" via dashboard")),
        "risk_score": F.when(pausing, "medium"),
        "tokens_used": F.lit(None).cast("long"),
        "cost_usd": F.lit(None).cast("double"),
        "duration_ms": F.lit(None).cast("long"),
        "chain_hash": F.lit(None).cast("string"),
    }
    return valid.select(
        *[columns.get(f, F.col(f) if f in requests.columns else F.lit(None)).alias(f) for f in EVENT_FIELDS]
    )
