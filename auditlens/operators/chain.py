"""Tamper-evident event chains: build, verify and locate breaks.

The hash recipe is this library's own, on HMAC-SHA256:

    digest(e)     = SHA-256 of the canonical text of the event's fields
    chain_hash(e) = HMAC(key, digest of the agent's previous event + digest(e)),
                    with "genesis" in place of the previous digest for the first event

Events of an agent are ordered by time, then id.  An edit, a removed or inserted
event and a changed order all break at least one link, and no valid link can be
made without the key.  Removing the newest events leaves a shorter valid chain;
`chain_log` keeps the records that show it.

Each link needs its neighbour's digest only, so building and verifying run in
parallel over the rows of one agent however many it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.functions.hashing import canonical_text, exact_number, hmac_sha256, key_pads
from auditlens.operators.ordering import with_previous

GENESIS = "genesis"
ORDER = ("ts", "id")


def event_digest() -> Column:
    return F.sha2(
        canonical_text(
            [
                F.col("agent_id"),
                F.col("id"),
                F.col("action_type"),
                F.col("human_summary"),
                F.col("raw_action"),
                F.date_format("ts", "yyyyMMddHHmmssSSSSSS"),
                F.col("risk_score"),
                F.col("tokens_used"),
                exact_number(F.col("cost_usd")),
                F.col("duration_ms"),
            ]
        ),
        256,
    )


def _with_previous_digest(events: DataFrame, keep: list[str]) -> DataFrame:
    narrow = events.select("agent_id", *ORDER, *keep, event_digest().alias("digest"))
    return with_previous(narrow, "agent_id", ORDER, {"previous_digest": "digest"})


def _link(events: DataFrame, key: bytes, previous: Column) -> Column:
    return hmac_sha256(F.concat(previous, F.col("digest")), key_pads(events.sparkSession, key))


def expected_links(events: DataFrame, key: bytes, keep: list[str]) -> DataFrame:
    """agent_id, ts, id, the kept columns, and the hash each event should carry.

    Only keys, digests and kept columns travel through the sort.
    """
    linked = _with_previous_digest(events, keep)
    expected = _link(events, key, F.coalesce("previous_digest", F.lit(GENESIS)))
    return linked.select("agent_id", *ORDER, *keep, "has_previous", expected.alias("expected_hash"))


def build_chain(events: DataFrame, key: bytes, keep: list[str] | None = None) -> DataFrame:
    """Event ids, the kept columns and the chain_hash of each event.

    With all columns of the events kept, this is the chained log itself and needs no join.
    """
    keep = [c for c in keep or [] if c not in ("agent_id", *ORDER, "chain_hash")]
    return expected_links(events, key, keep).select(
        "agent_id", *ORDER, *keep, F.col("expected_hash").alias("chain_hash")
    )


def extend_chain(stored: DataFrame, new: DataFrame, key: bytes) -> DataFrame:
    """The new events with a chain_hash that links them to their agent's last stored event.

    Stored events keep their hashes; of them one narrow row per agent is needed.  A new
    event that is not later than its agent's last stored one cannot be appended to a
    chain and fails the job.
    """
    place = F.struct(*ORDER)
    last = stored.groupBy("agent_id").agg(
        F.max_by(event_digest(), place).alias("last_digest"), F.max(place).alias("last_place")
    )
    keep = [c for c in new.columns if c not in ("agent_id", *ORDER, "chain_hash")]
    joined = _with_previous_digest(new, keep).join(last, "agent_id", "left")
    late = F.concat(F.lit("not later than the last stored event of its agent: event "), F.col("id").cast("string"))
    digest = F.coalesce("previous_digest", "last_digest", F.lit(GENESIS))
    previous = F.when(place <= F.col("last_place"), F.raise_error(late).cast("string")).otherwise(digest)
    linked = joined.withColumn("chain_hash", _link(new, key, previous))
    return linked.select(*[c for c in new.columns if c != "chain_hash"], "chain_hash")


def chain_breaks(events: DataFrame, key: bytes) -> DataFrame:
    """Events whose stored hash is missing or is not the expected one."""
    links = expected_links(events, key, ["chain_hash"])
    return links.where(~F.col("chain_hash").eqNullSafe(F.col("expected_hash")))


def verdict_columns(valid: Column) -> list[Column]:
    # The two messages.
    message = F.when(valid, "Chain intact").otherwise("Chain broken - possible tampering detected")
    return [valid.alias("valid"), message.alias("message")]


def verify_chain(events: DataFrame, key: bytes, agent_id: str | None = None) -> DataFrame:
    """One row: valid, scope (the agent or `all`), message.  No events is a valid chain."""
    scoped = events if agent_id is None else events.where(F.col("agent_id") == agent_id)
    ok = F.col("chain_hash").eqNullSafe(F.col("expected_hash"))
    total = expected_links(scoped, key, ["chain_hash"]).agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("ok"))
    return total.select(F.lit(agent_id or "all").alias("scope"), *verdict_columns(F.col("ok")))


def verify_agents(events: DataFrame, key: bytes) -> DataFrame:
    """The verdict for every agent at once, with the number of broken links."""
    ok = F.col("chain_hash").eqNullSafe(F.col("expected_hash"))
    per_agent = (
        expected_links(events, key, ["chain_hash"])
        .groupBy("agent_id")
        .agg(F.count(F.lit(1)).alias("events"), F.count_if(~ok).alias("broken"))
    )
    return per_agent.select(
        F.col("agent_id").alias("scope"), "events", "broken", *verdict_columns(F.col("broken") == 0)
    )
