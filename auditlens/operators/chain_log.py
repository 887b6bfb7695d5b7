"""A stored event log that is chained as it grows, with heads, anchors and a page index.

Every append is one commit of four parts:

    events    the new events, each linked to its agent's event before it, in files by (ts, id)
    heads     of each agent that has new events, the place and digest of the last one
    anchors   per agent, a keyed record of what this append added: how many events, the digest before
              them, and the root of a hash trie over their chain hashes
    index     per file, its rows and its first and last (ts, id)

An append reads heads and its own events, never the log.  Anchors are chained to each other,
so that events cut off at the end are missed as well as edited ones, and a check can be
confined to the appends after the last one that was found good.  Whoever removes whole commits
with their anchors has to be found by `seal`, a value to be kept elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlens.functions.hashing import canonical_text, hmac_sha256, key_pads
from auditlens.operators.agents import EVENT_FIELDS, control_events, project_events
from auditlens.operators.chain import GENESIS, ORDER, event_digest, verdict_columns
from auditlens.operators.ordering import PIECE, with_previous
from auditlens.session import cut_lineage
from auditlens.sources.commits import CommittedTable
from auditlens.sources.tables import EVENT_SCHEMA

HEAD_SCHEMA = (
    "agent_id string, last_ts timestamp_ntz, last_id long, last_digest string, events long, last_anchor string, version int"
)
ANCHOR_SCHEMA = (
    "agent_id string, version int, first_place long, events long, before_digest string, depth int, root string, "
    "previous_anchor string, anchor string"
)
INDEX_SCHEMA = "file string, rows long, low struct<ts timestamp_ntz, id long>, high struct<ts timestamp_ntz, id long>"
#: Every so many appends the heads of all agents are written, so that a reader opens this many folders at most.
HEADS_EVERY = 16
#: Hashes of a leaf of the trie, about.
LEAF = 256


def trie_roots(rows: DataFrame, unit: str, depth: int) -> DataFrame:
    """(unit, root): a hash trie over the column `chain_hash` of each unit.

    Leaves take the hashes that begin with the same `depth` hex digits, in order; a node
    above takes its up to 16 children.  Hashes are spread evenly, so no task holds a unit.
    A missing hash counts as an empty one.
    """
    value = F.coalesce("chain_hash", F.lit(""))
    nodes = rows.select(unit, value.alias("node"), F.substring(value, 1, depth).alias("prefix"))
    for level in range(depth, -1, -1):
        nodes = (
            nodes.groupBy(unit, "prefix")
            .agg(F.sha2(F.array_join(F.array_sort(F.collect_list("node")), ","), 256).alias("node"))
            .select(
                unit,
                F.concat_ws(":", "prefix", "node").alias("node"),
                F.substring("prefix", 1, max(level - 1, 0)).alias("prefix"),
            )
        )
    return nodes.select(unit, F.substring_index("node", ":", -1).alias("root"))


def _depth(largest: int) -> int:
    depth = 0
    while LEAF * 16**depth < largest:
        depth += 1
    return depth


def _unit(*columns: str) -> Column:
    """One text for several columns, null told from empty; digits of a hash come first, as sorts look at the first bytes."""
    digits = F.substring(F.reverse(F.hex(F.xxhash64(*columns))), 1, 6)
    return F.concat(digits, F.lit(":"), canonical_text([F.col(c) for c in columns]))


class ChainLog:
    """A log below `root`.  The key reaches queries as data and is not printed in plans."""

    def __init__(self, spark: SparkSession, root: str, key: bytes):
        self.spark, self.key = spark, key
        self.table = CommittedTable(spark, root)

    # -- reading -----------------------------------------------------------------

    def _parts(self, as_of: int | None, after: int = 0) -> list[dict]:
        return [p for p in self.table.parts(as_of) if p["version"] > after]

    def _read(self, kind: str, schema, parts: list[dict]) -> DataFrame:
        folders = [p[kind] for p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def events(self, as_of: int | None = None, after: int = 0) -> DataFrame:
        """The events of the appends after `after`, with the version that added them."""
        schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField("version", T.IntegerType())])
        return self._read("events", schema, self._parts(as_of, after))

    def heads(self, as_of: int | None = None) -> DataFrame:
        """One row per agent: its last place and digest, its number of events and its last anchor."""
        parts = self._parts(as_of)
        full = max((i for i, p in enumerate(parts) if p["full"]), default=0)
        rows = self._read("heads", HEAD_SCHEMA, parts[full:])
        columns = [c for c in rows.columns if c != "agent_id"]
        newest = rows.groupBy("agent_id").agg(F.max_by(F.struct(*columns), "version").alias("head"))
        return newest.select("agent_id", "head.*")

    def anchors(self, as_of: int | None = None, after: int = 0) -> DataFrame:
        return self._read("anchors", ANCHOR_SCHEMA, self._parts(as_of, after))

    def index(self, as_of: int | None = None) -> DataFrame:
        return self._read("index", INDEX_SCHEMA, self._parts(as_of))

    def seal(self, as_of: int | None = None) -> str:
        """A keyed value for the whole log; kept elsewhere, it shows later whether appends were removed."""
        heads = self.heads(as_of).select(F.lit("all").alias("unit"), F.col("last_anchor").alias("chain_hash"))
        root = trie_roots(cut_lineage(heads), "unit", _depth(heads.count()))
        sealed = root.select(hmac_sha256(F.col("root"), key_pads(self.spark, self.key)).alias("seal")).first()
        return sealed["seal"] if sealed else ""

    # -- appending ---------------------------------------------------------------

    def append(self, new: DataFrame) -> DataFrame:
        """Link and commit the new events; returns those left out, with an error text.

        An event that is not later than its agent's last stored one cannot follow it and is
        left out; the others are appended.  If another writer commits first, the links are
        made again from the new heads.
        """
        fields = [F.col(c) if c in new.columns else F.lit(None).alias(c) for c in EVENT_FIELDS if c != "chain_hash"]
        # Written once: the events are judged against the heads and linked from the same rows.
        rows = cut_lineage(new.select(*fields))
        refused: list[DataFrame] = []

        def write(version: int) -> dict:
            added, late = self._write(rows, version)
            refused[:] = [late]
            return added

        self.table.add(write)
        return refused[0]

    def control(self, requests: DataFrame, agents: DataFrame) -> DataFrame:
        """Pause and resume in one step: events are made of the requests for known agents, linked and committed."""
        return self.append(control_events(requests, agents))

    def _write(self, rows: DataFrame, version: int) -> tuple[dict, DataFrame]:
        heads = self.heads(version - 1).withColumnRenamed("agent_id", "__agent")
        joined = rows.join(heads, rows["agent_id"].eqNullSafe(heads["__agent"]), "left").drop("__agent")
        late = F.coalesce(F.struct(*ORDER) <= F.struct("last_ts", "last_id"), F.lit(False))
        error = F.concat(F.lit("not later than the last stored event of its agent: event "), F.col("id").cast("string"))
        refused = joined.where(late).select(*[c for c in rows.columns], error.alias("error"))
        accepted = joined.where(~late).withColumn("digest", event_digest())
        # Keys are sized on all rows, without the join with the heads.
        linked = with_previous(accepted, "agent_id", ORDER, {"previous_digest": "digest"}, sized=rows)
        before = F.coalesce("previous_digest", "last_digest", F.lit(GENESIS))
        pads = key_pads(self.spark, self.key)
        chained = linked.withColumn("chain_hash", hmac_sha256(F.concat(before, F.col("digest")), pads))
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        added = {kind: self.table.new_folder(kind) for kind in ("events", "heads", "anchors", "index")}
        # Files hold one range of (ts, id) each, which pages rely on.
        ordered = cut_lineage(chained.select(*EVENT_FIELDS, F.lit(version).alias("version"), "digest"))
        ordered.drop("digest").repartitionByRange(n, *ORDER).sortWithinPartitions(*ORDER).write.parquet(added["events"])
        schema = T.StructType([*EVENT_SCHEMA.fields, T.StructField("version", T.IntegerType())])
        stored = self.spark.read.schema(schema).parquet(added["events"])
        self._write_index(stored, added["index"])
        place = F.struct(*ORDER)
        totals = cut_lineage(
            ordered.groupBy("agent_id").agg(
                F.count(F.lit(1)).alias("n"),
                F.max(place).alias("last"),
                F.max_by("digest", place).alias("digest"),
            )
        )
        depth = _depth(totals.agg(F.max("n")).first()[0] or 0)
        roots = trie_roots(stored.withColumn("unit", _unit("agent_id")), "unit", depth)
        known = totals.join(heads, totals["agent_id"].eqNullSafe(heads["__agent"]), "left").withColumn(
            "unit", _unit("agent_id")
        )
        anchors = known.join(roots, "unit").select(
            "agent_id",
            F.lit(version).alias("version"),
            F.coalesce("events", F.lit(0)).cast("long").alias("first_place"),
            F.col("n").alias("events"),
            F.coalesce("last_digest", F.lit(GENESIS)).alias("before_digest"),
            F.lit(depth).alias("depth"),
            "root",
            F.coalesce("last_anchor", F.lit(GENESIS)).alias("previous_anchor"),
            "last",
            "digest",
        )
        anchors = cut_lineage(anchors.withColumn("anchor", hmac_sha256(_anchored(), pads)))
        anchors.select(*T._parse_datatype_string(ANCHOR_SCHEMA).names).write.parquet(added["anchors"])
        changed = anchors.select(
            "agent_id",
            F.col("last.ts").alias("last_ts"),
            F.col("last.id").alias("last_id"),
            F.col("digest").alias("last_digest"),
            (F.col("first_place") + F.col("events")).alias("events"),
            F.col("anchor").alias("last_anchor"),
            "version",
        )
        full = version % HEADS_EVERY == 0
        if full:
            others = self.heads(version - 1).join(
                changed.select(F.col("agent_id").alias("__a")), F.col("agent_id").eqNullSafe(F.col("__a")), "left_anti"
            )
            changed = changed.unionByName(others)
        changed.write.parquet(added["heads"])
        return added | {"full": full}, refused

    def _write_index(self, stored: DataFrame, folder: str) -> None:
        key = F.struct(*ORDER)
        per_file = stored.groupBy(F.input_file_name().alias("file")).agg(
            F.count(F.lit(1)).alias("rows"), F.min(key).alias("low"), F.max(key).alias("high")
        )
        per_file.coalesce(1).write.parquet(folder)

    # -- checking ----------------------------------------------------------------

    def verify(self, events: DataFrame | None = None, after: int = 0, as_of: int | None = None) -> DataFrame:
        """The verdict for every agent: scope, events, anchored, valid, message.

        `events` is a log to check, as `events()` gives it; the stored one by default.  Only the
        appends after `after`, the last version found good, are read and checked.  An agent is
        intact if each link fits, its events are exactly those its anchors record, and its
        anchors are whole and follow each other.  `anchored` is how many events there should be.
        """
        found = self.events(as_of, after) if events is None else events.where(F.col("version") > after)
        anchors = self.anchors(as_of, after)
        pads = key_pads(self.spark, self.key)
        narrow = cut_lineage(
            found.select(
                "agent_id", "version", *ORDER, "chain_hash", event_digest().alias("digest"), _unit("agent_id", "version").alias("unit")
            )
        )
        linked = with_previous(narrow, "unit", ORDER, {"previous_digest": "digest"}, pieces=True)
        fits = F.col("chain_hash").eqNullSafe(hmac_sha256(F.concat("previous_digest", "digest"), pads))
        # First where the rows lie, sorted as they are; a unit has several pieces only if it is large.
        place = F.struct(*ORDER)
        per_piece = linked.groupBy(*PIECE).agg(
            F.first("unit").alias("unit"),
            F.first("agent_id").alias("found_agent"),
            F.count(F.lit(1)).alias("found"),
            F.bool_and(~F.col("has_previous") | F.coalesce(fits, F.lit(False))).alias("fits"),
            F.min(place).alias("from"),
            F.min_by(F.struct("digest", "chain_hash"), place).alias("opening"),
        )
        per_unit = per_piece.groupBy("unit").agg(
            F.first("found_agent").alias("found_agent"),
            F.sum("found").alias("found"),
            F.bool_and("fits").alias("fits"),
            F.min_by("opening", "from").alias("opening"),
        )
        recorded = anchors.withColumn("unit", _unit("agent_id", "version"))
        roots = None
        # Few depths: one for the size of each append's largest agent.
        for (depth,) in recorded.select("depth").distinct().collect():
            units = recorded.where(F.col("depth") == depth).select("unit")
            some = trie_roots(narrow.join(units, "unit", "left_semi"), "unit", depth)
            roots = some if roots is None else roots.unionAll(some)
        if roots is None:
            roots = narrow.select("unit", F.lit("").alias("root")).limit(0)
        whole = (
            recorded.join(per_unit, "unit", "full")
            .join(roots.withColumnRenamed("root", "found_root"), "unit", "left")
            .withColumn("agent", F.coalesce("agent_id", "found_agent"))
        )
        by_agent = Window.partitionBy("agent").orderBy("version")  # one row an append
        opening = hmac_sha256(F.concat("before_digest", "opening.digest"), pads)
        follows = F.lag("anchor").over(by_agent)
        good = (
            F.col("fits")
            & (F.col("found") == F.col("events"))
            & (F.col("found_root") == F.col("root"))
            & (opening == F.col("opening.chain_hash"))
            & (hmac_sha256(_anchored(), pads) == F.col("anchor"))
            & (follows.isNull() | (follows == F.col("previous_anchor")))
        )
        total = whole.withColumn("good", F.coalesce(good, F.lit(False))).groupBy("agent").agg(
            F.coalesce(F.sum("found"), F.lit(0)).alias("events"),
            F.coalesce(F.sum("events"), F.lit(0)).alias("anchored"),
            F.bool_and("good").alias("ok"),
        )
        return total.select(F.col("agent").alias("scope"), "events", "anchored", *verdict_columns(F.col("ok")))

    # -- pages -------------------------------------------------------------------

    def page_files(self, limit: int, offset: int, as_of: int | None = None) -> tuple[list[str], int]:
        """The files that hold a page, and how many newer events they hold before it.

        Files whose ranges of (ts, id) overlap are taken together; those groups are in order
        and their rows are counted, so a page of any depth is found from the index alone.
        """
        # One row a file; the window over them is small beside the log.
        newest = Window.orderBy(F.col("high").desc(), F.col("low").desc())
        earlier = newest.rowsBetween(Window.unboundedPreceding, -1)
        lowest = F.min("low").over(earlier)
        opened = self.index(as_of).withColumn(
            "opens", F.when(lowest.isNull() | (F.col("high") < lowest), 1).otherwise(0)
        )
        grouped = opened.withColumn("group", F.sum("opens").over(newest))
        sized = grouped.withColumn("size", F.sum("rows").over(Window.partitionBy("group")))
        upto = F.sum("rows").over(Window.orderBy("group").rangeBetween(Window.unboundedPreceding, 0))
        placed = sized.withColumn("before", upto - F.col("size"))
        chosen = placed.where((F.col("before") < offset + limit) & (F.col("before") + F.col("size") > offset))
        files = chosen.select("file", "before").collect()  # the files of one page
        return [r["file"] for r in files], offset - min((r["before"] for r in files), default=0)

    def page(self, limit: int = 100, offset: int = 0, as_of: int | None = None) -> DataFrame:
        """One page of projected events, newest first, from the files that hold it."""
        files, skipped = self.page_files(max(limit, 0), offset, as_of)
        if not files or limit <= 0:
            return project_events(self.events(as_of=0))
        rows = self.spark.read.schema(EVENT_SCHEMA).parquet(*files)
        ties = [F.col(c) for c in rows.columns if c not in ORDER]
        ordered = rows.orderBy(F.col("ts").desc(), F.col("id").desc(), *ties)
        return project_events(ordered.offset(skipped).limit(limit))


def _anchored() -> Column:
    return canonical_text(
        [F.col(c) for c in ("previous_anchor", "agent_id", "version", "first_place", "events", "before_digest", "depth", "root")]
    )
