"""Running totals per agent over an event stream, each event counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from auditlens.operators.agents import agent_stats
from auditlens.session import remove_folder

BATCH, WHOLE = "batch", "whole"
#: Every so many batches the newest row of every agent is written to one folder.
COMPACT_EVERY = 16


def once_each(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Events without repetitions of an id, whatever the order they arrive in.

    State is one entry per id.  With a `delay` (by event time, such as "7 days") an entry is kept
    for that long only, and events that come later than it are dropped.  Events without an
    id are told apart by all their fields.
    """
    whole = F.sha2(F.to_json(F.struct(*events.columns)), 256)
    key = F.coalesce(F.concat(F.lit("i"), F.col("id").cast("string")), whole)
    timed = events.withColumns({"__at": F.col("ts").cast("timestamp"), "__key": key})
    if delay is None:
        return timed.dropDuplicates(["__key"]).drop("__at", "__key")
    return timed.withWatermark("__at", delay).dropDuplicatesWithinWatermark(["__key"]).drop("__at", "__key")


def stream_agent_stats(events: DataFrame, delay: str | None = None) -> DataFrame:
    """State of the totals is one row per agent; there is no window, so none expires."""
    return agent_stats(once_each(events, delay))


def start_agent_stats(
    events: DataFrame, path: str, checkpoint: str, once: bool = False, delay: str | None = None
) -> StreamingQuery:
    """Add, per batch, the new totals of the agents that the batch changed.

    Each batch writes its own folder below `path`, again if it is run again, so a reader
    sees whole batches only.  Folders are compacted now and then.  `read_agent_stats` gives
    the newest row of every agent.
    """

    def add(totals: DataFrame, batch: int) -> None:
        totals.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch}")
        if batch % COMPACT_EVERY == COMPACT_EVERY - 1:
            compact(totals.sparkSession, path, batch)

    writer = (
        stream_agent_stats(events, delay)
        .writeStream.outputMode("update")
        .foreachBatch(add)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def _folders(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers of the folders of a kind that are complete."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(root)] if files.exists(root) else []
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(
        int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}=") and files.exists(done(f"{path}/{n}/_SUCCESS"))
    )


def folders_read(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The newest compaction, and the batches after it: what a reader opens."""
    whole = _folders(spark, path, WHOLE)
    newest = whole[-1] if whole else None
    return newest, [b for b in _folders(spark, path, BATCH) if newest is None or b > newest]


def _newest_rows(spark: SparkSession, path: str) -> DataFrame:
    newest, batches = folders_read(spark, path)
    parts = [spark.read.parquet(f"{path}/{BATCH}={b}").withColumn(BATCH, F.lit(b).cast("long")) for b in batches]
    if newest is not None:
        parts.append(spark.read.parquet(f"{path}/{WHOLE}={newest}"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    values = [c for c in rows.columns if c != "agent_id"]
    best = rows.groupBy("agent_id").agg(F.max_by(F.struct(*values), BATCH).alias("row"))
    return best.select("agent_id", "row.*")


def compact(spark: SparkSession, path: str, batch: int) -> None:
    """Write the newest row of every agent to one folder, and delete what the compaction before made needless.

    What this one makes needless stays until the next, for readers that have begun.
    """
    before = _folders(spark, path, WHOLE)
    _newest_rows(spark, path).write.mode("overwrite").parquet(f"{path}/{WHOLE}={batch}")
    if before and before[-1] < batch:
        for b in _folders(spark, path, BATCH):
            if b <= before[-1]:
                remove_folder(spark, f"{path}/{BATCH}={b}")
        for w in before[:-1]:
            remove_folder(spark, f"{path}/{WHOLE}={w}")


def read_agent_stats(spark: SparkSession, path: str) -> DataFrame:
    return _newest_rows(spark, path).drop(BATCH)
