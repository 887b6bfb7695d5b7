"""Pause and resume as events arrive: the current status of each agent, kept as state.

The state of an agent is the place (time, id) of its last control event and what it said.  A
control event that arrives late changes nothing if a later one is known, so the order of
arrival does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from auditlens.operators.agents import CONTROL_STATUS, with_status

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROWS = "id string, at long, event long, action string"


class LastControl(StatefulProcessor):
    """Keeps the last control event of an agent, and gives it out when it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", "at long, event long, action string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._last.get() if self._last.exists() else None
        best = known
        for batch in rows:
            for at, event, action in zip(batch["at"], batch["event"], batch["action"], strict=True):
                if best is None or (int(at), int(event)) > (best[0], best[1]):
                    best = (int(at), int(event), str(action))
        if best is not known and best is not None:
            self._last.update(tuple(best))
            yield pd.DataFrame({"id": [key[0]], "at": [best[0]], "event": [best[1]], "action": [best[2]]})

    def close(self) -> None:
        pass


def stream_last_control(events: DataFrame) -> DataFrame:
    """(id, at, event, action): the last control event of an agent, whenever it changes."""
    control = events.where(F.col("action_type").isin(*CONTROL_STATUS) & F.col("agent_id").isNotNull())
    narrow = control.select(
        F.col("agent_id").alias("id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        F.col("id").alias("event"),
        F.col("action_type").alias("action"),
    )
    return narrow.groupBy("id").transformWithStateInPandas(
        statefulProcessor=LastControl(), outputStructType=_ROWS, outputMode="Update", timeMode="None"
    )


def start_agent_status(events: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write what changes, a folder a batch, again if the batch is run again."""
    spark = events.sparkSession

    def add(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    writer = (
        stream_last_control(events)
        .writeStream.outputMode("update")
        .foreachBatch(add)
        .option("checkpointLocation", checkpoint)
    )
    # State of this kind is kept by the RocksDB provider; the query takes the setting along when it starts.
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def read_agent_status(spark: SparkSession, path: str, agents: DataFrame) -> DataFrame:
    """The status of every registered agent, as `agents.agent_status` gives it for a whole log."""
    rows = spark.read.schema(_ROWS).parquet(path)
    last = rows.groupBy("id").agg(F.max_by(F.struct("action", "at"), F.struct("at", "event")).alias("last"))
    at = F.timestamp_micros(F.col("last.at")).cast("timestamp_ntz")
    return with_status(agents, last.select("id", F.col("last.action").alias("last_control"), at.alias("changed_at")))
