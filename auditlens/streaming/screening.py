"""Injection screening of arriving text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from auditlens.operators.screen import check_injection


def screen_stream(messages: DataFrame, text: str = "text") -> DataFrame:
    """The batch screening on a stream: stateless columns, so rows can be appended at once."""
    return check_injection(messages, text)


def start_screening(
    messages: DataFrame, path: str, checkpoint: str, text: str = "text", once: bool = False
) -> StreamingQuery:
    """Append screened messages to a Parquet folder; `once` handles what is there and stops."""
    writer = (
        screen_stream(messages, text)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
