"""Intermediate tables and word columns shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlens.session import remove_folder, shared_folder

#: Words are runs of anything but space and the ASCII controls tab to carriage return.
BREAKS = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    Later steps then start from files that every executor sees, so a lost executor
    costs the tasks it ran and not the whole lineage.
    """
    path = f"{shared_folder(df.sparkSession)}/auditlens-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Let Spark delete the shuffle files of a query when the query ends.

    For operators that write many intermediate tables: each starts from files, so the
    shuffles before it are not needed again.  It holds for the tables defined inside.
    """
    before = spark.conf.get(_CLEANUP, None)
    if before is None:  # a Spark without this setting keeps them longer
        yield
        return
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def replaced(old: DataFrame, new: DataFrame, label: str) -> DataFrame:
    """Write the next state of an iteration, and delete the state before, which nothing needs any more."""
    table = stored(new, label)
    remove_folder(old.sparkSession, old.stored_at)
    return table


def words(text: Column) -> Column:
    """The words of a text, unchanged and in order; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS), "")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names; `select("row.*")` gives them back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """(unnamed, id, content): in the order of ids, null ids last, and different for rows that differ in any column."""
    row = F.col(f"`{id_col}`")
    content = F.concat_ws(":", F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")), 256), F.xxhash64(whole_row(df)))
    return F.struct(row.isNull().alias("unnamed"), row.alias("id"), content.alias("content"))


def bind(value: Column, body) -> Column:
    """`body(value)` with `value` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
