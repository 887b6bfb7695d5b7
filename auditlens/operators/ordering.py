"""Row positions and neighbours in a total order, safe for very large groups.

A window over a whole group sorts it in one task.  Here the rows are cut along their order
as well, by range partitions or slices of about equal size, so a group of any size is spread
over as many tasks as it needs.  A row's neighbour is then the row before it in its own
slice, or the last one of an earlier slice.  The order columns must identify a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlens.session import cut_lineage

#: A key of so many rows is one task's work.
SLICE_ROWS = 100_000
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low bits
#: What `with_previous` adds with `pieces`: its rows lie sorted by these columns, those of equal ones in one task.
PIECE = ("__key", "__slice")


def with_position(df: DataFrame, order: Sequence[str], output: str = "position") -> DataFrame:
    """Add the 1-based position of every row in the order of `order`.

    Pass narrow rows: they are written once to the checkpoint folder, because the
    positions must not change when a lost task is run again.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    marked = cut_lineage(ranged.withColumn("__mark", F.monotonically_increasing_id()))
    marked = marked.withColumn("__part", F.shiftright("__mark", _ROW_BITS))
    # One row per partition, so both the window and the broadcast are bounded.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        marked.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    )
    row = F.col("__mark").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        marked.join(F.broadcast(offsets), "__part")
        .withColumn(output, F.col("__offset") + row + 1)
        .drop("__part", "__mark", "__offset")
    )


def _as_number(name: str, kind: T.DataType) -> Column:
    """A number that never falls as the column rises; equal ones may stand for different values."""
    c = F.col(name)
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampType):
        return c.cast("double")
    if isinstance(kind, T.TimestampNTZType):  # without a detour over a time zone, whose hours may repeat
        day = F.unix_date(c.cast("date")).cast("double")
        return day * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    head = F.substring(F.rpad(F.hex(c.cast("string").cast("binary")), 14, "0"), 1, 14)
    return F.conv(head, 16, 10).cast("double")


def _large_keys(keyed: DataFrame) -> DataFrame:
    """(__key, __bounds): the keys to be cut, with the bounds of their slices of about equal size.

    Only the largest keys, one for each shuffle partition at most, can hold more than a task's share
    of the rows, so the table is small.  It is written once: every user of it must see the same bounds.
    """
    partitions = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    largest = keyed.groupBy("__key").count().orderBy(F.col("count").desc()).limit(partitions)
    large = largest.where(F.col("count") > SLICE_ROWS).select("__key")
    # Twice as many slices as shuffle partitions at most, as range partitioning would have bounds.
    n = 2 * partitions
    shares = [i / n for i in range(1, n)]
    found = (
        keyed.join(F.broadcast(large), "__key")
        .groupBy("__key")
        .agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx("__number", shares, max(10_000, 20 * n)).alias("all"))
    )
    step = F.greatest(F.lit(1), F.floor(F.lit(n * SLICE_ROWS / 2) / F.col("rows")))
    bounds = F.filter("all", lambda _, i: (i + 1) % step == 0)
    return cut_lineage(found.select("__key", bounds.alias("__bounds")))


def _slice() -> Column:
    """The number of a row's slice in the order of __number: 0 for a key in one piece, and nulls come first."""
    table = F.col("__bounds")
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(table) + F.lit(1.0))).cast("int"))

    def halved(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        less = (state["low"] < state["high"]) & (F.get(table, middle) <= F.col("__number"))
        return F.struct(
            F.when(less, middle + 1).otherwise(state["low"]).alias("low"),
            F.when(less | (state["low"] >= state["high"]), state["high"]).otherwise(middle).alias("high"),
        )

    first = F.struct(F.lit(0).alias("low"), F.size(table).alias("high"))
    found = F.when(F.col("__number").isNotNull(), F.aggregate(steps, first, halved)["low"]).otherwise(-1)
    return F.when(table.isNull(), F.lit(0)).otherwise(found)


def with_previous(
    df: DataFrame, key: str, order: Sequence[str], values: dict[str, str], sized: DataFrame | None = None, pieces: bool = False
) -> DataFrame:
    """Add columns of the previous row of the same key: {output name: source column}.

    The first row of a key gets nulls.  `has_previous` tells a missing row from a
    null value.  Rows are shuffled once and take the row before from a window.  A key of more than
    SLICE_ROWS rows that is among the largest is cut along the order, so that it is spread out
    whatever its size; the first row of a slice takes the last one of an earlier slice, from a
    table with a row per large key and slice.

    Keys are sized on the rows of `sized`, where those of `df` are some of them and cost more to read.
    With `pieces` the columns PIECE are kept, so that a sum by them moves and sorts nothing.
    """
    number = _as_number(order[0], df.schema[order[0]].dataType)
    cut_by = {"__number": number, "__key": F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n"))}
    bounds = _large_keys((df if sized is None else sized).withColumns(cut_by).select("__key", "__number"))
    sliced = (
        df.withColumns(cut_by)
        .join(F.broadcast(bounds), "__key", "left")
        .withColumns({"__slice": _slice(), "__cut": F.col("__bounds").isNotNull()})
        .drop("__number", "__bounds")
    )
    row = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(values.values())], F.lit(True).alias("known"))
    within = Window.partitionBy(*PIECE).orderBy(*order)
    shifted = sliced.repartition(*PIECE).withColumn("__before", F.lag(row).over(within))
    # Rows of large keys alone, of which each task sends one a slice.
    ends = sliced.where("__cut").groupBy("__key", "__slice").agg(F.max_by(row, F.struct(*order)).alias("__end"))
    earlier = ends.select(
        "__key", "__slice", F.lag("__end").over(Window.partitionBy("__key").orderBy("__slice")).alias("__end")
    )
    before = F.coalesce("__before", "__end")
    # At most two rows for every SLICE_ROWS rows.
    return shifted.join(F.broadcast(earlier), ["__key", "__slice"], "left").select(
        *df.columns,
        *[before[f"v{i}"].alias(out) for i, out in enumerate(values)],
        before.isNotNull().alias("has_previous"),
        *(PIECE if pieces else ()),
    )
