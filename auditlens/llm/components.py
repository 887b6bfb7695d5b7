"""Connected components of an edge table, by alternating star rounds.

Each round hangs the neighbours of every node on the smallest one it knows
(large star: the larger neighbours, small star: the smaller ones).  Rows are only
grouped with a running minimum, so a node with very many neighbours is reduced
inside the tasks before the shuffle, and its join is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.tables import replaced, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a"))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(lowest, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge runs from the larger `a` to the smaller `b` here."""
    lowest = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(lowest.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of any direction to (node, component): the smallest node reachable.

    Nodes without an edge to another node have no row.  The driver sees two numbers a
    round, and the number of rounds grows with the logarithm of the longest path.
    """
    edges = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    before = None
    while (now := _state(edges)) != before:
        before = now
        edges = replaced(edges, _small_star(_large_star(edges).distinct()).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        edges.select("b", "b").distinct()
    )
