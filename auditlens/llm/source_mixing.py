"""Mix sources to target weights by entropy balancing.

Among all ways to take each document between 0 and `MOST` times, the one closest (in
relative entropy) to taking each once, with the words of a source adding up to its
target, takes a document of z mean sizes at the exponentially tilted rate

    rate = MOST / (1 + (MOST - 1) * exp(-theta * z))

with one dual variable theta a source.  The dual is convex; Newton steps, kept inside a
bracket, solve it for all sources at once: each is one distributed sum over the
distinct sizes of the sources.  Rates become whole copies by systematic rounding along
the documents of a source in order of size, so that the sum of the copies follows the
sum of the rates at every point and the words taken miss the target by less than the
largest document.  Of `PHASES` places to begin the rounding, each source takes the one
that comes nearest to its target.

Sums that steer the result are of decimals, which do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlens.llm.tables import replaced, row_key, stored, whole_row, words
from auditlens.operators.ordering import with_position

MOST = 3
PHASES = 64
#: Parts that the rows of a source are dealt into for the last join, as one source may hold a third of all.
SALTS = 64
WEIGHTS = (1, 2, 3)
STEPS = 80
TOLERANCE = 1e-10
EXACT = "decimal(38,12)"
WHOLE = "decimal(38,0)"


def _sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("digest"),
        F.col(source_col).cast("string").alias("source"),
        F.size(words(F.col(text_col))).cast("long").alias("size"),
    )


def source_targets(sizes: DataFrame) -> DataFrame:
    """(rank, source, docs, source_size, target) of each source, from rows (source, size).

    Sources by code point, null last, weigh 1, 2, 3, repeating.  They share the words of
    all by weight; no target passes MOST times its source, and what that leaves is shared
    by weight among the others until none is above.
    """
    totals = sizes.groupBy("source").agg(
        F.count_if(F.col("size") > 0).alias("docs"), F.sum("size").alias("source_size")
    )
    ordered = with_position(totals.withColumn("unnamed", F.col("source").isNull()), ["unnamed", "source"], "rank")
    weight = F.element_at(F.array(*[F.lit(x) for x in WEIGHTS]), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    sources = stored(ordered.drop("unnamed").withColumn("weight", weight.cast("long")), "sources")

    total = int(sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    most = F.col("source_size") * MOST
    over: Column = F.lit(False)
    before = None
    while True:  # the driver sees two sums a round; a round caps at least one more source
        row = sources.agg(
            F.coalesce(F.sum(F.when(over, most)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))
        ).first()
        capped, weights = int(row[0]), int(row[1])
        if (capped, weights) == before or not weights:
            break
        before = (capped, weights)
        over = F.col("weight").cast(WHOLE) * F.lit(total - capped).cast(WHOLE) > most.cast(WHOLE) * F.lit(weights).cast(
            WHOLE
        )
    share = F.col("weight") * F.lit((total - capped) / weights if weights else 0.0)
    target = F.when(over, most.cast("double")).otherwise(share)
    return sources.withColumn("target", target).drop("weight")


def tilted_rate(theta: Column, z: Column) -> Column:
    return F.lit(float(MOST)) / (1 + (MOST - 1) * F.exp(-theta * z))


def balance(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """(rank, theta) by Newton steps; theta is null where every document is taken MOST times.

    `cells` has (rank, size, n): how many documents of a source have a size.
    """
    full = F.col("target") >= MOST * F.col("source_size")
    scaled = sources.where("source_size > 0").withColumn("unit", F.col("source_size") / F.col("docs"))
    state = scaled.where(~full).select(
        "rank",
        "target",
        "unit",
        F.lit(0.0).alias("theta"),
        F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"),
        F.lit(1.0).alias("miss"),
    )
    state = stored(state, "duals")
    theta, low, high = F.col("theta"), F.col("low"), F.col("high")
    for _ in range(STEPS):
        if not (state.agg(F.coalesce(F.max("miss"), F.lit(0.0))).first()[0] > TOLERANCE):
            break
        z = F.col("size") / F.col("unit")
        rate = tilted_rate(theta, z)
        mass = F.col("n") * F.col("size") * rate
        sums = (
            cells.join(state.select("rank", "unit", "theta"), "rank")
            .groupBy("rank")
            .agg(F.sum(mass.cast(EXACT)).alias("got"), F.sum((mass * z * (1 - rate / MOST)).cast(EXACT)).alias("slope"))
        )
        off = F.col("got").cast("double") - F.col("target")
        moved = (
            state.drop("miss")
            .join(sums, "rank")
            .withColumn("low", F.when(off < 0, theta).otherwise(low))
            .withColumn("high", F.when(off > 0, theta).otherwise(high))
        )
        newton = theta - off / F.nullif(F.col("slope").cast("double"), F.lit(0.0))
        inside = F.coalesce((newton > low), low.isNull()) & F.coalesce((newton < high), high.isNull())
        # Outside the bracket a step is replaced: by its middle, or by going further where it is open.
        far = F.greatest(F.abs(theta), F.lit(1.0))
        other = F.coalesce((low + high) / 2, F.when(off < 0, theta + far).otherwise(theta - far))
        near = F.abs(newton - theta) <= 4 * far
        state = replaced(
            state,
            moved.select(
                "rank",
                "target",
                "unit",
                F.when(off == 0, theta)
                .when(newton.isNotNull() & inside & near, newton)
                .otherwise(other)
                .alias("theta"),
                "low",
                "high",
                (F.abs(off) / F.col("target")).alias("miss"),
            ),
            "duals",
        )
    return scaled.join(state.select("rank", "theta"), "rank", "left").select("rank", "unit", "theta")


def mixing_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per row of docs: id, digest of its text, size, source_size, target, taken, copies, rate.

    The size is the number of words, 0 for a null text.  Documents without words are
    taken 0 times.  Rows that repeat an id count as documents of their own.  Other
    columns are ignored, whatever their names.
    """
    sized = stored(_sizes(docs, id_col, text_col, source_col), "sizes")
    sources = stored(source_targets(sized), "targets")
    ranked = sized.join(sources.select("source", "rank"), sized["source"].eqNullSafe(sources["source"])).select(
        "id", "digest", "rank", "size"
    )
    placed = with_position(ranked, ["rank", "size", "id", "digest"])
    cells = placed.groupBy("rank", "size").agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("first"))
    cells = stored(cells, "cells")
    duals = balance(cells.where("size > 0"), sources)
    # A window over the distinct sizes of a source, not over its documents.
    before = Window.partitionBy("rank").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rated = (
        cells.where("size > 0")
        .join(duals, "rank")
        .withColumn(
            "rate",
            F.when(F.col("theta").isNull(), F.lit(float(MOST))).otherwise(
                tilted_rate(F.col("theta"), F.col("size") / F.col("unit"))
            ),
        )
        .withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(before), F.lit(0.0)))
    )
    # Each cell has one row; a hot cell of documents is split by Spark at run time.
    joined = placed.join(rated.select("rank", "size", "first", "rate", "before"), ["rank", "size"], "left")
    reached = F.col("before") + F.col("rate") * (F.col("position") - F.col("first"))
    joined = stored(joined.withColumn("reached", reached), "rated")

    def copies(phase: Column) -> Column:
        end = F.floor(F.col("reached") + F.col("rate") + phase)
        return F.least(F.coalesce(end - F.floor(F.col("reached") + phase), F.lit(0)), F.lit(MOST)).cast("long")

    # The words that each phase takes, reduced to one row a source inside the tasks.
    taken = joined.groupBy("rank").agg(
        F.array(*[F.sum(F.col("size") * copies(F.lit(i / PHASES))) for i in range(PHASES)]).alias("taken")
    )
    misses = F.transform("taken", lambda x, i: F.struct(F.abs(x - F.col("target")).alias("miss"), i.alias("phase")))
    chosen = sources.join(taken, "rank").select(
        "rank", "source_size", "target", (F.array_min(misses)["phase"] / PHASES).alias("phase")
    )
    salted = joined.withColumn("salt", F.pmod(F.col("position"), F.lit(SALTS)).cast("int"))
    dealt = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return (
        salted.join(dealt, ["rank", "salt"])
        .withColumn("copies", copies(F.col("phase")))
        .select(
            F.col("id").alias(id_col),
            "digest",
            "size",
            "source_size",
            "target",
            (F.col("copies") * F.col("size")).alias("taken"),
            "copies",
            F.coalesce("rate", F.lit(0.0)).alias("rate"),
        )
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs with every row as many times as the mix takes it, and columns as they were.

    Rows are told apart by all their columns, source included; wholly equal rows are taken
    as often as all of them are.  Null and empty texts have no words and go.  Rows with null
    or repeated ids, null sources and very long texts are mixed like others.  An empty table
    stays empty.  Columns may have any names: a row travels as one struct.
    """
    keyed = docs.select(row_key(docs).alias("key"), "text", "source")
    taken = mixing_copies(keyed, "key").where("copies > 0").groupBy("key").agg(F.sum("copies").alias("copies"))
    rows = docs.select(row_key(docs).alias("key"), whole_row(docs).alias("row")).dropDuplicates(["key"])
    repeated = rows.join(taken, "key").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select("row.*")
