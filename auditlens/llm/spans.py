"""Regular-expression matches with their places in the text, as built-in Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlens.llm.tables import bind

#: Lengths are added up in blocks, so that a text with very many matches costs no square of them.
_BLOCK = 256


def _running_sums(lengths: Column) -> Column:
    def total(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)

    def of(xs: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _BLOCK).cast("int")),
            lambda b: total(F.slice(xs, b * _BLOCK + 1, _BLOCK)),
        )

        def within(offsets: Column) -> Column:
            def end(x: Column, k: Column) -> Column:
                at = F.floor(k / _BLOCK).cast("int")
                return F.get(offsets, at) + total(F.slice(xs, at * _BLOCK + 1, k - at * _BLOCK + 1))

            return F.transform(xs, end)

        offsets = bind(blocks, lambda ts: F.transform(ts, lambda t, b: total(F.slice(ts, F.lit(1), b))))
        return bind(offsets, within)

    return F.when(F.size(lengths) > 0, bind(lengths, of)).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str, with_gap: bool = False) -> Column:
    """array<struct<start, end, value[, gap]>>: leftmost matches that do not overlap, in order.

    Places count code points, the end is exclusive; `gap` is the text between the match
    before and this one.  A pattern must not match the empty string.  Null text: no match.
    """
    whole = F.coalesce(text, F.lit(""))
    fields = "start:bigint,end:bigint,value:string" + (",gap:string" if with_gap else "")

    def placed(found: Column) -> Column:
        gaps = F.split(whole, pattern, -1)

        def build(gaps: Column) -> Column:
            lengths = F.transform(found, lambda m, k: (F.length(m) + F.length(F.get(gaps, k))).cast("long"))

            def row(end: Column, k: Column) -> Column:
                value = F.get(found, k)
                parts = [(end - F.length(value)).alias("start"), end.alias("end"), value.alias("value")]
                return F.struct(*parts, *([F.get(gaps, k).alias("gap")] if with_gap else []))

            return F.transform(_running_sums(lengths), row)

        return F.when(F.size(found) > 0, bind(gaps, build)).otherwise(F.array().cast(f"array<struct<{fields}>>"))

    return bind(F.regexp_extract_all(whole, F.lit(pattern), 0), placed)


def labelled(found: Column, kind: str, rank: int) -> Column:
    """Matches as array<struct<start, rank, end, kind>>, which sorts by start, then by kind."""
    return F.transform(
        found,
        lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")
        ),
    )


def span_text(spans: Column) -> Column:
    """`kind:start:end` of sorted spans, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
