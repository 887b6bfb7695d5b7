"""Personal data: patterns for four kinds, and identifiers found by their context.

The base kinds are matched by pattern.  Their matches seed a bootstrap: the two words before
an identifier are a lexical pattern, the identifier is an instance, and both are scored in
turn over the graph of patterns and instances of all documents.  Known identifiers are whole
base spans, unknown ones whole runs of words with a digit or an at sign; both are compared by
their digits, however these are spaced, or by their text if it has letters.

    pattern score  = mean confidence of the instances seen in it, for a kind
    instance score = 1 - product of (1 - score) over the patterns it is seen in

Patterns with enough support and a high score add the identifiers seen in them, which
count in the next round.  Text is read once; the rounds work on short rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.llm.spans import count_kind, labelled, matches, span_text
from auditlens.llm.tables import bind, stored, words

# The kinds and their patterns.  Possessive quantifiers and the boundaries in
# front keep the same matches and make the search linear in the length of a run.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
SMALL_PARTS = rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$"

#: What a bootstrapped pattern needs: distinct instances, and mean confidence.
MIN_SUPPORT = 3
MIN_SCORE = 0.8
ROUNDS = 3
#: A run of words with a digit or an at sign; the boundary in front keeps the search linear.
_WORD = r"[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
_RUN = rf"(?<![^\x20\x09-\x0D]){_WORD}(?:\x20++{_WORD})*+"
#: An unknown identifier has at least so many characters and digits, or an at sign, and no more digits than any kind.
LEAST_LENGTH, LEAST_DIGITS, MOST_DIGITS = 6, 4, 19
_BREAKS, _LAST = "\t\n\x0b\f\r", 8

#: A card or phone match runs on into at most 18 later runs, and each has at most four base spans that start in it.
_REACH = 100


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """From the right, every second digit is doubled, and the digits of all add up to a multiple of ten."""
    reverse = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(reverse, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _accepted(kind: str) -> callable:
    def card(m: Column) -> Column:
        return bind(
            _digits(m["value"]),
            lambda d: F.when(F.length(d).between(12, 19), passes_luhn(d)).otherwise(F.lit(False)),
        )

    return {
        "email": lambda m: F.lit(True),
        "ip": lambda m: m["value"].rlike(SMALL_PARTS),
        "card": card,
        "phone": lambda m: F.length(_digits(m["value"])).between(9, 15),
    }[kind]


#: A sign without which a text has no match of a kind, so that the pattern need not run.
_SIGNS = {"email": "@", "ip": ".", "phone": "+"}


def _kind_spans(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, PATTERNS[kind]), _accepted(kind))
    if kind in _SIGNS:
        none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
        found = F.when(F.contains(text, F.lit(_SIGNS[kind])), found).otherwise(none)
    return labelled(found, kind, KINDS.index(kind) + 1)


def base_spans(text: Column) -> Column:
    """All matches of the base patterns, by start, then by kind."""
    return F.sort_array(F.concat(*[_kind_spans(text, k) for k in KINDS]))


def _lexical(gap: Column) -> Column:
    """The last two words of a gap in lower case, whatever their length; null where it has none."""

    def tail(text: Column) -> Column:
        few = F.substring_index(text, " ", -_LAST)
        found = F.array_remove(F.split(F.lower(few), r"\x20"), "")
        # Many blanks in a row leave few words among the last pieces.
        return F.when((F.size(found) >= 2) | (few == text), found).otherwise(words(F.lower(text)))

    spaced = F.rtrim(F.translate(gap, _BREAKS, " " * len(_BREAKS)))
    last = bind(bind(spaced, tail), lambda w: F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), 2))
    return F.nullif(F.array_join(last, " "), F.lit(""))


def _normalised(value: Column) -> Column:
    """An identifier without what may differ between its spellings: the digits, or the text if it has letters."""
    return F.when(value.rlike("[A-Za-z@]"), F.lower(value)).otherwise(
        F.when(value.rlike(r"[0-9]\.[0-9]"), value).otherwise(_digits(value))
    )


def _instances(text: Column, base: Column) -> Column:
    """Identifiers: place, normalised value and pattern, and the kind if a base span starts in the run.

    A run with a base span stands for its first one; one that a base span only runs on into is a
    part of that and left out.  Any other run is unknown, without its outer punctuation.
    Runs and base spans are put in one order, so that each run looks at its neighbours only.
    """

    def run(m: Column) -> Column:
        return F.struct(
            m["start"].alias("start"),
            F.lit(0).alias("type"),
            m["end"].alias("end"),
            m["value"].alias("value"),
            m["gap"].alias("gap"),
        )

    def span(s: Column) -> Column:
        return F.struct(
            s["start"].alias("start"),
            F.lit(1).alias("type"),
            s["end"].alias("end"),
            s["kind"].alias("value"),
            F.lit(None).cast("string").alias("gap"),
        )

    def instance(events: Column):
        def of(m: Column, k: Column) -> Column:
            bare = F.regexp_replace(m["value"], r"^[^A-Za-z0-9+(]++", "")
            value = F.regexp_replace(bare, r"[^A-Za-z0-9]++\z", "")
            start = m["start"] + F.length(m["value"]) - F.length(bare)
            after = F.get(events, k + 1)
            opens = (after["type"] == 1) & (after["start"] < m["end"])
            known = F.substring(m["value"], (after["start"] - m["start"] + 1).cast("int"), (after["end"] - after["start"]).cast("int"))
            before = F.slice(events, F.greatest(k - _REACH + 1, F.lit(1)), F.least(k, F.lit(_REACH)))
            inside = F.exists(before, lambda e: (e["type"] == 1) & (e["end"] > m["start"]))
            return F.struct(
                (m["type"] == 0).alias("is_run"),
                start.alias("start"),
                (start + F.length(value)).alias("end"),
                _normalised(F.when(opens, known).otherwise(value)).alias("value"),
                _lexical(m["gap"]).alias("pattern"),
                F.when(opens, after["value"]).alias("kind"),
                inside.alias("inside"),
                F.length(value).alias("length"),
                F.length(_digits(value)).alias("digits"),
            )

        return of

    def wanted(i: Column) -> Column:
        sized = (i["length"] >= LEAST_LENGTH) & i["digits"].between(LEAST_DIGITS, MOST_DIGITS)
        like = sized | (i["value"].contains("@") & (i["digits"] <= MOST_DIGITS))
        return i["is_run"] & ~i["inside"] & i["pattern"].isNotNull() & (i["kind"].isNotNull() | like)

    ordered = F.sort_array(F.concat(F.transform(matches(text, _RUN, with_gap=True), run), F.transform(base, span)))
    seen = bind(ordered, lambda events: F.transform(events, instance(events)))
    return F.transform(
        F.filter(seen, wanted),
        lambda i: F.struct(*[i[c].alias(c) for c in ("start", "end", "value", "pattern", "kind")]),
    )


def bootstrap(occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, value, kind) of identifiers found by context.

    `occurrences` has (pattern, value, kind); kind is null for what no base pattern knows.
    """
    edges = stored(occurrences.select("pattern", "value").distinct(), "edges")
    seeds = occurrences.where("kind is not null").groupBy("value", "kind").agg(F.lit(1.0).alias("confidence"))
    seeds = stored(seeds, "seeds")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("values"))
    known = seeds
    accepted = None
    for _ in range(rounds):
        scored = (
            edges.join(known, "value")
            .groupBy("pattern", "kind")
            .agg(F.sum(F.col("confidence").cast("decimal(30,12)")).alias("mass"), F.count(F.lit(1)).alias("support"))
            .where(F.col("support") >= MIN_SUPPORT)
            .join(sizes, "pattern")
            .withColumn("score", F.col("mass").cast("double") / F.col("values"))
            .where(F.col("score") >= MIN_SCORE)
        )
        accepted = stored(scored.select("pattern", "kind", "score"), "patterns")
        doubt = F.log(1 - F.least(F.col("score"), F.lit(0.99)))
        found = (
            edges.join(accepted, "pattern")
            .join(seeds.select("value").distinct(), "value", "left_anti")
            .groupBy("value", "kind")
            .agg((1 - F.exp(F.sum(doubt.cast("decimal(30,12)")).cast("double"))).alias("confidence"))
        )
        known = stored(seeds.unionByName(found), "instances")
    best = known.where(F.col("confidence") >= MIN_SCORE).join(
        seeds.select("value").distinct(), "value", "left_anti"
    )
    return edges.join(accepted.select("pattern", "kind"), "pattern").join(
        best.select("value", "kind"), ["value", "kind"]
    )


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, base spans and all spans (arrays), and the counts.

    A null text counts as empty.  Very long texts are read whole.  Ids may be null or repeat:
    rows are told apart by a number of their own, and equal rows get equal results, as an
    instance counts once however often it is seen.  An empty table gives no row.  Other
    columns are ignored, whatever their names.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    read = (
        rows.withColumn("base", base_spans(text))
        .withColumn("seen", _instances(text, F.col("base")))
        .select(F.monotonically_increasing_id().alias("row"), "id", "base", "seen")
    )
    read = stored(read, "pii")
    seen = read.select("row", F.explode("seen").alias("s")).select("row", "s.*")
    learned = bootstrap(seen)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    extra = (
        seen.where("kind is null")
        .drop("kind")
        .join(learned, ["pattern", "value"])
        .groupBy("row")
        .agg(F.collect_set(F.struct("start", rank.alias("rank"), "end", "kind")).alias("extra"))
    )
    joined = read.join(extra, "row", "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return joined.select(
        F.col("id").alias(id_col),
        *[count_kind("base", k) for k in KINDS],
        "base",
        F.sort_array(F.concat("base", F.coalesce("extra", none))).alias("spans"),
    )


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(
        id_col,
        *[f"n_{k}" for k in KINDS],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
