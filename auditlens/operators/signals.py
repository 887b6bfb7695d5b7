"""One pass over source text: every rule's signal as a column.

The text is read once, in a projection without shuffle.  Later steps (findings,
roll-ups, reports) work on these narrow columns and never look at the text again.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.functions import text as T
from auditlens.functions.matching import Rule, Text, has_odd_case, lowered, probed, underscored
from auditlens.functions.rules import BARE_SIGNALS, CODE_SIGNALS, FRAMEWORKS, TRUST_LAYER

COUNTS = ("n_defs", "n_documented", "n_functions", "n_typed")
FRAMEWORK_FLAGS = tuple(f"fw_{name}" for name in FRAMEWORKS)
FLAGS = (*FRAMEWORK_FLAGS, "trust_layer", *CODE_SIGNALS, *BARE_SIGNALS)
SIGNALS = (*FLAGS, *COUNTS)

_LOW, _ODD, _BARE, _BARE_LOW = "__low", "__odd", "__bare", "__bare_low"
_CODE_TEXT, _NO_COMMENTS = "__code", "__no_comments"
_NAMES, _PROBES = "__names", "__probes"


def prepare(df: DataFrame, code: str | Column, bare: bool = True, guards: bool = False) -> DataFrame:
    """Add the lower-cased and the comment-free text, each computed once per row.

    `guards` adds what spares most words a search of the whole text, which pays for many rules.
    """
    src = F.col(code) if isinstance(code, str) else code
    out = df.withColumn(_CODE_TEXT, src)
    cols: dict[str, Column] = {_LOW: lowered(F.col(_CODE_TEXT)), _ODD: has_odd_case(F.col(_CODE_TEXT))}
    if bare:
        # Comments go first, so a hash inside a block can take its closing quotes along.
        cols[_NO_COMMENTS] = T.strip_comments(F.col(_CODE_TEXT))
    out = out.withColumns(cols)
    if bare:
        out = out.withColumn(_BARE, T.strip_blocks(F.col(_NO_COMMENTS)))
        out = out.withColumn(_BARE_LOW, lowered(F.col(_BARE)))
    if guards:
        out = out.withColumns({_NAMES: underscored(F.col(_LOW)), _PROBES: probed(F.col(_LOW))})
    return out


def code_text(guards: bool = False) -> Text:
    return Text(_CODE_TEXT, _LOW, _ODD, _NAMES, _PROBES) if guards else Text(_CODE_TEXT, _LOW, _ODD)


def bare_text() -> Text:
    return Text(_BARE, _BARE_LOW, _ODD)


def match_all(rules: Mapping[str, Rule], text: Text, prefix: str = "") -> dict[str, Column]:
    return {prefix + name: rule.on(text) for name, rule in rules.items()}


def count_columns(code: Column) -> dict[str, Column]:
    # Most text holds no definition at all, so ask the cheap question first.
    some_def = code.contains("def ")
    some = some_def | code.contains("class ")
    zero = F.when(code.isNotNull(), 0)
    return {
        "n_defs": F.when(some, T.count_public_definitions(code)).otherwise(zero),
        "n_documented": F.when(
            some & T.has_triple_quote(code), T.count_documented_definitions(code)
        ).otherwise(zero),
        "n_functions": F.when(some_def, T.count_public_functions(code)).otherwise(zero),
        "n_typed": F.when(some_def, T.count_typed_functions(code)).otherwise(zero),
    }


def with_signals(df: DataFrame, code: str = "code", only: Iterable[str] | None = None) -> DataFrame:
    """Add the signal columns named in `only` (all by default); no shuffle."""
    wanted = list(SIGNALS if only is None else only)
    needs_bare = any(w in BARE_SIGNALS for w in wanted)
    guards = len(wanted) > len(FRAMEWORK_FLAGS)
    text = code_text(guards)
    prepared = prepare(df, code, bare=needs_bare, guards=guards)
    available: dict[str, Column] = {
        **match_all(FRAMEWORKS, text, "fw_"),
        "trust_layer": TRUST_LAYER.on(text),
        **match_all(CODE_SIGNALS, text),
        **(match_all(BARE_SIGNALS, bare_text()) if needs_bare else {}),
        **count_columns(F.col(_CODE_TEXT)),
    }
    chosen = {name: available[name] for name in wanted}
    return prepared.select(*df.columns, *[c.alias(n) for n, c in chosen.items()])


def frameworks_column() -> Column:
    """Detected frameworks in reporting order, from the framework flags."""
    return F.array_compact(F.array(*[F.when(F.col(f"fw_{n}"), F.lit(n)) for n in FRAMEWORKS]))


def detect_framework(df: DataFrame, code: str = "code") -> DataFrame:
    """Add `frameworks`, the ordered list of frameworks the code uses."""
    flagged = with_signals(df, code, FRAMEWORK_FLAGS)
    return flagged.select(
        *df.columns, F.when(F.col(code).isNotNull(), frameworks_column()).alias("frameworks")
    )


def detect_trust_layer(df: DataFrame, code: str = "code") -> DataFrame:
    """Add `trust_layer_detected`."""
    return with_signals(df, code, ["trust_layer"]).withColumnRenamed("trust_layer", "trust_layer_detected")


def ai_context_flags(df: DataFrame, code: str = "code") -> DataFrame:
    """Add the three AI-code predicates: imports only, with constructors, with chat calls."""
    return with_signals(df, code, ["ai_import", "ai_construct", "ai_context"])


def strip_comments_docstrings(df: DataFrame, code: str = "code", output: str = "bare_code") -> DataFrame:
    """Add the code without comments and triple-quoted blocks."""
    return df.withColumn("__nc", T.strip_comments(F.col(code))).withColumn(
        output, T.strip_blocks(F.col("__nc"))
    ).drop("__nc")
