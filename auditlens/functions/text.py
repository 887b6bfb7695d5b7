"""Columns for lines, definitions and comment stripping in source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlens.functions.matching import INLINE_S, INLINE_SPACE_CHARS

_OTHER_BREAKS = r"\r\x0b\f\x1c-\x1e\x85\u2028\u2029"
_BREAKS = r"\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029"
_ANY_BREAK = f"\\r\\n|[{_BREAKS}]"
_QUOTES = "(?:\"\"\"|''')"
_MORE_ON_LINE = f"{INLINE_S}*[^{INLINE_SPACE_CHARS}\\n]"
_PUBLIC_FUNCTION = f"(?dm)^{INLINE_S}*def (?!_)(?={_MORE_ON_LINE})"
_PUBLIC_DEFINITION = f"(?dm)^{INLINE_S}*(?:class |def (?!_))(?={_MORE_ON_LINE})"
# The first line with text among the next three opens a triple-quoted string.
_DOC_FOLLOWS = f"[^\\n]*\\n(?:{INLINE_S}*\\n){{0,2}}{INLINE_S}*{_QUOTES}"
# Type names that count as an annotation.
_TYPE_NAMES = ("str", "int", "float", "bool", "list", "dict", "List", "Dict", "Optional", "Any")


def count_lines(text: Column) -> Column:
    """Number of lines; a final line break does not start another line."""
    newlines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    breaks = F.when(text.rlike(f"[{_OTHER_BREAKS}]"), F.regexp_count(text, F.lit(_ANY_BREAK))).otherwise(newlines)
    ended = F.right(text, F.lit(1)).rlike(f"[{_BREAKS}]")
    return breaks + F.when((text == "") | ended, 0).otherwise(1)


def count_public_definitions(code: Column) -> Column:
    return F.regexp_count(code, F.lit(_PUBLIC_DEFINITION))


def count_documented_definitions(code: Column) -> Column:
    return F.regexp_count(code, F.lit(f"{_PUBLIC_DEFINITION}(?={_DOC_FOLLOWS})"))


def count_public_functions(code: Column) -> Column:
    return F.regexp_count(code, F.lit(_PUBLIC_FUNCTION))


def count_typed_functions(code: Column) -> Column:
    hint = f"(?=[^\\n]*(?:->|:{INLINE_S}*(?:{'|'.join(_TYPE_NAMES)})))"
    return F.regexp_count(code, F.lit(_PUBLIC_FUNCTION + hint))


def strip_comments(code: Column) -> Column:
    """Drop everything from a hash sign to the end of its line, inside strings too."""
    return F.when(code.contains("#"), F.regexp_replace(code, r"#[^\n]*", "")).otherwise(code)


def has_triple_quote(code: Column) -> Column:
    return code.contains('"""') | code.contains("'''")


def strip_blocks(code: Column) -> Column:
    """Drop triple-quoted blocks, leftmost first, each up to its nearest closing quotes."""
    blocks = r'(?s)""".*?"""' + r"|'''.*?'''"
    return F.when(has_triple_quote(code), F.regexp_replace(code, blocks, "")).otherwise(code)


def half_even_percent(part: Column, whole: Column) -> Column:
    """Whole-number percentage text; a half goes to the even neighbour."""
    return F.bround(percent(part, whole), 0).cast("long").cast("string")


def percent(part: Column, whole: Column) -> Column:
    return part.cast("double") / whole.cast("double") * F.lit(100.0)

