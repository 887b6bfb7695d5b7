"""Text matchers that turn a rule into one Spark Column.

A rule is written as a word list, a chain of word lists on one line, or a Java
regular expression.  Each form gives the same answer as a search with the plain
regular expression, but the costly part only runs on rows that hold the words it
cannot match without: substring tests stay in generated code and read the UTF-8
bytes once, while a regular expression decodes the whole text on every call.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a text search treats as white space and as word
# characters, spelled out because the default Java classes cover ASCII only.
SPACE_CHARS = r"\t\n\x0b\f\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
INLINE_SPACE_CHARS = SPACE_CHARS.replace(r"\n", "")
S = f"[{SPACE_CHARS}]"
INLINE_S = f"[{INLINE_SPACE_CHARS}]"
W = r"[\p{L}\p{N}_]"
# Letters outside ASCII that equal an ASCII letter when case is ignored.  Rows
# that hold one of them take the regular expression; all others may be lower-cased.
ODD_CASE = "\u017f\u212a\u0130\u0131"
# Pieces that several words of the rules share.  Each is looked for once per row, and the
# words that hold it only where it is found; the choice changes times, not results.
PROBES = (
    "openai", "langchain", "crew", "autogen", "haystack", "anthropic", "agent", "completions", "vectorstore",
    "retriev", "log", "retry", "backoff", "tenacity", "except", "try", "budget", "throttle", "instrument", "lang",
)

#: Texts up to this size are split into pieces; larger ones are searched as they are.
SPLIT_BYTES = 1 << 20


@dataclass(frozen=True)
class Text:
    """Names of a text column and of the columns derived from it once per row.

    `names` and `probes` may be left out, and words are then looked for in the whole text.
    """

    raw: str
    low: str
    odd: str
    names: str | None = None
    probes: str | None = None


def lowered(col: Column) -> Column:
    return F.lower(col)


def has_odd_case(col: Column) -> Column:
    """True when lower-casing the text is not enough to ignore case."""
    # Every such letter takes two or three bytes, so plain ASCII rows skip the search.
    found = reduce(lambda a, b: a | b, [col.contains(letter) for letter in ODD_CASE])
    return (F.octet_length(col) != F.char_length(col)) & found


def underscored(low: Column) -> Column:
    """The pieces between spaces that hold an underscore: all that a word with one can be found in.

    A text of more than SPLIT_BYTES stays whole, so that no array of all its pieces is built.
    """
    pieces = F.filter(F.split(low, " "), lambda piece: piece.contains("_"))
    found = F.when(F.octet_length(low) > SPLIT_BYTES, low).otherwise(F.array_join(pieces, " "))
    return F.when(~low.contains("_"), "").otherwise(found)


def probed(low: Column) -> Column:
    """A number with a bit for each of PROBES, set if the text holds it."""
    bits = [F.when(low.contains(p), 1 << i).otherwise(F.when(low.isNotNull(), 0)) for i, p in enumerate(PROBES)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def _shortest(words: Sequence[str]) -> list[str]:
    """Drop words that contain another word of the list; they add nothing to an OR."""
    kept: list[str] = []
    for w in sorted(set(words), key=lambda w: (len(w), words.index(w))):
        if not any(k in w for k in kept):
            kept.append(w)
    return sorted(kept, key=words.index)


def sql_text(value: str) -> str:
    """A SQL string literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


def _contains_any(text: Text, words: Sequence[str], fold: bool) -> str:
    shown = _shortest([w.lower() for w in words] if fold else list(words))
    # Words under one guard, which holds wherever one of them occurs, are looked for together.
    guarded: dict[str, list[str]] = {}
    for w in shown:
        guarded.setdefault(_guard(text, w), []).append(_contains(text, w, fold))
    tests = [f"({g} AND ({' OR '.join(ws)}))" if g else " OR ".join(ws) for g, ws in guarded.items()]
    return "(" + " OR ".join(tests) + ")"


def _piece(word: str) -> str | None:
    """The part of a word that shows up in `underscored`, if there is one."""
    return next((p for p in word.lower().split(" ") if "_" in p), None)


def _contains(text: Text, word: str, fold: bool) -> str:
    # Folded words are in lower case, as `names` is.
    col = text.raw if not fold else text.names if text.names and _piece(word) == word else text.low
    return f"contains({col}, {sql_text(word)})"


def _guard(text: Text, word: str) -> str:
    """A cheap condition that holds wherever the word occurs, or nothing."""
    piece = _piece(word)
    if text.names and piece:
        return "" if piece == word else f"contains({text.names}, {sql_text(piece)})"
    bit = next((i for i, p in enumerate(PROBES) if p in word.lower()), None)
    return f"({text.probes} & {1 << bit}) <> 0" if text.probes and bit is not None else ""


def _checked(text: Text, groups: Sequence[Sequence[str]], fold: bool, regex: str) -> str:
    """The expression, evaluated only where one word of every group is present."""
    # Longer words are rarer, so a group of them is asked for first.
    rarest = sorted(groups, key=lambda g: -min(map(len, g)))
    possible = " AND ".join(_contains_any(text, g, fold) for g in rarest)
    if fold:
        possible = f"({text.odd} OR ({possible}))"
    return f"({possible} AND rlike({text.raw}, {sql_text(regex)}))"


def alternation(words: Sequence[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


class Rule:
    """A matcher.  Conditions are put together as SQL text and parsed once per rule,
    which builds a plan many times faster than one call per word."""

    def sql(self, text: Text) -> str:
        raise NotImplementedError

    def regexes(self) -> list[str]:
        raise NotImplementedError

    def on(self, text: Text) -> Column:
        return F.expr(self.sql(text))

    def search(self, text: Column) -> Column:
        """The same answer from the regular expressions alone: a far smaller plan, for short texts."""
        return reduce(lambda a, b: a | b, [text.rlike(r) for r in self.regexes()])


@dataclass(frozen=True)
class Words(Rule):
    """At least one of the words occurs; `fold` ignores case."""

    words: tuple[str, ...]
    fold: bool = False

    def regexes(self) -> list[str]:
        return [("(?iu)" if self.fold else "") + alternation(self.words)]

    def sql(self, text: Text) -> str:
        found = _contains_any(text, self.words, self.fold)
        if not self.fold:
            return found
        regex = sql_text(self.regexes()[0])
        return f"(CASE WHEN {text.odd} THEN rlike({text.raw}, {regex}) ELSE {found} END)"


@dataclass(frozen=True)
class Chain(Rule):
    """One word of each list, in this order, on one line.

    The pattern takes the earliest word of each list inside an atomic group, so a
    line is read once however many candidates it holds.  This is exact because no
    word of a list sits inside another word of the same list.
    """

    parts: tuple[tuple[str, ...], ...]
    fold: bool = False

    def regexes(self) -> list[str]:
        flags = "(?dmiu)" if self.fold else "(?dm)"
        return [flags + "^" + "".join(rf"(?>[^\n]*?{alternation(p)})" for p in self.parts)]

    def sql(self, text: Text) -> str:
        return _checked(text, self.parts, self.fold, self.regexes()[0])


@dataclass(frozen=True)
class Pattern(Rule):
    """A Java regular expression and the word lists every match must draw from."""

    body: str
    needs: tuple[tuple[str, ...], ...]
    fold: bool = False
    flags: str = "d"

    def regexes(self) -> list[str]:
        return [f"(?{self.flags}{'iu' if self.fold else ''}){self.body}"]

    def sql(self, text: Text) -> str:
        return _checked(text, self.needs, self.fold, self.regexes()[0])


@dataclass(frozen=True)
class OneOf(Rule):
    """Any of several rules, cheapest first."""

    options: tuple[Rule, ...]

    def regexes(self) -> list[str]:
        return [r for o in self.options for r in o.regexes()]

    def sql(self, text: Text) -> str:
        return "(" + " OR ".join(o.sql(text) for o in self.options) + ")"
