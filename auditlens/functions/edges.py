"""Short stand-ins for texts, of bounded size, that keep what can match across a file boundary.

When files are merged, a check can only find something new where two files meet:
white space in a rule may run over the boundary, a definition at the end of one
file may take its docstring from the next, or a triple-quoted block may span files.
No rule has more than two white-space gaps, so such a match touches at most the
three outermost lines with text on either side, and in a line at most its nine outermost
tokens, but for two things: a run of word characters may hold a module name anywhere, and
a definition may reach a noun anywhere on its line.  `edge` keeps those tokens, shortens
long runs, and notes names, nouns and open definitions in place of what it leaves out.  For
the rules that can cross a boundary, a text and its edge are alike in any surroundings.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlens.functions.matching import INLINE_S, INLINE_SPACE_CHARS, S, W, alternation
from auditlens.functions.rules import DEFENCE_NOUNS, DEFENCE_VERBS, GUARD_MODULES
from auditlens.functions.text import has_triple_quote

FILLER = "."
_BLANK = f"(?:{INLINE_S}*+\\n)*+"
_LINE = f"{INLINE_S}*+[^{INLINE_SPACE_CHARS}\\n][^\\n]*+"
_HEAD = "\\n".join([_BLANK + _LINE] * 3)
_TAIL = "\\n".join([_LINE] + [_BLANK + _LINE] * 2) + f"(?:\\n{INLINE_S}*+)*+"
# A dot that takes every character is several times as fast as a class that does.
_MIDDLE = f"(?ds)\\A({_HEAD})(?:\\n|\\n.*\\n)({_TAIL})\\z"
# A definition looks at three lines, so longer blank runs say no more than four blank lines.
_LONG_GAP = f"\\n(?:{INLINE_S}*+\\n){{5,}}+"
# Rules take any number of blanks or, where one character may stand between two words, at most one.
# The class before it holds all blanks and little else, and is far cheaper to try at every character.
_LONG_SPACE = f"(?=[^!-~\\u00a1-\\u167f\\u3001-\\uffff]{{3}})({INLINE_S}{{2}}){INLINE_S}+"
# No word of a rule is longer than what is kept of a run on either side.
_KEPT = f"{W}{{20}}"
_NAMES, _NOUNS = alternation(GUARD_MODULES), alternation(DEFENCE_NOUNS)
_LONG_RUN = f"(?iu)(?<!{W})(?={W}{{70}})(?:(?={W}*?({_NAMES}))|)(?:(?={W}*?({_NOUNS}))|)({_KEPT}){W}{{30,}}({_KEPT})(?!{W})"
# Word characters again, those of ASCII first, which takes half the time.
_WORD = r"[\w\p{L}\p{N}]"
_TOKENS = f"(?>{_WORD}++|{INLINE_S}++|[^\\n]){{9}}"
_MARK = "￾"
_LONG_LINE = f"(?dm)^({_TOKENS})([^\\n]+)(?:(?<!{_WORD})|(?!{_WORD}))({_TOKENS})$"
# What a line's middle may give to either side: a noun to a definition before it, and the last
# definition that may find its noun, or its verb, later.
_OPEN_DEFINITION = f"def{S}+{alternation(DEFENCE_VERBS)}"
_LINE_MIDDLE = (
    f"(?iu){_MARK}(?:(?=[^{_MARK}]*?({_NOUNS}))|)(?:(?=[^{_MARK}]*?({_OPEN_DEFINITION}))|)"
    f"(?:(?=[^{_MARK}]*(def{INLINE_S}*){_MARK})|)[^{_MARK}]*{_MARK}"
)
_PLAIN_MIDDLE = f"{_MARK}[^{_MARK}]*+{_MARK}"


def _bind(value: Column, body) -> Column:
    """`body(value)` with `value` computed once."""
    return F.transform(F.array(value), body)[0]


def _notable(text: Column) -> Column:
    """False if no line has anything to note; the two letters are those that equal an `i` when case is ignored."""
    words = _bind(F.lower(text), lambda low: reduce(or_, [low.contains(w) for w in ("def", *DEFENCE_NOUNS)]))
    return words | text.contains("\u0130") | text.contains("\u0131")


def _short_lines(text: Column) -> Column:
    """Lines with at most eighteen tokens, each of bounded length, and the notes on what is left out."""
    # A run is one token however long it is, so lines are cut first and runs in what is kept of them.
    marked = F.regexp_replace(F.regexp_replace(text, _LONG_SPACE, "$1"), _LONG_LINE, f"$1{_MARK}$2{_MARK}$3")
    noted = _bind(
        marked,
        lambda m: F.when(_notable(m), F.regexp_replace(m, _LINE_MIDDLE, "~$1~$2~$3")).otherwise(
            F.regexp_replace(m, _PLAIN_MIDDLE, "~~~")
        ),
    )
    # A text that holds the mark itself keeps its lines.
    return F.when(text.contains(_MARK), text).otherwise(F.regexp_replace(noted, _LONG_RUN, "$3__$1__$2__$4"))


def edge(text: Column) -> Column:
    short = F.regexp_replace(text, _MIDDLE, f"$1\n{FILLER}\n$2")
    return F.regexp_replace(_bind(short, _short_lines), _LONG_GAP, "\n\n\n\n\n")


# What opens a text: code, or the inside of a block of either quote kind.
STATES = ("code", "double", "single")
CODE, DOUBLE, SINGLE = range(3)
OPENERS = {"code": "", "double": '"""', "single": "'''"}
_END = "\x00"


def lex_blocks(text: Column, start: str, later_double: Column, later_single: Column) -> Column:
    """The code outside triple-quoted blocks of a text that begins in state `start`.

    A block left open runs on into the next text, but only if its closing quotes
    come up in some later text; otherwise the quotes are plain characters.  The
    result ends in a mark, or in the quotes of a block left open; see `lexed_end`.
    """
    closed = r'(?s)""".*?"""|' + r"'''.*?'''"
    source = F.concat(F.lit(OPENERS[start]), text, F.lit(_END))

    def run(open_quotes: str) -> Column:
        return F.regexp_replace(source, f"{closed}|({open_quotes}).*\\z", "$1")

    # A text without the quotes that matter is all code, or all inside the block.
    if start == "code":
        plain = F.when(~has_triple_quote(text), F.concat(text, F.lit(_END)))
    else:
        plain = F.when(~text.contains(OPENERS[start]), F.lit(OPENERS[start]))
    return (
        plain.when(later_double & later_single, run("\"\"\"|'''"))
        .when(later_double, run('"""'))
        .when(later_single, run("'''"))
        .otherwise(F.regexp_replace(source, closed, ""))
    )


def _lexed_end(lexed: Column) -> Column:
    """Split the result of `lex_blocks` into the state at its end, as a number, and the code."""
    done = lexed.endswith(_END)
    marks = F.when(done, 1).otherwise(3)
    return F.struct(
        F.when(done, CODE).when(lexed.endswith(OPENERS["double"]), DOUBLE).otherwise(SINGLE).alias("state"),
        F.substring(lexed, F.lit(1), F.length(lexed) - marks).alias("text"),
    )


def lexed_cases(text: Column) -> Column:
    """array<struct<state, text>>: a text read from each state, in three cases of what follows it.

    Quotes left open at the end begin a block if they come up later.  The cases, side by
    side for each state: they do; they do not, but those of the other kind do; neither
    does.  The last two are null where nothing is left open.
    """

    def cases(start: str) -> Column:
        def of(first: Column) -> Column:
            double, single = (first.endswith(OPENERS[q]) for q in STATES[1:])
            yes, no = F.lit(True), F.lit(False)
            other = F.when(double, lex_blocks(text, start, no, yes)).when(single, lex_blocks(text, start, yes, no))
            return F.array(first, other, F.when(double | single, lex_blocks(text, start, no, no)))

        return _bind(lex_blocks(text, start, F.lit(True), F.lit(True)), of)

    every = F.flatten(F.array(*[cases(s) for s in STATES]))
    return F.transform(every, lambda x: F.when(x.isNotNull(), _lexed_end(x)))
