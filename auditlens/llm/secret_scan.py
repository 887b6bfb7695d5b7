"""Secrets: rules found through a trigram inverted index and verified on the text.

Each rule's expression gives a Boolean query over the trigrams that every match must
hold.  The index has a posting (trigram, document) for the trigrams of the rules, in
lower case.  Postings are intersected into candidate documents of a rule, and only
there its expression runs.  Rules without mandatory trigrams run on every document.
"""

from __future__ import annotations

from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.llm.spans import count_kind, labelled, matches, span_text
from auditlens.llm.tables import stored

# The three base rules, and public formats of credentials.
BASE = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
}
ADDED = {
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    "code_host": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "chat": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "payment": r"sk_live_[A-Za-z0-9]{16,}",
    "maps": r"AIza[0-9A-Za-z_-]{35}",
    "web_token": r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
}
RULES = BASE | ADDED
MIN_ASSIGNED = 12

#: The most strings that a part of an expression is spelled out into.
_SPELLED = 24

Clause = list[frozenset[str]]


def _spell(node: tuple) -> set[str] | None:
    """All strings that a part can match, in lower case, if they are few."""
    op, arg = node
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        if any(str(kind) != "LITERAL" for kind, _ in arg) or len(arg) > _SPELLED:
            return None
        return {chr(c).lower() for _, c in arg}
    if name == "SUBPATTERN":
        return _spell_all(list(arg[3]))
    if name == "BRANCH":
        parts = [_spell_all(list(x)) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if name == "MAX_REPEAT" and arg[1] <= 8:
        inner = _spell_all(list(arg[2]))
        if inner is None:
            return None
        found, grown = set(), {""}
        for n in range(arg[1] + 1):
            found |= grown if n >= arg[0] else set()
            grown = {a + b for a in grown for b in inner}
        return found if len(found) <= _SPELLED else None
    return None


def _spell_all(nodes: list) -> set[str] | None:
    found = {""}
    for node in nodes:
        part = _spell(node)
        if part is None or len(found) * len(part) > _SPELLED:
            return None
        found = {a + b for a in found for b in part}
    return found


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses that all hold in a text with a match; each is a choice of sets of trigrams.

    An empty list means that the expression has no mandatory trigram.
    """
    clauses: list[Clause] = []
    run = {""}

    def close() -> None:
        nonlocal run
        if all(len(s) >= 3 for s in run):
            sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            # A choice that asks for more than another one adds nothing.
            clauses.append(sorted((x for x in sets if not any(y < x for y in sets)), key=sorted))
        run = {""}

    def walk(nodes: list) -> None:
        nonlocal run
        for node in nodes:
            part = _spell(node)
            if part is not None and len(run) * len(part) <= _SPELLED:
                run = {a + b for a in run for b in part}
                continue
            close()
            op, arg = str(node[0]), node[1]
            if op == "SUBPATTERN":
                walk(list(arg[3]))
                close()
            elif op == "MAX_REPEAT" and arg[0] >= 1:
                walk(list(arg[2]))
                close()
            elif part is not None:
                run = part

    walk(list(parser.parse(pattern)))
    close()
    return clauses


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: (trigram, id) for each of the given trigrams that a text holds, whatever its case."""
    low = docs.select("id", F.lower("text").alias("low"))
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col("low"), t))
    return low.select(F.explode(held).alias("trigram"), "id")


def candidates(index: DataFrame, queries: dict[str, list[Clause]]) -> DataFrame:
    """(id, rules): the rules whose query a document satisfies, by intersecting postings."""
    rows = [
        (rule, c, a, t, len(alternative), len(clauses))
        for rule, clauses in queries.items()
        for c, clause in enumerate(clauses)
        for a, alternative in enumerate(clause)
        for t in alternative
    ]
    terms = index.sparkSession.createDataFrame(
        rows, "rule string, clause int, choice int, trigram string, terms int, clauses int"
    )
    # The terms are as many as the rules have, whatever the corpus.
    return (
        index.join(F.broadcast(terms), "trigram")
        .groupBy("id", "rule", "clause", "choice", "terms", "clauses")
        .agg(F.count(F.lit(1)).alias("held"))
        .where("held = terms")
        .groupBy("id", "rule", "clauses")
        .agg(F.count_distinct("clause").alias("met"))
        .where("met = clauses")
        .groupBy("id")
        .agg(F.collect_list("rule").alias("rules"))
    )


def _rule_spans(text: Column, rule: str, rank: int, holds: Column | None) -> Column:
    found = matches(text, RULES[rule])
    if rule == "assign":
        value = lambda m: F.regexp_extract(m["value"], RULES[rule], 2)
        found = F.filter(found, lambda m: F.length(value(m)) >= MIN_ASSIGNED)
    found = labelled(found, rule, rank)
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    return found if holds is None else F.when(holds, found).otherwise(none)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id, base spans and all spans (arrays), and the counts.

    A null text counts as empty.  Rows with a repeated id share their postings and are
    verified each on its own text; rows with a null id are scanned with every rule.
    Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    queries = {rule: q for rule, p in RULES.items() if (q := trigram_query(p))}
    wanted = sorted({t for q in queries.values() for clause in q for alternative in clause for t in alternative})
    index = stored(postings(rows.where("id is not null"), wanted).distinct(), "postings")
    chosen = candidates(index, queries)
    text = F.col("text")

    def holds(rule: str) -> Column | None:
        if rule not in queries:
            return None
        return F.col("id").isNull() | F.coalesce(F.array_contains("rules", rule), F.lit(False))

    spans = {rule: _rule_spans(text, rule, n, holds(rule)) for n, rule in enumerate(RULES, start=1)}
    verified = rows.join(chosen, "id", "left").select(
        "id",
        F.sort_array(F.concat(*[spans[r] for r in BASE])).alias("base"),
        F.concat(*[spans[r] for r in ADDED]).alias("more"),
    )
    return verified.select(
        F.col("id").alias(id_col),
        *[count_kind("base", k) for k in BASE],
        "base",
        F.sort_array(F.concat("base", "more")).alias("spans"),
    )


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(
        id_col,
        *[f"n_{k}" for k in BASE],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
