"""Project-level scans: many files judged as if they were one text.

Source text is read once and never shuffled.  Each file becomes a narrow row of
signals; a project's signals are their OR, sum, minimum or maximum, which Spark
aggregates within each task first.  What can only match where two files meet is
found from a summary of bounded size per file: for each state in which it may begin (in
code, or inside a block of either quote kind), the state it ends in, the signals of its code
and the edges of that code.  Two summaries in a row give one of the same kind, so groups
of neighbours are merged, in rounds that shrink the rows until one per project is left.  A
project of any size therefore needs no task that holds all of it, and no row grows with
the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlens.functions import text as T
from auditlens.functions.edges import CODE, DOUBLE, OPENERS, SINGLE, STATES, edge, lexed_cases
from auditlens.functions.matching import Text, has_odd_case, lowered
from auditlens.functions.rules import BARE_SIGNALS, CODE_SIGNALS, FRAMEWORKS, HALF_SIGNALS, TRUST_LAYER
from auditlens.operators.findings import findings_from_signals, with_summary
from auditlens.operators.ordering import with_position
from auditlens.operators.signals import COUNTS, FLAGS, bare_text, code_text, count_columns, match_all, prepare
from auditlens.session import cut_lineage

GROUP = 8  # files, or merged groups of files, that one merge step takes together
FILES_SHOWN = 20
# Rules whose white space may run from one file into the next.
CROSSING = ("ai_import", "ai_construct", "ai_context", "trace_import", "tokens_unbounded")
GAP = "\n\n"


def file_signals(files: DataFrame, edges: bool = False) -> DataFrame:
    """One narrow row per file: project, path, signals and, if asked for, the summary for merging.

    `readings` has a file with triple quotes as it reads in every case; see `lexed_cases`.
    """
    prepared, text = prepare(files, "code", guards=True), code_text(guards=True)
    columns: dict[str, Column] = {
        **match_all(FRAMEWORKS, text, "fw_"),
        "trust_layer": TRUST_LAYER.on(text),
        **match_all(CODE_SIGNALS, text),
        **match_all(HALF_SIGNALS, text),
        **match_all(BARE_SIGNALS, bare_text()),
        **count_columns(F.col("__code")),
    }
    if edges:
        code, bare, plain = F.col("__code"), F.col("__bare"), F.col("__no_comments")
        quoted = T.has_triple_quote(plain)
        columns["code_edge"] = edge(code)
        columns["bare_edge"] = F.when(~quoted & (code != bare), edge(bare))
        columns["readings"] = F.when(quoted, _read(lexed_cases(plain), known=False))
        columns["has_double"] = plain.contains(OPENERS["double"])
        columns["has_single"] = plain.contains(OPENERS["single"])
    return prepared.select("project", "path", *[c.alias(n) for n, c in columns.items()])


def _read(runs: Column, known: bool) -> Column:
    """Texts with the state they end in as readings: what the checks find is added, and texts become edges.

    `known` tells that they have been checked in parts, whose findings hold.
    """

    def with_cases(x: Column) -> Column:
        flags = [x[n].alias(n) for n in BARE_SIGNALS] if known else [F.lit(False).alias(n) for n in BARE_SIGNALS]
        text = x["text"]
        return F.struct(
            x["state"].alias("state"), text.alias("text"), *flags, lowered(text).alias("low"), has_odd_case(text).alias("odd")
        )

    # Rules are SQL text over named columns, so they are put into a lambda of SQL.
    names = Text("x.text", "x.low", "x.odd")
    found = ", ".join(f"'{n}', x.{n} OR {rule.sql(names)}" for n, rule in BARE_SIGNALS.items())
    checked = F.call_function("transform", F.transform(runs, lambda x: F.when(x.isNotNull(), with_cases(x))), F.expr(
        f"x -> IF(x IS NULL, NULL, named_struct('state', x.state, 'text', x.text, {found}))"
    ))
    return F.transform(checked, lambda x: F.when(x.isNotNull(), x.withField("text", edge(x["text"]))))


def _rolled_up(per_file: DataFrame) -> DataFrame:
    """Signals per project.  An error handler counts in one file, or as try before except."""
    tries = F.min(F.when(F.col("try_word"), F.col("path")))
    excepts = F.max(F.when(F.col("except_word"), F.col("path")))
    flags = [
        F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in FLAGS if f != "try_except"
    ]
    handled = F.coalesce(F.bool_or("try_except"), F.lit(False)) | F.coalesce(tries < excepts, F.lit(False))
    counts = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]
    return per_file.groupBy("project").agg(*flags, handled.alias("try_except"), *counts)


def project_scan_rollup(files: DataFrame) -> DataFrame:
    """Scan every project from the signals of its files alone.

    One pass over the text and one small aggregate.  It differs from a scan of the
    merged text only where a match would span files; see `project_scan_merged`.
    """
    return with_summary(findings_from_signals(_rolled_up(file_signals(files)), ["project"]))


def _begun(start: int) -> Column:
    """How a file reads from a state, given where in its project quotes of each kind come up last."""
    later = {
        q: F.coalesce(F.col("path") < F.col(f"last_{n}"), F.lit(False)) for q, n in ((DOUBLE, "double"), (SINGLE, "single"))
    }
    case = lambda i: F.get("readings", F.lit(3 * start + i))
    state = case(0)["state"]
    same = F.when(state == DOUBLE, later[DOUBLE]).when(state == SINGLE, later[SINGLE]).otherwise(F.lit(True))
    other = F.when(state == DOUBLE, later[SINGLE]).otherwise(later[DOUBLE])
    return F.when(same, case(0)).when(other, case(1)).otherwise(case(2))


def summaries(placed: DataFrame) -> DataFrame:
    """(project, at, code_edge, runs, extra_documented, found_*): one row per file, numbered within its project.

    `runs` has a reading for each state the file may begin in.
    """
    last = [F.max(F.when(F.col(f"has_{q}"), F.col("path"))).alias(f"last_{q}") for q in STATES[1:]]
    facts = placed.groupBy("project").agg(F.min("position").alias("first"), *last)
    # A file without triple quotes is all code, or all inside a block.
    none = [F.lit(False).alias(n) for n in BARE_SIGNALS]
    plain = F.array(
        F.struct(F.lit(CODE).alias("state"), F.coalesce("bare_edge", "code_edge").alias("text"), *BARE_SIGNALS),
        *[F.struct(F.lit(q).alias("state"), F.lit("").alias("text"), *none) for q in (DOUBLE, SINGLE)],
    )
    quoted = F.array(*[_begun(s) for s in (CODE, DOUBLE, SINGLE)])
    return placed.join(facts, "project").select(
        "project",
        (F.col("position") - F.col("first")).alias("at"),
        "code_edge",
        F.when(F.col("readings").isNull(), plain).otherwise(quoted).alias("runs"),
        F.lit(0).cast("long").alias("extra_documented"),
        *[F.lit(False).alias(f"found_{n}") for n in CROSSING],
    )


def _chain(start: int) -> Column:
    """The readings of a group's parts in order, beginning in a state, put end to end."""
    first = F.struct(
        F.lit(start).alias("state"),
        F.lit(None).cast("string").alias("text"),
        *[F.lit(False).alias(n) for n in BARE_SIGNALS],
    )

    def step(run: Column, part: Column) -> Column:
        here = F.get(part["runs"], run["state"])
        gap = F.when(run["state"] == CODE, GAP).otherwise("")
        return F.struct(
            here["state"].alias("state"),
            F.when(run["text"].isNull(), here["text"]).otherwise(F.concat(run["text"], gap, here["text"])).alias("text"),
            *[(run[n] | here[n]).alias(n) for n in BARE_SIGNALS],
        )

    return F.aggregate("parts", first, step)


def grouped(rows: DataFrame, group: int) -> DataFrame:
    """Up to `group` neighbouring summaries of a project in one row, in order."""
    code = F.col("code_edge")
    return rows.groupBy("project", F.floor(F.col("at") / group).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("at", "code_edge", "runs"))).alias("parts"),
        F.sum(F.col("extra_documented") - T.count_documented_definitions(code)).alias("extra_documented"),
        *[F.bool_or(f"found_{n}").alias(f"found_{n}") for n in CROSSING],
    )


def merged(rows: DataFrame, group: int) -> DataFrame:
    """One merge step: summaries of up to `group` neighbours as one."""
    joined = grouped(rows, group).select(
        "project",
        F.col("block").alias("at"),
        F.array_join("parts.code_edge", GAP).alias("code"),
        F.array(*[_chain(s) for s in (CODE, DOUBLE, SINGLE)]).alias("runs"),
        "extra_documented",
        *[f"found_{n}" for n in CROSSING],
    )
    code = F.col("code")
    ready = joined.withColumns({"low": lowered(code), "odd": has_odd_case(code)})
    names = Text("code", "low", "odd")
    return ready.select(
        "project",
        "at",
        edge(code).alias("code_edge"),
        _read(F.col("runs"), known=True).alias("runs"),
        (F.col("extra_documented") + T.count_documented_definitions(code)).alias("extra_documented"),
        *[(F.col(f"found_{n}") | CODE_SIGNALS[n].on(names)).alias(f"found_{n}") for n in CROSSING],
    )


def rounds_needed(files: int, group: int) -> int:
    """How many merge steps leave one row of a project with this many files."""
    rounds = 0
    while group**rounds < files:
        rounds += 1
    return rounds


def _named(files: DataFrame) -> DataFrame:
    """Projects under names that are never null, so that joins on them lose nothing."""
    return files.withColumn("project", F.coalesce(F.concat(F.lit("p"), "project"), F.lit("n")))


def _unnamed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("project", F.when(F.col("project") != "n", F.substring("project", 2, 1 << 30)))


def placed_files(files: DataFrame) -> DataFrame:
    """The signals and summaries of readable files, in the order of (project, path)."""
    # Written before the sort: range partitioning reads its input twice, the text must be read once.
    return with_position(cut_lineage(file_signals(files, edges=True)), ["project", "path"])


def merged_signals(files: DataFrame, group: int = GROUP) -> DataFrame:
    """The signals of each project's files merged in path order, a blank line between files.

    Files without a project are one project, whose name is null.
    """
    files = _named(files)
    placed = placed_files(files.where(F.col("code").isNotNull()))
    everything = files.where(F.col("code").isNull()).select("project").distinct()
    rolled = _rolled_up(placed.unionByName(everything, allowMissingColumns=True))
    rows = summaries(placed)
    most = placed.groupBy("project").count().agg(F.max("count")).first()[0] or 0
    for _ in range(rounds_needed(most, group)):
        rows = merged(rows, group)
    whole = F.get("runs", F.lit(CODE))
    summary = rows.select(
        "project",
        "extra_documented",
        *[f"found_{n}" for n in CROSSING],
        *[whole[n].alias(f"whole_{n}") for n in BARE_SIGNALS],
    )
    joined = rolled.join(summary, "project", "left")
    found = {n: F.col(n) | F.coalesce(f"found_{n}", F.lit(False)) for n in CROSSING}
    # A file that begins inside a block counts as it reads there.
    found |= {n: F.coalesce(f"whole_{n}", F.lit(False)) for n in BARE_SIGNALS}
    found["n_documented"] = F.col("n_documented") + F.coalesce("extra_documented", F.lit(0))
    return _unnamed(joined.select("project", *[found.get(n, F.col(n)).alias(n) for n in (*FLAGS, *COUNTS)]))


def project_scan_merged(files: DataFrame, group: int = GROUP) -> DataFrame:
    """Scan every project as one text: its files in path order with a blank line between.

    Gives the result of merging the texts, without merging them.
    """
    return with_summary(findings_from_signals(merged_signals(files, group), ["project"]))


def file_lines(files: DataFrame) -> DataFrame:
    """(project, file, lines) of every file that could be read, as long rows without a cap."""
    readable = files.where(F.col("code").isNotNull())
    return readable.select("project", F.col("path").alias("file"), T.count_lines(F.col("code")).alias("lines"))


def project_files(files: DataFrame, shown: int = FILES_SHOWN) -> DataFrame:
    """Per project: how many files were read, and the first `shown` of them with line counts.

    The text is read once, into narrow rows; the row limit is applied within each task
    before the shuffle.  `file_lines` lists all files.
    """
    slim = cut_lineage(_named(files).select("project", "path", T.count_lines(F.col("code")).alias("lines")))
    totals = slim.groupBy("project").agg(F.count("lines").alias("files_scanned"))
    first = slim.where(F.col("lines").isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy("project").orderBy("path")))
    listed = (
        first.where(F.col("rank") <= shown)
        .groupBy("project")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("path").alias("file"), "lines"))).alias("files"))
    )
    return _unnamed(totals.join(listed, "project", "left"))
