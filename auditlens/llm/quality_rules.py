"""Quality rules: repetition and length, then a hashed n-gram log-likelihood ratio.

Every word and every pair of neighbouring words is hashed into one of `BUCKETS`
features.  Two multinomials are estimated: one from trusted documents, one from all
documents.  A text's score is the mean, over its features, of the log ratio of the two
probabilities, so it does not grow with length; texts below `MIN_SCORE` nats a feature
look less like the trusted ones than like the raw corpus and are rejected.  Trusted
documents that a model has not counted set an offset, so that a small trusted set does
not reject what it could not have seen.

Everything is computed inside the row with built-in functions; text is never shuffled.
The model is a table of one row, made by Spark and handed to queries as data: no number of
it is written into a plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.llm.tables import bind, stored, whole_row, words

BUCKETS = 1 << 16
#: Trusted documents that the target multinomial is fitted on, at most; chosen by the hash of their id.
TRUSTED_ROWS = 20_000
MIN_SCORE = -0.1
#: Folds of the trusted documents, and the share of them, each scored without its fold, that may lie below MIN_SCORE.
FOLDS = 5
HELD_OUT_SHARE = 0.01
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def _joined(h: Column, step: int) -> Column:
    """The hash of each value with the one `step` places on."""
    most = F.greatest(F.size(h) - step, F.lit(0))
    return F.zip_with(F.slice(h, F.lit(1), most), F.slice(h, F.lit(step + 1), most), lambda a, b: F.xxhash64(a, b))


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def pair_hashes(h: Column) -> Column:
    """Of neighbouring words, from their hashes."""
    return _joined(h, 1)


def repeat_words(w: Column, pairs: Column | None = None) -> Column:
    """The number of words in windows of WINDOW = 8 words that the text holds twice or more.

    Windows are compared by hash first, which is put together from those of two and four
    words (`pairs`, if at hand); only texts in which two hashes agree are compared by their words.
    """
    window = WINDOW
    pairs = pair_hashes(word_hashes(w)) if pairs is None else pairs
    starts = F.sequence(F.lit(1), F.size(w) - (window - 1))
    hashed = bind(_joined(pairs, 2), lambda fours: _joined(fours, 4))
    suspected = bind(hashed, lambda h: F.size(h) > F.size(F.array_distinct(h)))

    def counted(ordered: Column) -> Column:
        def repeated(e: Column, k: Column) -> Column:
            return e["s"].eqNullSafe(F.get(ordered, k - 1)["s"]) | e["s"].eqNullSafe(F.get(ordered, k + 1)["s"])

        at = F.sort_array(F.transform(F.filter(ordered, repeated), lambda e: e["i"]))
        return bind(
            at,
            lambda a: F.aggregate(
                F.transform(a, lambda x, k: F.least(F.coalesce(F.get(a, k + 1) - x, F.lit(window)), F.lit(window))),
                F.lit(0),
                lambda total, x: total + x,
            ),
        )

    spelled = F.transform(
        starts, lambda i: F.struct(F.array_join(F.slice(w, i, window), " ").alias("s"), i.alias("i"))
    )
    exact = F.when(suspected, bind(F.sort_array(spelled), counted)).otherwise(0)
    return F.when(F.size(w) >= window, exact).otherwise(0).cast("long")


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def bucket(hashed: Column) -> Column:
    return hashed.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def features(w: Column) -> Column:
    """The bucket of every word and of every pair of neighbours."""
    both = bind(word_hashes(w), lambda h: F.concat(h, pair_hashes(h)))
    return F.transform(both, lambda x: bucket(x))


def _tables(counts: DataFrame) -> DataFrame:
    """One row (model, folds): the log ratio of every bucket, with all of the target and without each fold.

    `counts` has (bucket, fold, n); a null fold is raw text only.  The target is smoothed
    towards raw with the weight of one count a bucket in use, so a feature that few trusted
    documents could show counts as neutral.  Without any target count every ratio is zero.
    """
    parts = [F.sum(F.when(F.col("fold") == i, F.col("n")).otherwise(0)).alias(f"t{i}") for i in range(FOLDS)]
    by_bucket = stored(counts.groupBy("bucket").agg(F.sum("n").alias("r"), *parts), "buckets")
    whole = sum(F.col(f"t{i}") for i in range(FOLDS))
    sums = by_bucket.agg(
        F.sum("r").alias("size"),
        F.count(F.lit(1)).alias("weight"),
        F.sum(whole).alias("all"),
        *[F.sum(f"t{i}").alias(f"s{i}") for i in range(FOLDS)],
    ).first()  # a few sums
    size, weight, total = float(sums["size"] or 0), float(sums["weight"]), float(sums["all"] or 0)

    def ratio(t: Column, all_t: float) -> Column:
        smoothed = t + weight * F.col("r") / size
        ratio = F.log(smoothed) - F.log(F.col("r") / size) - F.log(F.lit(all_t + weight))
        return F.when(F.col("r").isNull() | F.lit(total == 0 or size == 0), 0.0).otherwise(ratio)

    cases = [ratio(whole, total), *[ratio(whole - F.col(f"t{i}"), total - float(sums[f"s{i}"] or 0)) for i in range(FOLDS)]]
    places = by_bucket.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    rated = places.join(by_bucket, "bucket", "left").select("bucket", *[c.alias(f"c{i}") for i, c in enumerate(cases)])
    # BUCKETS rows, whatever the corpus.
    ordered = rated.agg(F.sort_array(F.collect_list(F.struct("bucket", *[f"c{i}" for i in range(FOLDS + 1)]))).alias("x"))
    return ordered.select(
        F.col("x.c0").alias("model"), F.array(*[F.col(f"x.c{i + 1}") for i in range(FOLDS)]).alias("folds")
    )


def ratio_model(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, float]:
    """A table of one row with the log ratio of every bucket, trusted over raw, and an offset to be added to scores.

    All of docs is counted.  Of the ids in `trusted` at most TRUSTED_ROWS are used.  How
    low good documents score that the model has not counted depends on how many it has.
    So trusted documents are scored by models fitted without their fold, and where
    HELD_OUT_SHARE of them lies below MIN_SCORE the offset lifts that quantile to it.
    """
    key = F.col(f"`{id_col}`").alias("id")
    ids = trusted.select(key).where("id is not null").distinct()
    ids = stored(ids.orderBy(F.xxhash64("id"), "id").limit(TRUSTED_ROWS).withColumn("trusted", F.lit(1)), "trusted")
    narrow = docs.select(key, F.col(f"`{text_col}`").alias("text"))
    # The hinted side has TRUSTED_ROWS rows of one id at most.  Equal texts are in one fold.
    fold = F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")
    marked = narrow.join(F.broadcast(ids), "id", "left").select(
        "text", F.when(F.col("trusted") == 1, fold).alias("fold")
    )
    found = (
        marked.select(words(F.col("text")).alias("w"), "fold")
        .select(F.explode(features(F.col("w"))).alias("bucket"), "fold")
        .groupBy("bucket", "fold")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    model = stored(_tables(found), "model")
    held = stored(narrow.join(F.broadcast(ids.drop("trusted")), "id").select("text", fold.alias("fold")), "held-out")
    rows = held.withColumn("table", F.get(model.select("folds").scalar(), F.col("fold")))
    # As an outer explode, so that the filter does not split the words again for every use.
    judged = rows.select(_facts(F.col("text")).alias("f")).select(F.explode_outer(F.array("f")).alias("f")).select("f.*")
    judged = judged.where((F.col("n") >= MIN_WORDS) & (100 * F.col("repeat") <= MAX_REPEAT_PERCENT * F.col("n")))
    low = judged.agg(F.percentile("score", HELD_OUT_SHARE)).first()[0]
    return model, max(0.0, MIN_SCORE - low) if low is not None else 0.0


def _facts(text: Column, more=lambda w: []) -> Column:
    """struct<n, repeat, score, ...>: words, repeated words and mean log ratio, from one pass of hashes.

    The ratios are the column `table`, a scalar subquery, which a query may not name in a
    lambda itself.  It is named once here, so that Spark puts it in place of the
    column and does not carry it in rows.
    """

    def mean(h: Column, pairs: Column) -> Column:
        total = F.aggregate(F.concat(h, pairs), F.lit(0.0), lambda s, x: s + F.get(F.col("table"), bucket(x)))
        return F.when(F.size(h) > 0, total / (2 * F.size(h) - 1))

    def of(w: Column) -> Column:
        return bind(
            word_hashes(w),
            lambda h: bind(
                pair_hashes(h),
                lambda pairs: F.struct(
                    F.size(w).cast("long").alias("n"),
                    repeat_words(w, pairs).alias("repeat"),
                    mean(h, pairs).alias("score"),
                    *more(w),
                ),
            ),
        )

    return bind(words(text), of)


def quality_verdicts(
    docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE
) -> DataFrame:
    """One row per row of docs: its id, the counts, base_failed, score and kept.

    `trusted` has the ids of trusted documents.  A null text counts as empty; a text
    without words fails the base rules.  Null and repeated ids are judged like others.
    Other columns are ignored, whatever their names.
    """
    model, offset = ratio_model(docs, trusted, id_col, text_col)
    text = F.col("text")
    table = model.select("model").scalar().alias("table")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), table)
    facts = _facts(text, lambda w: [F.length(F.array_join(w, "")).cast("long").alias("word_chars")])
    symbols = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long")
    # As an outer explode of one item: a filter that a user puts on plain columns would be moved
    # below the projection, where the words are split again for every use.
    both = F.struct(facts.alias("f"), symbols.alias("n_symbols"), dup_lines(text).alias("n_dup_lines"))
    counted = rows.select("id", both.alias("x")).select("id", F.explode_outer(F.array("x")).alias("x"))
    counted = counted.select("id", "x.f.*", "x.n_symbols", "x.n_dup_lines")
    failed = (F.col("n") < MIN_WORDS) | (100 * F.col("repeat") > MAX_REPEAT_PERCENT * F.col("n"))
    judged = counted.withColumn("base_failed", failed).withColumn("score", F.col("score") + F.lit(offset))
    return judged.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("repeat").alias("n_repeat_words"),
        "base_failed",
        (~F.col("base_failed") & (F.col("score") >= min_score)).alias("kept"),
        "score",
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("quality") == 1).select("doc_id")


def kept_documents(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of docs that pass, with their columns as they were.

    The verdict is computed beside the text, so nothing is joined or shuffled.  Null and
    empty texts have no words and go; very long texts, repeated rows and rows with null or
    repeated ids are judged like others.  An empty table stays empty.  Columns may have any
    names: a row travels as one struct.
    """
    model, offset = ratio_model(docs, trusted)
    table = model.select("model").scalar().alias("table")
    rows = docs.select(whole_row(docs).alias("row"), F.col("text").alias("text"), table)
    # An outer explode for the reason given above.
    judged = rows.select("row", _facts(F.col("text")).alias("f")).select("row", F.explode_outer(F.array("f")).alias("f"))
    n, repeat, score = (F.col("f")[c] for c in ("n", "repeat", "score"))
    passes = (n >= MIN_WORDS) & (100 * repeat <= MAX_REPEAT_PERCENT * n) & (score + F.lit(offset) >= MIN_SCORE)
    return judged.where(passes).select("row.*")
