"""Each stage of the pipeline against plain Python on the rows that it was given."""

from __future__ import annotations

from collections import Counter

import brute
import pytest
from conftest import FOLDER, HARD_TEXTS, frame
from pyspark.sql import functions as F
from test_quality_score import verdicts
from tokenizers import Tokenizer

import corpus_pipeline
from auditlens.llm import decontaminate, simhash_dedup, source_mixing
from auditlens.llm.queries import TOKENIZER


@pytest.fixture(scope="module")
def steps(spark, given):
    """The rows before the first stage and after every stage."""
    docs, out = given, [given.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), name)
        out.append(docs.collect())
    return out


def test_stages_keep_the_columns(steps):
    for rows in steps[:-1]:
        assert rows[0].asDict().keys() == steps[0][0].asDict().keys()


def test_quality(spark, steps):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    expected = verdicts({r["doc_id"]: r["text"] for r in steps[0]}, labels)
    kept = {d for d, (_, good) in expected.items() if good}
    assert {r["doc_id"] for r in steps[1]} == kept
    assert 0 < len(kept) < len(steps[0])


def test_near_duplicates(steps):
    parts = brute.components({r["doc_id"]: brute.simhash(r["text"]) for r in steps[1]})
    assert sorted(r["doc_id"] for r in steps[2]) == sorted(set(parts.values()))


def test_decontamination(spark, steps):
    items = [decontaminate.plain_words(r["text"].encode()) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]

    def grams(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    known = [grams(i) for i in items]
    kept = set()
    for r in steps[2]:
        doc = decontaminate.plain_words(r["text"].encode())
        near = [i for i, g in zip(items, known) if len(g & grams(doc)) * 5 >= 0.8 * len(i)]
        if not any(brute.tiles(doc, i) >= 0.8 * len(i) for i in near):
            kept.add(r["doc_id"])
    assert {r["doc_id"] for r in steps[3]} == kept


def test_mixing(steps):
    before, after = steps[3], steps[4]
    size = {r["doc_id"]: len(brute.words(r["text"])) for r in before}
    source = {r["doc_id"]: r["source"] for r in before}
    totals, taken = Counter(), Counter()
    for d in size:
        totals[source[d]] += size[d]
    copies = Counter(r["doc_id"] for r in after)
    for d, n in copies.items():
        taken[source[d]] += n * size[d]
    assert max(copies.values()) <= 3
    target = brute.targets(dict(totals))
    assert all(abs(taken[s] - target[s]) <= max(size[d] for d in size if source[d] == s) for s in totals)
    texts = {r["doc_id"]: r for r in before}
    assert all(texts[r["doc_id"]] == r for r in after)


def test_tokens(steps):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    start = 0
    by_id = sorted(steps[4], key=lambda r: r["doc_id"])
    found = sorted(steps[5], key=lambda r: r["start"])
    assert len(found) == len(by_id)
    for doc, row in zip(by_id, found):
        _, n, crc = brute.token_rows({0: doc["text"]}, tokenizer)[0]
        assert tuple(row) == (doc["doc_id"], start, n, crc)
        start += n


def test_hard_and_empty_tables_pass_every_stage(spark, hard, empty, tmp_path):
    folder = str(tmp_path)
    frame(spark, HARD_TEXTS).selectExpr("doc_id", "1 as quality", "0 as toxic").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, HARD_TEXTS[6]), (2, None), (3, "")], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    for docs in (hard, empty):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
            assert docs.columns == columns
        corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()


def test_columns_of_any_name_stay(spark, tmp_path):
    """Columns named as those used inside, or with a dot, come out as they went in."""
    folder = str(tmp_path)
    names = ["__words", "__content", "__id", "a.b", "row", "key", "id", "copies", "w", "f", "size"]
    long = [f"{HARD_TEXTS[6]} number {i} of many texts " * 1 for i in range(12)]
    docs = frame(spark, long).select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")) for n in names})
    docs.selectExpr("doc_id", "1 as quality", "0 as toxic").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "no such words in any text here")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        rows = docs.collect()
        assert docs.columns == columns and rows
        assert all(r[n] == f"{n} of {r['doc_id']}" for r in rows for n in names)


def test_rows_of_two_sources_stay_apart(spark):
    """Rows with the same id and text in two sources are mixed for each source."""
    rows = [(1, "a b c", "x"), (1, "a b c", "y"), (2, "d e f", "x"), (None, "g h", "y"), (3, "g h", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").unionAll(
        spark.createDataFrame([("a b", "z")] * 3, "text string, source string").selectExpr("cast(7 as long)", "text", "source")
    )
    taken = Counter()
    for r in source_mixing.mixed_documents(docs).collect():
        taken[r["source"]] += len(r["text"].split())
    targets = brute.targets({"x": 6, "y": 7, "z": 6})
    assert all(abs(taken[s] - targets[s]) <= 3 for s in targets)


def test_one_row_of_a_group_stays(spark):
    """Repeated and null ids: distinct texts are never lost, copies and equal rows go."""
    a, b = HARD_TEXTS[6], "some other words that are not like those at all " * 3
    rows = [(1, a, 0), (1, b, 0), (2, a, 1), (None, b, 1), (None, "third text of its own here", 1), (3, a, 2), (3, a, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    kept = sorted(simhash_dedup.keep_one(docs).collect(), key=str)
    assert kept == sorted([r for r in docs.collect() if tuple(r) in (rows[0], rows[1], rows[4])], key=str)
