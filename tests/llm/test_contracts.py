"""The registered queries and operators against brute force, on given and on hostile tables."""

from __future__ import annotations

import random

import brute
import pytest
from conftest import FOLDER, frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from __spark_entry__ import oracle_sql, queries
from auditlens.llm import (
    contextual_pii,
    license_scan,
    quality_rules,
    secret_scan,
    source_mixing,
    substring_dedup,
    suffix_dedup,
    token_files,
)
from auditlens.llm.queries import TOKENIZER

RNG = random.Random(11)


def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


def rows(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def repetitive(size: int) -> list[str]:
    """Documents cut together from one text, at word and at byte borders."""
    base = [f"w{RNG.randrange(40)}" for _ in range(400)]
    line = " ".join(base)
    out = []
    for _ in range(size):
        parts = []
        for _ in range(RNG.randrange(6)):
            a = RNG.randrange(380)
            parts.append(
                RNG.choice(
                    [
                        " ".join(base[a : a + RNG.randrange(60)]),
                        line[a : a + RNG.randrange(150)],
                        " ".join(f"x{RNG.randrange(500)}" for _ in range(RNG.randrange(40))),
                        "q " * RNG.randrange(60),
                        "é" * RNG.randrange(60),
                    ]
                )
            )
        out.append(RNG.choice([" ", "", "\n"]).join(parts))
    return out


@pytest.fixture(scope="module")
def tables(spark, given, hard):
    return [given, hard, frame(spark, repetitive(120)).repartition(6)]


def test_all_operators_and_the_pipeline_are_registered():
    names = [n for n in queries() if n.startswith("op") or n == "pipeline"]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
    assert set(oracle_sql()) & set(names) == {"op3_license_scan"}


def test_substring_dedup(tables):
    for docs in tables:
        got = rows(substring_dedup.dedup_windows(docs), "n_words", "n_removed", "kept_sha256")
        assert got == brute.substring_dedup(texts(docs))


def test_suffix_dedup(tables):
    for docs in tables:
        got = rows(suffix_dedup.dedup_bytes(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == brute.suffix_dedup(texts(docs))


def test_removed_text_is_returned_too(hard):
    import hashlib

    for r in substring_dedup.dedup_windows(hard, with_text=True).collect():
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
    for r in suffix_dedup.dedup_bytes(hard, with_text=True).collect():
        assert hashlib.sha256(r["kept_bytes"]).hexdigest() == r["kept_sha256"]


@pytest.mark.parametrize("dedup", [substring_dedup.dedup_windows, suffix_dedup.dedup_bytes])
def test_repeated_and_null_ids(spark, dedup):
    base = repetitive(12)
    once = frame(spark, base)
    plain = sorted(tuple(r) for r in dedup(once).collect())
    twice = sorted(tuple(r) for r in dedup(once.unionAll(once)).collect())
    assert twice == sorted(plain * 2)
    last = sorted(tuple(r)[1:] for r in dedup(once).where("doc_id = 11").collect())
    unnamed = once.withColumn("doc_id", F.when(F.col("doc_id") != 11, F.col("doc_id")))
    assert sorted(tuple(r)[1:] for r in dedup(unnamed).where("doc_id is null").collect()) == last


def test_quality_counts(spark, tables, empty):
    trusted = quality_rules.trusted_ids(spark.read.parquet(f"{FOLDER}/labels.parquet"))
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for docs in tables:
        found = quality_rules.quality_verdicts(docs, trusted).collect()
        expected = texts(docs)
        for r in found:
            assert tuple(r[c] for c in columns) == brute.quality_counts(expected[r["doc_id"]])
            assert r["kept"] is (not r["base_failed"] and r["score"] >= quality_rules.MIN_SCORE)
    nobody = quality_rules.quality_verdicts(tables[0], trusted.limit(0)).collect()
    assert all(r["kept"] is not r["base_failed"] for r in nobody)
    assert quality_rules.quality_verdicts(empty, trusted).count() == 0


def test_quality_tells_labelled_documents_apart(spark):
    folder = FOLDER.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = labels.where("doc_id % 2 = 1").select("doc_id", "quality")
    trusted = quality_rules.trusted_ids(labels.where("doc_id % 2 = 0"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    judged = quality_rules.quality_verdicts(docs, trusted).join(held, "doc_id").where("not base_failed").collect()
    good = [r["kept"] for r in judged if r["quality"] == 1]
    poor = [r["kept"] for r in judged if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(poor) <= 0.3 * len(poor)


def test_mixing(spark, tables, empty):
    for docs in tables:
        expected = texts(docs)
        source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
        sizes = {d: len(brute.words(t)) for d, t in expected.items()}
        totals: dict = {}
        for d, n in sizes.items():
            totals[source[d]] = totals.get(source[d], 0) + n
        target, taken = brute.targets(totals), dict.fromkeys(totals, 0)
        first = source_mixing.mixing_copies(docs).collect()
        for r in first:
            s = source[r["doc_id"]]
            assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == totals[s]
            assert r["target"] == pytest.approx(target[s])
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[s] += r["taken"]
        for s in totals:
            largest = max(n for d, n in sizes.items() if source[d] == s)
            assert abs(taken[s] - target[s]) <= largest
        again = source_mixing.mixing_copies(docs.repartition(5)).collect()
        assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, first), key=repr)
    assert source_mixing.mixing_copies(empty).count() == 0


def test_mixing_weights_order_and_caps(spark):
    names = ["b", None, "Z", "é", "a", "small"]
    docs = frame(spark, ["w " * (3 if s == "small" else 100) for s in names for _ in range(10)], [s for s in names for _ in range(10)])
    found = {r["source"]: r["target"] for r in source_mixing.mixing_copies(docs).join(docs.select("doc_id", "source"), "doc_id").collect()}
    sizes = {s: 30 if s == "small" else 1000 for s in names}
    assert found == pytest.approx(brute.targets(sizes)) and found["small"] == 90


def test_pii(tables, empty):
    for docs in tables:
        expected = texts(docs)
        for r in contextual_pii.pii_digest(contextual_pii.find_pii(docs)).collect():
            assert tuple(r)[1:6] == brute.pii(expected[r["doc_id"]])[:5]
            base = {f"{k}:{s}:{e}" for s, _, e, k in brute.pii(expected[r["doc_id"]])[5]}
            assert base <= set(r["spans"].split(","))
    assert contextual_pii.find_pii(empty).count() == 0


def test_pii_learns_a_context(spark):
    """A phone number without a plus sign, in a context that held phone numbers only."""
    texts_ = [f"Please call me on +1 555 010 {1000 + i} today" for i in range(6)]
    texts_ += ["Please call me on 555-010-7777, or not", "we counted 5550101234 birds", "call me on monday"]
    found = rows(contextual_pii.pii_digest(contextual_pii.find_pii(frame(spark, texts_))), "n_phone", "spans")
    assert found[6] == (0, "phone:18:30") and texts_[6][18:30] == "555-010-7777"
    assert found[7] == (0, "") and found[8] == (0, "")
    assert all(found[i][0] == 1 for i in range(6))


def test_secrets(tables, empty):
    for docs in tables:
        expected = texts(docs)
        for r in secret_scan.secret_digest(secret_scan.find_secrets(docs)).collect():
            assert tuple(r)[1:5] == brute.secrets(expected[r["doc_id"]])[:4]
    assert secret_scan.find_secrets(empty).count() == 0


def test_secret_formats_and_null_ids(spark):
    docs = frame(
        spark,
        [
            "-----BEGIN RSA PRIVATE KEY-----",
            "x ghp_" + "a1B2" * 10,
            "PassWord='aaaaaaaaaaaa'",
            "sk_live_" + "Q" * 20 + " xoxb-1234567890ab",
            "the secretary took the keynote",
        ],
    )
    both = docs.unionAll(docs.withColumn("doc_id", F.lit(None).cast("long")))
    found = secret_scan.secret_digest(secret_scan.find_secrets(both)).collect()
    kinds = [sorted(x.split(":")[0] for x in r["spans"].split(",") if x) for r in found]
    expected = [["private_key"], ["code_host"], ["assign"], ["chat", "payment"], []]
    assert sorted(kinds) == sorted(expected * 2)


@pytest.mark.parametrize("rule", secret_scan.RULES)
def test_trigram_queries_are_necessary(rule):
    """Every string that a rule matches satisfies its query."""
    samples = {
        "assign": ["api_key: abcdefghijkl", "APIKEY=abcdefghijkl", "passwd 'x", "TOKEN = \"abcdefghijkl\""],
        "access": ["AKIAABCDEFGHIJKLMN"],
        "hex": ["0123456789abcdef"],
        "private_key": ["-----BEGIN PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----"],
        "code_host": ["gho_" + "a" * 36, "ghr_" + "Z" * 40],
        "chat": ["xoxp-" + "1" * 12],
        "payment": ["sk_live_" + "a" * 16],
        "maps": ["AIza" + "x" * 35],
        "web_token": [".".join(["eyJ" + "a" * 12, "eyJ" + "b" * 12, "c" * 12])],
    }
    clauses = secret_scan.trigram_query(secret_scan.RULES[rule])
    assert bool(clauses) is (rule != "hex")
    for text in samples[rule]:
        low = text.lower()
        if rule == "assign" and "'x" in text:
            continue
        assert all(any(all(t in low for t in choice) for choice in clause) for clause in clauses)


def test_licenses(spark, hard, empty):
    mit = license_scan.TEMPLATES[16][1]
    docs = frame(
        spark,
        [
            "prose before\n  released UNDER the mit license!!\nprose after",
            mit,
            "Some story.\n\n" + mit.replace("deal in", "work with") + "\n\nMore story.",
            "released the license under discussion",
            "This work is licensed under the GNU General Public License, version 3.",
        ],
    )
    found = {(r["doc_id"], r["license"]): round(r["similarity"], 3) for r in license_scan.scan_licenses(docs).collect()}
    assert set(found) == {(0, "MIT"), (1, "MIT"), (2, "MIT"), (4, "GPL-3.0")}
    assert found[0, "MIT"] == found[1, "MIT"] == found[4, "GPL-3.0"] == 1.0 and 0.9 < found[2, "MIT"] < 1
    license_scan.scan_licenses(hard).collect()
    assert license_scan.scan_licenses(empty).count() == 0


@pytest.mark.parametrize("size", range(1, 60, 7))
def test_size_bounds_lose_no_template(size):
    low, high = license_scan.size_bounds(size)
    for other in range(1, 200):
        reached = 200 * min(size, other) >= license_scan.PERCENT * (size + other)
        assert reached == (low <= other <= high)
        if reached:
            shared = [k for k in range(min(size, other) + 1) if 200 * k >= license_scan.PERCENT * (size + other)]
            assert min(shared) >= license_scan.least_shared(size)


def test_token_files(spark, tables, empty):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for docs in tables:
        got = rows(token_files.round_trip(docs, TOKENIZER, 2), "start", "n_tokens", "ids_crc32")
        assert got == brute.token_rows(texts(docs), tokenizer)
    assert token_files.round_trip(empty, TOKENIZER, 2).count() == 0
    twice = tables[1].unionAll(tables[1].withColumn("doc_id", F.lit(None).cast("long")))
    found = token_files.round_trip(twice, TOKENIZER, 2).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None] * 18 + list(range(18))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:]))
