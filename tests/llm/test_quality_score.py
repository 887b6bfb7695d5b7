"""The quality model against plain Python: features, smoothing, folds, offset and verdicts."""

from __future__ import annotations

import math
import struct
from collections import Counter

import brute
import pytest
import xxhash
from conftest import FOLDER

from auditlens.llm import quality_rules as q


def _signed(h):
    return h - (1 << 64) if h >> 63 else h


def features(text):
    w = [x.encode() for x in brute.words(text)]
    single = [xxhash.xxh64_intdigest(x, 42) for x in w]
    pairs = [
        xxhash.xxh64_intdigest(struct.pack("<Q", b), xxhash.xxh64_intdigest(struct.pack("<Q", a), 42))
        for a, b in zip(single, single[1:])
    ]
    return [h % q.BUCKETS for h in single + pairs]


def ratios(raw, target):
    size, weight, total = sum(raw.values()), len(raw), sum(target.values())
    return {b: math.log(target[b] + weight * r / size) - math.log(r / size) - math.log(total + weight) for b, r in raw.items()}


def mean(f, table):
    return sum(table.get(b, 0.0) for b in f) / len(f)


def percentile(values, share):
    values = sorted(values)
    at = share * (len(values) - 1)
    low = math.floor(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (at - low) * (values[high] - values[low])


def verdicts(docs: dict, labels: dict):
    """{id: (score, kept)} of documents {id: text}, all labelled rows within the bound of the fit."""
    raw, folds = Counter(), [Counter() for _ in range(q.FOLDS)]
    made = {d: features(t) for d, t in docs.items()}
    fold = {d: _signed(xxhash.xxh64_intdigest((t or "").encode(), 42)) % q.FOLDS for d, t in docs.items()}
    for d, f in made.items():
        raw.update(f)
        if labels.get(d) == 1:
            folds[fold[d]].update(f)
    target = sum(folds, Counter())
    failed = {d: brute.quality_counts(t)[5] for d, t in docs.items()}
    without = [ratios(raw, target - folds[i]) for i in range(q.FOLDS)]
    held = [mean(made[d], without[fold[d]]) for d in docs if labels.get(d) == 1 and not failed[d]]
    offset = max(0.0, q.MIN_SCORE - percentile(held, q.HELD_OUT_SHARE))
    table = ratios(raw, target)
    out = {}
    for d, f in made.items():
        score = mean(f, table) + offset if f else None
        out[d] = (score, not failed[d] and score >= q.MIN_SCORE)
    return out


def test_scores_and_verdicts(spark, given):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    docs = {r["doc_id"]: r["text"] for r in given.collect()}
    trusted = q.trusted_ids(spark.read.parquet(f"{FOLDER}/labels.parquet"))
    expected = verdicts(docs, labels)
    for r in q.quality_verdicts(given, trusted).collect():
        score, kept = expected[r["doc_id"]]
        assert r["score"] == (None if score is None else pytest.approx(score, abs=1e-9))
        assert r["kept"] == kept or abs(score - q.MIN_SCORE) < 1e-9
    assert 0 < sum(k for _, k in expected.values()) < len(docs)


def test_the_plan_holds_no_model(spark, given):
    """65,536 numbers as text would fill the driver with every plan that names them."""
    trusted = q.trusted_ids(spark.read.parquet(f"{FOLDER}/labels.parquet"))
    plan = q.quality_verdicts(given, trusted)._jdf.queryExecution().toString()
    assert len(plan) < 200_000
