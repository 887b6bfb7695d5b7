from __future__ import annotations

import brute
from hypothesis import given as drawn
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditlens.llm import simhash_dedup
from auditlens.llm.simhash_dedup import BITS, PAIRED, covering_masks, links, simhash_groups


def rows(df):
    return {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in df.collect()}


def test_given_and_hard_texts_match_brute_force(given, hard):
    for docs in (given, hard):
        texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        prints = {d: brute.simhash(t) for d, t in texts.items()}
        parts = brute.components(prints)
        assert rows(simhash_groups(docs)) == {d: (f"{prints[d]:016x}", parts[d]) for d in texts}


@settings(max_examples=300, deadline=None)
@drawn(st.sets(st.integers(0, BITS - 1), max_size=2), st.integers(0, 2**64 - 1))
def test_pairs_within_the_radius_share_a_table(flipped, x):
    y = x
    for bit in flipped:
        y ^= 1 << bit
    assert any(x & m == y & m for m in covering_masks())


def test_large_buckets_are_linked_without_pairs(spark):
    """A ball around one fingerprint: far more than PAIRED members in a bucket, all connected."""
    center = 0x0123_4567_89AB_CDEF
    ball = {center} | {center ^ 1 << i for i in range(BITS)} | {center ^ 1 << i ^ 1 << (i * 7 + 1) % BITS for i in range(BITS)}
    far = {center ^ 0xFFFF << 16, center ^ 0xFFF}
    assert len(ball) > 4 * PAIRED
    values = [simhash_dedup._signed(x) for x in ball | far]
    edges = links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    assert all((e["a"] ^ e["b"]).bit_count() <= 2 or ((e["a"] ^ e["b"]) & 2**64 - 1).bit_count() <= 2 for e in edges)
    from auditlens.llm.components import connected_components

    frame = spark.createDataFrame([(e["a"], e["b"]) for e in edges], "a long, b long")
    parts = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    expected = brute.components({v: v for v in values})
    assert {v: parts.get(v, v) for v in values} == expected


def test_chains_are_followed_to_the_end(spark):
    from auditlens.llm.components import connected_components

    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)]
    parts = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(parts[i] == 0 for i in range(201))
    assert parts[500] == parts[501] == 500


def test_one_of_each_group_stays_with_its_columns(hard, empty, spark):
    kept = simhash_dedup.keep_one(hard)
    assert kept.columns == hard.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    groups = simhash_groups(hard).select("component_id").distinct()
    assert ids == sorted(r[0] for r in groups.collect())
    assert simhash_dedup.keep_one(empty).count() == 0 and simhash_groups(empty).count() == 0
    doubled = hard.unionAll(hard).unionAll(hard.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    again = [r["doc_id"] for r in simhash_dedup.keep_one(doubled).collect()]
    assert sorted(again) == ids  # a copy without an id goes, too
    assert simhash_groups(doubled).count() == 2 * hard.count() + 1
