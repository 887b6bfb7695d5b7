"""Clusters against plain Python, and the curve and the boxes by themselves."""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
import pytest

from auditlens.llm import centroid_clusters as cc
from auditlens.llm.queries import op13
from tests.llm.conftest import FOLDER


def brute(rows, clusters=8, rounds=10, dimensions=64):
    kept = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)
    ]
    order = sorted(
        kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    )
    centroids = [v for _, v in order[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = [[] for _ in centroids]
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(groups, centroids)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    by = {c: sum(d for _, x, d in found if x == c) for c in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, by[c], sum(by.values()), sha[c]) for i, c, d in found), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(spark, rows):
    rows = [(i, v, "x", 1) for i, v in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, cluster int")


def test_query_equals_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    assert found(op13(spark, FOLDER)) == brute(rows)


def test_hard_rows(spark):
    """Copies that fill many blocks, ties, nulls, wrong lengths, repeated and null ids, columns that clash."""
    rng = np.random.default_rng(1)
    points = [(i, np.float32(rng.normal(size=64) + i % 5).tolist()) for i in range(60)]
    rows = points + [(100 + i, points[3][1]) for i in range(40)] + [(5, points[9][1]), (5, points[5][1])]
    rows += [(None, points[1][1]), (7, None), (8, []), (9, [1.0] * 63), (10, [1.0] * 65), (11, [0.0] * 64)]
    rows += [(12, [None] + [1.0] * 63), (13, [math.nan] + [1.0] * 63), (14, [math.inf] + [1.0] * 63)]
    rows += [(15, [-0.0] * 64), (16, [-1e-30] * 64)]
    assert found(cc.cluster_vectors(vectors(spark, rows), block_rows=7)) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 3, 8])
def test_few_vectors(spark, n):
    rows = [(i, [float(i)] * 64) for i in range(n)]
    assert found(cc.cluster_vectors(vectors(spark, rows))) == brute(rows)


def test_equal_vectors_stay_in_the_first_cluster(spark):
    rows = [(i, [1.5] * 64) for i in range(50)]
    result = found(cc.cluster_vectors(vectors(spark, rows)))
    assert result == brute(rows) and {r[1] for r in result} == {0}


@pytest.mark.parametrize(("dimensions", "bits"), [(2, 3), (3, 2), (4, 1)])
def test_the_curve_visits_neighbours(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = cc.hilbert_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    ordered = cells[np.argsort(np.array([int.from_bytes(k, "big") for k in keys]))]
    assert (np.abs(np.diff(ordered, axis=0)).sum(axis=1) == 1).all()


def test_boxes_lose_no_nearest_centroid():
    rng = np.random.default_rng(2)
    for _ in range(200):
        centroids = rng.integers(-50, 50, (9, 5))
        points = rng.integers(-50, 50, (20, 5)) // rng.integers(1, 20)
        found, distance = cc.nearest(points, points.min(axis=0), points.max(axis=0), centroids)
        each = ((points[:, None] - centroids) ** 2).sum(axis=2)
        assert (found == each.argmin(axis=1)).all() and (distance == each.min(axis=1)).all()


def test_boxes_prune(spark):
    """Of well separated groups every block has one candidate, so that its vectors are not compared."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 64)) * 10
    points = np.floor(1024 * (centres[rng.integers(0, 4, 500)] + rng.normal(size=(500, 64)) * 0.01)).astype(np.int64)
    keys = cc.hilbert_keys((points - points.min()) // (np.ptp(points) // 15), cc.CURVE_BITS)
    ordered = points[np.argsort(np.array(keys, dtype=object))]
    counts = [len(cc.candidates(b.min(axis=0), b.max(axis=0), np.floor(1024 * centres).astype(np.int64))) for b in np.array_split(ordered, 50)]
    assert sum(counts) <= 60
