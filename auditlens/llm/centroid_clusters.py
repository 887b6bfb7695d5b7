"""Centroid clustering of vectors, with zone maps along a Hilbert curve.

Vectors are put in the order of a Hilbert curve and packed into blocks, each with the
smallest and largest value of every component.  A round bounds the distance of each
centroid to each block's box from below and above: centroids whose lower bound is beyond
another's upper bound cannot be the nearest of any vector inside.  A block with one
candidate adds the sum it carries; otherwise its vectors are compared with the
candidates, exactly, in whole numbers.  Tasks return one sum a cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.tables import shuffle_partitions, stored

DIMENSIONS = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024.0
SEED = "3:"
#: Vectors of a block, bits of a component that the curve sees, and the largest component: with it, squared
#: distances of 64 components stay below 2 ** 63.
BLOCK_ROWS = 256
CURVE_BITS = 4
LARGEST = 1 << 27


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """Places on the Hilbert curve of rows of whole numbers below 2 ** bits, as byte strings in its order.

    By Skilling's transform ("Programming the Hilbert curve", 2004), all rows at once.
    """
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = np.uint32(q - 1)
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p).astype(np.uint32)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.uint32)
    q = top
    while q > 1:
        flip ^= np.where((x[n - 1] & q) != 0, np.uint32(q - 1), np.uint32(0))
        q >>= 1
    x ^= flip
    # The highest bit of every component first, then the next.
    planes = [((x >> np.uint32(b)) & 1).astype(np.uint8) for b in range(bits - 1, -1, -1)]
    return [row.tobytes() for row in np.packbits(np.concatenate(planes).T, axis=1)]


def box_bounds(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest squared distance of each centroid to any point of the box."""
    below, above = low - centroids, centroids - high
    near = np.maximum(np.maximum(below, above), 0)
    far = np.maximum(np.abs(below), np.abs(above))
    return (near * near).sum(axis=1), (far * far).sum(axis=1)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The numbers of the centroids that can be nearest to a point of the box, ties included."""
    near, far = box_bounds(low, high, centroids)
    return np.flatnonzero(near <= far.min())


def nearest(points: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray):
    """The nearest centroid of each point, the smaller number in a tie, and its squared distance."""
    some = candidates(low, high, centroids)
    distances = np.stack([((points - centroids[c]) ** 2).sum(axis=1) for c in some])
    best = distances.argmin(axis=0)
    return some[best], distances[best, np.arange(len(points))]


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def _with_keys(dimensions: int, low: int, high: int):
    """Cells of the curve: the range of all components cut into equal parts."""
    width = max(1, -(-(high - low + 1) // (1 << CURVE_BITS)))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            cells = (_matrix(part.column("v"), dimensions) - low) // width
            keys = pa.array(hilbert_keys(cells, CURVE_BITS), pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, keys], names=[*part.schema.names, "place"])

    return run


def _blocks(dimensions: int, block_rows: int):
    def block(ids: pa.Array, points: np.ndarray) -> dict:
        lists = lambda a: pa.array([a.tolist()], pa.list_(pa.int64()))
        return {
            "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            "low": lists(points.min(axis=0)),
            "high": lists(points.max(axis=0)),
            "total": lists(points.sum(axis=0)),
            "points": pa.array([points.astype("<i4").tobytes()], pa.binary()),
        }

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0

        def flushed(most: int) -> Iterator[pa.RecordBatch]:
            nonlocal ids, rows, held
            while held and held >= most:
                all_ids, all_rows = pa.concat_arrays(ids), np.concatenate(rows)
                n = min(held, block_rows)
                yield pa.RecordBatch.from_pydict(block(all_ids[:n], all_rows[:n]))
                ids, rows, held = [all_ids[n:]], [all_rows[n:]], held - n

        for part in parts:
            if part.num_rows:
                ids.append(part.column("id"))
                rows.append(_matrix(part.column("v"), dimensions))
                held += part.num_rows
                yield from flushed(block_rows)
        yield from flushed(1)

    return run


def zone_blocks(vectors: DataFrame, dimensions: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(ids, low, high, total, points): blocks of neighbouring vectors from rows (id, v) of whole numbers."""
    id_type = vectors.schema["id"].dataType.simpleString()
    ends = vectors.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    keyed = vectors.mapInArrow(
        _with_keys(dimensions, ends[0] or 0, ends[1] or 0), f"id {id_type}, v array<long>, place binary"
    )
    # Equal vectors share a place; a number of their own lets a large group of them fill several blocks and tasks.
    keyed = stored(keyed.withColumn("row", F.monotonically_increasing_id()), "places")
    ranged = keyed.repartitionByRange(shuffle_partitions(vectors), "place", "row").sortWithinPartitions("place", "row")
    schema = f"ids array<{id_type}>, low array<long>, high array<long>, total array<long>, points binary"
    return stored(ranged.select("id", "v").mapInArrow(_blocks(dimensions, block_rows), schema), "zones")


def _each_block(part: pa.RecordBatch, dimensions: int):
    low, high, total = (_matrix(part.column(c), dimensions) for c in ("low", "high", "total"))
    for i, points in enumerate(part.column("points")):
        yield i, low[i], high[i], total[i], np.frombuffer(points.as_buffer(), "<i4").reshape(-1, dimensions)


def _sums(centroids: np.ndarray, dimensions: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), dimensions), dtype=np.int64)
        counts = np.zeros(len(centroids), dtype=np.int64)
        for part in parts:
            for _, low, high, total, points in _each_block(part, dimensions):
                some = candidates(low, high, centroids)
                if len(some) == 1:
                    sums[some[0]] += total
                    counts[some[0]] += len(points)
                    continue
                points = points.astype(np.int64)
                found, _ = nearest(points, low, high, centroids)
                np.add.at(sums, found, points)
                counts += np.bincount(found, minlength=len(centroids))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used, pa.int32()),
                pa.array(counts[used]),
                pa.array(sums[used].tolist(), pa.list_(pa.int64())),
            ],
            names=["cluster", "n", "total"],
        )

    return run


def _assigned(centroids: np.ndarray, dimensions: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids = part.column("ids")
            for i, low, high, _, points in _each_block(part, dimensions):
                found, distance = nearest(points.astype(np.int64), low, high, centroids)
                yield pa.RecordBatch.from_arrays(
                    [ids[i].values, pa.array(found, pa.int32()), pa.array(distance, pa.int64())],
                    names=["id", "cluster", "distance"],
                )

    return run


def _update(blocks: DataFrame, centroids: np.ndarray, dimensions: int) -> np.ndarray:
    """Each centroid's mean, rounded down; one without vectors stays.  The driver sees one row a cluster."""
    parts = blocks.mapInArrow(_sums(centroids, dimensions), "cluster int, n long, total array<long>")
    total = F.array(*[F.sum(F.col("total")[d].cast("decimal(38,0)")) for d in range(dimensions)])
    moved = centroids.copy()
    for row in parts.groupBy("cluster").agg(F.sum("n").alias("n"), total.alias("total")).collect():
        moved[row["cluster"]] = [int(x) // row["n"] for x in row["total"]]
    return moved


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: float) -> DataFrame:
    """(id, v): the vectors of the right length without a null, infinite or too large component, in whole numbers."""
    v = F.col(f"`{vector_col}`")
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(scale * x.cast("double")) <= LARGEST)
    kept = vectors.where((F.size(v) == dimensions) & F.forall(v, fits))
    whole = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return kept.select(F.col(f"`{id_col}`").alias("id"), whole.alias("v"))


def cluster_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: float = SCALE,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per kept vector: id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    A vector is kept if it has `dimensions` components, none of them null or not finite;
    a component times `scale` may be LARGEST at most, beyond which a squared distance does
    not fit a long.  The first centroids are the vectors whose ids have the smallest hash,
    equal ids by their components, null ids last; with fewer vectors than clusters there are
    fewer.  Repeated rows count each.  Without vectors there is no row.  Other columns are
    ignored, whatever their names.
    """
    whole = stored(whole_vectors(vectors, id_col, vector_col, dimensions, scale), "vectors")
    named = F.sha2(F.concat(F.lit(SEED), F.col("id").cast("string")), 256)
    first = whole.orderBy(named.asc_nulls_last(), "v").limit(clusters).collect()
    centroids = np.array([r["v"] for r in first], dtype=np.int64).reshape(-1, dimensions)
    out = f"id {whole.schema['id'].dataType.simpleString()}, cluster int, distance long"
    if not first:
        assigned = whole.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        sums = []
    else:
        blocks = zone_blocks(whole, dimensions, block_rows)
        for _ in range(rounds):
            moved = _update(blocks, centroids, dimensions)
            if (moved == centroids).all():
                break  # nothing changes in the rounds left
            centroids = moved
        assigned = stored(blocks.mapInArrow(_assigned(centroids, dimensions), out), "assigned")
        sums = assigned.groupBy("cluster").agg(F.sum("distance")).collect()  # one row a cluster
    by_cluster = dict(map(tuple, sums))
    known = sorted(by_cluster)

    def of_cluster(values: list, kind: str):
        return F.element_at(F.array(*[F.lit(x) for x in values]), F.col("cluster") + 1) if values else F.lit(None).cast(kind)

    inertias = [by_cluster.get(c, 0) for c in range(len(centroids))]
    return assigned.select(
        F.col("id").alias(id_col),
        "cluster",
        "distance",
        of_cluster(inertias, "long").cast("long").alias("cluster_inertia"),
        F.lit(sum(by_cluster[c] for c in known)).cast("long").alias("inertia"),
        of_cluster([centroid_digest(c) for c in centroids], "string").alias("centroid_sha256"),
    )
