"""Numpy helpers for operators that move packed blocks through a shuffle."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.operators.ordering import with_position

#: Classes that n-grams are counted in, to find those that are too frequent to lead a bucket.
SLOTS = 1 << 16
_FREQUENT = 4
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, in place."""
    x ^= x >> np.uint64(32)
    x *= _ODD[3]
    x ^= x >> np.uint64(29)
    x *= _ODD[0]
    x ^= x >> np.uint64(32)
    return x


def combined(*parts: np.ndarray) -> np.ndarray:
    """One hash of several, in which their order matters."""
    total = parts[0] * _ODD[0]
    for n, part in enumerate(parts[1:], start=1):
        total += (part ^ (part >> np.uint64(31))) * _ODD[n % 3]
        total ^= total >> np.uint64(27)
        total *= _ODD[3]
    return mixed(total)


def slot_of(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * _ODD[2]) >> np.uint64(48)).astype(np.int64)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((mixed(hashes * _ODD[1]) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def ranked(hashes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The order of minimisers: that of their hashes, with those of frequent classes last."""
    late = frequent[slot_of(hashes)].astype(np.uint64)
    return (hashes >> np.uint64(1)) | (late << np.uint64(63))


def at_every_byte(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers; `data` ends with eight spare bytes."""
    return np.ndarray((len(data) - 8,), dtype="<u8", buffer=data, strides=(1,))


def pack(*arrays: np.ndarray, text: bytes = b"") -> bytes:
    """Whole-number arrays and a text as one compressed block, numbers by byte planes."""
    parts = [struct.pack("<I", len(arrays))]
    planes = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(struct.pack("<2sQ", a.dtype.str[1:].encode(), len(a)))
        planes.append(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join([*parts, *planes, text]))


def unpack(block: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    (count,) = struct.unpack_from("<I", raw)
    kinds = [struct.unpack_from("<2sQ", raw, 4 + 10 * i) for i in range(count)]
    at, arrays = 4 + 10 * count, []
    for kind, size in kinds:
        dtype = np.dtype("<" + kind.decode())
        data = np.frombuffer(raw, dtype=np.uint8, count=size * dtype.itemsize, offset=at)
        arrays.append(np.ascontiguousarray(data.reshape(dtype.itemsize, size).T).reshape(-1).view(dtype))
        at += size * dtype.itemsize
    return arrays, raw[at:]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, id, text): text as bytes, and a long key in the order of the ids that tells texts apart.

    Ids that are whole numbers, not null and not repeated are keys themselves.  Otherwise
    keys are the positions of the distinct (id, text), null ids last; rows with the same
    id and the same text have the same key and so are judged alike.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    whole = rows.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    counts = rows.agg(F.count(F.lit(1)), F.count("id"), F.count_distinct("id")).first()
    if whole and counts[0] == counts[1] == counts[2]:
        return rows.select(F.col("id").cast("long").alias("key"), "id", "text")
    marked = rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit(b"")), 256))
    known = marked.select(F.col("id").isNull().alias("unnamed"), "id", "digest").distinct()
    placed = with_position(known, ["unnamed", "id", "digest"], "key").drop("unnamed")
    same: Column = marked["id"].eqNullSafe(placed["id"]) & (marked["digest"] == placed["digest"])
    return marked.join(placed, same).select("key", marked["id"], "text")


def frequent_classes(rows: DataFrame, hashes: Callable[[Iterator[tuple[int, bytes]]], Iterator[np.ndarray]]):
    """(frequent, bytes): which of the SLOTS classes of n-grams are far above the mean, and the size of all texts.

    Every n-gram is counted.  Tasks report classes above their own mean only; the driver
    gets one number a class.  The result steers how evenly buckets fill, never what they find.
    """

    def batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros(SLOTS, dtype=np.int64), 0

        def texts() -> Iterator[tuple[int, bytes]]:
            nonlocal size
            for part in parts:
                for value in part.column(0):
                    text = value.as_py() or b""
                    size += len(text)
                    yield 0, text

        for found in hashes(texts()):
            total += np.bincount(slot_of(found), minlength=SLOTS)
        some = np.flatnonzero(total > total.sum() * 2 / SLOTS)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-2, -1, *some.tolist()], pa.int64()), pa.array([size, int(total.sum()), *total[some].tolist()], pa.int64())],
            names=["slot", "n"],
        )

    counted = rows.select("text").mapInArrow(batch, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = {r["slot"]: r["n"] for r in counted.collect()}
    frequent = np.zeros(SLOTS, dtype=bool)
    limit = _FREQUENT * found.get(-1, 0) / SLOTS
    for slot, n in found.items():
        if slot >= 0 and n > limit:
            frequent[slot] = True
    return frequent, found.get(-2, 0)


def joined_ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges as ascending ranges that do not touch."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    opens = np.concatenate([[True], first[1:] > reach[:-1]]) if len(first) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(opens)
    return first[at], reach[np.concatenate([at[1:] - 1, [len(first) - 1]])] if len(first) else reach
