"""Near-duplicates by SimHash, found with covering locality-sensitive hashing.

A document's fingerprint has a bit set where more than half of its shingle hashes
have it.  Fingerprints link at Hamming distance 2 or less.

Covering tables: every bit position i gets a vector m(i) of three bits, not zero,
and table v, for each of the seven vectors v that are not zero, keeps the bits with
odd <m(i), v>.  Two fingerprints that differ in at most two positions leave a v that
is orthogonal to both m(i): in that table the differing bits are masked out and the
two collide.  So no pair within the radius is missed, with certainty and not just
with some probability.

Inside a bucket of up to `PAIRED` fingerprints, pairs are compared.  A larger bucket
is linked without pairs, and as exactly: each fingerprint is hung on itself and on
its one-bit neighbours, among the bits that the table masks out; two fingerprints
share such a hub if and only if they differ in at most two of those bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.components import connected_components
from auditlens.llm.tables import row_key, stored, whole_row

BITS = 64
RADIUS = 2
PAIRED = 16
#: Shingles whose bits are counted at a time, so that a very long text needs no more memory.
CHUNK = 65_536


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """The kept bits of each table, as unsigned numbers."""
    tables = 2 ** (radius + 1)
    vectors = [i % (tables - 1) + 1 for i in range(bits)]
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, tables)
    ]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes | None, shingle: int = 3) -> bytes:
    """Eight bytes, most significant first."""
    found = (text or b"").lower().split()
    if not found:
        return bytes(8)
    joined = b" ".join(found)
    ends = list(accumulate(len(w) + 1 for w in found))
    starts = [0, *ends]
    last = ends[shingle - 1 :] or ends[-1:]
    digest = xxhash.xxh64_digest
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(last), CHUNK):
        hashes = b"".join(
            [digest(joined[s : e - 1], 42) for s, e in zip(starts[at : at + CHUNK], last[at : at + CHUNK])]
        )
        bits = np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(last)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp): one row per document; fp is the fingerprint as a signed long.

    Words are split at ASCII white space after lower-casing A to Z; a text with fewer
    words than a shingle is one shingle, and a null or empty text has fingerprint zero.
    """

    def batch(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in rows:
            made = b"".join(fingerprint(t.as_py(), shingle) for t in part.column(1))
            values = np.frombuffer(made, dtype=">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(batch, f"id {kind}, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp), enough to connect all within the radius."""
    masks = covering_masks()
    keyed = fps.select(
        "fp",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
                    for t, m in enumerate(masks)
                ]
            )
        ).alias("k"),
    ).select("fp", "k.table", "k.key")
    shared = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = stored(keyed.join(shared, ["table", "key"]), "buckets")

    few = members.where(F.col("members") <= PAIRED)
    left = few.select("table", "key", F.col("fp").alias("a"))
    right = few.select("table", "key", F.col("fp").alias("b"))
    pairs = left.join(right, ["table", "key"]).where(
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    )

    flips = F.array(
        *[F.array(F.lit(0), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks]
    )
    hung = (
        members.where(F.col("members") > PAIRED)
        .withColumn("flip", F.explode(F.get(flips, F.col("table"))))
        .select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("hub"))
    )
    # A hub used by one fingerprint alone links nothing; the others hang on the smallest.
    lowest = hung.groupBy("hub").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b <> top")
    stars = hung.join(lowest, "hub").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.select("a", "b").unionAll(stars).distinct()


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3
) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of docs.

    component_id is the smallest id among the documents reached over links, itself
    included.  Rows with a repeated id each get a row.  A null id takes part in
    linking and gets its group's smallest id that is not null, or null if there is none.
    Other columns of docs are ignored, whatever their names.
    """
    made = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stored(made.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    parts = connected_components(links(distinct.select("fp")))
    placed = distinct.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left")
    placed = placed.withColumn("component", F.coalesce("component", "fp"))
    lowest = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    # From here on joins are on fingerprints of which each side has one row, or which Spark can split.
    groups = placed.join(lowest, "component").select("fp", "component_id")
    return made.join(groups, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """docs with one row of each group left: the one with the smallest id, null ids last.

    Rows are told apart by all their columns, so rows that repeat an id with different
    texts are judged each; of wholly equal rows one stays.  Null and empty texts are one
    group.  Columns may have any names: a row travels as one struct.  Which rows stay is
    decided on keys and fingerprints; the rows themselves are shuffled once.
    """
    keyed = docs.select(row_key(docs, id_col, text_col).alias("key"), F.col(f"`{text_col}`").alias("text"))
    chosen = simhash_groups(keyed, "key", "text", shingle).where(F.col("key") == F.col("component_id"))
    rows = docs.select(row_key(docs, id_col, text_col).alias("key"), whole_row(docs).alias("row"))
    return rows.join(chosen.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]).select("row.*")
