"""A Merkle manifest of a table: a digest for every row, a root for all, and a proof for each.

Rows are leaves.  Per source they ascend by id and are hashed in runs of FANOUT until one
node is left, the source's root; the roots of the sources give the root of the table in
the same way.

The tree is built by a butterfly exchange.  Every FANOUT ** BLOCK_LEVELS neighbouring
leaves are a block, whose own tree one task hashes.  Then, round by round, blocks that lie
alike in neighbouring subtrees swap the roots of these subtrees (the `wire`), in groups of
FANOUT, and each hashes the common ancestor for itself.  After the last round every block
holds the root and the upper part of the proofs of all its leaves: nothing has to be sent
down the tree.  A round moves one short row a block, so a source of any size is spread out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.llm.tables import replaced, stored
from auditlens.operators.ordering import with_position

FANOUT = 3
#: A block has up to FANOUT ** BLOCK_LEVELS leaves.
BLOCK_LEVELS = 6
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_LEVEL = "struct<left:string,right:string>"
Level = tuple[str, str]


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    )


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def block_levels(nodes: list[str], levels: int | None, fanout: int = FANOUT) -> list[list[str]]:
    """The nodes of every level, the given ones first; without `levels`, until one is left."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        last = out[-1]
        out.append([_digest("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return out


def folded(node: str, levels: list[Level]) -> str:
    """The root that a node and its siblings, level by level, lead to."""
    for left, right in levels:
        node = _digest(left + node + right)
    return node


def _own_levels(leaves: list[dict], blocks: int, levels: int) -> list[list[str]]:
    """A block among others is raised to the level of a full one, a single block to its root."""
    return block_levels([x["leaf"] for x in leaves], levels if blocks > 1 else None)


def _block_roots(levels: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            leaves, blocks = part.column("leaves").to_pylist(), part.column("blocks").to_pylist()
            roots = [_own_levels(x, n, levels)[-1][0] for x, n in zip(leaves, blocks, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(roots)], names=[*part.schema.names, "node"])

    return run


def butterfly(state: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """From (tree, block, blocks, node) to (tree, block, root, levels).

    Blocks of a tree are numbered from 0 to blocks - 1.  `levels` holds the siblings to the
    left and right of the block's ancestor on every level above, joined.
    """
    state = stored(state.withColumn("levels", F.array().cast(f"array<{_LEVEL}>")), "butterfly")
    most = state.agg(F.max("blocks")).first()[0] or 0
    span = 1
    while span < most:
        width = span * fanout
        # The last subtree may have fewer blocks than wires; its blocks then serve several.
        end = F.least(F.ceil((F.col("block") + 1) / width) * width, F.col("blocks"))
        mine = F.floor(F.col("block") / span)
        own = F.least(F.lit(span), F.col("blocks") - mine * span)
        offset = F.col("block") - mine * span
        wires = F.when(own < span, F.sequence(offset, F.lit(span - 1).cast("long"), own)).otherwise(F.array(offset))
        sent = state.where(F.col("blocks") > span).select(
            "tree",
            F.floor(F.col("block") / width).alias("group"),
            mine.alias("index"),
            end.alias("end"),
            offset.alias("offset"),
            "block",
            "blocks",
            "node",
            "levels",
            F.explode(wires).alias("wire"),
        )
        swapped = sent.groupBy("tree", "group", "wire").agg(
            # At most one node of each of the FANOUT subtrees.
            F.sort_array(F.collect_list(F.struct("index", "node"))).alias("run"),
            F.collect_list(
                F.when(F.col("wire") == F.col("offset"), F.struct("index", "block", "blocks", "levels"))
            ).alias("members"),
        )
        joined = F.array_join(F.col("run.node"), "")
        side = lambda keep: F.array_join(F.transform(F.filter("run", keep), lambda x: x["node"]), "")
        met = swapped.select("tree", "run", F.sha2(joined, 256).alias("node"), F.explode("members").alias("m")).select(
            "tree",
            "m.block",
            "m.blocks",
            "node",
            F.concat(
                "m.levels",
                F.array(
                    F.struct(
                        side(lambda x: x["index"] < F.col("m.index")).alias("left"),
                        side(lambda x: x["index"] > F.col("m.index")).alias("right"),
                    )
                ),
            ).alias("levels"),
        )
        done = state.where(F.col("blocks") <= span).select("tree", "block", "blocks", "node", "levels")
        state = replaced(state, met.unionByName(done), "butterfly")
        span = width
    return state.select("tree", "block", F.col("node").alias("root"), "levels")


def _proofs(levels: int):
    """Per leaf: its digest, the roots, the digest of its proof, and the root its present state leads to."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: dict[str, list] = {c: [] for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
            for row in part.select([c for c in part.schema.names if c != "ids"]).to_pylist():
                leaves = row["leaves"]
                nodes = _own_levels(leaves, row["blocks"], levels)
                upper = [(x["left"], x["right"]) for x in row["levels"]]
                above = "".join(left + right for left, right in upper)
                for place, x in enumerate(leaves):
                    lower, i = [], place
                    for level in nodes[:-1]:
                        first = i - i % FANOUT
                        lower.append(("".join(level[first:i]), "".join(level[i + 1 : first + FANOUT])))
                        i //= FANOUT
                    found = folded(x["present"], lower + upper)
                    out["leaf"].append(x["leaf"])
                    out["subroot"].append(row["subroot"])
                    out["root"].append(row["root"])
                    out["proof_sha256"].append(_digest("".join(a + b for a, b in lower) + above))
                    out["folded_root"].append(found)
                    out["verified"].append(found == row["root"])
            ids = part.column("ids").flatten()
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(v) for v in out.values()]], names=["id", *out])

    return run


def manifest(
    docs: DataFrame,
    present: Sequence[Column] | None = None,
    id_col: str = "doc_id",
    tree_col: str = "source",
    columns: Sequence[str] = LEAF_COLUMNS,
    levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """One row per row of docs: id_col, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves are digests of `columns`, in this order; a null column is told from an empty
    one.  `present` gives the same columns as they are found now; `verified` says whether
    the proof of the recorded row leads from the present one to the root.  Rows of a source
    ascend by id, null ids first, and rows with the same id by their digest; repeated rows
    are leaves of their own.  A block has FANOUT ** `levels` leaves, whatever their number.  A null source is a source, the first.  Texts of any length are
    read once and not moved.  An empty table gives no row.  Other columns are ignored,
    whatever their names.
    """
    quoted = [F.col(f"`{c}`") for c in columns]
    leaves = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{tree_col}`").alias("source"),
        leaf_digest(quoted).alias("leaf"),
        leaf_digest(present or quoted).alias("present"),
    )
    # Written before they are ranged, as ranging reads its input twice.
    placed = with_position(stored(leaves, "leaves"), ["source", "id", "leaf", "present"], "at")
    firsts = placed.groupBy("source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    trees = with_position(firsts, ["first"], "tree").withColumnRenamed("source", "name")
    size = FANOUT**levels
    place = F.col("at") - F.col("first")
    blocks = (
        placed.join(trees, placed["source"].eqNullSafe(trees["name"]))
        .select(
            (F.col("tree") - 1).alias("tree"),
            F.floor(place / size).alias("block"),
            F.ceil(F.col("n") / size).alias("blocks"),
            F.struct(place.alias("place"), "leaf", "present", "id").alias("x"),
        )
        .groupBy("tree", "block", "blocks")
        .agg(F.sort_array(F.collect_list("x")).alias("x"))  # a block is of bounded size
        .select(
            "tree",
            "block",
            "blocks",
            F.col("x.id").alias("ids"),
            F.transform("x", lambda x: F.struct(x["leaf"].alias("leaf"), x["present"].alias("present"))).alias("leaves"),
        )
    )
    id_type = docs.schema[id_col].dataType.simpleString()
    packed = f"tree long, block long, blocks long, ids array<{id_type}>, leaves array<struct<leaf:string,present:string>>"
    blocks = stored(blocks.mapInArrow(_block_roots(levels), packed + ", node string"), "blocks")
    tops = stored(butterfly(blocks.select("tree", "block", "blocks", "node")), "subtrees")
    sources = trees.agg(F.count(F.lit(1))).first()[0]
    # The roots of the sources are the blocks of one more tree.
    roots = tops.where("block = 0").select(
        F.lit(0).cast("long").alias("tree"),
        F.col("tree").alias("block"),
        F.lit(sources).cast("long").alias("blocks"),
        F.col("root").alias("node"),
    )
    whole = butterfly(roots).select(
        F.col("block").alias("tree"), F.col("root"), F.col("levels").alias("over")
    )
    upper = tops.withColumnRenamed("root", "subroot").join(whole, "tree")
    upper = upper.select("tree", "block", "subroot", "root", F.concat("levels", "over").alias("levels"))
    out = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    found = blocks.drop("node").join(upper, ["tree", "block"]).mapInArrow(_proofs(levels), f"id {id_type}, {out}")
    return found.withColumnRenamed("id", id_col)


def without_breaks(docs: DataFrame) -> list[Column]:
    """The columns of documents, some of whose texts have lost their line breaks: those of an even crc32 of the id."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return [changed if c == "text" else F.col(c) for c in LEAF_COLUMNS]
