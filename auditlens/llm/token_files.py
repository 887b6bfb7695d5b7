"""Token ids of documents in compressed binary blocks, written and read by all executors.

A folder has two tables: `table`, the frequency of every id in the whole corpus, made
once and shared by all blocks, and `blocks`, each row a run of whole documents in
ascending order of their id: where it stands (shard, block), the ids and token counts
of its documents, and their tokens coded by `rans`.  Blocks do not depend on each other.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlens.llm.rans import Coder, quantise
from auditlens.llm.tables import shuffle_partitions, stored
from auditlens.session import shared_folder

#: Tokens after which a block is closed; a longer document makes a longer block.
BLOCK_TOKENS = 1 << 20
#: Pieces of text whose ids a worker remembers.
REMEMBERED = 1_200_000

_ENCODERS: dict[str, "PieceEncoder"] = {}


class PieceEncoder:
    """Encodes whole texts with a byte-level tokenizer, each distinct piece of text once.

    The tokenizer never merges across a single space or line break between two
    characters that are not white space, nor between a letter and a mark.  So the ids of
    a text are those of its pieces one after another.  Texts with other white space, or
    with a special token in them, are encoded as a whole.

    A piece follows a space, or, where it begins with a line break, that break; the start
    of a text is treated as a break whose ids are cut off again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.wide = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        split = self.tokenizer.pre_tokenizer
        self.by_bytes = (
            self.tokenizer.normalizer is None
            and type(split).__name__ == "ByteLevel"
            and split.use_regex
            and not any(x.isspace() for s in self.special for x in s)
        )
        # Ids that begin with a space or a line break, as byte-level vocabularies spell them.
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t[:1] in ("Ġ", "Ċ")]] = True
        self.id_bytes = np.dtype(self.wide).itemsize
        self.known: dict[str, bytes] = {}
        (self.newline,) = self._encode(["\n"])

    @classmethod
    def of(cls, path: str) -> PieceEncoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _encode(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.wide).tobytes() for x in made]

    def _learn(self, new: list[str]) -> None:
        """Adds the ids of pieces to what is known.

        A byte-level tokenizer gives every piece a first id that begins with its space or
        line break, which no other id of the piece has.  So all are encoded as one text
        and told apart by those ids.
        """
        if not self.by_bytes:
            bare = self._encode([p[1:] if p[:1] == "\n" else " " + p for p in new])
            self.known.update((p, self.newline + ids if p[:1] == "\n" else ids) for p, ids in zip(new, bare))
            return
        (packed,) = self._encode(["".join([p if p[:1] == "\n" else " " + p for p in new])])
        cuts = np.flatnonzero(self.opens[np.frombuffer(packed, dtype=self.wide)]) * self.id_bytes
        if len(cuts) != len(new):
            raise ValueError("the tokenizer does not begin every piece of text with an id of its own")
        ends = cuts.tolist()[1:] + [len(packed)]
        self.known.update(zip(new, [packed[a:b] for a, b in zip(cuts.tolist(), ends)]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed unsigned numbers."""
        cut: list[list[str] | None] = []
        for text in texts:
            # White space other than single spaces and line breaks between words.
            uneven = text.replace("\n", " ") != " ".join(text.split())
            if not text or uneven or any(s in text for s in self.special):
                cut.append(None)
            else:
                cut.append(f"\n{text}".replace("\n", " \n").split(" ")[1:])
        new = list(set().union(*[c for c in cut if c]).difference(self.known))
        if new:
            self._learn(new)
        whole = iter(self._encode([t for t, c in zip(texts, cut) if c is None and t]))
        known, skip = self.known.__getitem__, len(self.newline)
        found = [
            (next(whole) if text else b"") if parts is None else b"".join(map(known, parts))[skip:]
            for text, parts in zip(texts, cut)
        ]
        for p in new[max(0, len(new) + REMEMBERED - len(self.known)) :]:
            del self.known[p]
        return found


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, tokens): the packed ids of every document with the end id after them."""

    def batch(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(tokenizer)
        end = np.array([end_id], dtype=encoder.wide).tobytes()
        for part in rows:
            for at in range(0, part.num_rows, 512):
                some = part.slice(at, 512)
                texts = [(t.as_py() or b"").decode("utf-8", "replace") for t in some.column(1)]
                made = [x + end for x in encoder.encode(texts)]
                counts = pa.array([len(x) // len(end) for x in made], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), counts, pa.array(made, pa.binary())], names=["id", "n", "tokens"]
                )

    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return narrow.mapInArrow(batch, f"id {kind}, n long, tokens binary")


def _width(tokenizer: str) -> tuple[str, int]:
    encoder = PieceEncoder.of(tokenizer)
    return encoder.wide, encoder.tokenizer.get_vocab_size()


def _counts(tokens: DataFrame, wide: str, size: int) -> np.ndarray:
    """How often each id occurs in the whole corpus; the driver gets one number an id."""

    def batch(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for part in rows:
            joined = b"".join(part.column(0).to_pylist())
            total += np.bincount(np.frombuffer(joined, dtype=wide), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["token", "n"])

    counted = tokens.select("tokens").mapInArrow(batch, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = np.zeros(size, dtype=np.int64)
    for row in counted.collect():
        counts[row["token"]] = row["n"]
    return counts


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write the token files of docs to the folder `path`.

    A null text is empty and has the end id only.  Null ids come first; rows that repeat
    an id are documents of their own, in order of length and checksum.
    """
    wide, size = _width(tokenizer)
    tokens = stored(tokenised(docs, tokenizer, end_id, id_col, text_col), "tokens")
    frequencies = quantise(_counts(tokens, wide, size))
    spark = docs.sparkSession
    rows = [(i, int(f)) for i, f in enumerate(frequencies) if f]
    spark.createDataFrame(rows, "token int, frequency int").coalesce(1).write.parquet(f"{path}/table")

    id_type = tokens.schema["id"].dataType

    def batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, shard = Coder(frequencies), TaskContext.get().partitionId()
        ids: list = []
        runs: list[np.ndarray] = []
        block = tokens_held = 0

        def close() -> pa.RecordBatch:
            payload = coder.encode(np.concatenate(runs))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([ids], pa.list_(kind)),
                    pa.array([[len(r) for r in runs]], pa.list_(pa.int64())),
                    pa.array([payload], pa.binary()),
                ],
                names=["shard", "block", "ids", "lengths", "payload"],
            )

        for part in parts:
            kind = part.column(0).type
            for doc, packed in zip(part.column(0), part.column(2)):
                run = np.frombuffer(packed.as_py(), dtype=wide)
                if runs and tokens_held + len(run) > BLOCK_TOKENS:
                    yield close()
                    ids, runs, tokens_held, block = [], [], 0, block + 1
                ids.append(doc.as_py())
                runs.append(run)
                tokens_held += len(run)
        if runs:
            yield close()

    order = ["id", "n", "mark"]
    marked = tokens.select("id", "n", "tokens", F.crc32("tokens").alias("mark"))
    placed = marked.repartitionByRange(shuffle_partitions(docs), *order).sortWithinPartitions(*order)
    schema = (
        f"shard int, block int, ids array<{id_type.simpleString()}>, lengths array<bigint>, payload binary"
    )
    placed.select("id", "n", "tokens").mapInArrow(batch, schema).write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of every document, decoded from the files.

    start counts the ids of all documents before it.  The shared table has one row an id
    of the vocabulary, and comes to the driver for that reason.
    """
    found = spark.read.parquet(f"{path}/table").collect()
    frequencies = np.zeros(max((r["token"] for r in found), default=0) + 1, dtype=np.int64)
    for r in found:
        frequencies[r["token"]] = r["frequency"]
    blocks = spark.read.parquet(f"{path}/blocks")
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequencies)
        for part in parts:
            for i in range(part.num_rows):
                shard, block, ids, lengths, payload = (part.column(c)[i] for c in range(5))
                tokens = coder.decode(payload.as_py()).astype("<u4")
                counts = np.asarray(lengths.values, dtype=np.int64)
                ends = np.cumsum(counts)
                if len(tokens) != ends[-1]:
                    raise ValueError("a block has other documents than its tokens")
                sums = [zlib.crc32(tokens[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist())]
                size = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(size, shard.as_py(), dtype=np.int32)),
                        pa.array(np.full(size, block.as_py(), dtype=np.int32)),
                        ids.values,
                        pa.array(ends - counts),
                        pa.array(counts),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["shard", "block", "id", "within", "n", "crc"],
                )

    decoded = blocks.mapInArrow(batch, f"shard int, block int, id {id_type}, within long, n long, crc long")
    total = F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)
    sizes = blocks.select("shard", "block", total.alias("tokens"))
    # One row a shard, then one a block of the shard.
    shards = sizes.groupBy("shard").agg(F.sum("tokens").alias("tokens"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    above = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("above", F.coalesce(F.sum("tokens").over(above), F.lit(0))).join(shards, "shard")
    return decoded.join(offsets.select("shard", "block", "base", "above"), ["shard", "block"]).select(
        F.col("id").alias(id_col),
        (F.col("base") + F.col("above") + F.col("within")).alias("start"),
        F.col("n").alias("n_tokens"),
        F.col("crc").alias("ids_crc32"),
    )


def round_trip(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the token files of docs to the shared folder and read them back."""
    path = f"{shared_folder(docs.sparkSession)}/auditlens-token-files-{uuid.uuid4().hex}"
    write_tokens(docs, path, tokenizer, end_id, id_col, text_col)
    return read_tokens(docs.sparkSession, path, id_col)
