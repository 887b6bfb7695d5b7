"""Benchmark passages in documents, by greedy string tiling.

Texts are compared as words in lower case without ASCII punctuation.  Running
Karp-Rabin hashes over LEAST words give the seeds that a document shares with an item of
the benchmark; seeds on one diagonal join to maximal matches, verified on the words.
Then the longest match that does not overlap a marked one is marked, again and again,
until none of LEAST words is left.  An item is in a document if the marked tiles cover
enough of the item, wherever they stand, so passages in another order count, too.  An item
of fewer words than LEAST has one seed, all its words.

The benchmark is the query set: it is cut into blocks of bounded size, and every block is
sent to the tasks that read all documents.  No text of a document is shuffled.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.substring_dedup import Words
from auditlens.llm.tables import whole_row

LEAST = 5
COVERAGE = 0.8
#: Words of benchmark text that a broadcast block is meant for, and bytes of documents looked at together.
BLOCK_WORDS = 1 << 20
CHUNK_BYTES = 4 << 20
#: Pairs of places of one document and item block beyond which repeating stretches are looked for, and their periods.
MANY_PAIRS, PERIODS = 100_000, 16

_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256)
)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


def plain_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_PLAIN).split()


def running_hashes(words: Words, least: int = LEAST) -> np.ndarray:
    """The Karp-Rabin hash of each `least` neighbouring words, modulo 2^64."""
    size = max(0, len(words.hashes) - least + 1)
    total = np.zeros(size, dtype=np.uint64)
    for i in range(least):
        total *= _FACTOR
        total += words.hashes[i : i + size]
    return total


class SeedTable:
    """Where the seeds of `least` words stand in items (number, words)."""

    def __init__(self, items: list[tuple[int, list[bytes]]], least: int):
        self.least, self.longest = least, max((len(found) for _, found in items), default=0)
        hashes, item, place = [], [], []
        for n, found in items:
            values = running_hashes(Words(b" ".join(found)), least)
            hashes.append(values)
            item.append(np.full(len(values), n, dtype=np.int64))
            place.append(np.arange(len(values)))
        none = np.empty(0, dtype=np.uint64)
        values = np.concatenate([*hashes, none])
        order = np.argsort(values, kind="stable")
        self.values, self.begins = np.unique(values[order], return_index=True)
        self.ends = np.append(self.begins[1:], len(values))
        self.item = np.concatenate([*item, none.astype(np.int64)])[order]
        self.place = np.concatenate([*place, none.astype(np.int64)])[order]
        self.maybe = np.zeros(1 << _BITS, dtype=bool)
        self.maybe[(self.values >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `hashes` with a seed, and the number of the seed."""
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = np.searchsorted(self.values, hashes[some])
        good = at < len(self.values)
        some, at = some[good], at[good]
        same = self.values[at] == hashes[some]
        return some[same], at[same]

    def without_middles(self, at: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A document's hits without the middles of long stretches that repeat the same few words.

        Tiles of an item have no more words than the item and take the first places that
        do, so they lie within that many words of an end of the stretch.
        """
        if (self.ends - self.begins)[seed].sum() <= MANY_PAIRS:
            return at, seed
        for period in range(1, PERIODS + 1):
            if len(at) <= period:
                break
            same = (seed[period:] == seed[:-period]) & (at[period:] == at[:-period] + period)
            ends = np.flatnonzero(np.diff(same, prepend=False, append=False))
            margin = self.longest + period
            keep = np.ones(len(at), dtype=bool)
            for first, last in zip(ends[::2], ends[1::2], strict=True):
                keep[first + margin : max(first + margin, last + period - margin)] = False
            at, seed = at[keep], seed[keep]
        return at, seed


class Seeds:
    """The items of a block of the benchmark, and a table of seeds for each seed length."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.items = [(key, found) for key, text in items if (found := plain_words(text))]
        by_length: dict[int, list[tuple[int, list[bytes]]]] = defaultdict(list)
        for n, (_, found) in enumerate(self.items):
            by_length[min(LEAST, len(found))].append((n, found))
        self.tables = [SeedTable(some, least) for least, some in sorted(by_length.items())]


def longest_tiles(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Tiles (length, place in item, place in document), longest first, from maximal matches of that form.

    Of matches of one length the one that starts first in the item goes first, then in the document.
    """
    in_item: set[int] = set()
    in_doc: set[int] = set()
    heap = [(-n, p, q) for n, p, q in matches if n >= LEAST]
    heapq.heapify(heap)
    tiles = []
    while heap:
        n, p, q = heapq.heappop(heap)
        free = [p + i not in in_item and q + i not in in_doc for i in range(-n)]
        if all(free):
            tiles.append((-n, p, q))
            in_item.update(range(p, p - n))
            in_doc.update(range(q, q - n))
            continue
        begin = None
        for i, ok in enumerate([*free, False]):  # what is left of it between marked words
            if ok and begin is None:
                begin = i
            elif not ok and begin is not None:
                if i - begin >= LEAST:
                    heapq.heappush(heap, (begin - i, p + begin, q + begin))
                begin = None
    return tiles


def _maximal(pairs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Maximal matches from seeds (place in item, place in document): runs on a diagonal."""
    found: list[tuple[int, int, int]] = []
    for p, q in sorted(pairs, key=lambda x: (x[1] - x[0], x[0])):
        if found:
            n, a, b = found[-1]
            if q - p == b - a and p == a + n - LEAST + 1:
                found[-1] = (n + 1, a, b)
                continue
        found.append((LEAST, p, q))
    return found


def _covered(doc: list[bytes], items: list, table: SeedTable, at: np.ndarray, seed: np.ndarray, coverage: float):
    """(item, covered words, tiles) of the items that the tiles cover well enough, for one document."""
    least = table.least
    by_item: dict[int, list[tuple[int, int]]] = defaultdict(list)
    at, seed = table.without_middles(at, seed)
    for q, s in zip(at.tolist(), seed.tolist()):
        for k in range(int(table.begins[s]), int(table.ends[s])):
            by_item[int(table.item[k])].append((int(table.place[k]), q))
    for n, pairs in sorted(by_item.items()):
        item = items[n][1]
        if least < LEAST:  # the seed is the whole item
            if any(item == doc[q : q + least] for _, q in pairs):
                yield n, least, 1
            continue
        need = coverage * len(item)
        # Tiles lie within seeds, so too few words under seeds are too few under tiles.
        if len({p + i for p in {p for p, _ in pairs} for i in range(LEAST)}) < need:
            continue
        pairs = [(p, q) for p, q in pairs if item[p : p + LEAST] == doc[q : q + LEAST]]
        tiles = longest_tiles(_maximal(pairs))
        covered = sum(t[0] for t in tiles)
        if covered and covered >= need:
            yield n, covered, len(tiles)


def scan(texts: list[bytes | None], seeds: Seeds, coverage: float = COVERAGE):
    """(number of the text, item, covered words, tiles) for a list of texts."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size < CHUNK_BYTES):
            size += len(texts[end] or b"")
            end += 1
        docs = [plain_words(t) for t in texts[begin:end]]
        full = [i for i, d in enumerate(docs) if d]
        joined = Words(b" ".join(b" ".join(docs[i]) for i in full)) if full else None
        lengths = np.array([len(docs[i]) for i in full], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        for table in seeds.tables if full else ():
            at, seed = table.hits(running_hashes(joined, table.least))
            owner = np.searchsorted(starts, at, side="right") - 1
            inside = at + table.least <= starts[owner] + lengths[owner]
            at, seed, owner = at[inside], seed[inside], owner[inside]
            edges = np.flatnonzero(np.diff(owner, prepend=-1, append=-1)) if len(owner) else []
            for lo, hi in zip(edges[:-1], edges[1:]):
                o = int(owner[lo])
                for found in _covered(docs[full[o]], seeds.items, table, at[lo:hi] - starts[o], seed[lo:hi], coverage):
                    yield begin + full[o], *found
        begin = end


def blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, bytes]]]:
    """The benchmark in blocks of about BLOCK_WORDS words; each comes to the driver on its own."""
    rows = benchmark.select(
        F.col(item_col).alias("item"), F.col(text_col).cast("binary").alias("text")
    ).where("text is not null")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-size // (6 * BLOCK_WORDS)))
    for n in range(count):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == n)
        found = [(r["item"], bytes(r["text"])) for r in part.collect()]
        if found:
            yield sorted(found, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    coverage: float = COVERAGE,
) -> DataFrame:
    """(id_col, item_col, item_words, covered, tiles, coverage): items found in documents.

    Null and empty texts, and items without words, hold and are nothing.  Very long texts
    are read whole, in time that grows with their length also if they repeat few words.
    Equal rows of docs, and equal items, give one row.  A null id is an id.  Empty tables
    give no row.  Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    item_type = benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {id_type}, item {item_type}, item_words long, covered long, tiles long"
    found = docs.sparkSession.createDataFrame([], schema)
    for items in blocks(benchmark, item_col, item_text_col):
        # A block has a bounded size, whatever that of the benchmark.
        sent = docs.sparkSession.sparkContext.broadcast(Seeds(items))

        def batch(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            seeds = sent.value
            for part in parts:
                texts = [t.as_py() for t in part.column(1)]
                hits = list(scan(texts, seeds, coverage))
                if hits:
                    keys = [seeds.items[h[1]] for h in hits]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array([h[0] for h in hits])),
                            pa.array([k[0] for k in keys]),
                            pa.array([len(k[1]) for k in keys], pa.int64()),
                            pa.array([h[2] for h in hits], pa.int64()),
                            pa.array([h[3] for h in hits], pa.int64()),
                        ],
                        names=["id", "item", "item_words", "covered", "tiles"],
                    )

        found = found.unionAll(rows.mapInArrow(batch, schema))
    return found.distinct().select(
        F.col("id").alias(id_col),
        F.col("item").alias(item_col),
        "item_words",
        "covered",
        "tiles",
        (F.col("covered") / F.col("item_words")).alias("coverage"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that hold no item of the benchmark, with their columns as they were.

    Rows are judged where they are read: nothing is joined or shuffled.  Null and empty
    texts hold no item and stay; very long texts, repeated rows and rows with null or
    repeated ids are judged like others.  An empty table stays empty.  Columns may have any
    names: a row travels as one struct.
    """
    rows = docs.select(whole_row(docs).alias("row"), F.col("text").cast("binary").alias("text"))
    for items in blocks(benchmark, "item_id", "text"):
        sent = docs.sparkSession.sparkContext.broadcast(Seeds(items))

        def batch(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for part in parts:
                texts = [t.as_py() for t in part.column(1)]
                keep = np.ones(len(texts), dtype=bool)
                keep[[h[0] for h in scan(texts, sent.value, coverage)]] = False
                yield part.filter(pa.array(keep))

        rows = rows.mapInArrow(batch, rows.schema)
    return rows.select("row.*")
