"""Exact substring dedup over word windows, by super-k-mer partitioning.

A window is WINDOW consecutive words.  Its minimiser is the least hash among its runs of
MER words; neighbouring windows mostly share it.  Consecutive windows with one minimiser
travel as a single packed string of words to the bucket of that minimiser, so that equal
windows meet although each word is sent about three times and not WINDOW times.  In a
bucket the windows are sorted and equal ones are adjacent.

Equal packed strings of a task are sent once.  Runs of words that are very frequent in
the corpus come last in the order of minimisers, so a common line does not draw all
windows that touch it into one bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlens.llm.packing import (
    at_every_byte,
    bucket_of,
    combined,
    frequent_classes,
    joined_ranges,
    keyed,
    pack,
    ranked,
    unpack,
)
from auditlens.llm.tables import shuffle_partitions, stored

WINDOW = 20
MER = 3
#: Bytes of text that are looked at together, and words after which a long text is cut (with an overlap).
CHUNK_BYTES = 8 << 20
UNIT_WORDS = 1 << 18
#: Windows in a packed string at most, and bytes of packed strings that a bucket is meant for.
RUN = 64
BUCKET_BYTES = 32 << 20

Unit = tuple[int, int, bytes]
_RANGES = "key long, first long, last long"


def _units(rows: Iterator[tuple[int, bytes]], overlap: int = WINDOW - 1) -> Iterator[Unit]:
    """(key, number of the first word, words joined by spaces); long texts in overlapping parts."""
    for key, text in rows:
        found = text.split()
        for at in range(0, max(1, len(found) - overlap), UNIT_WORDS):
            yield key, at, b" ".join(found[at : at + UNIT_WORDS + overlap])


def _chunks(units: Iterator[Unit], size: int = CHUNK_BYTES) -> Iterator[list[Unit]]:
    held, total = [], 0
    for unit in units:
        if held and total + len(unit[2]) > size:
            yield held
            held, total = [], 0
        if unit[2]:
            held.append(unit)
            total += len(unit[2]) + 1
    if held:
        yield held


class Words:
    """The words of texts joined by single breaks: places, and a hash of each."""

    def __init__(self, joined: bytes, breaks: bytes = b" "):
        data = np.frombuffer(joined + bytes(8), dtype=np.uint8)
        inner = data[: len(joined)]
        found = inner == breaks[0]
        for other in breaks[1:]:
            found |= inner == other
        cuts = np.flatnonzero(found)
        self.starts = np.concatenate([[0], cuts + 1])
        self.ends = np.concatenate([cuts, [len(joined)]])
        self.data = inner
        # The first and the last eight bytes and the length: enough to choose buckets by.
        eight, length = at_every_byte(data), self.ends - self.starts
        masks = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
        head = eight[self.starts] & masks[np.minimum(length, 8)]
        tail = np.where(length > 8, eight[np.maximum(self.ends - 8, 0)], np.uint64(0))
        self.hashes = combined(head, tail, length.astype(np.uint64))


def _mers(words: Words) -> np.ndarray:
    h = words.hashes
    size = max(0, len(h) - MER + 1)
    return combined(*[h[i : i + size] for i in range(MER)])


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _mer_hashes(rows: Iterator[tuple[int, bytes]]) -> Iterator[np.ndarray]:
    for chunk in _chunks(_units(rows, 0), 1 << 20):
        yield _mers(Words(b" ".join(u[2] for u in chunk)))


def _super_kmers(chunk: list[Unit], frequent: np.ndarray):
    """(first window, last window, unit, minimiser) of each run, and the words."""
    joined = b" ".join(u[2] for u in chunk)
    words = Words(joined)
    unit = np.repeat(np.arange(len(chunk)), [u[2].count(b" ") + 1 for u in chunk])
    count = len(unit) - WINDOW + 1
    if count <= 0:
        none = np.empty(0, dtype=np.int64)
        return joined, words, none, none, none, none.astype(np.uint64), unit
    least = least_of(ranked(_mers(words), frequent), WINDOW - MER + 1)
    inside = unit[:count] == unit[WINDOW - 1 :]
    opens = inside.copy()
    opens[1:] &= (least[1:] != least[:-1]) | (unit[1:count] != unit[: count - 1])
    # A run of more than RUN windows is cut; windows are counted one by one all the same.
    place = np.arange(count)
    since = place - np.maximum.accumulate(np.where(opens, place, 0))
    opens |= inside & (since % RUN == 0)
    first = np.flatnonzero(opens)
    stops = np.flatnonzero(~inside | np.concatenate([opens[1:], [True]]))
    last = stops[np.searchsorted(stops, first)]
    last = np.where(inside[last], last, last - 1)
    return joined, words, first, last, unit[first], least[first], unit


def _map(frequent: np.ndarray, buckets: int):
    def batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            (key.as_py(), text.as_py() or b"") for part in parts for key, text in zip(part.column(0), part.column(1))
        )
        for chunk in _chunks(_units(rows)):
            chunk.sort(key=lambda u: u[:2])
            joined, words, first, last, unit, least, owner = _super_kmers(chunk, frequent)
            begins = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(chunk)))[:-1]])
            keys = np.array([u[0] for u in chunk], dtype=np.int64)[unit]
            at = first - begins[unit] + np.array([u[1] for u in chunk], dtype=np.int64)[unit]
            size = last - first + 1
            seen: dict[bytes, int] = {}
            sent, again = [], []
            spans = zip(words.starts[first].tolist(), words.ends[last + WINDOW - 1].tolist())
            strings = [joined[s:e] for s, e in spans]
            for i, packed in enumerate(strings):
                if seen.setdefault(packed, i) == i:
                    sent.append(i)
                else:
                    again.append(i)
            sent_at, again_at = np.array(sent, dtype=np.int64), np.array(again, dtype=np.int64)
            origin = np.array([seen[strings[i]] for i in again], dtype=np.int64)
            # A string that the task holds earlier is removed here and needs no sending.
            later = (keys[again_at] != keys[origin]) | (at[again_at] != at[origin])
            gone = again_at[later]
            bucket = bucket_of(least[sent_at], buckets)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            for k, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
                mine = sent_at[order[lo:hi]]
                some = gone if k == 0 else gone[:0]
                block = pack(
                    keys[mine],
                    at[mine],
                    size[mine].astype(np.uint8),
                    keys[some],
                    at[some],
                    (at[some] + size[some] + WINDOW - 1),
                    text=b"\n".join([strings[i] for i in mine.tolist()]),
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(bucket[order[lo]])], pa.int64()), pa.array([block], pa.binary())],
                    names=["bucket", "block"],
                )

    return batch


def _repeated(keys: np.ndarray, at: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of every window of the packed strings that also starts earlier among them."""
    order = np.lexsort((at, keys))
    keys, at, texts = keys[order], at[order], [texts[i] for i in order.tolist()]
    joined = b"\n".join(texts)
    words = Words(joined, b" \n")
    per = np.array([t.count(b" ") + 1 for t in texts], dtype=np.int64)
    string = np.repeat(np.arange(len(texts)), per)
    count = len(string) - WINDOW + 1
    start = np.flatnonzero(string[:count] == string[WINDOW - 1 :])
    prints = combined(*[words.hashes[start + i] for i in range(WINDOW)])
    begins = np.concatenate([[0], np.cumsum(per)[:-1]])
    owner = string[start]
    key, place = keys[owner], at[owner] + start - begins[owner]
    # Stable, so that equal windows stay in the order of their documents.
    ranks = np.argsort(prints, kind="stable")
    prints = prints[ranks]
    same = np.concatenate([[False], prints[1:] == prints[:-1]])
    lead = ranks[np.maximum.accumulate(np.where(same, 0, np.arange(len(ranks))))]
    some = np.flatnonzero(same)
    mine, head = ranks[some], lead[some]
    lo, hi = words.starts[start], words.ends[start + WINDOW - 1]
    # Equal hashes are only a hint: break marks aside, the windows themselves must agree.
    plain = joined.replace(b"\n", b" ")
    equal = np.fromiter(
        (
            plain[a:b] == plain[c:d]
            for a, b, c, d in zip(lo[mine].tolist(), hi[mine].tolist(), lo[head].tolist(), hi[head].tolist())
        ),
        dtype=bool,
        count=len(mine),
    )
    if not equal.all():  # different windows under one hash: sort those runs by their words
        first: dict[bytes, int] = {}
        odd = np.isin(head, head[~equal])
        for i in np.sort(np.concatenate([np.unique(head[odd]), mine[odd]])).tolist():
            first.setdefault(plain[lo[i] : hi[i]], i)
        head = head.copy()
        head[odd] = [first[plain[lo[i] : hi[i]]] for i in mine[odd].tolist()]
    later = (key[mine] > key[head]) | ((key[mine] == key[head]) & (place[mine] > place[head]))
    return key[mine[later]], place[mine[later]]


def _reduce(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = ((b.as_py(), x.as_py()) for part in parts for b, x in zip(part.column(0), part.column(1)))
    for _, group in groupby(rows, key=lambda r: r[0]):
        keys, at, texts, found = [], [], [], []
        for _, block in group:
            (k, a, _, gone_key, gone_first, gone_last), text = unpack(block)
            keys.append(k)
            at.append(a)
            texts += text.split(b"\n") if len(k) else []
            found.append((gone_key, gone_first, gone_last))
        if texts:
            key, place = _repeated(np.concatenate(keys), np.concatenate(at), texts)
            found.append((key, place, place + WINDOW))
        key, first, last = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.lexsort((first, key))
        key, first, last = key[order], first[order], last[order]
        for lo, hi in _same(key):
            a, b = joined_ranges(first[lo:hi], last[lo:hi])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(a), key[lo])), pa.array(a), pa.array(b)], names=["key", "first", "last"]
            )


def _same(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, int)
    return zip(edges.tolist(), [*edges[1:].tolist(), len(keys)])


def repeated_ranges(rows: DataFrame) -> DataFrame:
    """(key, first, last): word ranges to remove, from rows (key, text); ranges of a key may overlap."""
    frequent, size = frequent_classes(rows, _mer_hashes)
    parts = shuffle_partitions(rows)
    buckets = max(4 * parts, 3 * size // BUCKET_BYTES)
    sent = rows.select("key", "text").mapInArrow(_map(frequent, buckets), "bucket long, block binary")
    placed = sent.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return stored(placed.mapInArrow(_reduce, _RANGES), "ranges")


def with_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows (key, id, text) with the ranges of their key as arrays `first` and `last`, null for none."""
    gathered = ranges.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("r"))
    return rows.join(gathered, "key", "left").select(
        "id", "text", F.col("r.first").alias("first"), F.col("r.last").alias("last")
    )


def ranges_of(first: pa.Scalar, last: pa.Scalar) -> list[tuple[int, int]]:
    if not first.is_valid:
        return []
    a, b = joined_ranges(np.asarray(first.values), np.asarray(last.values))
    return list(zip(a.tolist(), b.tolist()))


def dedup_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False
) -> DataFrame:
    """(id_col, n_words, n_removed, kept_sha256[, kept_text]) for every row of docs.

    A word goes if a window over it has a sequence that also starts earlier: in a
    document with a smaller id, or in the same one further ahead.  Null and empty texts
    have no words.  Rows that repeat an id and a text are judged alike, as one document;
    rows that repeat an id with another text count as later documents of their own; null
    ids come after all others.  Other columns are ignored, whatever their names.
    """

    def batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 1024):
                some = part.slice(at, 1024)
                columns: list[list] = [[], [], [], []]
                for text, first, last in zip(some.column(1), some.column(2), some.column(3)):
                    found = (text.as_py() or b"").split()
                    keep, removed = bytearray(b"\1") * len(found), 0
                    for a, b in ranges_of(first, last):
                        keep[a:b] = bytes(b - a)
                        removed += b - a
                    kept = b" ".join(compress(found, keep) if removed else found)
                    made = (len(found), removed, hashlib.sha256(kept).hexdigest(), kept)
                    for column, value in zip(columns, made):
                        column.append(value)
                arrays = [some.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))]]
                names = ["id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    arrays, names = [*arrays, pa.array(columns[3], pa.binary())], [*names, "kept_text"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = keyed(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text binary" * with_text
    made = with_ranges(rows, repeated_ranges(rows)).mapInArrow(batch, schema)
    if with_text:
        made = made.withColumn("kept_text", F.col("kept_text").cast("string"))
    return made.withColumnRenamed("id", id_col)
