"""Exact substring dedup over bytes, by a distributed sort of suffixes.

Every string of SIZE bytes holds an anchor: the place of the least hash among its grams
of GRAM bytes, the leftmost of equal ones.  Equal strings have their anchor at the same
offset, so it is enough to sort the suffixes that begin at anchors, about one in
eighteen, as a sparse suffix array.  Grams that are frequent in the corpus come last in
the order of hashes, so that they are rarely anchors.

1. Anchors whose gram occurs in one document only cannot repeat.  Their hashes are sent
   as sorted, delta-coded runs, and what is left are the candidates.
2. Each task sorts the candidate suffixes of its documents, keeps one of those that agree
   in all bytes that matter, and front-codes the sorted run.
3. Runs are cut at common splitters and exchanged; each task merges its pieces with a
   loser tree that keeps the common prefix of every loser with the last winner, so that
   known prefixes are not compared again.
4. Neighbours in the merged order with a common gram are compared string by string.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

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
from auditlens.llm.substring_dedup import ranges_of, with_ranges
from auditlens.llm.tables import shuffle_partitions, stored

SIZE = 50
GRAM = 16
_PLACES = SIZE - GRAM + 1
#: Bytes that numpy looks at together, and that one run of suffixes or hashes is made from.
STEP_BYTES = 1 << 18
RUN_BYTES = 8 << 20
#: Suffixes that are compared together; a larger group is one of its own.
TOGETHER = 50_000
#: Anchors that a bucket of the first exchange is meant for.
BUCKET_ANCHORS = 1 << 20

Unit = tuple[int, int, bytes]


def _units(rows: Iterator[tuple[int, bytes]]) -> Iterator[Unit]:
    """(key, place of the first byte, bytes); long texts in parts that share SIZE - 1 bytes."""
    for key, text in rows:
        for at in range(0, max(1, len(text) - SIZE + 1), STEP_BYTES):
            yield key, at, text[at : at + STEP_BYTES + SIZE - 1]


def _steps(units: Iterator[Unit], least: int) -> Iterator[list[Unit]]:
    held, total = [], 0
    for unit in units:
        if len(unit[2]) < least:
            continue
        if held and total + len(unit[2]) > STEP_BYTES:
            yield held
            held, total = [], 0
        held.append(unit)
        total += len(unit[2])
    if held:
        yield held


def _grams(joined: bytes) -> np.ndarray:
    data = np.frombuffer(joined + bytes(8), dtype=np.uint8)
    eight = at_every_byte(data)
    size = max(0, len(joined) - GRAM + 1)
    return combined(eight[:size], eight[GRAM - 8 : GRAM - 8 + size])


def _gram_hashes(rows: Iterator[tuple[int, bytes]]) -> Iterator[np.ndarray]:
    for step in _steps(_units(rows), GRAM):
        yield _grams(b"".join(u[2] for u in step))


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each `width` neighbours, the leftmost of equal ones, by doubling."""
    places = np.arange(len(values), dtype=np.int32)

    def either(v: np.ndarray, p: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
        right = v[shift:] < v[:-shift]
        return np.minimum(v[shift:], v[:-shift]), np.where(right, p[shift:], p[:-shift])

    have = 1
    while have * 2 <= width:
        values, places = either(values, places, have)
        have *= 2
    return either(values, places, width - have)[1] if width > have else places


def anchors(step: list[Unit], frequent: np.ndarray):
    """(unit, first, last, anchor, hash): runs of strings with one anchor; places are within the unit."""
    joined = b"".join(u[2] for u in step)
    lengths = np.array([len(u[2]) for u in step], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    hashes = _grams(joined)
    anchor = least_places(ranked(hashes, frequent), _PLACES)
    valid = np.ones(len(anchor), dtype=bool)
    for end in (begins[1:]).tolist():  # strings that would reach into the next unit
        valid[max(0, end - SIZE + 1) : end] = False
    opens = valid.copy()
    opens[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(opens)
    ends = np.flatnonzero(valid & np.concatenate([opens[1:] | ~valid[1:], [True]]))
    at = anchor[first].astype(np.int64)
    unit = np.searchsorted(begins, first, side="right") - 1
    base = begins[unit]
    return unit, first - base, ends - base, at - base, hashes[at]


def _rows(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for part in parts:
        for key, text in zip(part.column(0), part.column(1)):
            yield key.as_py(), text.as_py() or b""


# 1. Anchors that may repeat.


def _send_hashes(frequent: np.ndarray, buckets: int):
    def block(held: list) -> Iterator[pa.RecordBatch]:
        keys, places, hashes = (np.concatenate([h[i] for h in held]) for i in range(3))
        known, doc = np.unique(keys, return_inverse=True)
        bucket = bucket_of(hashes, buckets)
        order = np.lexsort((hashes, bucket))
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            mine = order[lo:hi]
            docs, local = np.unique(doc[mine], return_inverse=True)
            made = pack(
                np.diff(known[docs], prepend=0),
                np.diff(hashes[mine], prepend=np.uint64(0)),
                local.astype(np.uint32),
                places[mine].astype(np.uint64),
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[order[lo]])], pa.int64()), pa.array([made], pa.binary())], names=["bucket", "block"]
            )

    def batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for step in _steps(_units(_rows(parts)), SIZE):
            unit, first, _, _, hashes = anchors(step, frequent)
            keys = np.array([u[0] for u in step], dtype=np.int64)[unit]
            held.append((keys, first + np.array([u[1] for u in step], dtype=np.int64)[unit], hashes >> np.uint64(20)))
            total += sum(len(u[2]) for u in step)
            if total > RUN_BYTES:
                yield from block(held)
                held, total = [], 0
        if held:
            yield from block(held)

    return batch


def _shared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, first): packed places of the anchors whose hash more than one document has."""

    def emit(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        keys, hashes, places = [], [], []
        for block in blocks:
            (known, deltas, local, at), _ = unpack(block)
            keys.append(np.cumsum(known)[local])
            hashes.append(np.cumsum(deltas))
            places.append(at)
        key, value, place = np.concatenate(keys), np.concatenate(hashes), np.concatenate(places)
        order = np.argsort(value, kind="stable")
        key, value, place = key[order], value[order], place[order]
        opens = np.concatenate([[True], value[1:] != value[:-1]])
        at = np.flatnonzero(opens)
        many = np.minimum.reduceat(key, at) != np.maximum.reduceat(key, at)
        keep = np.repeat(many, np.diff(np.append(at, len(key))))
        key, place = key[keep], place[keep]
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else at[:0]
        ends = np.append(edges[1:], len(key))
        for begin in range(0, len(edges), 4096):
            some, stops = edges[begin : begin + 4096], ends[begin : begin + 4096]
            lists = [place[a:b].astype("<u8").tobytes() for a, b in zip(some.tolist(), stops.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(lists, pa.binary())], names=["key", "first"])

    bucket, blocks = None, []
    for part in parts:
        for b, x in zip(part.column(0), part.column(1)):
            if b.as_py() != bucket and blocks:
                yield from emit(blocks)
                blocks = []
            bucket = b.as_py()
            blocks.append(x.as_py())
    if blocks:
        yield from emit(blocks)


# 2. Sorted runs.  A suffix is (right, left, key, place of the anchor): the bytes from the
# anchor to the end of its last string, and those from the start of its first one.

Suffix = tuple[bytes, bytes, int, int]


def shared_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """The length of the common prefix, of which `start` bytes are known."""
    size, at = min(len(a), len(b)), start
    if a[at:size] == b[at:size]:
        return size
    while at + 8 <= size and a[at : at + 8] == b[at : at + 8]:
        at += 8
    while at < size and a[at] == b[at]:
        at += 1
    return at


def byte_rows(strings: list[bytes]) -> np.ndarray:
    """The strings as rows of a matrix of bytes, shorter ones with zero bytes after them."""
    width = max(1, max(map(len, strings), default=1))
    return np.array(strings, dtype=f"S{width}").view(np.uint8).reshape(len(strings), width)


def shared_with_before(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row has in common with the row before; none for the first."""
    found = np.zeros(len(rows), dtype=np.int64)
    if len(rows) > 1:
        differs = rows[1:] != rows[:-1]
        at = differs.argmax(axis=1)
        found[1:] = np.where(differs[np.arange(len(at)), at], at, rows.shape[1])
    return found


def write_run(suffixes: list[Suffix]) -> bytes:
    """A sorted run, front-coded: what a suffix has in common with the one before is not repeated."""
    rights, lefts = [s[0] for s in suffixes], [s[1] for s in suffixes]
    sizes = np.array([len(r) for r in rights], dtype=np.int64)
    shared = np.minimum(shared_with_before(byte_rows(rights)), np.minimum(sizes, np.append(0, sizes)[:-1]))
    return pack(
        shared.astype(np.uint8),
        (sizes - shared).astype(np.uint8),
        np.array([len(x) for x in lefts], dtype=np.uint8),
        np.array([s[2] for s in suffixes], dtype=np.int64),
        np.array([s[3] for s in suffixes], dtype=np.int64),
        text=b"".join([*[r[n:] for r, n in zip(rights, shared.tolist())], *lefts]),
    )


def read_run(block: bytes) -> Iterator[tuple[int, Suffix]]:
    """(bytes in common with the suffix before, suffix), in order."""
    (shared, sizes, left_sizes, keys, places), text = unpack(block)
    at, left_at, before = 0, int(sizes.sum(dtype=np.int64)), b""
    for n, size, left_size, key, place in zip(
        shared.tolist(), sizes.tolist(), left_sizes.tolist(), keys.tolist(), places.tolist()
    ):
        before = before[:n] + text[at : at + size]
        yield n, (before, text[left_at : left_at + left_size], key, place)
        at += size
        left_at += left_size


def prefix_number(right: bytes) -> int:
    return int.from_bytes(right[:7], "big")


def _runs(frequent: np.ndarray):
    """(block, prefixes, gone): a sorted run, the numbers of its prefixes, and ranges removed already."""

    def close(found: list[Suffix]) -> pa.RecordBatch:
        found.sort()
        kept: list[Suffix] = []
        gone: list[tuple[int, int, int]] = []
        for s in found:
            if kept and s[0] == kept[-1][0] and s[1] == kept[-1][1] and s[2] != kept[-1][2]:
                # The same strings in a document with a smaller key, in this very run.
                gone.append((s[2], s[3] - len(s[1]), s[3] + len(s[0])))
            elif not kept or s != kept[-1]:
                kept.append(s)
        key, first, last = (np.array([g[i] for g in gone], dtype=np.int64) for i in range(3))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([write_run(kept)], pa.binary()),
                pa.array([[prefix_number(s[0]) for s in kept[::16]]], pa.list_(pa.int64())),
                pa.array([pack(key, first, last)], pa.binary()),
            ],
            names=["block", "prefixes", "gone"],
        )

    def batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted: list[tuple[int, np.ndarray] | None] = []

        def rows() -> Iterator[tuple[int, bytes]]:
            for part in parts:
                for key, text, lists in zip(part.column(0), part.column(1), part.column(2)):
                    places = np.frombuffer(b"".join(x.as_py() for x in lists.values), dtype="<u8")
                    wanted.append((key.as_py(), places.astype(np.int64)))
                    yield len(wanted) - 1, text.as_py() or b""

        found: list[Suffix] = []
        for step in _steps(_units(rows()), SIZE):
            unit, first, last, anchor, _ = anchors(step, frequent)
            row_of, bases = (np.array([u[i] for u in step], dtype=np.int64) for i in range(2))
            here = sorted({u[0] for u in step})
            sought = np.concatenate([wanted[row][1] + (row - here[0] << 40) for row in here])
            candidates = np.flatnonzero(np.isin(first + bases[unit] + (row_of[unit] - here[0] << 40), sought))
            edges = np.searchsorted(unit[candidates], np.arange(len(step) + 1))
            for u, (row, base, text) in enumerate(step):
                some, key = candidates[edges[u] : edges[u + 1]], wanted[row][0]
                for a, b, p in zip(first[some].tolist(), last[some].tolist(), anchor[some].tolist()):
                    found.append((text[p : b + SIZE], text[a:p], key, base + p))
            for row in here[:-1]:  # the last one may go on in the next step
                wanted[row] = None
            if len(found) > RUN_BYTES // 32:
                yield close(found)
                found = []
        if found:
            yield close(found)

    return batch


# 3. Exchange and merge.


def cut_run(block: bytes, splitters: list[int]) -> Iterator[tuple[int, bytes]]:
    """(number, run) of the parts of a run between the splitters.

    A part begins where the first seven bytes change, so only suffixes that have fewer
    in common with the one before are looked at; the others go over as they are coded.
    """
    (shared, sizes, left_sizes, keys, places), text = unpack(block)
    right_at = np.append(0, np.cumsum(sizes, dtype=np.int64))
    left_at = right_at[-1] + np.append(0, np.cumsum(left_sizes, dtype=np.int64))
    changes = np.flatnonzero(shared < 7)
    head, heads = b"", []
    for n, at, size in zip(shared[changes].tolist(), right_at[changes].tolist(), sizes[changes].tolist()):
        head = head[:n] + text[at : at + min(size, 7 - n)]
        heads.append(head)
    numbers = [prefix_number(h) for h in heads]
    cuts = [*[bisect_left(numbers, x) for x in splitters], len(heads)]
    begin = 0
    for part, end in enumerate(cuts):
        if end > begin:
            lo, hi = int(changes[begin]), int(changes[end]) if end < len(changes) else len(shared)
            common = int(shared[lo])
            some, tails = shared[lo:hi].copy(), sizes[lo:hi].copy()
            some[0], tails[0] = 0, common + int(sizes[lo])
            rights = heads[begin][:common] + text[right_at[lo] : right_at[hi]]
            lefts = text[left_at[lo] : left_at[hi]]
            yield part, pack(some, tails, left_sizes[lo:hi], keys[lo:hi], places[lo:hi], text=rights + lefts)
        begin = end


def _pieces(splitters: list[int]):
    def batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for block in part.column(0):
                for n, piece in cut_run(block.as_py(), splitters):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([n], pa.int64()), pa.array([piece], pa.binary())], names=["piece", "block"]
                    )

    return batch


def merge_runs(runs: list[Iterator[tuple[int, Suffix]]]) -> Iterator[tuple[int, Suffix]]:
    """(bytes in common with the suffix before, suffix) of all runs in order, by a loser tree.

    Each run's head is known to share `common[i]` bytes with the last suffix given out.
    Of two heads, the one that shares more is smaller; only heads that share the same
    number are compared, from there on.
    """
    count = len(runs)
    if count == 0:
        return
    heads: list[Suffix | None] = [None] * count
    common = [0] * count

    def advance(i: int) -> None:
        common[i], heads[i] = next(runs[i], (-1, None))  # a run at its end loses to all

    def beats(i: int, j: int) -> bool:
        """Whether head i comes first; the loser's number then counts from the winner."""
        if common[i] != common[j]:
            return common[i] > common[j]
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return b is None
        n = shared_prefix(a[0], b[0], common[i])
        ends = n == len(a[0]), n == len(b[0])
        if any(ends):
            first = (*a[1:], i) < (*b[1:], j) if all(ends) else ends[0]
        else:
            first = a[0][n] < b[0][n]
        common[j if first else i] = n
        return first

    for i in range(count):
        advance(i)
    size = 1 << (count - 1).bit_length()
    losers = [-1] * size
    # Play all runs once, from the leaves up; -1 stands for no run.
    level = [i if i < count else -1 for i in range(size)]
    base = size
    while len(level) > 1:
        base //= 2
        winners = []
        for n in range(0, len(level), 2):
            i, j = level[n], level[n + 1]
            won = i if j < 0 or beats(i, j) else j
            losers[base + n // 2] = j if won == i else i
            winners.append(won)
        level = winners
    best = level[0]
    while heads[best] is not None:
        yield common[best], heads[best]
        advance(best)
        node = (best + size) // 2
        while node:
            rival = losers[node]
            if rival >= 0:
                mine, other = common[best], common[rival]
                if other > mine or other == mine and not beats(best, rival):
                    losers[node], best = best, rival
            node //= 2


# 4. Strings of suffixes with a common gram.


def repeats(common: list[int], suffixes: list[Suffix]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first, last): byte ranges of strings that a document with a smaller key has, too.

    The suffixes are whole groups in their merged order; `common` counts the bytes each
    shares with the one before.  Strings that are equal have their anchor at the same
    offset, with equal bytes on both sides of it.  For each offset the suffixes are
    classed by the bytes to the right, which are neighbours already, and by those to the
    left, sorted backwards.  All strings of a suffix hold its gram, so that what they
    remove is one range.
    """
    count = len(suffixes)
    rights = np.array([len(s[0]) for s in suffixes], dtype=np.int64)
    lefts = np.array([len(s[1]) for s in suffixes], dtype=np.int64)
    key = np.array([s[2] for s in suffixes], dtype=np.int64)
    place = np.array([s[3] for s in suffixes], dtype=np.int64)
    shared = np.array(common, dtype=np.int64)
    rows = byte_rows([s[1][::-1] for s in suffixes])
    backwards = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    left_shared = shared_with_before(rows[backwards])
    least, most = np.full(count, SIZE, dtype=np.int64), np.full(count, -1, dtype=np.int64)
    left_class = np.empty(count, dtype=np.int64)
    for offset in range(_PLACES):
        some = np.flatnonzero((lefts >= offset) & (rights >= SIZE - offset))
        if len(some) < 2:
            continue
        left_class[backwards] = np.cumsum(left_shared < offset)
        both = np.cumsum(shared < SIZE - offset)[some] * (count + 1) + left_class[some]
        order = np.argsort(both)
        both, some = both[order], some[order]
        opens = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        lowest = np.repeat(np.minimum.reduceat(key[some], opens), np.diff(np.append(opens, len(some))))
        hits = some[key[some] > lowest]
        least[hits] = np.minimum(least[hits], offset)
        most[hits] = offset
    found = np.flatnonzero(most >= 0)
    return key[found], place[found] - most[found], place[found] - least[found] + SIZE


def range_batches(key: np.ndarray, first: np.ndarray, last: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Ranges of each key, joined where they touch."""
    if not len(key):
        return
    known, rank = np.unique(key, return_inverse=True)
    apart = int(last.max()) + 2  # each key's ranges in a stretch of its own
    first, last = joined_ranges(first + rank * apart, last + rank * apart)
    rank = first // apart
    columns = [known[rank], first - rank * apart, last - rank * apart]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "first", "last"])


def _merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
        common: list[int] = []
        held: list[Suffix] = []
        begin = 0  # of the last group
        for n, suffix in merge_runs([read_run(b) for b in blocks]):
            if n < GRAM:
                if len(held) - begin == 1:  # a gram that no other suffix begins with
                    common.pop()
                    held.pop()
                if len(held) > TOGETHER:
                    yield from range_batches(*repeats(common, held))
                    common, held = [], []
                begin = len(held)
            common.append(n)
            held.append(suffix)
        if len(held) > 1:
            yield from range_batches(*repeats(common, held))

    piece, blocks = None, []
    for part in parts:
        for n, x in zip(part.column(0), part.column(1)):
            if n.as_py() != piece and blocks:
                yield from emit(blocks)
                blocks = []
            piece = n.as_py()
            blocks.append(x.as_py())
    if blocks:
        yield from emit(blocks)


def _gone(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        for block in part.column(0):
            yield from range_batches(*unpack(block.as_py())[0])


def repeated_bytes(rows: DataFrame) -> DataFrame:
    """(key, first, last): byte ranges to remove, from rows (key, text); ranges of a key may overlap."""
    frequent, size = frequent_classes(rows, _gram_hashes)
    parts = shuffle_partitions(rows)
    buckets = max(4 * parts, size // 16 // BUCKET_ANCHORS)
    hashes = rows.select("key", "text").mapInArrow(_send_hashes(frequent, buckets), "bucket long, block binary")
    placed = hashes.repartition(parts, "bucket").sortWithinPartitions("bucket")
    shared = stored(placed.mapInArrow(_shared, "key long, first binary"), "anchors")
    wanted = shared.groupBy("key").agg(F.collect_list("first").alias("first"))
    runs = rows.join(wanted, "key").select("key", "text", "first")
    runs = stored(runs.mapInArrow(_runs(frequent), "block binary, prefixes array<bigint>, gone binary"), "runs")

    # Splitters are quantiles of the prefixes of all runs: a few numbers, however many runs there are.
    ways = [i / parts for i in range(1, parts)]
    cuts = runs.select(F.explode("prefixes").alias("p")).agg(F.percentile_approx("p", F.array(*map(F.lit, ways)), 10_000))
    splitters = sorted({*(cuts.first()[0] or [])}) if ways else []
    pieces = runs.select("block").mapInArrow(_pieces(splitters), "piece long, block binary")
    merged = pieces.repartition(parts, "piece").sortWithinPartitions("piece").mapInArrow(
        _merge, "key long, first long, last long"
    )
    early = runs.select("gone").mapInArrow(_gone, "key long, first long, last long")
    return stored(merged.unionAll(early), "ranges")


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256[, kept_bytes]) for every row of docs.

    A byte of the UTF-8 text goes if a string of SIZE bytes over it also starts in a
    document with a smaller id.  Null texts are empty.  Rows that repeat an id and a text
    are judged alike, as one document; rows that repeat an id with another text count as
    later documents; null ids come after all others.  Other columns are ignored,
    whatever their names.
    """

    def batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 1024):
                some = part.slice(at, 1024)
                columns: list[list] = [[], [], [], [], []]
                for text, first, last in zip(some.column(1), some.column(2), some.column(3)):
                    whole = text.as_py() or b""
                    spans = ranges_of(first, last)
                    stays = zip([0, *[b for _, b in spans]], [*[a for a, _ in spans], len(whole)])
                    kept = b"".join([whole[a:b] for a, b in stays])
                    made = (len(whole), len(whole) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept)
                    for column, value in zip(columns, made):
                        column.append(value)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                arrays = [some.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]]
                names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if with_text:
                    arrays, names = [*arrays, pa.array(columns[4], pa.binary())], [*names, "kept_bytes"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = keyed(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary" * with_text
    made = with_ranges(rows, repeated_bytes(rows)).mapInArrow(batch, schema)
    return made.withColumnRenamed("id", id_col)
