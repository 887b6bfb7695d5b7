"""Language-model scores: an interpolated three-gram model in Elias-Fano tries, over shards.

    p(w | u, v) = own(u, v, w) + rest(u, v) * (own(v, w) + rest(v) * p(w))

own is a discounted relative frequency, rest what the discount leaves for the shorter
context, p(w) the add-0.1 estimate of the single word.  Texts are cut into blocks where
they are read.  A block sends its distinct words, packed, to shards that count and number
them, and then each distinct pair and triple once to the shard of the pair's context, where
they are added up to the model; the same messages are answered from the shard's trie.  A
frequent context word is dealt over as many shards as its count asks for, so no word
fills a shard.  Answers go back to the block, which scores its texts.

All sizes follow the corpus: words, shards and tries grow with it, blocks in number.  The
driver sees one number a shard and, of words more frequent than a shard, two numbers each.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlens.llm import ngram_trie
from auditlens.llm.packing import mixed, pack, unpack
from auditlens.llm.tables import shuffle_partitions, stored, tidy_shuffles
from auditlens.session import remove_folder

#: Bytes of text of a block, and of the text that a shard is made for.
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 6 << 20
#: What the estimate of a single word adds to its count.
ADDED = 0.1
_SLICE = 1 << 20
_WAITING = 1 << 21
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BREAK = re.compile(rb"[\x20\x09-\x0D]")
#: The token at the end of a text is the empty word; number 0 stands for its start and is never predicted.
_END, _START, _UNKNOWN = b"", 0, -1


class _Words(dict):
    """Numbers for words, in the order they are first seen."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def tokens(text: bytes, numbers: dict) -> array:
    """Numbers of the words of a text in lower case, then of its end; slices keep a long text's words few at a time."""
    out, at = array("I"), 0
    while at < len(text):
        cut = at + _SLICE
        if cut < len(text):
            found = _BREAK.search(text, cut)
            cut = found.start() if found else len(text)
        out.extend(map(numbers.__getitem__, text[at:cut].translate(_LOWER).split()))
        at = cut
    out.append(numbers[_END])
    return out


def _text_blocks(block_bytes: int, shards: int):
    """Rows (id, learns, text) as blocks: ids, packed texts as numbers of words, and packed words by shard."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        ids, learns, lengths, found, words, size = [], [], [], array("I"), _Words(), 0

        def packed() -> pa.RecordBatch:
            n, at = np.array(lengths, np.uint32), np.frombuffer(found, np.uint32)
            learned = np.repeat(np.array(learns, bool), n)
            counts = np.bincount(at[learned], minlength=len(words)).astype(np.uint32)
            names = list(words)
            shard = np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64) % np.uint64(shards)
            order = np.argsort(shard, kind="stable")
            body = pack(np.array(learns, np.uint8), n, at, shard.astype(np.uint32))
            text = b"\n".join([names[i] for i in order])
            values = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values),
                    pa.array([body], pa.binary()),
                    pa.array([pack(shard[order].astype(np.uint32), counts[order], text=text)], pa.binary()),
                ],
                names=["block", "ids", "body", "words"],
            )

        for part in parts:
            for i in range(part.num_rows):
                text = part.column("text")[i].as_py() or b""
                if lengths and size + len(text) > block_bytes:
                    yield packed()
                    number += 1
                    ids, learns, lengths, found, words, size = [], [], [], array("I"), _Words(), 0
                here = tokens(text, words)
                found.extend(here)
                ids.append(part.column("id").slice(i, 1))
                learns.append(part.column("learns")[i].as_py())
                lengths.append(len(here))
                size += len(text)
        if lengths:
            yield packed()

    return run


def _word_messages(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each shard, the words of a block that belong to it, with their counts in the texts to learn from."""
    for part in parts:
        for block, body in zip(part.column("block"), part.column("words"), strict=True):
            (shard, counts), text = unpack(body.as_py())
            names = text.split(b"\n")
            used, first = np.unique(shard, return_index=True)
            ends = np.append(first[1:], len(names))
            bodies = [pack(counts[a:b], text=b"\n".join(names[a:b])) for a, b in zip(first, ends, strict=True)]
            yield _rows(block=np.full(len(used), block.as_py()), shard=used.astype(np.int64), body=bodies)


def _rows(**columns) -> pa.RecordBatch:
    arrays = [pa.array(v, pa.binary()) if c in ("body", "messages") else pa.array(v) for c, v in columns.items()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def _each_shard(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(shard, its messages with their blocks) from rows sorted by shard; a shard's messages fit in memory, packed."""
    shard, held = None, []
    for part in parts:
        for of, block, body in zip(part.column("shard").to_pylist(), part.column("block").to_pylist(), part.column("body"), strict=True):
            if held and of != shard:
                yield shard, held
                held = []
            shard = of
            held.append((block, body.as_py()))
    if held:
        yield shard, held


def _numbered(shards: int):
    """Words of a shard, counted over all blocks and numbered, frequent ones first; an answer to each block.

    Numbers of different shards interleave.  A row without a block has the shard's totals.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, held in _each_shard(parts):
            opened = [unpack(body) for _, body in held]
            names = [pa.array(text.split(b"\n"), pa.binary()) for _, text in opened]
            counts = [pa.array(c.astype(np.int64)) for (c,), _ in opened]
            table = pa.table({"w": pa.chunked_array(names), "c": pa.chunked_array(counts)}).group_by("w").aggregate([("c", "sum")])
            table = table.filter(pc.greater(table["c_sum"], 0)).sort_by([("c_sum", "descending"), ("w", "ascending")])
            known, c = table["w"].combine_chunks(), table["c_sum"].to_numpy()
            yield _answer_row(None, shard, None, len(c), int(c.sum()))
            for (block, _), words in zip(held, names, strict=True):
                place = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)
                ids = np.where(place >= 0, 1 + place * shards + shard, 0).astype(np.uint32)
                mine = np.where(place >= 0, np.append(c, 0)[place], 0)
                yield _answer_row(block, shard, pack(ids, mine.astype(np.uint64)), 0, 0)

    return run


def _answer_row(block: int | None, shard: int, body: bytes | None, kinds: int, total: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block], pa.int64()),
            pa.array([shard], pa.int64()),
            pa.array([body], pa.binary()),
            pa.array([kinds], pa.int64()),
            pa.array([total], pa.int64()),
        ],
        names=["block", "shard", "body", "kinds", "total"],
    )


def shard_parts(count: np.ndarray, shards: int, total: int) -> np.ndarray:
    """Over how many shards a context word of this count is dealt."""
    return np.maximum(1, -(-count * shards // max(total, 1))).astype(np.int64)


def shard_of(word: np.ndarray, part: np.ndarray, shards: int) -> np.ndarray:
    key = (word.astype(np.uint64) << np.uint64(24)) ^ part.astype(np.uint64)
    return (mixed(key + np.uint64(1)) % np.uint64(shards)).astype(np.int64)


def _part_of(following: np.ndarray, parts: np.ndarray) -> np.ndarray:
    return (mixed(following.astype(np.uint64) + np.uint64(7)) % parts.astype(np.uint64)).astype(np.int64)


class _Grams:
    """The pairs and triples of a block, and the shards they belong to."""

    def __init__(self, body: bytes, known: list[dict], shards: int, total: int):
        (learns, self.lengths, at, word_shard), _ = unpack(body)
        self.learns = learns.astype(bool)
        # Answers follow the order of the words by shard.
        order = np.argsort(word_shard, kind="stable")
        answered = [unpack(x["body"])[0] for x in sorted(known, key=lambda x: x["shard"])]
        ids, self.count = np.full(len(order), _UNKNOWN, dtype=np.int64), np.zeros(len(order), dtype=np.int64)
        ids[order] = np.concatenate([x[0] for x in answered])
        self.count[order] = np.concatenate([x[1] for x in answered])
        ids[ids == 0] = _UNKNOWN
        self.at = at
        self.starts = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)[:-1]])
        word = ids[at]
        before = np.concatenate([[_START], word[:-1]])
        before[self.starts] = _START
        learned = np.repeat(self.learns, self.lengths)
        self.of_pair = np.full(len(at), -1, dtype=np.int64)
        # An unknown word is asked for by the number of the start, which no context has as a successor: the
        # context's rest is wanted all the same.
        good = np.flatnonzero(before >= 0)
        two = np.maximum(word[good], _START).astype(np.uint64)
        keys, self.of_pair[good] = np.unique(
            (before[good].astype(np.uint64) << np.uint64(32)) | two, return_inverse=True
        )
        self.n2 = np.bincount(self.of_pair[good[learned[good]]], minlength=len(keys))
        self.one = (keys >> np.uint64(32)).astype(np.int64)
        self.two = (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # A triple is the pair of the token before, and a word.
        self.context = np.concatenate([[-1], self.of_pair[:-1]])
        self.context[self.starts] = -1
        self.of_triple = np.full(len(at), -1, dtype=np.int64)
        good = np.flatnonzero((self.context >= 0) & (word > 0))
        keys3, self.of_triple[good] = np.unique(
            (self.context[good].astype(np.uint64) << np.uint64(32)) | word[good].astype(np.uint64), return_inverse=True
        )
        self.n3 = np.bincount(self.of_triple[good[learned[good]]], minlength=len(keys3))
        self.pair = (keys3 >> np.uint64(32)).astype(np.int64)
        self.three = (keys3 & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # Context words are known ones, or the start, which is as frequent as the end.
        order = np.argsort(ids)
        place = np.searchsorted(ids[order], self.one)
        ends = int(self.count[at[-1]])
        frequency = np.where(self.one == _START, ends, self.count[order[np.minimum(place, len(order) - 1)]])
        shard = shard_of(self.one, _part_of(self.two, shard_parts(frequency, shards, total)), shards)
        self.order2 = np.argsort(shard, kind="stable")
        self.order3 = np.argsort(shard[self.pair], kind="stable")
        self.used, first = np.unique(shard[self.order2], return_index=True)
        self.cuts2 = np.append(first, len(shard))
        self.cuts3 = np.searchsorted(shard[self.pair][self.order3], np.append(self.used, shards))

    def each(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, its pairs, its triples), as places in ascending order."""
        for k, shard in enumerate(self.used):
            yield (
                int(shard),
                self.order2[self.cuts2[k] : self.cuts2[k + 1]],
                self.order3[self.cuts3[k] : self.cuts3[k + 1]],
            )


def _messages(shards: int, total: int):
    """To each shard, a block's pairs and triples with their counts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, block in enumerate(part.column("block")):
                grams = _Grams(part.column("body")[i].as_py(), part.column("known")[i].as_py(), shards, total)
                rank = np.zeros(len(grams.one), dtype=np.int64)
                for shard, two, three in grams.each():
                    rank[two] = np.arange(len(two))
                    step = np.diff(grams.one[two], prepend=0)
                    # Successors of one word are ascending: of all but the first, the difference is sent.
                    follow = np.where(step > 0, grams.two[two], np.diff(grams.two[two], prepend=0))
                    follow[:1] = grams.two[two[:1]]
                    body = pack(
                        step.astype(np.uint32),
                        follow.astype(np.uint32),
                        grams.n2[two].astype(np.uint32),
                        np.bincount(rank[grams.pair[three]], minlength=len(two)).astype(np.uint32),
                        grams.three[three].astype(np.uint32),
                        grams.n3[three].astype(np.uint32),
                    )
                    yield _rows(block=[block.as_py()], shard=[shard], body=[body])

    return run


def _opened(body: bytes) -> tuple[np.ndarray, ...]:
    """(one, two, n2, place of the pair, three, n3) of a message."""
    (step, follow, n2, sizes, three, n3), _ = unpack(body)
    opens = step > 0
    opens[:1] = True
    total = np.cumsum(follow, dtype=np.int64)
    first = np.flatnonzero(opens)
    base = np.repeat(total[first] - follow[first], np.diff(np.append(first, len(step))))
    pair = np.repeat(np.arange(len(step)), sizes)
    return np.cumsum(step, dtype=np.int64), total - base, n2, pair, three.astype(np.int64), n3


class _Sum:
    """Counts of pairs and triples of many messages; those that no text to learn from holds are left out."""

    def __init__(self) -> None:
        self.keys, self.n2 = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pair, self.three, self.n3 = (np.zeros(0, np.int64) for _ in range(3))
        self.waiting, self.held = [], 0

    def add(self, body: bytes) -> None:
        one, two, n2, pair, three, n3 = _opened(body)
        keys = (one.astype(np.uint64) << np.uint64(32)) | two.astype(np.uint64)
        some = n3 > 0
        self.waiting.append((keys, n2.astype(np.int64), pair[some], three[some], n3[some].astype(np.int64)))
        self.held += len(keys) + int(some.sum())
        if self.held > _WAITING:
            self.settle()

    def settle(self) -> None:
        parts = [(self.keys, self.n2, self.pair, self.three, self.n3), *self.waiting]
        self.waiting, self.held = [], 0
        keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        n2 = np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)
        kept = n2 > 0
        place = np.cumsum(kept) - 1
        self.keys, self.n2 = keys[kept], n2[kept]
        offsets = np.cumsum([0, *[len(p[0]) for p in parts[:-1]]])
        pair = place[back[np.concatenate([p[2] + o for p, o in zip(parts, offsets, strict=True)])]]
        triple = (pair.astype(np.uint64) << np.uint64(32)) | np.concatenate([p[3] for p in parts]).astype(np.uint64)
        keys3, back = np.unique(triple, return_inverse=True)
        self.n3 = np.bincount(back, weights=np.concatenate([p[4] for p in parts]), minlength=len(keys3)).astype(np.int64)
        self.pair = (keys3 >> np.uint64(32)).astype(np.int64)
        self.three = (keys3 & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def packed(self) -> bytes:
        self.settle()
        sizes = np.bincount(self.pair, minlength=len(self.keys)).astype(np.uint32)
        return pack(
            np.diff(self.keys, prepend=np.uint64(0)), self.n2, sizes, self.three.astype(np.uint32), self.n3
        )


def _counted(shards: int, total: int):
    """Messages sorted by shard to one row a shard: its counts, the messages, and what concerns other shards.

    That is how many pairs and triples are seen once and twice, and of context words dealt
    over several shards the distinct successors and the count here.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, held in _each_shard(parts):
            sums = _Sum()
            for _, body in held:
                sums.add(body)
            body = sums.packed()
            words, kinds, c = _context_counts(sums.keys, sums.n2)
            singles = [int((n == k).sum()) for n in (sums.n2, sums.n3) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int64()),
                    pa.array([body], pa.binary()),
                    pa.array([[b for b, _ in held]], pa.list_(pa.int64())),
                    pa.array([[x for _, x in held]], pa.list_(pa.binary())),
                    *[pa.array([x], pa.int64()) for x in singles],
                    *[pa.array([x.tolist()], pa.list_(pa.int64())) for x in (words, kinds, c)],
                ],
                names=["shard", "body", "blocks", "messages", "one2", "two2", "one3", "two3", "words", "kinds", "c"],
            )

    return run


def _context_counts(keys: np.ndarray, n2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context words, their distinct successors and their counts."""
    words, at = np.unique(keys >> np.uint64(32), return_inverse=True)
    kinds = np.bincount(at, minlength=len(words)).astype(np.int64)
    return words.astype(np.int64), kinds, np.bincount(at, weights=n2, minlength=len(words)).astype(np.int64)


def _trie(shard: int, body: bytes, dealt: dict[str, np.ndarray], shards: int, total: int, discounts: tuple[float, float]) -> bytes | None:
    """The trie of a shard.  `dealt` has the totals of the context words that several shards share."""
    (step, n2, sizes, three, n3), _ = unpack(body)
    keys = np.cumsum(step)
    word, kinds, c = _context_counts(keys, n2)
    # Shared words are there even where none of their successors is: their rest is asked for.
    n = shard_parts(dealt["c"], shards, total)
    at = np.repeat(np.arange(len(n)), n)
    part = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    here = np.unique(at[shard_of(dealt["word"][at], part, shards) == shard])
    own = ~np.isin(word, dealt["word"])
    word = np.concatenate([word[own], dealt["word"][here]])
    kinds, c = np.concatenate([kinds[own], dealt["kinds"][here]]), np.concatenate([c[own], dealt["c"][here]])
    if not len(word):
        return None
    order = np.argsort(word)
    word, kinds, c = word[order], kinds[order], c[order]
    one, two = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return ngram_trie.build(
        (word, kinds, c),
        (np.searchsorted(word, one), two, n2),
        (np.repeat(np.arange(len(two)), sizes), three.astype(np.int64), n3),
        discounts,
    )


def _tries(dealt: dict[str, np.ndarray], shards: int, total: int, discounts: tuple[float, float]):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for shard, body in zip(part.column("shard").to_pylist(), part.column("body"), strict=True):
                trie = _trie(shard, body.as_py(), dealt, shards, total, discounts)
                if trie is not None:
                    yield _rows(shard=[shard], body=[trie])

    return run


def _answers(dealt: dict[str, np.ndarray], shards: int, total: int, discounts: tuple[float, float]):
    """The messages of a shard, answered from its trie."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i, shard in enumerate(part.column("shard").to_pylist()):
                built = _trie(shard, part.column("body")[i].as_py(), dealt, shards, total, discounts)
                trie = ngram_trie.Trie(built, decode=True) if built else None  # it answers every block
                blocks, bodies = part.column("blocks")[i].as_py(), part.column("messages")[i].values
                for block, body in zip(blocks, bodies, strict=True):
                    one, two, _, pair, three, _ = _opened(body.as_py())
                    if trie is not None:
                        codes = trie.query(one, two, pair, three)
                    else:  # no text to learn from has a word of this shard
                        codes = [np.zeros(n, np.uint8) for n in (len(one), len(one), len(one), len(three))]
                    yield _rows(block=[block], shard=[shard], body=[pack(*codes)])

    return run


def _scores(shards: int, total: int, kinds: int):
    """A block and its answers to the scores of its texts."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(part.num_rows):
                grams = _Grams(part.column("body")[i].as_py(), part.column("known")[i].as_py(), shards, total)
                answers = part.column("answers")[i].as_py() or []
                replies = {x["shard"]: x["body"] for x in answers}
                own2, rest2, rest3 = (np.zeros(len(grams.one) + 1) for _ in range(3))
                own3 = np.zeros(len(grams.three) + 1)
                for shard, two, three in grams.each():
                    codes = unpack(replies[shard])[0]
                    own2[two], rest2[two], rest3[two] = (ngram_trie.probability(x) for x in codes[:3])
                    own3[three] = ngram_trie.probability(codes[3])
                # The last place stands for what the model does not know: nothing of its own, all of the rest.
                rest2[rest2 == 0] = 1.0
                rest3[rest3 == 0] = 1.0
                single = (grams.count + ADDED) / (total + ADDED * (kinds + 1))
                p = own2[grams.of_pair] + rest2[grams.of_pair] * single[grams.at]
                inner = np.ones(len(p), dtype=bool)
                inner[grams.starts] = False
                p = np.where(inner, own3[grams.of_triple] + rest3[grams.context] * p, p)
                sums = lambda x: np.add.reduceat(x, grams.starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("ids")[i].values,
                        pa.array(~grams.learns),
                        pa.array(grams.lengths.astype(np.int64)),
                        pa.array(sums((grams.count > 0)[grams.at].astype(np.int64))),
                        pa.array(sums(np.log10(single)[grams.at])),
                        pa.array(sums(np.log10(p))),
                    ],
                    names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return run


def discount(singles: int, doubles: int) -> float:
    """What is taken off every count, from how many n-grams are seen once and twice."""
    return min(0.9, max(0.1, singles / (singles + 2 * doubles))) if singles + doubles else 0.5


class _Model:
    """What training leaves: texts as coded blocks, and the shards with their counts and messages."""

    def __init__(self, rows: DataFrame, block_bytes: int, shard_bytes: int):
        spark = rows.sparkSession
        self.id_type = rows.schema["id"].dataType.simpleString()
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.shards = shards = max(1, -(-size // shard_bytes))
        one_row = "block long, shard long, body binary"
        blocks = stored(
            rows.mapInArrow(
                _text_blocks(block_bytes, shards), f"block long, ids array<{self.id_type}>, body binary, words binary"
            ),
            "texts",
        )
        sent = blocks.select("block", "words").mapInArrow(_word_messages, one_row)
        numbered = stored(self._to_shards(sent).mapInArrow(_numbered(shards), one_row + ", kinds long, total long"), "words")
        self.kinds, self.total = numbered.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("kinds", "total")]).first()
        # A block has one answer from each shard, with two numbers a word.
        known = numbered.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("shard", "body")).alias("known"))
        self.coded = stored(blocks.drop("words").join(known, "block"), "coded")
        for table in (blocks, numbered):
            remove_folder(spark, table.stored_at)
        sent = self.coded.mapInArrow(_messages(shards, self.total), one_row)
        fields = ", ".join(f"{x} long" for x in ("one2", "two2", "one3", "two3"))
        lists = ", ".join(f"{x} array<long>" for x in ("words", "kinds", "c"))
        self.sums = stored(
            self._to_shards(sent).mapInArrow(
                _counted(shards, self.total),
                f"shard long, body binary, blocks array<long>, messages array<binary>, {fields}, {lists}",
            ),
            "counts",
        )
        singles = self.sums.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("one2", "two2", "one3", "two3")]).first()
        self.discounts = (discount(*singles[:2]), discount(*singles[2:]))
        # At most `shards` words are so frequent that they are dealt over several.
        zipped = self.sums.select(F.explode(F.arrays_zip("words", "kinds", "c")).alias("x")).select("x.*")
        frequent = (
            zipped.groupBy("words")
            .agg(F.sum("kinds").alias("kinds"), F.sum("c").alias("c"))
            .where(F.col("c") * shards > self.total)
            .collect()
        )
        self.dealt = {
            name: np.array([r[column] for r in frequent], dtype=np.int64)
            for name, column in (("word", "words"), ("kinds", "kinds"), ("c", "c"))
        }

    @staticmethod
    def _to_shards(sent: DataFrame) -> DataFrame:
        return sent.repartition(shuffle_partitions(sent), "shard").sortWithinPartitions("shard", "block")

    def _shared(self) -> tuple:
        return self.dealt, self.shards, self.total, self.discounts

    def tries(self) -> DataFrame:
        return self.sums.select("shard", "body").mapInArrow(_tries(*self._shared()), "shard long, body binary")

    def scores(self) -> DataFrame:
        asked = self.sums.select("shard", "body", "blocks", "messages")
        answers = asked.mapInArrow(_answers(*self._shared()), "block long, shard long, body binary")
        # A block has an answer from each shard it asked, with one byte for each of its n-grams.
        replies = answers.groupBy("block").agg(F.collect_list(F.struct("shard", "body")).alias("answers"))
        out = f"id {self.id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
        scored = _scores(self.shards, self.total, self.kinds)
        return self.coded.join(replies, "block", "left").mapInArrow(scored, out)


def _rows_of(docs: DataFrame, learns: Column, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(learns, F.lit(False)).alias("learns"),
        F.col(f"`{text_col}`").cast("binary").alias("text"),
    )


def train_tries(docs: DataFrame, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(shard, body): the model as one trie a shard; `ngram_trie.Trie` opens a body, or a file that holds one."""
    with tidy_shuffles(docs.sparkSession):
        text = F.col(f"`{text_col}`").cast("binary")
        rows = docs.select(F.lit(0).alias("id"), F.lit(True).alias("learns"), text.alias("text"))
        return _Model(rows, BLOCK_BYTES, shard_bytes).tries()


def score_texts(
    docs: DataFrame,
    learns: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """One row per row of docs: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows for which `learns` is true train the model, the others (null too) are held out; all are
    scored.  Texts are put in lower case (A-Z) and cut at white space; the end is a token.
    A null text counts as empty, which is the end alone.  Very long texts are cut into words
    piece by piece and are a block of their own.  Repeated rows and ids count and are scored
    each.  Without a text to learn from every word is unknown and every score 0.  An empty
    table gives no row.  Other columns are ignored, whatever their names.
    """
    with tidy_shuffles(docs.sparkSession):
        model = _Model(_rows_of(docs, learns, id_col, text_col), block_bytes, shard_bytes)
        return model.scores().select(
            F.col("id").alias(id_col),
            "held_out",
            "n_tokens",
            "n_known",
            F.lit(model.total).cast("long").alias("train_tokens"),
            "base_score",
            "score",
        )


def not_every_tenth(id_col: str = "doc_id") -> Column:
    """True unless the crc32 of the id ends in 0; a null id is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 != 0, F.lit(True))
