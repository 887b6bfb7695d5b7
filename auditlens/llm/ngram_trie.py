"""One shard of a three-gram model: an Elias-Fano trie with quantised probabilities.

Level 1 has context words, level 2 their successors, level 3 the successors of both.  A
level is one ascending sequence: the successors of a context are numbered relative to it
and follow the last number of the context before, and pointers, ascending as well, say where
a context's successors lie.  So a word is found by a successor search that begins at its
context's base, on coded numbers.

The block is flat: `Trie` reads it where it lies, in memory or mapped from a file.
"""

from __future__ import annotations

from collections.abc import Buffer

import numpy as np

from auditlens.llm.elias_fano import Decoded, EliasFano, encode, flat, views

#: Probabilities are codes of one byte: 0 for none, then this many steps a power of ten.
STEPS = 24
_VALUES = np.concatenate([[0.0], 10.0 ** (-np.arange(255) / STEPS)])


def quantised(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities above 0, at most 1; those below 10 ** (-254 / STEPS) get the smallest value."""
    return (1 + np.clip(np.rint(-np.log10(p) * STEPS), 0, 254)).astype(np.uint8)


def probability(codes: np.ndarray) -> np.ndarray:
    return _VALUES[codes]


def _relative(sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Successors, ascending within each context, as one ascending sequence."""
    ends = np.cumsum(sizes)
    reach = np.zeros(len(sizes), dtype=np.int64)
    some = sizes > 0
    reach[some] = words[ends[some] - 1] + 1
    return words + 1 + np.repeat(np.cumsum(reach) - reach, sizes)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def build(
    contexts: tuple[np.ndarray, np.ndarray, np.ndarray],
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray],
    triples: tuple[np.ndarray, np.ndarray, np.ndarray],
    discounts: tuple[float, float],
) -> bytes:
    """The block of a shard.

    contexts: words in ascending order, their distinct successors and their count, of the
    whole corpus.  pairs: places of the contexts, successors, counts.  triples: places of
    the pairs, successors, counts.  Both ascend.  Every probability is discounted by its
    level's discount; what is taken off is the weight of the shorter context.
    """
    words, kinds, total = contexts
    at2, next2, n2 = pairs
    at3, next3, n3 = triples
    sizes2 = np.bincount(at2, minlength=len(words)).astype(np.int64)
    sizes3 = np.bincount(at3, minlength=len(next2)).astype(np.int64)
    total3 = np.bincount(at3, weights=n3, minlength=len(next2))
    d2, d3 = discounts
    rest3 = np.zeros(len(next2), dtype=np.uint8)
    some = sizes3 > 0
    rest3[some] = quantised(d3 * sizes3[some] / total3[some])
    return flat(
        encode("words", words)
        | encode("first2", _starts(sizes2))
        | encode("next2", _relative(sizes2, next2))
        | encode("first3", _starts(sizes3))
        | encode("next3", _relative(sizes3, next3))
        | {
            "rest2": quantised(d2 * kinds / total),
            "own2": quantised((n2 - d2) / total[at2]) if len(n2) else np.zeros(0, np.uint8),
            "rest3": rest3,
            "own3": quantised((n3 - d3) / total3[at3]) if len(n3) else np.zeros(0, np.uint8),
        }
    )


class Trie:
    """Answers many queries at once; codes are 0 where the model has no entry.

    Levels are read where they lie, or with `decode` written out once, a few times as fast
    and some eight times as large.
    """

    def __init__(self, block: Buffer, decode: bool = False):
        arrays = views(block)
        levels = [EliasFano(name, arrays) for name in ("words", "first2", "next2", "first3", "next3")]
        self.words, self.first2, self.next2, self.first3, self.next3 = (
            [x.decoded() for x in levels] if decode else levels
        )
        self.rest2, self.own2, self.rest3, self.own3 = (arrays[x] for x in ("rest2", "own2", "rest3", "own3"))

    def _below(
        self, pointers: EliasFano | Decoded, level: EliasFano | Decoded, context: np.ndarray, word: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """(found, place) of the word among the successors of the context's node."""
        first, last = pointers[context], pointers[context + 1]
        base = np.zeros(len(context), dtype=np.int64)
        after = np.flatnonzero(first > 0)
        base[after] = level[first[after] - 1]
        wanted = base + word + 1
        place = level.successor(wanted, first, last)
        found = place < last
        some = np.flatnonzero(found)
        found[some] = level[place[some]] == wanted[some]
        return found, place

    def query(
        self, one: np.ndarray, two: np.ndarray, pair: np.ndarray, three: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(own2, rest2, rest3, own3) of pairs (one, two), and of triples (place of a pair, three)."""
        own2, rest2, rest3 = (np.zeros(len(one), dtype=np.uint8) for _ in range(3))
        own3 = np.zeros(len(three), dtype=np.uint8)
        none = np.zeros(len(one), dtype=np.int64)
        node = self.words.successor(one, none, none + self.words.n)
        known = np.flatnonzero(node < self.words.n)
        known = known[self.words[node[known]] == one[known]]
        rest2[known] = self.rest2[node[known]]
        found, place = self._below(self.first2, self.next2, node[known], two[known])
        seen, place = known[found], place[found]
        own2[seen], rest3[seen] = self.own2[place], self.rest3[place]
        at = none - 1
        at[seen] = place
        context = at[pair]
        asked = np.flatnonzero(context >= 0)
        found, place = self._below(self.first3, self.next3, context[asked], three[asked])
        own3[asked[found]] = self.own3[place[found]]
        return own2, rest2, rest3, own3
