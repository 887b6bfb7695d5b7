"""Elias-Fano coded ascending numbers, read in place, and flat blocks of named arrays.

A number is split into low bits, packed one after another, and high bits, written in unary
as one bit vector: with n numbers below u that takes about 2 + log2(u / n) bits each.  A
directory with one entry for every 512 bits finds the k-th one or zero, so that numbers are
read and successors searched in the coded form, many queries at once.
"""

from __future__ import annotations

import json
from collections.abc import Buffer

import numpy as np

_WORDS = 8  # 64-bit words of a directory entry
_ALIGN = 8


def flat(arrays: dict[str, np.ndarray]) -> bytes:
    """Named arrays as one block that `views` opens without copying, in memory or mapped from a file."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, at, len(a))
        at += -(-a.nbytes // _ALIGN) * _ALIGN
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % _ALIGN)
    parts = [len(text).to_bytes(_ALIGN, "little"), text]
    for a in arrays.values():
        parts += [a.tobytes(), bytes(-a.nbytes % _ALIGN)]
    return b"".join(parts)


def views(block: Buffer) -> dict[str, np.ndarray]:
    whole = np.frombuffer(block, np.uint8)
    size = int.from_bytes(whole[:_ALIGN].tobytes(), "little")
    head = json.loads(whole[_ALIGN : _ALIGN + size].tobytes())
    body = whole[_ALIGN + size :]
    out = {}
    for name, (kind, at, n) in head.items():
        dtype = np.dtype(kind)
        out[name] = body[at : at + n * dtype.itemsize].view(dtype)
    return out


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest `bits` of each value, one after another, in 64-bit words with one to spare."""
    groups = -(-len(values) // 64)
    lanes = np.zeros(groups * 64, dtype=np.uint64)
    lanes[: len(values)] = values & np.uint64((1 << bits) - 1)
    lanes = lanes.reshape(groups, 64)
    out = np.zeros((groups, bits + 1), dtype=np.uint64)
    for lane in range(64 if bits else 0):
        word, shift = divmod(lane * bits, 64)
        out[:, word] |= lanes[:, lane] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= lanes[:, lane] >> np.uint64(64 - shift)
    return np.concatenate([out[:, :bits].reshape(-1), np.zeros(1, dtype=np.uint64)])


def encode(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of an Elias-Fano coded ascending sequence (equal numbers allowed), for `flat`."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    largest = int(values[-1]) if n else 0
    bits = max(0, ((largest + 1) // max(n, 1)).bit_length() - 1)
    high = (values >> np.uint64(bits)).astype(np.int64)
    length = n + (largest >> bits) + 1
    span = 64 * _WORDS
    vector = np.zeros(-(-length // span) * span, dtype=bool)
    vector[high + np.arange(n)] = True
    words = np.packbits(vector, bitorder="little").view(np.uint64)
    ones = np.bitwise_count(words).reshape(-1, _WORDS).sum(axis=1, dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(ones)])
    return {
        f"{name}.size": np.array([n, bits, largest], dtype=np.int64),
        f"{name}.low": _packed(values, bits),
        f"{name}.high": words,
        f"{name}.ones": before[:-1],
    }


def _in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit of each word, from 0."""
    words, k, place = words.copy(), k.copy(), np.zeros(len(words), dtype=np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count(words & np.uint64((1 << half) - 1)).astype(np.int64)
        later = k >= count
        k -= np.where(later, count, 0)
        place += np.where(later, half, 0)
        words >>= np.where(later, half, 0).astype(np.uint64)
    return place


class EliasFano:
    """Reads a coded sequence from the arrays of an opened block."""

    def __init__(self, name: str, arrays: dict[str, np.ndarray]):
        self.n, self.bits, self.largest = (int(x) for x in arrays[f"{name}.size"])
        self.low, self.high, self.ones = (arrays[f"{name}.{part}"] for part in ("low", "high", "ones"))
        self.zeros = np.arange(len(self.ones)) * (64 * _WORDS) - self.ones

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the k-th one or zero in the bit vector."""
        before = self.ones if ones else self.zeros
        entry = np.searchsorted(before, k, side="right") - 1
        # An entry without a one repeats the number before it; the last of equal entries holds the bit.
        words = self.high[entry[:, None] * _WORDS + np.arange(_WORDS)]
        if not ones:
            words = ~words
        counts = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64)
        rest = k - before[entry]
        which = (counts <= rest[:, None]).sum(axis=1)
        row = np.arange(len(k))
        rest -= np.where(which > 0, counts[row, np.maximum(which - 1, 0)], 0)
        return (entry * _WORDS + which) * 64 + _in_word(words[row, which], rest)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if self.bits == 0:
            return np.zeros(len(i), dtype=np.int64)
        at = i * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        value = self.low[word] >> shift
        # A shift by 64 is not defined, so the next word is shifted in two steps.
        value |= (self.low[word + 1] << (np.uint64(63) - shift)) << np.uint64(1)
        return (value & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, dtype=np.int64)
        return ((self._select(i, True) - i) << self.bits) | self._low(i)

    def successor(self, x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The place of the first number of at least x between `first` and `last`, or `last` if there is none.

        The numbers before `first` must be smaller than x, as those of earlier contexts are.
        """
        x = np.asarray(x, dtype=np.int64)
        out = np.asarray(last, dtype=np.int64).copy()
        some = np.flatnonzero((x <= self.largest) & (first < last))
        if not len(some):
            return out
        x, end = x[some], out[some]
        high = x >> self.bits
        ends = self._select(high, False) - high
        starts = np.zeros(len(x), dtype=np.int64)
        later = np.flatnonzero(high > 0)
        starts[later] = self._select(high[later] - 1, False) - (high[later] - 1)
        low, top = np.maximum(starts, first[some]), np.minimum(ends, end)
        wanted = x & ((1 << self.bits) - 1)
        while len(open_ := np.flatnonzero(low < top)):
            middle = (low[open_] + top[open_]) >> 1
            less = self._low(middle) < wanted[open_]
            low[open_] = np.where(less, middle + 1, low[open_])
            top[open_] = np.where(less, top[open_], middle)
        out[some] = np.minimum(low, end)
        return out

    def decoded(self) -> Decoded:
        """The same numbers, written out, for a block that answers very many queries."""
        bits = np.unpackbits(self.high.view(np.uint8), bitorder="little")
        i = np.arange(self.n)
        return Decoded(((np.flatnonzero(bits)[: self.n] - i) << self.bits) | self._low(i))


class Decoded:
    """Numbers in memory, read like coded ones."""

    def __init__(self, values: np.ndarray):
        self.values, self.n = values, len(values)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return self.values[i]

    def successor(self, x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return np.clip(np.searchsorted(self.values, x), first, last)
