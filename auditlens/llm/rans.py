"""Interleaved range asymmetric numeral coding of integer ids with a static table, on numpy vectors.

A block codes its ids on `lanes` interleaved coders: id i belongs to lane i % lanes, and
all lanes advance together, one row of ids at a time.  A coder's state is a 64-bit
number in [2^31, 2^63) that gives up 32-bit words when it would grow too large.

Block layout, little-endian:

    magic "ILR1" | ids u32 | lanes u32 | rows between checkpoints u32 | checkpoints u32 | words u32
    per checkpoint: word position u32 | crc32 of the ids up to the next checkpoint u32
    per checkpoint: the state of every lane u64
    the words u32
    crc32 of all before u32

Decoding can begin at any checkpoint, so parts of a block can be decoded side by side.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

PRECISION = 20
LANES = 2048
ROWS = 128
_LOW = 1 << 31
_MAGIC = b"ILR1"
_HEAD = struct.Struct("<4s5I")


def quantise(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Whole frequencies that add up to 2^precision; every id that occurs keeps at least 1."""
    counts = np.asarray(counts, dtype=np.int64)
    total, size = int(counts.sum()), 1 << precision
    if total == 0:
        return np.zeros(len(counts), dtype=np.int64)
    used = np.flatnonzero(counts)
    if len(used) > size:
        raise ValueError(f"{len(used)} ids do not fit into 2^{precision} slots")
    # One slot each, the others by share; what rounding leaves goes to the most frequent.
    spare = size - len(used)
    shares = [int(c) * spare // total for c in counts[used].tolist()]
    frequencies = np.zeros(len(counts), dtype=np.int64)
    frequencies[used] = np.asarray(shares) + 1
    frequencies[used[np.argmax(counts[used])]] += size - int(frequencies.sum())
    return frequencies


class Coder:
    """Codes blocks with one frequency table."""

    def __init__(self, frequencies: Sequence[int], precision: int = PRECISION):
        self.precision = precision
        self.frequency = np.asarray(frequencies, dtype=np.uint64)
        self.start = np.concatenate([[0], np.cumsum(self.frequency)[:-1]]).astype(np.uint64)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        """The id of every slot; made when a block is first decoded."""
        if self._slots is None:
            self._slots = np.repeat(
                np.arange(len(self.frequency), dtype=np.uint32), self.frequency.astype(np.int64)
            )
        return self._slots

    def encode(self, ids: np.ndarray, lanes: int = LANES, rows: int = ROWS) -> bytes:
        count = len(ids)
        lanes = max(1, min(lanes, count))
        steps = -(-count // lanes)
        shift, wide = np.uint64(self.precision), np.uint64(32)
        limit_unit = np.uint64((_LOW >> self.precision) << 32)
        state = np.full(lanes, _LOW, dtype=np.uint64)
        words: list[np.ndarray] = [np.empty(0, dtype=np.uint32)] * steps
        states: dict[int, np.ndarray] = {}
        for step in range(steps - 1, -1, -1):
            row = ids[step * lanes : (step + 1) * lanes]
            frequency, start = self.frequency[row], self.start[row]
            x = state[: len(row)]
            over = x >= limit_unit * frequency
            if over.any():
                words[step] = (x[over] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                x = np.where(over, x >> wide, x)
            whole = x // frequency
            state[: len(row)] = (whole << shift) + (x - whole * frequency) + start
            if step % rows == 0:
                states[step] = state.copy()
        marks = sorted(states)
        lengths = np.cumsum([0, *[len(w) for w in words]])
        ids32 = np.ascontiguousarray(ids, dtype="<u4")
        entries = b"".join(
            struct.pack("<II", int(lengths[m]), zlib.crc32(ids32[m * lanes : (m + rows) * lanes].tobytes()))
            for m in marks
        )
        body = b"".join(
            [
                _HEAD.pack(_MAGIC, count, lanes, rows, len(marks), int(lengths[-1])),
                entries,
                *[states[m].astype("<u8").tobytes() for m in marks],
                *[w.astype("<u4").tobytes() for w in words],
            ]
        )
        return body + struct.pack("<I", zlib.crc32(body))

    def decode(self, block: bytes, parts: Sequence[int] | None = None) -> np.ndarray:
        """The ids of a block, or only those after the given checkpoints; raises on damage."""
        if len(block) < _HEAD.size + 4 or zlib.crc32(block[:-4]) != struct.unpack("<I", block[-4:])[0]:
            raise ValueError("the block is damaged: its checksum differs")
        magic, count, lanes, rows, marks, size = _HEAD.unpack_from(block)
        if magic != _MAGIC:
            raise ValueError("not a block of ids")
        at = _HEAD.size
        entries = np.frombuffer(block, dtype="<u4", count=2 * marks, offset=at).reshape(-1, 2)
        at += 8 * marks
        states = np.frombuffer(block, dtype="<u8", count=lanes * marks, offset=at).reshape(marks, lanes)
        at += 8 * lanes * marks
        words = np.frombuffer(block, dtype="<u4", count=size, offset=at)
        found = [np.empty(0, dtype=np.uint32)]
        for part in range(marks) if parts is None else parts:
            first, last = part * rows * lanes, min(count, (part + 1) * rows * lanes)
            ids = self._run(last - first, lanes, states[part], words, int(entries[part, 0]))
            if zlib.crc32(ids.astype("<u4").tobytes()) != entries[part, 1]:
                raise ValueError("the block is damaged: decoded ids differ from their checksum")
            found.append(ids)
        return np.concatenate(found)

    def _run(self, count: int, lanes: int, states: np.ndarray, words: np.ndarray, at: int) -> np.ndarray:
        mask, shift, wide = np.uint64((1 << self.precision) - 1), np.uint64(self.precision), np.uint64(32)
        low, state = np.uint64(_LOW), states.astype(np.uint64)
        found = np.empty(count, dtype=np.uint32)
        for begin in range(0, count, lanes):
            end = min(count, begin + lanes)
            x = state[: end - begin]
            slot = x & mask
            ids = self.slots[slot]
            found[begin:end] = ids
            x = self.frequency[ids] * (x >> shift) + slot - self.start[ids]
            under = np.flatnonzero(x < low)
            if len(under):
                x[under] = (x[under] << wide) | words[at : at + len(under)]
                at += len(under)
            state[: end - begin] = x
        return found
