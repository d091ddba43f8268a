"""Words and word n-grams of an Arrow text column as numpy arrays, whole batches at a time.

Words are runs of bytes of a class. Every byte of a non-ASCII character is 0x80 or above, so a class that holds all of
those, or is given by ASCII characters alone, splits UTF-8 bytes exactly where it splits characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes hashed at a time; bounds the 64-bit temporaries.
CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def byte_class(wanted) -> np.ndarray:
    return np.array([wanted(i) for i in range(256)], dtype=bool)


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``, after folding.
ALNUM = byte_class(lambda i: 48 <= i <= 57 or 97 <= i <= 122 or i >= 128)
#: ``[^\x20\x09-\x0D]``
NOT_SPACE = byte_class(lambda i: i != 32 and not 9 <= i <= 13)

_BYTES = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(33))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 2**64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            for name, base in (("up", self.base), ("down", self.inverse)):
                powers = np.full(size, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = _Powers(_BASE), _Powers(_STEP)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


@dataclass
class Words:
    """Words of some documents: ``row`` is the document's place in the batch, ``start`` and ``end`` bytes of ``data``."""

    data: np.ndarray
    offsets: np.ndarray
    first_row: int
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def bounds(self) -> np.ndarray:
        """Where the words of each document begin, and the end of the last."""
        return np.searchsorted(self.row, np.arange(self.first_row, self.first_row + self.rows + 1))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, code) of every run of ``n`` words of one document."""
        if len(self.code) < n:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        total = np.zeros(len(self.code) + 1, dtype=np.uint64)
        up, down = _word_powers.get(len(self.code))
        np.cumsum(self.code * up, out=total[1:])
        place = np.flatnonzero(self.row[: len(self.row) - n + 1] == self.row[n - 1 :])
        return place, mix((total[place + n] - total[place]) * down[place] + np.uint64(n))


def _codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        upto = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK, side="right")))
        low, high = int(start[at]), int(end[upto - 1])
        up, down = _byte_powers.get(high - low)
        total = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_BYTES[data[low:high]] * up, out=total[1:])
        s, e = start[at:upto] - low, end[at:upto] - low
        out[at:upto] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        at = upto
    return out


def words(column: pa.Array, inside: np.ndarray, fold: np.ndarray = FOLD, kinds: np.ndarray | None = None) -> Iterator[Words]:
    """Words of a text column, some whole documents at a time.

    ``inside``: the bytes that words are made of, after ``fold``. ``kinds``: words also end where this class of the bytes
    changes. Two words have one code if they are equal (up to chance, 64 bits).
    """
    offsets, data = text_bytes(column)
    row = 0
    while row < len(offsets) - 1:
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, side="right")) - 1)
        own = offsets[row : upto + 1] - offsets[row]
        part = fold[data[offsets[row] : offsets[upto]]]
        word = inside[part]
        kind = word if kinds is None else kinds[part]
        edge = np.ones(len(part) + 1, dtype=bool)
        edge[1:-1] = (word[1:] != word[:-1]) | (kind[1:] != kind[:-1])
        edge[own] = True
        start = np.flatnonzero(word & edge[:-1])
        end = np.flatnonzero(word & edge[1:]) + 1
        rows = np.searchsorted(own, start, side="right") - 1 + row
        yield Words(part, own, row, rows, start, end, _codes(part, start, end))
        row = upto


class Codes:
    """A sorted array of distinct codes with a bit map in front of it: most codes that are not in it cost one look."""

    SLOT_BITS = 24

    def __init__(self, codes: np.ndarray):
        self.codes = np.sort(codes.astype(np.uint64))
        slot = self.codes >> np.uint64(64 - self.SLOT_BITS)
        self.slots = np.zeros((1 << self.SLOT_BITS) // 8, dtype=np.uint8)
        np.bitwise_or.at(self.slots, (slot >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (slot & np.uint64(7)).astype(np.uint8)))

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``codes`` that are known, their ranks in the sorted array)."""
        slot = codes >> np.uint64(64 - self.SLOT_BITS)
        near = np.flatnonzero((self.slots[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1)
        rank = np.searchsorted(self.codes, codes[near])
        rank[rank == len(self.codes)] = 0
        sure = self.codes[rank] == codes[near] if len(self.codes) else np.zeros(0, bool)
        return near[sure], rank[sure]
