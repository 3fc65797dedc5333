"""Byte-level text primitives over Arrow columns, in numpy.

A batch of texts is one UTF-8 buffer and its offsets. Words are runs of the bytes that a 256-entry
table marks; no word crosses a text's end. A word's 64-bit hash is a polynomial over its bytes
modulo 2**64, taken from one running sum, so its cost is per byte and not per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _libc = None

WHITE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def table_without(excluded: bytes) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(excluded, dtype=np.uint8)] = False
    return table


#: Bytes of words [^\x20\x09-\x0D]+.
NOT_WHITE = table_without(WHITE)
#: ASCII digits and letters, and every byte of a non-ASCII character.
ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
#: ASCII letters, and every byte of a non-ASCII character.
LETTER = np.array([b >= 0x80 or chr(b).isalpha() for b in range(256)])
#: A-Z to a-z; other bytes as they are.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose outputs look random (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for later calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.empty(size, dtype=np.uint64)
        have[0], k = 1, 1
        while k < size:
            have[k : 2 * k] = have[:k] * np.uint64(pow(base, k, 1 << 64))
            k *= 2
        _powers[base] = have
    return have[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(ends):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def tidy() -> None:
    """Give memory that isn't used back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about `most` bytes of `column`, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end
    tidy()


def unspaced(data: np.ndarray) -> np.ndarray | None:
    """Places beside a character of a script that is written without spaces: kana, ideographs, Thai, Lao, Burmese, Khmer."""
    if not len(data) or data.max() < 0xE0:
        return None
    after = np.append(data[1:], 0)
    three = (data >= 0xE4) & (data <= 0xE9) | (data == 0xE3) & (after >= 0x81) | (data == 0xE0) & (after >= 0xB8) & (after <= 0xBB) | (data == 0xE1) & ((after >= 0x80) & (after <= 0x82) | (after == 0x9E) | (after == 0x9F))
    cuts = np.zeros(len(data) + 5, dtype=bool)
    for lead, size in ((three, 3), ((data == 0xF0) & (after >= 0xA0), 4)):
        at = np.flatnonzero(lead)
        cuts[at] = cuts[at + size] = True
    return cuts[: len(data) + 1]


def runs(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, counts): the words' byte spans, and how many words each text has; no word crosses a place of `cuts`."""
    inside = table[data]
    begins, stops = offsets[:-1], offsets[1:]
    full = stops > begins
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[begins[full]] = True
    edge[len(data)] = True
    if cuts is not None:
        edge |= cuts
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, stops) - np.searchsorted(starts, begins)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; it depends on the span's bytes only."""
    if not len(starts):
        return np.empty(0, np.uint64)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.multiply(_SYMBOL[data], powers(_BASE, len(data)), out=total[1:])
    np.cumsum(total, out=total)
    return mix((total[ends] - total[starts]) * powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def grams(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): of every n consecutive words of each text; a text with fewer words gives none."""
    each = np.maximum(counts - (n - 1), 0)
    total = int(each.sum())
    if not total:
        return np.empty(0, np.uint64), each
    begins = np.cumsum(counts) - counts
    at = np.repeat(begins - (np.cumsum(each) - each), each) + np.arange(total)
    out = np.zeros(total, dtype=np.uint64)
    for k in range(n):
        out = mix(out + words[at + k] * np.uint64(pow(_BASE, k + 1, 1 << 64) | 1))
    return out, each


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The spans as an Arrow array; spans don't overlap and ascend."""
    lengths = ends - starts
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])


def spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begins[0], begins[0]+1, .. (lengths[0] of them), begins[1], .. : indices of many ranges, one after another."""
    total = int(lengths.sum())
    return np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(total)


class Slots:
    """A hash table from 64-bit hashes to slot numbers, probed for whole arrays at a time."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.count = 0
        self._resize(16)

    def _resize(self, bits: int) -> None:
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.zeros(1 << bits, dtype=np.uint64)
        self._slots = np.full(1 << bits, -1, dtype=np.int32)

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        at = (hashed >> self._shift).astype(np.int64)
        out = self._slots[at]
        left = np.flatnonzero((out >= 0) & (self._keys[at] != hashed))
        while len(left):
            at[left] = (at[left] + 1) & self._mask
            out[left] = self._slots[at[left]]
            left = left[(out[left] >= 0) & (self._keys[at[left]] != hashed[left])]
        return out

    def full(self, more: int) -> bool:
        return self.count + more > self.most

    def add(self, hashed: np.ndarray) -> np.ndarray:
        """Slots count, count + 1, .. for distinct hashes that are not in the table."""
        while (self.count + len(hashed)) * 4 > self._mask * 3:
            old = self._slots >= 0
            keys, slots = self._keys[old], self._slots[old]
            self._resize(65 - int(self._shift))
            self._put(keys, slots)
        slots = np.arange(self.count, self.count + len(hashed), dtype=np.int32)
        self._put(hashed, slots)
        self.count += len(hashed)
        return slots

    def _put(self, hashed: np.ndarray, slots: np.ndarray) -> None:
        at = (hashed >> self._shift).astype(np.int64)
        left = np.arange(len(hashed))
        while len(left):
            free = left[self._slots[at[left]] < 0]
            self._slots[at[free]] = slots[free]  # of several at one place, the last stays
            stays = free[self._slots[at[free]] == slots[free]]
            self._keys[at[stays]] = hashed[stays]
            left = left[self._slots[at[left]] != slots[left]]
            at[left] = (at[left] + 1) & self._mask


def first_of_each(hashed: np.ndarray) -> np.ndarray:
    """The index of one occurrence of each distinct hash."""
    return np.unique(hashed, return_index=True)[1]


def span_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    raw = data.tobytes() if len(data) < 1 << 16 else memoryview(np.ascontiguousarray(data))
    return [bytes(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
