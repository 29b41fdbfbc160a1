"""Words of whole Arrow text columns as numpy arrays.

A batch of texts is one UTF-8 byte buffer. A table of 256 entries says which
bytes belong to a word; words never cross a text. Each word gets a 64-bit
hash (eight bytes at a time, mixed with the length), so that no Python object
is made per word.
Nulls and empty texts have no words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_MIX = U(0xD6E8FEB86659FD93)
#: Bytes of text that are worked on at once; a longer text is still taken whole.
SLICE_BYTES = 1 << 20
#: Longer runs of bytes are hashed one by one.
LONG_RUN = 1024
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is true for the bytes of the closed ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words of the class [^\x20\x09-\x0D]+ : each byte but ASCII white space.
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
#: Words of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z.
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@lru_cache(8)
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[U(1)], np.full(n - 1, _ODD)]), dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """Powers of the odd constant, at least n of them."""
    return _powers(1 << max(8, int(n - 1).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(32))) * _MIX
        h = (h ^ (h >> U(29))) * _ODD
        return h ^ (h >> U(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; a null is empty."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    data = np.frombuffer(raw[2], dtype=np.uint8)[first:last] if raw[2] is not None and last > first else np.zeros(0, np.uint8)
    return data, (offsets - first if len(offsets) else np.zeros(1, np.int64))


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``most`` bytes."""
    data, offsets = buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@dataclass
class Words:
    """Words of some texts: byte bounds, hashes, and each text's range of words."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # first word of each text, and the number of all words

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of bytes [start, end), read eight bytes at a time."""
    lengths = ends - starts
    h = lengths.astype(np.uint64) * _MIX
    if not len(starts):
        return h
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    at, left, todo = starts, lengths, None
    for _ in range((LONG_RUN + 7) // 8):
        with np.errstate(over="ignore"):
            x = ((h if todo is None else h[todo]) ^ (eight[at] & _FIRST_BYTES[np.minimum(left, 8)])) * _ODD
            x ^= x >> U(32)
            x *= _MIX
        if todo is None:
            h = x
        else:
            h[todo] = x
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        todo = more if todo is None else todo[more]
        at, left = at[more] + 8, left[more] - 8
    for k in np.flatnonzero(lengths > LONG_RUN):
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return mix(h)


def words(data: np.ndarray, offsets: np.ndarray, inside_table: np.ndarray, lower: bool = False) -> Words:
    """The words of each text."""
    if lower:
        data = LOWER[data]
    inside = inside_table[data]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(data):
        at = offsets[:-1]
        before[at[at < len(data)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
        before[0] = after[-1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, run_hashes(data, starts, ends), np.searchsorted(starts, offsets))


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each window of ``size`` words within one text, hash of the window)."""
    n = len(w.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row = w.rows()
    keep = np.flatnonzero(row[:n] == row[size - 1 :])
    power = powers(size)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(size):
            h += w.hashes[k : k + n] * power[k]
        return keep, mix(h[keep] + U(size) * _MIX)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - counts), counts)
