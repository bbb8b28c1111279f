"""Vectorised word hashing of Arrow text columns.

A word is a run of bytes other than space and \\x09-\\x0D.  The words of a block are hashed eight bytes a step, all at
once, so no Python object is made per word (but of words over 64 bytes).  FIRST and SECOND differ in their seeds; the two
together are 128 bits, each alone 64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 19
U = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> U(32))
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


class Base:
    """One hash function of byte runs: eight bytes at a time go through a multiplicative scramble, longer runs through
    xxh3.  Both depend on the seed, and neither has collisions by structure (as polynomials modulo 2**64 have)."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.seed = seed
        self.start, self.size, self.odd = (U(int(x) | 1) for x in rng.integers(0, 1 << 64, 3, dtype=np.uint64))

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        """Hashes of data[start:end]."""
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = _LOWER[data] if lower else data
        eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
        left = (ends - starts).astype(np.int64)
        h = self.start + left.astype(U) * self.size
        at, which = starts, np.arange(len(left))
        for step in range(LONG // 8):
            h[which] = mix(h[which] * self.odd ^ (eight[at] & _FIRST_BYTES[np.minimum(left[which] - 8 * step, 8)]))
            stay = left[which] > 8 * (step + 1)
            which, at = which[stay], at[stay] + 8
            if not len(which):
                return h
        for i in which:
            h[i] = xxhash.xxh3_64_intdigest(padded[starts[i] : ends[i]], self.seed)
        return h

    def grams(self, words: np.ndarray, k: int) -> np.ndarray:
        """Hash of each k consecutive values, len(words) - k + 1 of them (none if that is negative)."""
        n = len(words) - k + 1
        if n <= 0 or k <= 0:
            return np.zeros(0, U)
        # runs of 1, 2, 4, .. values; those that make up k are joined from left to right
        run, width, found, done = words, 1, None, 0
        while True:
            if k & width:
                part = run[done : done + n]
                found = part if found is None else self._pair(found, part)
                done += width
            if 2 * width > k:
                return mix(found ^ self.start) if k == 1 else found
            run, width = self._pair(run[:-width], run[width:]), 2 * width

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * self.odd + b + self.size)


#: Words over so many bytes are hashed one by one.
LONG = 64
_FIRST_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
FIRST, SECOND = Base(11), Base(12)


@dataclass
class Block:
    """Rows row .. row + len(self) of a batch: their bytes, words and the index of each row's first word."""

    row: int
    data: np.ndarray
    bounds: np.ndarray  # byte bounds of rows
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # word bounds of rows

    def __len__(self) -> int:
        return len(self.bounds) - 1


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def release() -> None:
    """Give freed memory back to the system; a worker that waits for its next task would keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        release()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    x = batch.column(batch.schema.get_field_index(name))
    return x if pa.types.is_string(x.type) or pa.types.is_large_string(x.type) else x.cast(pa.string())


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks of whole rows of about ``limit`` bytes; a null text has no bytes."""
    n = len(texts)
    if not n:
        return
    _, at, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(at, kind, n + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield split(row, data[at[row] : at[end]], at[row : end + 1] - at[row])
        row = end


def split(row: int, data: np.ndarray, bounds: np.ndarray) -> Block:
    black = ~WHITE[data]
    before, after = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    before[1:], after[:-1] = black, black
    before[bounds] = False  # rows don't run into one another
    after[bounds] = False
    starts = np.flatnonzero(black & ~before[:-1])
    ends = np.flatnonzero(black & ~after[1:]) + 1
    return Block(row, data, bounds, starts, ends, np.searchsorted(starts, bounds))


def column_long(batch: pa.RecordBatch, name: str) -> list:
    """A column of longs as Python values, nulls as None."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
