"""Length-limited canonical Huffman codes of token ids: package-merge lengths, vectorised packing, table decoding."""

from __future__ import annotations

import numpy as np

#: The longest code; a decoding table has 2**LIMIT entries.  Raised where more ids occur than LIMIT - 2 bits can tell apart.
LIMIT = 18
#: A bit offset is kept for each so many ids; decoding runs from all of them at once.
EVERY = 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each id (0: it does not occur), by package-merge; no code is longer than the limit."""
    counts = np.asarray(counts, np.int64)
    ids = np.flatnonzero(counts)
    bits = np.zeros(len(counts), np.uint8)
    if len(ids) < 2:
        bits[ids] = 1
        return bits
    limit = max(limit, int(len(ids) - 1).bit_length())
    ids = ids[np.argsort(counts[ids], kind="stable")]
    coins = counts[ids]
    packages, leaves = np.zeros(0, np.int64), []
    for _ in range(limit):
        merged = np.concatenate([coins, packages])
        order = np.argsort(merged, kind="stable")
        leaves.append(order < len(coins))
        merged = merged[order]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    taken, length = 2 * len(ids) - 2, np.zeros(len(ids), np.int64)
    for leaf in reversed(leaves):
        n = int(leaf[:taken].sum())
        length[:n] += 1
        taken = 2 * (taken - n)
    bits[ids] = length
    return bits


class Code:
    """Canonical codes: shorter first, then by id."""

    def __init__(self, bits: np.ndarray):
        self.bits = np.asarray(bits, np.uint8).astype(np.int64)
        self.longest = int(self.bits.max(initial=0))
        ids = np.flatnonzero(self.bits)
        ids = ids[np.argsort(self.bits[ids], kind="stable")]
        self.code = np.zeros(len(self.bits), np.uint64)
        span = 1 << (self.longest - self.bits[ids]) if len(ids) else np.zeros(0, np.int64)
        begin = np.cumsum(span) - span
        self.code[ids] = (begin // span).astype(np.uint64) if len(ids) else 0
        self.table = np.zeros(1 << self.longest, np.uint32)  # id * 64 + bits
        used = int(span.sum())
        self.table[:used] = np.repeat((ids * 64 + self.bits[ids]).astype(np.uint32), span)

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """(bits, first at the top of each byte; bits between checkpoints as little-endian 16-bit numbers)."""
        if not len(ids):
            return b"", b""
        n = self.bits[ids]
        at = np.cumsum(n) - n
        total = int(at[-1] + n[-1])
        wide = self.code[ids] << (64 - n - (at & 31)).astype(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        words = np.zeros((total >> 5) + 2, np.uint64)
        words[word[first]] += np.add.reduceat(wide >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), first)
        marks = np.diff(at[::EVERY]).astype("<u2")
        return words.astype(">u4").tobytes()[: (total + 7) // 8], marks.tobytes()

    def decode(self, data: bytes, marks: bytes, n: int) -> np.ndarray:
        """The n ids of a block: every checkpoint's run advances by one id a step, by one table look-up."""
        if not n:
            return np.zeros(0, np.uint32)
        at = np.concatenate(([0], np.cumsum(np.frombuffer(marks, "<u2").astype(np.int64))))
        raw = np.frombuffer(data + bytes(8 + -len(data) % 4), ">u4").astype(np.uint64)
        pairs = (raw[:-1] << np.uint64(32)) | raw[1:]
        out = np.zeros((EVERY, len(at)), np.uint32)
        drop = np.uint64(64 - self.longest)
        for i in range(min(EVERY, n)):
            if i == n - (len(at) - 1) * EVERY:  # the last run is short
                at = at[:-1]
            entry = self.table[(pairs[at >> 5] << (at & 31).astype(np.uint64)) >> drop]
            out[i, : len(at)] = entry >> 6
            at = at + (entry & 63)
        return out.T.ravel()[:n]
