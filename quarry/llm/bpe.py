"""Token ids of Arrow text columns by a byte-level BPE file of the tokenizers library.

The pre-tokenizer of these files never joins a word with white space behind it, so a text is encoded piece by piece: each
piece is a word with the white space before it, or the marks that end a word, and only pieces not yet in the worker's bounded table are passed
to the tokenizer.  Texts with white space outside ASCII go to the tokenizer whole.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import wordhash as W

BLOCK_BYTES = 1 << 20
#: ASCII marks other than the apostrophe, and bytes that can end a word before such marks.
MARK = np.array([33 <= i < 127 and i != 39 and not chr(i).isalnum() for i in range(256)])
ALNUM = np.array([i < 128 and chr(i).isalnum() for i in range(256)])
#: Pieces a worker remembers (about 40 bytes each); beyond it starts anew.
REMEMBERED = 700_000


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class _Table:
    """Open addressing over two 64-bit hashes of each piece; begin and length tell where its ids are in ``flat``."""

    def __init__(self, bits: int = 21):
        self.slot, self.n = np.full(1 << bits, -1, np.int32), 0
        self.key, self.check = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
        self.begin, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Entry of each piece, -1 where there is none."""
        mask = len(self.slot) - 1
        at = (key & np.uint64(mask)).astype(np.int64)
        entry = self.slot[at]
        left = np.flatnonzero((entry >= 0) & ((self.key[entry] != key) | (self.check[entry] != check)))
        while len(left):  # another piece's slot: look at the next
            at[left] = (at[left] + 1) & mask
            entry[left] = e = self.slot[at[left]]
            left = left[(e >= 0) & ((self.key[e] != key[left]) | (self.check[e] != check[left]))]
        return entry

    def add(self, key, check, begin, length) -> None:
        """Add pieces that are different and not there yet."""
        lo, self.n = self.n, self.n + len(key)
        for name, more in (("key", key), ("check", check), ("begin", begin), ("length", length)):
            if self.n > len(have := getattr(self, name)):
                setattr(self, name, have := np.concatenate([have, np.zeros(max(len(have), len(key)), have.dtype)]))
            have[lo : self.n] = more
        mask = len(self.slot) - 1
        at, new = (key & np.uint64(mask)).astype(np.int64), np.arange(lo, self.n, dtype=np.int32)
        while len(new):
            free = self.slot[at] < 0
            self.slot[at[free]] = new[free]  # of several for one slot the last stays
            lost = self.slot[at] != new
            at, new = (at[lost] + 1) & mask, new[lost]


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        plain = self.tokenizer.get_vocab_size()
        # a byte-level token has one character for each byte
        self.size = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(plain)], np.int64)
        self.forget()

    def forget(self) -> None:
        self.table, self.flat, self.used = _Table(), np.zeros(1 << 20, np.uint32), 0

    def _keep(self, lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        length = np.fromiter(map(len, lists), np.int32, len(lists))
        ids = np.fromiter((i for x in lists for i in x), np.uint32, int(length.sum()))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(len(ids), self.used), np.uint32)])
        self.flat[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(length, dtype=np.int64) - length
        self.used += len(ids)
        return begin, length

    def whole(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, some texts at a time: the library's results are large."""
        encode = self.tokenizer.encode_batch
        return [x.ids for i in range(0, len(texts), 16) for x in encode(texts[i : i + 16], add_special_tokens=False)]

    def _pieces(self, data, lo, hi) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces: those that begin with white space many at a time, told apart by the bytes of their tokens."""
        free = W.WHITE[data[lo]] & ~W.WHITE[data[hi - 1]]
        begin, length = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int32)
        for at in (np.flatnonzero(free), np.flatnonzero(~free)):
            step = 250 if free[at[:1]].any() else 1
            texts = [b"".join(data[lo[i] : hi[i]].tobytes() for i in at[j : j + step]).decode() for j in range(0, len(at), step)]
            lists = self.whole(texts)
            first, _ = self._keep(lists)
            if len(at):
                ids = self.flat[first[0] : self.used]
                ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum(hi[at] - lo[at])) + 1
                length[at] = np.diff(ends, prepend=0)
                begin[at] = first[0] + ends - length[at]
        return begin, length

    def _places(self, data, lo, hi) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of data[lo:hi] in ``flat``."""
        if self.table.n > REMEMBERED:
            self.forget()
        key, check = W.FIRST.spans(data, lo, hi, False), W.SECOND.spans(data, lo, hi, False)
        entry = self.table.find(key, check)
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            _, one = np.unique(key[missing] ^ (check[missing] >> np.uint64(1)), return_index=True)
            one = missing[one]
            self.table.add(key[one], check[one], *self._pieces(data, lo[one], hi[one]))
            entry[missing] = self.table.find(key[missing], check[missing])
        return self.table.begin[entry], self.table.length[entry]

    def _cut(self, b: W.Block) -> tuple[np.ndarray, ...]:
        """Pieces of a block: row, first byte, place and number of ids; a row of odd white space is one piece."""
        # a piece begins at the end of the word before it, or of the row before
        n = len(b.starts)
        lo = np.empty(n, np.int64)
        lo[1:] = b.ends[:-1]
        some = b.first[1:] > b.first[:-1]
        lo[b.first[:-1][some]] = b.bounds[:-1][some]
        last = b.bounds[:-1].copy()  # where each row's last word ends
        last[some] = b.ends[b.first[1:][some] - 1]
        tail = np.flatnonzero(last < b.bounds[1:])  # rows that end in white space
        mark = self._marks(b.data, lo, b.ends)
        cut = np.flatnonzero(mark < b.ends)
        lo, hi = np.concatenate([lo, mark[cut], last[tail]]), np.concatenate([mark, b.ends[cut], b.bounds[1:][tail]])
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], hi[order]
        row = np.searchsorted(b.bounds, lo, "right") - 1
        odd = self._odd(b)
        if len(odd):
            mine = np.isin(row, odd)
            lo, hi, row = lo[~mine], hi[~mine], row[~mine]
        begin, length = self._places(b.data, lo, hi) if len(lo) else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        if len(odd):
            at, n_ids = self._keep(self.whole([b.data[b.bounds[i] : b.bounds[i + 1]].tobytes().decode() for i in odd]))
            row, lo, begin, length = (np.concatenate([x, y]) for x, y in ((row, odd), (lo, b.bounds[odd]), (begin, at), (length, n_ids)))
            order = np.argsort(row, kind="stable")
            row, lo, begin, length = row[order], lo[order], begin[order], length[order]
        return row, lo, begin, length

    def pieces(self, texts: pa.Array) -> Iterator[tuple[W.Block, np.ndarray, np.ndarray, np.ndarray]]:
        """Of each block: row, first byte and number of ids of each piece."""
        for b in W.blocks(texts, BLOCK_BYTES):
            row, lo, _, length = self._cut(b)
            yield b, row, lo, length

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids of some rows on end, number of ids of each); nulls have none."""
        for b in W.blocks(texts, BLOCK_BYTES):
            row, _, begin, length = self._cut(b)
            total = np.concatenate(([0], np.cumsum(length, dtype=np.int64)))
            ids = self.flat[np.repeat(begin - total[:-1], length) + np.arange(total[-1])]
            yield b.row, ids, np.diff(total[np.searchsorted(row, np.arange(len(b) + 1))])

    @staticmethod
    def _marks(data: np.ndarray, lo: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the marks begin that end each word after a letter or digit; its end, if it has none."""
        if not len(ends):
            return ends
        last = np.maximum.accumulate(np.where(MARK[data], 0, np.arange(len(data), dtype=np.int32)))[ends - 1]
        latin = (data[last] >= 0x80) & (data[np.maximum(last - 1, 0)] == 0xC3) & (data[last] != 0x97) & (data[last] != 0xB7)
        return np.where((last >= lo) & (ALNUM[data[last]] | latin & (last > lo)), last + 1, ends)

    @staticmethod
    def _odd(b: W.Block) -> np.ndarray:
        """Rows with white space outside ASCII, or with control characters that some call white space."""
        d = np.concatenate([b.data, np.zeros(2, np.uint8)])
        at = np.flatnonzero((b.data == 0xC2) | (b.data == 0xE1) | (b.data == 0xE2) | (b.data == 0xE3) | ((b.data >= 0x1C) & (b.data < 0x20)))
        x, y, z = d[at], d[at + 1], d[at + 2]
        hit = (x < 0x20) | ((x == 0xC2) & ((y == 0x85) | (y == 0xA0))) | ((x == 0xE1) & (y == 0x9A) & (z == 0x80))
        hit |= ((x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))) | ((x == 0xE2) & (y == 0x81) & (z == 0x9F))
        hit |= (x == 0xE3) & (y == 0x80) & (z == 0x80)
        return np.unique(np.searchsorted(b.bounds, at[hit], "right") - 1)
