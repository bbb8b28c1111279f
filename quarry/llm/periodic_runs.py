"""Operator 13: maximal periodic runs of words, by branching tandem repeats of a suffix tree.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), at least ``exponent`` periods and
``least`` words long, that no neighbouring word extends keeping the period.  Of each text the suffix tree is made as the
intervals of its sorted suffixes; the texts of a block share the arrays, but their words are numbered apart, so no suffix
of one meets one of another.  Each node of depth D deals the leaves of all its children but the largest: leaf i is the start, or
the middle, of a tandem repeat of period D that branches here if the leaf D words on, or back, lies under the node
too and the next words differ.  A leaf is dealt at most log2(n) + 1 times.  Each such repeat is rotated to the left as far as its
words repeat, which gives the run that it ends; of the repeats of one stretch the smallest period counts.

Every text is whole, in one task; equality is that of the words, not of hashes.  Null, empty and blank texts have no word and no run;
rows without an id are left out; repeated rows are judged alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .common import text_batches

LEAST, EXPONENT = 6, 4
#: Words of a block; a longer text is a block of its own.
BLOCK_WORDS = 1 << 17
SCHEMA = "id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, kept string"


class Suffixes:
    """Sorted suffixes of numbers in which each text ends in a number of its own, with the ranks of all blocks of
    1, 2, 4, .. numbers as far as blocks repeat."""

    def __init__(self, numbers: np.ndarray):
        n = self.n = len(numbers)
        self.sa = np.argsort(numbers, kind="stable").astype(np.int32)
        ordered = numbers[self.sa]
        first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        slots = np.arange(n, dtype=np.int32)
        rank = np.empty(n, np.int32)
        rank[self.sa] = np.maximum.accumulate(np.where(first, slots, 0))
        self.ranks, width = [rank], 1
        open_ = slots[~first | ~np.concatenate((first[1:], [True]))]  # of groups of several
        while len(open_):
            u = self.sa[open_]
            group = rank[u].astype(np.int64)
            key = group * (n + 1) + rank[np.minimum(u + width, n - 1)]
            order = np.argsort(key, kind="stable")
            u, key = u[order], key[order]
            self.sa[open_] = u
            first = np.concatenate(([True], key[1:] != key[:-1]))
            rank = rank.copy()
            rank[u] = open_[np.maximum.accumulate(np.where(first, np.arange(len(u)), 0))]
            self.ranks.append(rank)
            width *= 2
            open_ = open_[~first | ~np.concatenate((first[1:], [True]))]
        self.place = rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal numbers from places a and b on; blocks that reach beyond a text differ from all others."""
        out = np.zeros(len(a), np.int32)
        for k in range(len(self.ranks) - 1, -1, -1):
            same = np.flatnonzero(self.ranks[k][np.minimum(a + out, self.n - 1)] == self.ranks[k][np.minimum(b + out, self.n - 1)])
            out[same] += 1 << k
        return out

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal numbers that end just before places a < b."""
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            at = a - out - (1 << k)
            same = np.flatnonzero((at >= 0) & (self.ranks[k][np.maximum(at, 0)] == self.ranks[k][np.maximum(at + b - a, 0)]))
            out[same] += 1 << k
        return out


class Tree:
    """Inner nodes of the suffix tree, but for the root: intervals left .. right - 1 of sorted suffixes whose first ``depth`` numbers are equal."""

    def __init__(self, s: Suffixes):
        n = s.n
        near = np.flatnonzero(s.ranks[0][s.sa[1:]] == s.ranks[0][s.sa[:-1]]) + 1
        depth = np.zeros(n + 1, np.int32)  # of each suffix with the one before it
        depth[near] = s.common(s.sa[near], s.sa[near - 1])
        own = depth[near]
        # minima of 1, 2, 4, .. places; a node can't be wider than the longest run of places above the root
        wide = int(np.diff(np.flatnonzero(depth == 0)).max(initial=1))
        minima = [depth]
        while 1 << len(minima) <= wide:
            half, last = 1 << (len(minima) - 1), minima[-1]
            low = np.zeros(n + 1, np.int32)
            low[: n + 1 - half] = np.minimum(last[: n + 1 - half], last[half:])
            minima.append(low)
        left, right = near.copy(), near + 1
        for k in range(len(minima) - 1, -1, -1):
            low = minima[k]
            at = left - (1 << k)
            left = np.where((at >= 0) & (low[np.maximum(at, 0)] >= own), at, left)
            right = np.where((right <= n) & (low[np.minimum(right, n)] >= own), right + (1 << k), right)
        left -= 1
        _, at, inverse = np.unique(left.astype(np.int64) * (n + 1) + right, return_index=True, return_inverse=True)
        self.left, self.right, self.depth = left[at], right[at], own[at]
        node_of = np.full(n + 1, -1, np.int64)  # the node whose depth a place has
        node_of[near] = inverse
        over = lambda a, b: np.where(np.maximum(depth[a], depth[b]) > 0, node_of[np.where(depth[a] >= depth[b], a, b)], -1)
        self.parent = over(self.left, self.right)
        slots = np.arange(n)
        self.parent_of_leaf = over(slots, slots + 1)
        # the largest inner child continues its parent's path; light: the node at which a node's path begins
        m = len(self.depth)
        self.light = np.arange(m)
        order = np.lexsort((self.right - self.left, self.parent))
        last = order[np.concatenate((self.parent[order][1:] != self.parent[order][:-1], [True]))] if m else order
        heavy = last[self.parent[last] >= 0]
        self.light[heavy] = self.parent[heavy]
        while m:
            further = self.light[self.light]
            if np.array_equal(further, self.light):
                break
            self.light = further

    def dealt(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(nodes, places of leaves among the sorted suffixes): each node's leaves outside its largest inner child."""
        slots = np.flatnonzero(self.parent_of_leaf >= 0)
        node = self.parent_of_leaf[slots]
        while len(node):
            yield node, slots
            node = self.parent[self.light[node]]
            slots, node = slots[node >= 0], node[node >= 0]


def branching_repeats(numbers: np.ndarray, most: np.ndarray) -> tuple[Suffixes, np.ndarray, np.ndarray]:
    """(suffixes, start, period) of the branching tandem repeats with period up to ``most`` of their place."""
    s = Suffixes(numbers)
    tree, n = Tree(s), s.n
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for node, slots in tree.dealt():
        d, i = tree.depth[node].astype(np.int64), s.sa[slots].astype(np.int64)
        ok = d <= most[i]
        node, d, i = node[ok], d[ok], i[ok]
        for a in (i, i - d):  # the leaf as start, and as middle
            b = a + d
            ok = np.flatnonzero((a >= 0) & (b < n))
            other = s.place[(b if a is i else a)[ok]]
            ok = ok[(other >= tree.left[node[ok]]) & (other < tree.right[node[ok]])]
            ok = ok[numbers[a[ok] + d[ok]] != numbers[np.minimum(b[ok] + d[ok], n - 1)]]
            found.append((a[ok], d[ok]))
    start, period = (np.concatenate(x) for x in zip(*found, strict=True))
    _, once = np.unique(start * (n + 1) + period, return_index=True)
    return s, start[once], period[once]


def find_runs(texts: list[np.ndarray], least: int = LEAST, exponent: int = EXPONENT) -> list[np.ndarray]:
    """Of each text (numbers of its words, equal words alike) the rows start, length, period of its maximal runs with at least ``exponent``
    (2 or more) periods and ``least`` words, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    first = np.concatenate(([0], np.cumsum(sizes + 1)))  # a text's words, then its end
    base = np.concatenate(([0], np.cumsum([int(t.max(initial=-1)) + 2 for t in texts])))
    numbers = np.concatenate([np.append(t, -1) - (-1 - b) for t, b in zip(texts, base[:-1], strict=True)] or [np.zeros(0, np.int64)]).astype(np.int64)
    if not len(numbers):
        return [np.zeros((0, 3), np.int64) for _ in texts]
    s, at, period = branching_repeats(numbers, np.repeat(sizes // exponent, sizes + 1))
    start = at - s.before(at, at + period)
    length = at + 2 * period - start
    ok = length >= np.maximum(least, exponent * period)
    start, length, period = start[ok], length[ok], period[ok]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), bool)  # of one stretch the smallest period
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((length, period, start))
    rows = np.stack([start, length, period], 1)[order]
    owner = np.searchsorted(first, rows[:, 0], "right") - 1
    rows[:, 0] -= first[owner]
    return np.split(rows, np.searchsorted(owner, np.arange(1, len(texts)))) if len(texts) else []


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def repeating_ends(ids: list[int], sizes: list[int]) -> list[np.ndarray | None]:
    """Of a tenth of all ids, by crc32 of the id, the texts whose ends are made to repeat: the word that stands at each place."""
    out: list[np.ndarray | None] = []
    for i, n in zip(ids, sizes, strict=True):
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 or not n:
            out.append(None)
            continue
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at = np.arange(n)
        at[a:] = a + (at[a:] - a) % p
        out.append(at)
    return out


def _runs(batches: Iterator[pa.RecordBatch], least: int, exponent: int, placed: Callable | None) -> Iterator[pa.RecordBatch]:
    def done(ids, texts, numbers):
        columns = [ids, [len(t) for t in texts], [], [], [], []]
        for words, runs in zip(texts, find_runs(numbers, least, exponent), strict=True):
            for k in range(3):
                columns[2 + k].append(runs[:, k])
            if len(runs):
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, runs[:, 0] + runs[:, 2], 1)
                np.add.at(change, runs[:, 0] + runs[:, 1], -1)
                words = compress(words, (np.cumsum(change[:-1]) == 0).tolist())
            columns[5].append(b" ".join(words))
        kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
        made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*made[:5], made[5].cast(pa.string())], names=["id", "n_words", "starts", "lengths", "periods", "kept"])

    for batch in W.slices(batches):
        ids = batch.column("id").to_pylist()
        split = [(t.as_py() or b"").split() for t in W.column(batch, "text").cast(pa.binary())]
        placements = placed(ids, [len(x) for x in split]) if placed else [None] * len(ids)
        block, size = [], 0
        for i, words, at in zip(ids, split, placements, strict=True):
            if block and size + len(words) > BLOCK_WORDS:
                yield done(*map(list, zip(*block, strict=True)))
                block, size = [], 0
            numbers = numbered(words)
            if at is not None:
                words, numbers = [words[k] for k in at.tolist()], numbers[at]
            block.append((i, words, numbers))
            size += len(words) + 1
        if block:
            yield done(*map(list, zip(*block, strict=True)))


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT, placed: Callable | None = None) -> DataFrame:
    """One row per document: id, n_words, starts, lengths, periods (of its runs, by start, then period), kept (its words but those that a
    run contains after its first period, joined by spaces).

    ``placed`` (ids, numbers of words) may give for a document the place whose word stands at each place."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    docs = text_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    return docs.mapInArrow(partial(_runs, least=least, exponent=exponent, placed=placed), SCHEMA)


def digests(found: DataFrame) -> DataFrame:
    """The rows of ``runs`` as id, n_runs, the longest run's start, length, period and exponent_milli (ties: smallest start, then
    period; null without runs), runs_sha256, collapsed_sha256."""
    lines = F.transform(F.arrays_zip("starts", "lengths", "periods"), lambda r: F.concat_ws(",", r["starts"], r["lengths"], r["periods"]))
    best = F.array_position("lengths", F.array_max("lengths")).cast("int")  # the first, which starts first
    of = lambda c: F.try_element_at(c, best)
    return found.select(
        "id", F.size("starts").cast("long").alias("n_runs"), of(F.col("starts")).alias("start"), of(F.col("lengths")).alias("length"), of(F.col("periods")).alias("period"),
        F.floor(1000 * of(F.col("lengths")) / of(F.col("periods"))).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )
