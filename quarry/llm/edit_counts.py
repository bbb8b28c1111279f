"""Operator 9: edit-aware token counts on segment trees.

A text is cut into leaves of some pieces each, at places where the pre-tokenizer always cuts (ASCII white space behind a
character that is none).  A document's tree is an array of sums over its leaves, of bytes and of tokens; the leaves are the
second half.  Trees are a table that is built once and kept; edits are another, and only documents with edits are opened
again.  An edit (byte range, new text) finds its leaves by descending the byte sums; they, and the neighbour whose border
the edit touches, are encoded again, and only the sums above them change.  A leaf that edits made too long is cut anew.
Counts equal those of the whole new text.

Edits of a document apply one after the other in order of ``nth``, each to the text the one before left; a range beyond the
text's end is cut to it.  A null text counts as empty; no edits or edits of unknown documents leave the counts, null members of an edit are 0 or empty;
rows without an id are left out; equal ids keep their rows, and edits of an id apply to each of them; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .bpe import Encoder, encoder
from .common import cut, small_side, text_batches
from .token_file import default_tokenizer

#: Pieces (words with the white space before them) of a leaf.
LEAF = 32
#: Bytes of a leaf beyond which an edited one is cut anew, if it can be.
LEAF_BYTES = 2048
TREES = "id long, text string, leaf_bytes array<int>, leaf_tokens array<int>"
COUNTED = TREES + ", tokens_before long, tokens_after long, n_edits long, bytes_encoded long"


class Tree:
    """Sums of (bytes, tokens) over leaves, in a binary heap: node i has children 2i and 2i + 1."""

    def __init__(self, data: bytes, sizes, counts, encode: Encoder):
        self.encode, self.encoded, at, texts = encode, 0, 0, []
        for n in sizes:
            texts.append(data[at : at + n])
            at += n
        self._grow(texts, [int(c) for c in counts])

    def _grow(self, texts: list[bytes], counts: list[int]) -> None:
        self.half = 1 << max(0, int(max(len(texts), 1) - 1).bit_length())
        rest = self.half - len(texts)
        self.texts = [*texts, *[b""] * rest]
        self.bytes = [*[0] * self.half, *map(len, self.texts)]
        self.tokens = [*[0] * self.half, *counts, *[0] * rest]
        for i in range(self.half - 1, 0, -1):
            self.bytes[i] = self.bytes[2 * i] + self.bytes[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def leaf_at(self, at: int) -> tuple[int, int]:
        """(leaf that holds byte ``at``, its first byte)."""
        node, start = 1, 0
        while node < self.half:
            node *= 2
            if at - start >= self.bytes[node]:
                start += self.bytes[node]
                node += 1
        return node - self.half, start

    def _set(self, leaf: int, text: bytes, tokens: int) -> None:
        self.texts[leaf] = text
        node = leaf + self.half
        more, new = len(text) - self.bytes[node], tokens - self.tokens[node]
        while node:
            self.bytes[node] += more
            self.tokens[node] += new
            node //= 2

    def edit(self, at: int, length: int, text: bytes) -> None:
        total = self.bytes[1]
        at = min(max(at, 0), total)
        end = min(at + max(length, 0), total)
        # a byte before and one behind: their leaves' outer borders stay what they are
        first, start = self.leaf_at(max(at - 1, 0)) if total else (0, 0)
        last, _ = self.leaf_at(min(end, total - 1)) if total else (0, 0)
        old = b"".join(self.texts[first : last + 1])
        new = (old[: at - start] + text + old[end - start :]).decode("utf-8", "replace").encode()
        self.encoded += len(new)
        parts = cut_leaves(new) if len(new) > LEAF_BYTES else [new]
        counts = [len(x) for x in self.encode.whole([p.decode() for p in parts])]
        if len(parts) > last - first + 1:  # more leaves than there are: all sums are made anew, nothing else is encoded
            return self._grow([*self.texts[:first], *parts, *self.texts[last + 1 :]], [*self.tokens[self.half :][:first], *counts, *self.tokens[self.half + last + 1 :]])
        for i in range(first, last + 1):
            k = i - first
            if k < len(parts):
                self._set(i, parts[k], counts[k])
            elif self.texts[i]:
                self._set(i, b"", 0)

    def text(self) -> bytes:
        return b"".join(self.texts)


def cut_leaves(data: bytes, leaf: int = LEAF) -> list[bytes]:
    """A text's leaves: each border follows an ASCII character that is no white space or control, and precedes ASCII white space."""
    x = np.frombuffer(data, np.uint8)
    if len(x) < 2:
        return [data]
    at = np.flatnonzero(W.WHITE[x[1:]] & (x[:-1] > 32) & (x[:-1] < 127)) + 1
    bounds = [0, *at[leaf - 1 :: leaf].tolist(), len(data)]
    return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a]


def leaves(encode: Encoder, texts: pa.Array, leaf: int = LEAF):
    """(row, bytes of its leaves, tokens of its leaves)."""
    for b, row, lo, counts in encode.pieces(texts):
        opens = W.WHITE[b.data[lo]] if len(lo) else np.zeros(0, bool)
        nth = np.cumsum(opens)
        bounds = np.searchsorted(row, np.arange(len(b) + 1))
        total = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        odd = set(encode._odd(b).tolist())
        for i in range(len(b)):
            if i in odd:  # white space outside ASCII: the pieces are not known, the leaves are encoded one by one
                parts = cut_leaves(b.data[b.bounds[i] : b.bounds[i + 1]].tobytes(), leaf)
                yield b.row + i, np.array([len(x) for x in parts], np.int32), np.array([len(x) for x in encode.whole([x.decode() for x in parts])], np.int32)
                continue
            p, q = bounds[i], bounds[i + 1]
            cut = np.flatnonzero(opens[p:q] & (nth[p:q] % leaf == 0)) + p
            cut = cut[cut > p]
            at = np.concatenate(([p], cut, [q])) if q > p else np.array([p, q])
            ends = np.append(lo[at[1:-1]], b.bounds[i + 1])
            yield b.row + i, np.diff(np.concatenate(([b.bounds[i]], ends))).astype(np.int32), np.diff(total[at]).astype(np.int32)


def _lists(values: list[np.ndarray]) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(x) for x in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32), pa.int32()))


def _build(batches, path: str):
    for batch in W.slices(batches):
        text = W.column(batch, "text")
        found = list(leaves(encoder(path), text))
        yield pa.RecordBatch.from_arrays([batch.column("id"), text, _lists([x[1] for x in found]), _lists([x[2] for x in found])], names=["id", "text", "leaf_bytes", "leaf_tokens"])


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Each document's tree: id, text, bytes and tokens of its leaves (the inner sums follow from them)."""
    docs = text_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("id is not null")
    return docs.mapInArrow(partial(_build, path=tokenizer or default_tokenizer()), TREES)


def _apply(batches, path: str):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            tree = Tree(r["text"].encode(), r["leaf_bytes"], r["leaf_tokens"], encoder(path))
            before = tree.tokens[1]
            for e in r["edits"]:
                tree.edit(e["at"] or 0, e["length"] or 0, (e["text"] or "").encode())
            sizes = [(len(t), c) for t, c in zip(tree.texts, tree.tokens[tree.half :], strict=True) if t] or [(0, 0)]
            out.append((r["id"], tree.text().decode("utf-8", "replace"), [n for n, _ in sizes], [c for _, c in sizes], before, tree.tokens[1], len(r["edits"]), tree.encoded))
        kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int64()] * 4]
        names = ["id", "text", "leaf_bytes", "leaf_tokens", "tokens_before", "tokens_after", "n_edits", "bytes_encoded"]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], names=names)


def apply_edits(trees: DataFrame, edits: DataFrame, tokenizer: str | None = None, key: str = "id") -> DataFrame:
    """The trees after the edits (id, nth, at: byte offset, length: in bytes, text), with counts before and after.  An edit's
    id names a tree by the column ``key``.

    Trees without edits pass as they are, their counts summed from their leaves; only the others reach Python."""
    step = F.struct("nth", "at", "length", "text")
    each = edits.where("id is not null").groupBy(F.col("id").alias("edited")).agg(F.transform(F.sort_array(F.collect_list(step)), lambda x: F.struct(x["at"], x["length"], x["text"])).alias("edits"))
    each = small_side(cut(each, "op9-edits"), EDITED_ROWS)
    mine = F.col(key) == F.col("edited")
    opened = text_batches(trees).join(each, mine).select("id", "text", "leaf_bytes", "leaf_tokens", "edits").mapInArrow(partial(_apply, path=tokenizer or default_tokenizer()), COUNTED)
    whole = F.aggregate("leaf_tokens", F.lit(0).cast("long"), lambda s, x: s + x)
    none = F.lit(0).cast("long")
    rest = trees.join(each.select("edited"), mine, "left_anti").select("id", "text", "leaf_bytes", "leaf_tokens", whole.alias("tokens_before"), whole.alias("tokens_after"), none.alias("n_edits"), none.alias("bytes_encoded"))
    return rest.unionByName(opened)


#: Rows of grouped edits that may be broadcast, some hundred bytes each.
EDITED_ROWS = 50_000
EMAIL = re.compile(rb"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}")
NUMBER = re.compile(rb"\+?[0-9](?:[ ().-]?[0-9]){6,18}")
_HAS_DIGITS = re.compile(rb"[0-9][^A-Za-z]{0,2}[0-9]")


def redactions(data: bytes) -> list[tuple[int, int, str]]:
    """(at, length, new text): replacements of e-mail addresses and of long numbers outside them, from the text's end on, so that
    offsets hold."""
    found = [(m.start(), m.end(), "<email>") for m in EMAIL.finditer(data)] if b"@" in data else []
    if _HAS_DIGITS.search(data):
        mails, i = list(found), 0
        for m in NUMBER.finditer(data):
            while i < len(mails) and mails[i][1] <= m.start():
                i += 1
            if i == len(mails) or mails[i][0] >= m.end():
                found.append((m.start(), m.end(), "<number>"))
    return [(a, b - a, t) for a, b, t in sorted(found, reverse=True)]


def _redactions(batches):
    for batch in batches:
        ids, out = batch.column("id").to_pylist(), []
        for i, x in enumerate(W.column(batch, "text")):
            out += [(ids[i], nth, *e) for nth, e in enumerate(redactions(x.as_buffer().to_pybytes() if x.is_valid else b""))]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["id", "nth", "at", "length", "text"])


def redaction_edits(trees: DataFrame) -> DataFrame:
    """Edits (id, nth, at, length, text) that replace e-mail addresses and long numbers of the trees' texts."""
    return text_batches(trees).select("id", "text").mapInArrow(_redactions, "id long, nth int, at int, length int, text string")


def redacted_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Trees of all documents after e-mail addresses and long numbers were replaced, with counts before and after.

    The trees are written first and edited from there.  Rows of one id with different texts have edits of their own, so each
    row goes under a hash of id and text meanwhile."""
    trees = cut(build(docs, id_col, text_col, tokenizer), "op9-trees")
    named = trees.withColumn("row", F.xxhash64("id", "text"))
    edits = redaction_edits(named.select(F.col("row").alias("id"), "text")).distinct()  # equal rows have equal edits
    return apply_edits(named, edits, tokenizer, "row")
