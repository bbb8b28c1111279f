"""Operator 3: substring dedup on a compacted de Bruijn graph of token k-mers.

An edge of the graph is a window of k consecutive words.  Every edge belongs to the smallest (by hash) of its short
word grams; consecutive edges of a document with the same smallest gram form a nonbranching path, which travels as one
row: the gram, its source coordinate (id, word position) and a hash of each edge.  Equal edges always have the
same gram, so paths meet by gram:

* within a task, edges already seen are marked at their coordinates and leave the path, so that of a passage in
  very many documents each task sends on one path;
* grams with many paths in some task (where the graph branches: a common line between ever different neighbours) are
  listed first, the most frequent up to a fixed number; their edges are dealt out one by one by their own hash, so
  no group of paths grows with the copies of a passage;
* after one shuffle by gram, edges that also start earlier are marked, and the marks join the documents by
  id, where the source coordinates are merged to spans and the words outside them stay.

Equality of edges is equality of 104 hash bits (a 64-bit gram and 40 bits of the edge; 64-bit keys and 40 bits for
edges dealt one by one).  Positions are exact: all words of whole texts count, unchanged.

Null and empty texts have no words; texts under k words stay whole; rows without an id are left out; rows of one id are one
document that does not repeat itself at the same position; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W

WINDOW = 20
GRAM = 5
#: Bytes of text among which a task looks for repeats before it sends paths on.
CHUNK_BYTES = 6 << 20
#: Grams with so many paths or more in a chunk are candidates for the list of branching grams, of bounded length.
BRANCHING, LISTED = 8, 1 << 17
EDGE_BYTES = 5


def _least(grams: np.ndarray, n: int) -> np.ndarray:
    """Index of the first smallest of grams[i : i + n], for each i."""
    value, at, width = grams, np.arange(len(grams), dtype=np.int32), 1
    while width < n:
        step = min(width, n - width)
        left, right = value[:-step], value[step:]
        later = right < left
        value, at = np.where(later, right, left), np.where(later, at[step:], at[:-step])
        width += step
    return at


def _edges(block: W.Block, k: int):
    """Of each window of a block: row, word position in the row, hash of the window, hash and place of its gram."""
    words = W.FIRST.spans(block.data, block.starts, block.ends, False)
    if len(words) < k:
        return None
    gram = min(GRAM, k)
    lengths = np.diff(block.first)
    row = np.repeat(np.arange(len(block)), lengths)
    whole = np.flatnonzero((np.arange(len(words)) + k <= block.first[1:][row])[: len(words) - k + 1])
    hashes = W.FIRST.grams(words, gram)
    place = _least(hashes, k - gram + 1)[whole]
    return block.row + row[whole], whole - block.first[:-1][row[whole]], W.SECOND.grams(words, k)[whole], hashes[place], place


def _chunks(batches, chunk: int):
    """Texts of about ``chunk`` bytes, in order of id: (ids, texts)."""
    kept, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            kept.append(part)
            size += part.nbytes
            if size >= chunk:
                yield _in_order(kept)
                kept, size = [], 0
    if kept:
        yield _in_order(kept)


def _in_order(parts):
    t = pa.Table.from_batches(parts)
    t = t.take(pc.sort_indices(t["id"])).combine_chunks()
    text = t["text"].combine_chunks()
    if isinstance(text, pa.ChunkedArray):
        text = text.chunk(0) if text.num_chunks else pa.array([], pa.string())
    return t["id"].to_numpy(), text


def _chunk_paths(ids, text, k):
    """Arrays of a chunk's edges, a flag for each that occurs first here, and bounds of paths of such edges."""
    found, base = [], 0
    for b in W.blocks(text):
        if (e := _edges(b, k)) is not None and len(e[0]):
            found.append((*e[:4], e[4] + base))
        base += len(b.starts)
    if not found:
        return None
    row, pos, edge, gram, place = (np.concatenate(x) for x in zip(*found, strict=True))
    again = _later(edge, ids[row], pos)
    turn = np.ones(len(edge), bool)  # a path ends where row, gram or flag change
    turn[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1]) | (again[1:] != again[:-1])
    starts = np.flatnonzero(turn)
    return row, pos, edge, gram, again, starts, np.append(starts[1:], len(edge)) - starts


def _later(key: np.ndarray, ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Whether an equal key stands at an earlier (id, pos); equal keys come in that order."""
    order = np.argsort(key, kind="stable")
    opens = np.ones(len(key), bool)
    opens[1:] = key[order[1:]] != key[order[:-1]]
    first = order[np.maximum.accumulate(np.where(opens, np.arange(len(key)), 0))]
    later = np.zeros(len(key), bool)
    later[order] = (ids[order] != ids[first]) | (pos[order] != pos[first])
    return later


def _branching(batches, k: int, chunk: int, least: int):
    for ids, text in _chunks(batches, chunk):
        if (x := _chunk_paths(ids, text, k)) is not None:
            _, _, _, gram, again, starts, _ = x
            values, counts = np.unique(gram[starts[~again[starts]]], return_counts=True)
            many = counts >= least
            yield pa.RecordBatch.from_arrays([pa.array(values[many].view(np.int64)), pa.array(counts[many])], names=["gram", "c"])


def _pack(edges: np.ndarray, lengths: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(edges.view(np.uint8).reshape(-1, 8)[:, :EDGE_BYTES])
    at = np.concatenate(([0], np.cumsum(lengths * EDGE_BYTES))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(raw)])


def _paths(batches, k: int, chunk: int, listed):
    """Rows (gram, id, pos, n, edges); without edges: a run of n edges at pos that start earlier in this task."""
    names = ["gram", "id", "pos", "n", "edges"]
    for ids, text in _chunks(batches, chunk):
        if (x := _chunk_paths(ids, text, k)) is None:
            continue
        row, pos, edge, gram, again, starts, lengths = x
        ids = ids[row[starts]]
        own = again[starts]
        apart = np.isin(gram[starts], listed.value) & ~own if len(listed.value) else np.zeros(len(starts), bool)
        groups = [(starts[own], lengths[own], ids[own], W.mix(ids[own].astype(np.uint64)), False)]
        whole = ~own & ~apart
        groups.append((starts[whole], lengths[whole], ids[whole], gram[starts[whole]], True))
        if apart.any():  # branching: each edge by itself
            at = np.repeat(starts[apart], lengths[apart]) + np.arange(lengths[apart].sum()) - np.repeat(np.cumsum(lengths[apart]) - lengths[apart], lengths[apart])
            groups.append((at, np.ones(len(at), np.int64), np.repeat(ids[apart], lengths[apart]), W.mix(edge[at] + gram[at]), True))
        for s, n, i, key, sent in groups:
            if sent and len(s):
                flat = np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                packed = _pack(edge[flat], n)
            else:
                packed = _pack(np.zeros(0, np.uint64), np.zeros(len(s), np.int64))
            for lo in range(0, len(s), 20_000):
                hi = lo + 20_000
                yield pa.RecordBatch.from_arrays([pa.array(key[lo:hi].view(np.int64)), pa.array(i[lo:hi]), pa.array(pos[s[lo:hi]].astype(np.int32)), pa.array(n[lo:hi].astype(np.int32)), packed[lo:hi]], names=names)


def _repeats(batches):
    """Runs (id, pos, n) of edges that start earlier; rows come in order of gram, id and pos."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        gram = t["gram"].to_numpy()
        cut = int(np.searchsorted(gram, gram[-1], "left")) if len(gram) else 0  # the last gram may go on
        rest = t.slice(cut)
        if cut:
            yield _marked(t.slice(0, cut))
    if rest is not None:
        yield _marked(rest)


def _marked(t: pa.Table) -> pa.RecordBatch:
    t = t.combine_chunks()
    gram, ids, pos, n = (t[c].to_numpy() for c in ("gram", "id", "pos", "n"))
    size = pc.binary_length(t["edges"]).to_numpy()
    out = [(ids[size == 0], pos[size == 0], n[size == 0])]
    same = np.zeros(len(gram) + 1, bool)
    same[1:-1] = gram[1:] == gram[:-1]
    met = np.flatnonzero((same[1:] | same[:-1]) & (size > 0))  # a gram of one path repeats nothing
    if len(met):
        raw = np.frombuffer(b"".join(t["edges"].take(pa.array(met)).to_pylist()), np.uint8).reshape(-1, EDGE_BYTES)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :EDGE_BYTES] = raw
        edge = wide.view(np.uint64).ravel()
        path = np.repeat(np.arange(len(met)), n[met])
        group = np.cumsum(np.concatenate(([0], gram[met][1:] != gram[met][:-1]))).astype(np.uint64)[path]
        key = (group << np.uint64(8 * EDGE_BYTES)) | edge
        at = pos[met][path] + np.arange(len(path)) - np.repeat(np.cumsum(n[met]) - n[met], n[met])
        again = _later(key, ids[met][path], at)
        turn = np.ones(len(path), bool)
        turn[1:] = (path[1:] != path[:-1]) | (again[1:] != again[:-1])
        s = np.flatnonzero(turn)
        length = np.append(s[1:], len(path)) - s
        keep = again[s]
        out.append((ids[met][path[s[keep]]], at[s[keep]], length[keep]))
    ids, pos, n = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(pos.astype(np.int32)), pa.array(n.astype(np.int32))], names=["id", "pos", "n"])


def repeated_runs(docs: DataFrame, k: int = WINDOW, chunk: int = CHUNK_BYTES, branching: int = BRANCHING) -> DataFrame:
    """Runs (id, pos, n): the windows of k words of document id at word pos, .., pos + n - 1 also start earlier."""
    top = (
        docs.mapInArrow(partial(_branching, k=k, chunk=chunk, least=branching), "gram long, c long")
        .groupBy("gram").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "gram").limit(LISTED).toPandas()
    )
    listed = docs.sparkSession.sparkContext.broadcast(np.sort(top["gram"].to_numpy(np.int64).view(np.uint64)))
    paths = docs.mapInArrow(partial(_paths, k=k, chunk=chunk, listed=listed), "gram long, id long, pos int, n int, edges binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return paths.repartition(parts, "gram").sortWithinPartitions("gram", "id", "pos").mapInArrow(_repeats, "id long, pos int, n int")


def _kept(batches, k: int):
    for batch in batches:
        ids, texts = batch.column("id"), W.column(batch, "text")
        runs, out = batch.column("runs"), []
        for b in W.blocks(texts):
            for i in range(len(b)):
                data = b.data[b.bounds[i] : b.bounds[i + 1]].tobytes()
                words = data.split()
                spans = []
                if (found := runs[b.row + i].as_py()):
                    for s in sorted((r["pos"], r["pos"] + r["n"] + k - 1) for r in found):
                        if spans and s[0] <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], max(spans[-1][1], s[1]))
                        else:
                            spans.append(s)
                stay, at = [], 0
                for s, e in spans:
                    stay += words[at:s]
                    at = e
                stay += words[at:]
                out.append((len(words), len(words) - len(stay), b" ".join(stay).decode(), [{"start": s, "end": e} for s, e in spans]))
        n, gone, text, spans = zip(*out, strict=True) if out else ((), (), (), ())
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.string()), pa.array(spans, span)], names=["id", "n_words", "n_removed", "kept", "spans"])


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WINDOW, chunk: int = CHUNK_BYTES, branching: int = BRANCHING
) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (its words that stay, joined by a space), removed spans."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    runs = repeated_runs(docs, k, chunk, branching).groupBy("id").agg(F.collect_list(F.struct("pos", "n")).alias("runs"))
    return docs.join(runs, "id", "left").select("id", "text", "runs").mapInArrow(
        partial(_kept, k=k), "id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>"
    )


