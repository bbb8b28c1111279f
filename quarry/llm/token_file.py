"""Operator 2: token ids in a binary file format with canonical Huffman coding.

A first pass encodes every text once, writes the plain ids of each document to a scratch table and counts them; the
length-limited canonical code of the counts makes one small table.  A second pass range partitions the scratch table by id
and writes each partition's ids as blocks of whole documents, each a row of a Parquet folder: document ids, lengths,
the packed bits, and a bit offset for each 256 ids.  The scratch table goes when the file is there.  Blocks decode
independently, from all their checkpoints at once, by one look-up table.  Parquet is only the container: it lets any
store hold the file and Spark's writer commit it, so tasks that run again leave no second copy.

``folder/code``: one row, the bits of each id.  ``folder/blocks``: part, block, tokens before it in its part,
ids and lengths of its documents, marks, bits; in order of (part, block) documents ascend.

Rows without an id are left out; a null or empty text has the end id only; equal ids keep their rows, in order of their
token bytes; an empty table makes a file without blocks; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import huffman
from . import wordhash as W
from .bpe import encoder
from .common import cut, discard, shared_dir, text_batches

END_ID = 0
BLOCK_IDS = 1 << 19
ENCODED = "id long, width int, tokens binary, counted array<long>, counts array<long>"
BLOCKS = "part int, block int, before long, ids array<long>, lengths array<int>, marks binary, bits binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encoded(batches, path: str):
    """Rows (id, width, tokens) of each document, tokens as little-endian numbers of width bytes; then the task's counts."""
    total = np.zeros(1, np.int64)

    def batch_of(names, width, tokens, values, counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array(width, pa.int32()), tokens, pa.array(values, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))],
            names=["id", "width", "tokens", "counted", "counts"],
        )

    for batch in W.slices(batches):
        names = W.column_long(batch, "id")
        for first, ids, lengths in encoder(path).encode(W.column(batch, "text")):
            more = np.bincount(ids, minlength=len(total))
            more[: len(total)] += total
            total, n = more, len(lengths)
            total[END_ID] += n
            ids, lengths = np.insert(ids, np.cumsum(lengths), END_ID), lengths + 1
            width = 2 if int(ids.max(initial=0)) < 1 << 16 else 4
            at = np.concatenate(([0], np.cumsum(lengths * width))).astype(np.int32)
            tokens = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(ids.astype(f"<u{width}"))])
            yield batch_of(names[first : first + n], [width] * n, tokens, [None] * n, [None] * n)
    seen = np.flatnonzero(total)
    yield batch_of([None], [0], pa.array([None], pa.binary()), [seen], [total[seen]])


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """The scratch table of documents (id, text): each one's tokens with the end id, and a row of counts from each task."""
    return cut(docs.mapInArrow(partial(_encoded, path=path), ENCODED), "tokens-plain")


def token_counts(encoded: DataFrame) -> DataFrame:
    """(token, c) over all documents, with one end id for each."""
    each = encoded.where("counted is not null").select(F.explode(F.arrays_zip("counted", "counts")).alias("x"))
    return each.groupBy(F.col("x.counted").alias("token")).agg(F.sum("x.counts").alias("c"))


def _blocks(batches, bits):
    encoder.cache_clear()  # a worker that encoded before would keep its pieces
    W.release()
    code, part, block, before = huffman.Code(bits.value), TaskContext.get().partitionId(), 0, 0
    kept_ids, kept_lengths, kept, size = [], [], [], 0

    def row():
        data, marks = code.encode(np.concatenate(kept))
        return pa.RecordBatch.from_pylist(
            [{"part": part, "block": block, "before": before, "ids": kept_ids, "lengths": kept_lengths, "marks": marks, "bits": data}],
            schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("marks", pa.binary()), ("bits", pa.binary())]),
        )

    for batch in W.slices(batches):
        names, width, tokens = W.column_long(batch, "id"), W.column_long(batch, "width"), batch.column("tokens")
        for name, w, x in zip(names, width, tokens, strict=True):
            ids = np.frombuffer(x.as_buffer(), f"<u{w}").astype(np.uint32)
            kept_ids.append(name)
            kept_lengths.append(len(ids))
            kept.append(ids)
            size += len(ids)
            if size >= BLOCK_IDS:
                yield row()
                block, before = block + 1, before + size
                kept_ids, kept_lengths, kept, size = [], [], [], 0
    if kept:
        yield row()


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> str:
    """Write the token file of all documents into ``folder`` and return it."""
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    docs = text_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    encoded = encode_documents(docs, path)
    found = token_counts(encoded).toPandas()  # as many rows as the vocabulary, at most
    counts = np.zeros(int(found["token"].max()) + 1 if len(found) else 0, np.int64)
    counts[found["token"].to_numpy(np.int64)] = found["c"].to_numpy(np.int64)
    bits = huffman.code_lengths(counts)
    spark.createDataFrame([(bytearray(bits.tobytes()),)], "bits binary").coalesce(1).write.parquet(f"{folder}/code")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = encoded.where("id is not null").select("id", "width", "tokens").repartitionByRange(parts, "id").sortWithinPartitions("id", "tokens")
    sent = spark.sparkContext.broadcast(bits)
    ordered.mapInArrow(partial(_blocks, bits=sent), BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    discard(encoded)
    return folder


def _documents(batches, bits):
    code = huffman.Code(bits.value)
    for batch in batches:
        for b in batch.to_pylist():
            lengths = np.array(b["lengths"], np.int64)
            at = np.concatenate(([0], np.cumsum(lengths)))
            ids = code.decode(b["bits"], b["marks"], int(at[-1])).astype("<u4")
            list_at = pa.array(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(b["ids"], pa.int64()), pa.array(b["start"] + at[:-1]), pa.array(lengths), pa.ListArray.from_arrays(list_at, pa.array(ids.astype(np.int32)))],
                names=["id", "start", "n_tokens", "token_ids"],
            )


def _digests(batches, bits):
    for batch in _documents(batches, bits):
        tokens = batch.column("token_ids")
        flat, at = tokens.values.to_numpy().astype("<u4"), tokens.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, folder: str, digests: bool = False) -> DataFrame:
    """Per document, decoded from the file: id, start (ids of all documents before), n_tokens, and token_ids (or, with
    ``digests``, ids_crc32: of the ids as little-endian unsigned 32-bit integers)."""
    bits = np.frombuffer(bytes(spark.read.parquet(f"{folder}/code").first()["bits"]), np.uint8)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    sizes = blocks.select("part", F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    starts, total = [], 0
    for part, n in sorted(sizes.collect()):  # one row for each partition written
        starts.append((part, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(starts, "part int, part_start long"))
    rows = blocks.join(offsets, "part").withColumn("start", F.col("before") + F.col("part_start")).drop("part", "block", "before", "part_start")
    sent = spark.sparkContext.broadcast(bits)
    if digests:
        return rows.mapInArrow(partial(_digests, bits=sent), "id long, start long, n_tokens long, ids_crc32 long")
    return rows.mapInArrow(partial(_documents, bits=sent), "id long, start long, n_tokens long, token_ids array<int>")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quarry/tokens-{uuid.uuid4().hex}"
