"""Content-addressed records: canonical JSON under its sha256, written once.

A store is a folder ``records`` by the first two digits of the digest, and beside it Bloom filters: of each of the 256 prefixes
BLOCKS bitmaps of 32,768 bits, of which a digest takes one and sets PROBES bits.  A batch reads the filters of its prefixes, and of the records
only the digests of those prefixes in which a filter holds one of its own; new records cost a reader nothing but filters.
Filters are written before records, so what a batch that failed leaves behind can only make a later one look."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_json_exact
from ..scratch import small_side, written

SCHEMA = "digest string, payload binary, prefix2 string"
FILTERS = "prefix2 string, block int, bits binary"
#: About ten bits a digest up to 50 million digests; beyond, more of the records are looked at, with the same result.
BLOCKS, PROBES, BITS = 64, 4, 32768
#: Generations of filters that are merged into one.
GENERATIONS = 32


def addressed(rows: DataFrame, value: str = "value") -> DataFrame:
    """Rows with ``payload`` (canonical JSON bytes), ``digest`` and ``ref`` (sha256:<digest>)."""
    rows = rows.withColumn("payload", canonical_json_exact(F.col(value)).cast("binary"))
    return rows.withColumn("digest", F.sha2("payload", 256)).withColumn("ref", F.concat(F.lit("sha256:"), F.col("digest")))


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(folder)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, f"{folder}/records", SCHEMA)


def _digits(digest: Column, first: int) -> Column:
    """Four hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(digest, first, 4), 16, 10).cast("int")


def _block(digest: Column) -> Column:
    return _digits(digest, 3) % BLOCKS


def _places(digest: Column) -> Column:
    return F.array(*[_digits(digest, 7 + 4 * i) % BITS for i in range(PROBES)])


def _holds(bits: Column, places: Column) -> Column:
    byte = lambda p: F.conv(F.hex(F.substring(bits, F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.forall(places, lambda p: byte(p).bitwiseAND(F.pow(F.lit(2), p % 8).cast("int")) > 0)


def _generations(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/filters")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().toString() for s in store.listStatus(path)] if store.exists(path) else []


def _merge(spark: SparkSession, folder: str, generations: list[str]) -> None:
    """One generation in place of several; where it stops midway bits stand twice, which changes nothing."""
    merged = spark.read.schema(FILTERS).parquet(*generations).groupBy("prefix2", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    merged.repartitionByRange(16, "prefix2").sortWithinPartitions("prefix2", "block").write.parquet(f"{folder}/filters/{uuid.uuid4().hex}")
    for g in generations:
        path = spark._jvm.org.apache.hadoop.fs.Path(g)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def known(new: DataFrame, folder: str) -> DataFrame:
    """(digest): those of a written table of digests (digest, prefix2) that the store holds."""
    spark = new.sparkSession
    generations = _generations(spark, folder)
    if not generations:
        return new.select("digest").where("false")
    mine = [r[0] for r in new.select("prefix2").distinct().collect()]  # 256 at most
    filters = spark.read.schema(FILTERS).parquet(*generations).where(F.col("prefix2").isin(mine)).groupBy("prefix2", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
    asked = new.select("digest", "prefix2", _block(F.col("digest")).alias("block"))
    maybe = written(asked.join(filters, ["prefix2", "block"]).where(_holds(F.col("bits"), _places(F.col("digest")))).select("digest", "prefix2"), "blobs-maybe")
    held = [r[0] for r in maybe.select("prefix2").distinct().collect()]
    return read(spark, folder).where(F.col("prefix2").isin(held)).join(small_side(maybe), ["prefix2", "digest"], "left_semi").select("digest")


def put(rows: DataFrame, folder: str) -> None:
    """Append payloads whose digest the folder does not hold; by a two-digit prefix."""
    spark = rows.sparkSession
    new = written(rows.select("digest", "payload", F.substring("digest", 1, 2).alias("prefix2")).dropDuplicates(["digest"]), "blobs-batch")
    fresh = written(new.join(written(known(new.select("digest", "prefix2"), folder), "blobs-known"), "digest", "left_anti"), "blobs-fresh")
    if fresh.isEmpty():
        return
    bits = fresh.select("prefix2", _block(F.col("digest")).alias("block"), F.explode(_places(F.col("digest"))).alias("p"))
    bits = bits.groupBy("prefix2", "block").agg(F.bitmap_construct_agg("p").alias("bits"))
    bits.sort("prefix2", "block").write.parquet(f"{folder}/filters/{uuid.uuid4().hex}")
    fresh.repartition("prefix2").write.mode("append").partitionBy("prefix2").parquet(f"{folder}/records")
    if len(generations := _generations(spark, folder)) > GENERATIONS:
        _merge(spark, folder, generations)


def get(refs: DataFrame, folder: str, ref: str = "ref") -> DataFrame:
    """Rows of refs with their ``record`` (JSON text) and ``intact``: found, and its bytes still have the digest."""
    stored = read(refs.sparkSession, folder).select("digest", "payload")
    wanted = refs.withColumn("digest", F.regexp_extract(ref, "^sha256:([0-9a-f]{64})$", 1))
    both = wanted.join(stored, "digest", "left")
    return both.withColumn("intact", F.coalesce(F.sha2("payload", 256) == F.col("digest"), F.lit(False))).withColumn("record", F.col("payload").cast("string")).drop("payload")
