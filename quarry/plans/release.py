"""Releases: build the tables beside their final place, verify them from the files, then publish by a rename."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..scratch import written
from ..sources import blobs
from . import canonical

SPLITS = ("train", "dev", "test")
HASHED = {"episodes": schemas.EPISODES, "decisions": schemas.DECISIONS, "snapshots": schemas.SNAPSHOTS, "forks": schemas.FORKS}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def content_digest(df: DataFrame) -> tuple[int, str]:
    """(rows, digest) that do not depend on the order of rows or files."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)"))
    r = df.agg(F.count("*").alias("n"), *[part(i).alias(f"p{i}") for i in range(4)]).first()
    return r["n"], "-".join(str(r[f"p{i}"] or 0) for i in range(4))


def build(episodes: DataFrame, splits: DataFrame, folder: str, chosen: DataFrame | None = None, provenance: dict | None = None) -> dict:
    """Write the release of normalized episodes (splits: source_record_id, split) to folder; it must not exist.

    ``chosen`` (episode_id, message_index) are the decisions to hold, all of them by default; provenance goes into the manifest.  Episodes that
    an adapter makes should be written first: the join reads their ids, and so do splits made from them, each by running the adapter again."""
    spark = episodes.sparkSession
    temporary = f"{folder.rstrip('/')}.building"
    for path in (folder, temporary):
        fs, p = _fs(spark, path)
        if fs.exists(p):
            raise FileExistsError(path)
    df = written(canonical.with_ids(episodes.join(splits, "source_record_id")), "release-episodes")
    blobs.put(df, f"{temporary}/traces")
    tables = {"episodes": canonical.episode_table(df), "decisions": canonical.decision_table(df, chosen)}
    for name, schema in HASHED.items():
        table = tables[name] if name in tables else spark.createDataFrame([], schema)
        table.write.option("compression", "zstd").parquet(f"{temporary}/{name}")
    df.select("episode_id", "split").write.partitionBy("split").parquet(f"{temporary}/splits")
    owned = spark.read.parquet(f"{temporary}/splits")
    for name in SPLITS:  # sorted lists, one id a line
        owned.where(F.col("split") == name).select("episode_id").orderBy("episode_id").write.text(f"{temporary}/lists/{name}")
    manifest = {
        "schema_version": schemas.VERSION, "tables": {n: content_digest(spark.read.schema(s).parquet(f"{temporary}/{n}")) for n, s in HASHED.items()},
        "splits": {r["split"]: r["count"] for r in owned.groupBy("split").count().collect()}, "provenance": provenance or {},
    }
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{temporary}/manifest")
    faults = verify(spark, temporary)
    if faults:
        raise ValueError(f"release does not verify: {faults}")
    fs, p = _fs(spark, temporary)
    if not fs.rename(p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)):
        raise OSError(f"cannot publish {folder}")
    return manifest


def verify(spark: SparkSession, folder: str) -> list[str]:
    """Names of the checks that a release's files fail."""
    manifest = json.loads(spark.read.text(f"{folder}/manifest").first()["value"])
    t = {n: spark.read.schema(s).parquet(f"{folder}/{n}") for n, s in HASHED.items()}
    splits = spark.read.parquet(f"{folder}/splits")
    some = lambda df: bool(df.limit(1).count())
    twice = lambda df, c: some(df.groupBy(c).count().where("count > 1"))
    checks = {f"content of {n}": list(content_digest(df)) != list(manifest["tables"][n]) for n, df in t.items()}
    counts = {r["split"]: r["count"] for r in splits.groupBy("split").count().collect()}
    checks |= {
        "split counts": counts != manifest["splits"],
        "schema": any(schemas.shape(spark.read.parquet(f"{folder}/{n}").schema) != schemas.shape(s) for n, s in HASHED.items()),
        "unique episodes": twice(t["episodes"], "episode_id"),
        "unique decisions": twice(t["decisions"], "decision_id"),
        "decisions of episodes": some(t["decisions"].join(t["episodes"], "episode_id", "left_anti")),
        "one split each": twice(splits, "episode_id") or some(splits.where(~F.col("split").isin(*SPLITS))),
        "splits cover": some(t["episodes"].join(splits, "episode_id", "left_anti")) or some(splits.join(t["episodes"], "episode_id", "left_anti")),
        "groups in one split": some(t["episodes"].join(splits, "episode_id").groupBy("split_group").agg(F.countDistinct("split").alias("n")).where("n > 1")),
        "traces intact": some(blobs.get(t["episodes"].select("raw_trace_ref").distinct(), f"{folder}/traces", "raw_trace_ref").where("not intact")),
    }
    return [name for name, failed in checks.items() if failed]
