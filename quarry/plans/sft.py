"""Inputs of supervised fine-tuning: every admitted decision becomes a token record or a line of the exclusion ledger.

A build is verified against its release from the files alone; only a verified build can be loaded.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import metrics as M
from ..operators import reconcile as R
from ..scratch import LONG_ROWS, read_text, write_once, written
from . import canonical, release, windows

LEDGER = ["decision_id", "episode_id", "reason", "split"]
INDEXED = ["episode_id", "split", "source_success", "teacher", "message_index", "group_sha256"]


def source_index(spark: SparkSession, folder: str) -> DataFrame:
    """(decision_id, episode_id, split, source_success, teacher, message_index, group_sha256) of a release's decisions."""
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{folder}/{name}")
    owners = spark.read.parquet(f"{folder}/splits")
    episodes = read("episodes", schemas.EPISODES).join(owners, "episode_id")
    at = F.regexp_extract("prefix_messages_ref", r"=0:(\d+)$", 1).cast("int")
    decisions = read("decisions", schemas.DECISIONS).select("decision_id", "episode_id", at.alias("message_index"))
    return decisions.join(episodes, "episode_id").select(
        "decision_id", "episode_id", "split", F.coalesce("success", F.lit(False)).alias("source_success"), F.col("teacher_model").alias("teacher"), "message_index", F.sha2("split_group", 256).alias("group_sha256")
    )


def distributions(spark: SparkSession, folder: str) -> dict:
    """Counts of input and learning tokens per split."""
    records = spark.read.parquet(f"{folder}/records")
    rows = records.select("split", (F.size("token_ids") - 1).alias("input"), F.size(F.filter("token_loss_weights", lambda w: w > 0)).alias("loss"))
    out: dict = {}
    for name in ("input", "loss"):
        for r in M.length_distribution(rows, ["split"], name).collect():
            out.setdefault(r["split"], {})[name] = {k: r[k] for k in ("n", "total", "longest", "p50", "p95")}
    return out


def build(spark: SparkSession, release_folder: str, folder: str, vocabulary: list[str], max_tokens: int) -> dict:
    """Write the inputs of a verified release into a new folder; raises where a decision is lost or counted twice."""
    if faults := release.verify(spark, release_folder):
        raise ValueError(f"the release does not verify: {faults}")
    index = written(source_index(spark, release_folder), "sft-index")
    episodes = spark.read.schema(schemas.EPISODES).parquet(f"{release_folder}/episodes").join(spark.read.parquet(f"{release_folder}/splits"), "episode_id")
    restored = written(canonical.restore(episodes, f"{release_folder}/traces"), "sft-episodes")
    if not restored.where("not restored").isEmpty():
        raise ValueError("an episode's trace is not what its release says")
    records = windows.token_records(restored.withColumn("tools", F.col("tools_schema")), vocabulary, max_tokens, index)
    records = written(records, "sft-records", **LONG_ROWS)
    names = [f.name for f in schemas.TOKENS.fields]
    records.where("excluded is null").select(*names).write.options(compression="zstd", **LONG_ROWS).partitionBy("split").parquet(f"{folder}/records")
    ledger = records.where("excluded is not null").select(F.to_json(F.struct("decision_id", "episode_id", F.col("excluded").alias("reason"), "split")).alias("value"))
    ledger.write.text(f"{folder}/excluded")
    counts = {k: {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()} for k, rows in (("accepted", records.where("excluded is null")), ("excluded", records.where("excluded is not null")))}
    total = sum(n for c in counts.values() for n in c.values())
    if total != index.count() or not R.repeated(records, "decision_id").isEmpty():
        raise ValueError("the inputs do not cover the release's decisions once each")
    manifest = {
        "version": 1, "status": "built", "max_tokens": max_tokens, **counts, "release": json.loads(read_text(spark, f"{release_folder}/manifest")), "tokens": distributions(spark, folder),
        "content": release.content_digest(spark.read.parquet(f"{folder}/records").select(*names)),
    }
    write_once(spark, f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} string" for c in LEDGER)).json(f"{folder}/excluded")


def faults(spark: SparkSession, release_folder: str, folder: str) -> DataFrame:
    """(decision_id, fault) of a build's rows against its release: rules of records, members that differ, decisions that are
    missing, unknown or repeated, wrong reasons, and owners in two splits."""
    manifest = json.loads(read_text(spark, f"{folder}/manifest.json"))
    records, excluded, index = spark.read.parquet(f"{folder}/records"), ledger(spark, folder), source_index(spark, release_folder)
    records = records.select(*[f.name for f in schemas.TOKENS.fields])
    rules = windows.record_violations(records, manifest["max_tokens"]).where("size(violations) > 0").select("sample_id", F.explode("violations").alias("fault"))
    out = records.select("decision_id", "sample_id").join(rules, "sample_id").select("decision_id", "fault")
    named = lambda df, fault: df.select("decision_id", F.lit(fault).alias("fault"))
    met = R.differences(records.select("decision_id", *INDEXED), index.join(records.select("decision_id"), "decision_id", "left_semi"), ["decision_id"], INDEXED)
    out = out.unionByName(met.select("decision_id", F.when(F.col("fault") == "left_only", "unknown_decision").otherwise(F.concat(F.lit("differs: "), F.array_join("columns", ","))).alias("fault")))
    both = excluded.join(index.select("decision_id", F.col("episode_id").alias("e"), F.col("split").alias("s"), "source_success"), "decision_id", "left")
    reason = F.when(F.col("source_success"), f"protected_context_overflow_{manifest['max_tokens']}").otherwise("source_failure_requires_verified_recovery")
    out = out.unionByName(named(both.where("e is null"), "unknown_decision")).unionByName(named(both.where((F.col("e") != F.col("episode_id")) | (F.col("s") != F.col("split"))), "ledger_differs"))
    out = out.unionByName(named(both.where(F.col("e").isNotNull() & (F.col("reason") != reason)), "wrong_reason"))
    every = records.select("decision_id").unionByName(excluded.select("decision_id"))
    out = out.unionByName(named(R.repeated(every, "decision_id"), "repeated_decision")).unionByName(named(index.join(every, "decision_id", "left_anti"), "missing_decision"))
    for owner in ("episode_id", "group_sha256"):
        two = R.owners_in_two(records, owner, "split")
        out = out.unionByName(named(records.join(two, owner, "left_semi"), f"{owner}_in_two_splits"))
    return out


def verify(spark: SparkSession, release_folder: str, folder: str) -> dict:
    """Reconcile a build with its release and record the outcome beside it; raises at the first fault."""
    manifest_text = read_text(spark, f"{folder}/manifest.json")
    manifest = json.loads(manifest_text)
    found = faults(spark, release_folder, folder).limit(5).collect()
    names = [f.name for f in schemas.TOKENS.fields]
    if not found and list(manifest["content"]) != list(release.content_digest(spark.read.parquet(f"{folder}/records").select(*names))):
        found = ["content differs from the manifest"]
    if not found and manifest["tokens"] != distributions(spark, folder):
        found = ["token counts differ from the manifest"]
    if found:
        raise ValueError(f"the inputs do not reconcile: {found}")
    proof = {"status": "verified", "content": manifest["content"], "release": manifest["release"]["tables"]}
    write_once(spark, f"{folder}/verification.json", json.dumps(proof, sort_keys=True))
    return proof


def load_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The records of one split of a verified build whose manifest is still the verified one."""
    if split not in release.SPLITS:
        raise ValueError(f"no split {split!r}")
    proof, manifest = (json.loads(read_text(spark, f"{folder}/{name}.json")) for name in ("verification", "manifest"))
    if proof["status"] != "verified" or proof["content"] != manifest["content"]:
        raise ValueError("the inputs are not verified")
    return spark.read.parquet(f"{folder}/records").where(F.col("split") == split)
