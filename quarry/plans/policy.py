"""Held-out policies: salted bucket ranges, pinned sources and the hash lists of the groups held out."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..scratch import read_text, small_side, write_once, written

SPLITS, LISTED = ("train", "dev", "test"), ("dev", "test")
HEX64 = r"\A[0-9a-f]{64}\z"
KEYS = {"schema_version", "status", "created_at", "group_identity_version", "split_algorithm", "salt", "bucket_count", "ranges", "sources", "lists", "statistics"}
SOURCE_KEYS, LIST_KEYS = {"source_id", "revision", "episode_count", "group_count"}, {"path", "sha256", "count"}


def exact_keys(given: dict, expected: set[str], name: str) -> None:
    if set(given) != expected:
        raise ValueError(f"{name}: missing {sorted(expected - set(given))}, unknown {sorted(set(given) - expected)}")


def uncovered(ranges: dict[str, list[int]], buckets: int) -> list[str]:
    """Faults of inclusive ranges that should cover 0 .. buckets - 1 once: ends, gaps and overlaps of their sorted order."""
    spans = sorted((lo, hi, name) for name, (lo, hi) in ranges.items())
    faults = [f"{name} is empty" for lo, hi, name in spans if lo > hi]
    ends = [-1, *[hi for _, hi, _ in spans]]
    faults += [f"{'gap' if lo > end + 1 else 'overlap'} before {name}" for (lo, _, name), end in zip(spans, ends, strict=False) if lo != end + 1]
    return faults + ([] if ends[-1] == buckets - 1 else ["the last bucket"])


def list_faults(hashes: DataFrame, policy: dict) -> DataFrame:
    """(split, group_sha256, fault) of listed hashes (split, group_sha256): bad form, repeated, out of their split's range,
    or listed for both splits."""
    h = F.col("group_sha256")
    at = I.bucket(F.when(h.rlike(HEX64), h), policy["bucket_count"])
    inside = F.lit(False)
    for name in LISTED:
        lo, hi = policy["ranges"][name]
        inside = inside | ((F.col("split") == name) & at.between(lo, hi))
    counts = hashes.groupBy("group_sha256").agg(F.collect_set("split").alias("splits"), F.count("*").alias("n"))
    rows = hashes.distinct().join(counts, "group_sha256")
    fault = F.when(~F.coalesce(h.rlike(HEX64), F.lit(False)), "form").when(F.size("splits") > 1, "both_splits").when(F.col("n") > 1, "repeated").when(~inside, "range")
    return rows.select("split", "group_sha256", fault.alias("fault")).where("fault is not null")


@dataclass
class Policy:
    """A frozen policy.  ``lists`` has (split, group_sha256)."""

    manifest: dict
    sha256: str
    lists: DataFrame

    def verify_source(self, source_id: str, revision: str) -> None:
        pinned = {s["source_id"]: s["revision"] for s in self.manifest["sources"]}
        if pinned.get(source_id) != revision:
            raise ValueError(f"the policy does not freeze {source_id} at {revision}")

    def split(self, digest: Column) -> Column:
        """The split of a group digest by its bucket."""
        return I.split_of(I.bucket(digest, self.manifest["bucket_count"]), {k: tuple(v) for k, v in self.manifest["ranges"].items()})

    def with_splits(self, rows: DataFrame, identity: str = "identity") -> DataFrame:
        """Rows with group_sha256, split, and ``split_fault`` where a held-out group is not on its split's list."""
        rows = rows.withColumn("group_sha256", I.group_digest(F.col(identity), self.manifest["salt"])).withColumn("split", self.split(F.col("group_sha256")))
        lists = self.lists.select("group_sha256", F.col("split").alias("listed"))
        both = rows.join(small_side(lists), "group_sha256", "left")
        fault = F.when(F.col("split").isin(*LISTED) & ~F.col("split").eqNullSafe(F.col("listed")), "unlisted_group")
        return both.withColumn("split_fault", fault).drop("listed")


def load(spark: SparkSession, folder: str) -> Policy:
    """The policy of ``folder/manifest.json`` and its lists; raises at the first thing that is not as frozen."""
    text = read_text(spark, f"{folder}/manifest.json")
    m = json.loads(text)
    exact_keys(m, KEYS, "policy")
    if m["schema_version"] != 1 or m["status"] != "frozen" or m["group_identity_version"] != I.GROUP_IDENTITY or m["split_algorithm"] != I.SPLIT_ALGORITHM:
        raise ValueError("not a frozen policy of a known version")
    exact_keys(m["ranges"], set(SPLITS), "ranges")
    if faults := uncovered(m["ranges"], m["bucket_count"]):
        raise ValueError(f"bucket ranges: {', '.join(faults)}")
    for source in m["sources"]:
        exact_keys(source, SOURCE_KEYS, "source")
    if len({s["source_id"] for s in m["sources"]}) != len(m["sources"]):
        raise ValueError("a source is pinned twice")
    exact_keys(m["lists"], set(LISTED), "lists")
    lists = None
    for split, listed in m["lists"].items():
        exact_keys(listed, LIST_KEYS, f"list of {split}")
        if listed["path"].startswith("/") or ".." in re.split(r"[/\\]", listed["path"]):
            raise ValueError("a list lies outside the policy's folder")
        rows = spark.read.text(f"{folder}/{listed['path']}").select(F.lit(split).alias("split"), F.col("value").alias("group_sha256"))
        if list(list_digest(rows)) != [listed["count"], listed["sha256"]]:
            raise ValueError(f"the list of {split} has changed")
        lists = rows if lists is None else lists.unionByName(rows)
    if bad := list_faults(lists, m).limit(1).collect():
        raise ValueError(f"list of {bad[0]['split']}: {bad[0]['fault']}")
    return Policy(m, hashlib.sha256(text.encode()).hexdigest(), lists)


def list_digest(rows: DataFrame) -> tuple[int, str]:
    """(count, sha256 over sorted partial digests) of listed hashes: lists are bounded by groups, partial sums by 256 prefixes."""
    parts = rows.groupBy(F.substring("group_sha256", 1, 2).alias("p")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("group_sha256")), "\n"), 256).alias("h"))
    found = sorted(parts.collect())
    return sum(r["n"] for r in found), hashlib.sha256("\n".join(r["h"] for r in found).encode()).hexdigest()


def freeze(rows: DataFrame, folder: str, salt: str, ranges: dict[str, list[int]], buckets: int, revisions: dict[str, str], created_at: str) -> dict:
    """Write the policy of rows (source_id, identity) into a new folder: sorted lists of the held-out groups, then the manifest.

    A row without an identity stops the freeze."""
    spark = rows.sparkSession
    invalid = rows.where("identity is null").groupBy("source_id").count().collect()  # one row for each source
    if invalid:
        raise ValueError(f"rows without identity: { {r['source_id']: r['count'] for r in invalid} }")
    digest = I.group_digest(F.col("identity"), salt)
    groups = rows.groupBy("source_id", digest.alias("group_sha256")).agg(F.count("*").alias("n"))
    groups = written(groups.withColumn("split", I.split_of(I.bucket(F.col("group_sha256"), buckets), {k: tuple(v) for k, v in ranges.items()})), "policy-groups")
    lists = {}
    for split in LISTED:
        listed = groups.where(F.col("split") == split).select("group_sha256").distinct()
        listed.orderBy("group_sha256").write.text(f"{folder}/{split}.sha256")
        count, sha = list_digest(spark.read.text(f"{folder}/{split}.sha256").withColumnRenamed("value", "group_sha256"))
        lists[split] = {"path": f"{split}.sha256", "count": count, "sha256": sha}
    per = groups.groupBy("source_id").agg(F.sum("n").alias("episodes"), F.count("*").alias("groups")).orderBy("source_id").collect()
    sources = [{"source_id": r["source_id"], "revision": revisions[r["source_id"]], "episode_count": r["episodes"], "group_count": r["groups"]} for r in per]
    shared = groups.groupBy("group_sha256", "split").agg(F.count("*").alias("s"), F.sum("n").alias("n"))
    totals = {r["split"]: {"episodes": r["e"], "groups": r["g"], "cross_source_groups": r["x"]} for r in shared.groupBy("split").agg(F.sum("n").alias("e"), F.count("*").alias("g"), F.count(F.when(F.col("s") > 1, 1)).alias("x")).collect()}
    manifest = {
        "schema_version": 1, "status": "frozen", "created_at": created_at, "group_identity_version": I.GROUP_IDENTITY, "split_algorithm": I.SPLIT_ALGORITHM, "salt": salt,
        "bucket_count": buckets, "ranges": ranges, "sources": sources, "lists": lists, "statistics": totals,
    }
    write_once(spark, f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest
