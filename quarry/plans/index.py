"""The contamination index as versions of a folder of tables, bound to the held-out policy it was made under.

A version is a manifest, written once, that names the segments it consists of: a first ``build``, and one for each ``append``.  A segment
holds what is new in its batch: digests with their shingles (the first 64 bits of each), (digest, group, split) rows, bands of (digest, split) pairs, and
traces.  So a batch makes signatures of its new texts only, and a reader that opened a version keeps it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contamination as C
from ..scratch import read_text, small_side, write_once, written

VERSION = 3
TABLES = ("tasks", "bands", "task_groups", "traces")
KEYS = {"tasks": ["digest"], "bands": ["digest", "split", "band"], "task_groups": ["digest", "group_sha256", "split"], "traces": ["digest", "split"]}


def _manifest(folder: str, version: int) -> str:
    return f"{folder}/manifest-{version:06d}.json"


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The complete versions of an index, the latest last."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
    return sorted(int(n[9:15]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def _segment(tasks: DataFrame, traces: DataFrame, folder: str, held: dict[str, DataFrame] | None) -> str:
    """Write what the batch adds to the tables ``held``; the segment's name."""
    spark, name = tasks.sparkSession, f"segment-{uuid.uuid4().hex}"
    new = lambda df, table: df.join(held[table].select(*KEYS[table]), KEYS[table], "left_anti") if held else df
    rows = written(tasks.select("folded", "group_sha256", "split").distinct().withColumn("digest", F.sha2("folded", 256)), "index-batch")
    groups = rows.select(*KEYS["task_groups"]).distinct()
    # a text that stands in a split for the first time is signed for it, also where the index knows it from another
    pairs = groups.select("digest", "split").distinct()
    if held:
        pairs = pairs.join(held["bands"].where("band = 0").select("digest", "split"), ["digest", "split"], "left_anti")
    pairs = written(pairs, "index-pairs")
    fresh = written(C.fingerprints(rows.join(pairs.select("digest").distinct(), "digest", "left_semi")), "index-signed")
    new(fresh.select("digest", "shingles"), "tasks").write.parquet(f"{folder}/{name}/tasks")
    bands = fresh.select("digest", "n", F.posexplode_outer("bands").alias("band", "value")).join(pairs, "digest")
    bands.select("band", "value", "digest", "split", "n").repartition("band", "value").write.parquet(f"{folder}/{name}/bands")
    new(groups, "task_groups").write.parquet(f"{folder}/{name}/task_groups")
    new(traces.select("digest", "split").distinct(), "traces").write.parquet(f"{folder}/{name}/traces")
    return name


def _publish(spark: SparkSession, folder: str, version: int, segments: list[str], policy_sha256: str, sources: list[dict]) -> dict:
    counts = {t: spark.read.parquet(*[f"{folder}/{s}/{t}" for s in segments]).count() for t in TABLES}
    manifest = {"version": VERSION, "index": version, "status": "complete", "heldout_sha256": policy_sha256, "sources": sources, "segments": segments, "counts": counts}
    write_once(spark, _manifest(folder, version), json.dumps(manifest, sort_keys=True))
    return manifest


def check_rows(rows: DataFrame, sources: list[dict], source: str = "source") -> None:
    """Raises where the rows of a source are not as many as its entry in ``sources`` (source, rows) froze."""
    found = {r[source]: r["count"] for r in rows.groupBy(source).count().collect()}  # one row for each source
    frozen = {s["source"]: s["rows"] for s in sources}
    if wrong := {k: (found.get(k, 0), frozen.get(k, 0)) for k in found.keys() | frozen.keys() if found.get(k, 0) != frozen.get(k, 0)}:
        raise ValueError(f"rows found and rows frozen differ: {wrong}")


def build(tasks: DataFrame, traces: DataFrame, folder: str, policy_sha256: str, sources: list[dict]) -> dict:
    """Write the index of tasks (folded, group_sha256, split) and traces (digest, split) into a new folder.

    The manifest comes last and names policy and sources; a folder without one is no index."""
    spark = tasks.sparkSession
    if versions(spark, folder):
        raise FileExistsError(folder)
    return _publish(spark, folder, 1, [_segment(tasks, traces, folder, None)], policy_sha256, sources)


def append(tasks: DataFrame, traces: DataFrame, folder: str, policy_sha256: str, sources: list[dict]) -> dict:
    """The next version: the latest one and a segment of what the batch adds.  Of two at once one fails, at its manifest."""
    held = Index(tasks.sparkSession, folder, policy_sha256)
    segment = _segment(tasks, traces, folder, {t: held.table(t) for t in TABLES})
    return _publish(tasks.sparkSession, folder, held.manifest["index"] + 1, [*held.manifest["segments"], segment], policy_sha256, [*held.manifest["sources"], *sources])


class Index:
    """A version of an index, the latest unless named, opened for reading; raises where it is incomplete or belongs to another policy."""

    def __init__(self, spark: SparkSession, folder: str, policy_sha256: str, version: int | None = None):
        self.spark, self.folder = spark, folder
        there = versions(spark, folder)
        if not there or version is not None and version not in there:
            raise FileNotFoundError(f"{folder} has no such index")
        self.manifest = json.loads(read_text(spark, _manifest(folder, version or there[-1])))
        if self.manifest["version"] != VERSION or self.manifest["status"] != "complete":
            raise ValueError("the contamination index is not complete")
        if self.manifest["heldout_sha256"] != policy_sha256:
            raise ValueError("the contamination index belongs to another held-out policy")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.folder}/{s}/{name}" for s in self.manifest["segments"]])

    def findings(self, candidates: DataFrame) -> DataFrame:
        """(candidate, finding) of candidates (candidate, folded, trace, split) against all indexed tasks and traces.

        Near texts: a text of a bucket first meets one text of each other split there, and only those without a finding
        the rest; texts whose numbers of shingles alone rule the similarity out never meet."""
        mine = written(candidates.withColumn("digest", F.sha2("folded", 256)), "index-candidates")
        other = F.col("split") != F.col("t")
        groups = self.table("task_groups").select("digest", F.col("split").alias("t")).distinct()
        exact = mine.join(groups, "digest").where(other).select("candidate", F.lit("cross_split_exact_task").alias("finding"))
        trace = mine.join(self.table("traces").select(F.col("digest").alias("trace"), F.col("split").alias("t")), "trace").where(other)
        trace = trace.select("candidate", F.lit("cross_split_exact_trace").alias("finding"))
        sets = written(C.fingerprints(mine), "index-own")
        own = sets.select(F.col("digest").alias("a"), F.col("n").alias("n_a"), F.posexplode_outer("bands").alias("band", "value")).join(mine.select(F.col("digest").alias("a"), "split").distinct(), "a")
        own = written(own, "index-own-bands")
        theirs = self.table("bands").select("band", "value", F.col("digest").alias("b"), F.col("split").alias("t"), F.col("n").alias("n_b"))
        theirs = written(theirs.join(own.select("band", "value").distinct(), ["band", "value"], "left_semi"), "index-met")
        both = self.table("tasks").unionByName(sets.select("digest", "shingles"))

        def near(left: DataFrame, right: DataFrame) -> DataFrame:
            pairs = written(left.join(right, ["band", "value"]).where(other & (F.col("a") != F.col("b")) & C.sizes_fit("n_a", "n_b")).select("a", "split", "b").distinct(), "index-pairs-met")
            # only the sets of these pairs are read on
            met = C.similar(pairs.select("a", "b").distinct(), written(C.among(pairs, both).dropDuplicates(["digest"]), "index-sets")).select("a", "b")
            return pairs.join(met, ["a", "b"]).select("a", "split").distinct()

        first = theirs.groupBy("band", "value", "t").agg(F.min(F.struct("b", "n_b")).alias("x")).select("band", "value", "t", "x.*")
        found = written(near(own, first), "index-near")
        more = near(own.join(found, ["a", "split"], "left_anti"), theirs)
        met = mine.join(found.unionByName(more).withColumnRenamed("a", "digest").distinct(), ["digest", "split"]).select("candidate", F.lit("cross_split_near_task").alias("finding"))
        return exact.unionByName(trace).unionByName(met).distinct()

    def __contains__(self, digest: str) -> bool:
        return not self.table("tasks").where(F.col("digest") == digest).isEmpty()


def without_findings(candidates: DataFrame, findings: DataFrame) -> DataFrame:
    """Candidates without any of the written findings."""
    return candidates.join(small_side(findings.select("candidate").distinct()), "candidate", "left_anti")
