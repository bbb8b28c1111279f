"""Admission of a source's episodes: ordered scan, findings, greedy quotas, ledgers and reports, and its later verification.

Findings are made for all scanned candidates at once; only the choice among clean ones follows the order.
"""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions import text as X
from ..operators import audit as A
from ..operators import reconcile as R
from ..operators import selection as S
from ..scratch import numbered, read_text, small_side, write_once, written
from . import release, windows
from .index import Index
from .policy import Policy, exact_keys

VERSION = 1
KEYS = {"version", "release_id", "source_id", "seed", "quotas", "teachers", "decisions_per_episode", "maximum_scan", "max_tokens"}
UNREADABLE, OUTCOME_UNKNOWN, TOO_FEW, OVERFLOW = "normalization_or_schema_error", "unknown_outcome", "insufficient_decisions", "protected_context_overflow"


def check_config(config: dict) -> dict:
    """The configuration, if it has exactly the known keys and sound values; raises otherwise."""
    exact_keys(config, KEYS, "admission")
    if config["version"] != VERSION:
        raise ValueError("unknown version of the admission")
    if not re.fullmatch(r"[A-Za-z0-9_-]+", config["release_id"]):
        raise ValueError("the release id is no plain name")
    exact_keys(config["quotas"], set(release.SPLITS), "quotas")
    whole = lambda x, least: isinstance(x, int) and not isinstance(x, bool) and x >= least
    if not whole(config["seed"], 0) or not all(whole(x, 1) for x in (*config["quotas"].values(), config["decisions_per_episode"], config["maximum_scan"], config["max_tokens"])):
        raise ValueError("seed and counts must be whole numbers, counts positive")
    teachers = config["teachers"]
    if not teachers or len(set(teachers)) != len(teachers) or any(n % len(teachers) for n in config["quotas"].values()):
        raise ValueError("quotas must divide among different teachers")
    return config


def code_digest(root: str | None = None) -> str:
    """sha256 over the package's source files, by their paths."""
    base = Path(root) if root else Path(__file__).resolve().parents[1]
    return hashlib.sha256(X.canonical({p.relative_to(base).as_posix(): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(base.rglob("*.py"))}).encode()).hexdigest()


def config_digest(config: dict) -> str:
    return hashlib.sha256(X.canonical(config).encode()).hexdigest()


def scan_order(rows: DataFrame, seed: int, most: int) -> DataFrame:
    """The first ``most`` rows in order of their file's seeded hash and their place in it, with ``place`` from 0."""
    keyed = rows.withColumn("__file", F.sha2(F.concat(F.lit(f"{seed}/"), F.col("source_file")), 256))
    placed, _ = numbered(keyed, ["__file", "source_file", "row_index"], "place")
    return placed.where(F.col("place") < most).drop("__file")


def eligible(messages: Column) -> Column:
    """Places of the messages that can be decisions: assistants that act or say something, and are not masked."""
    placed = F.transform(messages, lambda m, i: F.struct(m.alias("m"), i.alias("i")))
    good = F.filter(placed, lambda x: (x["m"]["role"] == "assistant") & F.coalesce(x["m"]["loss_mask"], F.lit(True)) & (x["m"]["action"].isNotNull() | (F.length(x["m"]["content"]) > 0)))
    return F.transform(good, lambda x: x["i"])


def spread(places: Column, n: int) -> Column:
    """n of the places, evenly from the first to the last; of one the last."""
    size = F.size(places)
    at = (lambda i: F.floor(i * (size - 1) / (n - 1)).cast("int") + 1) if n > 1 else (lambda i: size)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(places, at(i) - 1))


def admit(
    episodes: DataFrame, tasks: DataFrame, policy: Policy, index: Index | None, vocabulary: list[str], config: dict,
) -> tuple[DataFrame, DataFrame]:
    """(accepted, judged) of episodes with locator (source_file, row_index, record_sha256) and ``error``.

    accepted: locator, episode_id, split, message_indices, base_commit, repo_license, window_tokens, dropped_messages.
    judged: place, record_sha256, accepted, reasons, quarantined."""
    config = check_config(config)
    placed = scan_order(episodes, config["seed"], config["maximum_scan"])
    placed = placed.withColumn("episode_id", I.stable_id("source_dataset", "source_record_id"))
    placed = placed.withColumn("identity", I.group_identity(I.folded_text(F.col("repo")), I.folded_text(F.col("task_id")))).withColumn("licence", A.repo_licence())
    placed = written(policy.with_splits(placed), "admission-placed")
    readable = placed.where("error is null and identity is not null")
    audited = R.task_findings(A.audit(readable.drop("base_commit"), "place"), tasks)
    audited = audited.withColumn("findings", F.concat("findings", F.array_compact(F.array("task_finding", F.when(F.col("success").isNull(), OUTCOME_UNKNOWN)))))
    audited = audited.withColumn("folded", I.folded_text(F.col("task_text")))
    audited = audited.withColumn("content_digest", F.sha2(F.to_json(F.transform("messages", lambda m: F.struct(m["action"], m["content"], m["reasoning"], m["role"])), {"ignoreNullFields": "false"}), 256))
    audited = written(audited.withColumn("chosen", eligible(F.col("messages"))), "admission-audited")
    if index is not None:
        clean = audited.where("size(findings) = 0").select(F.col("place").alias("candidate"), "folded", F.col("content_digest").alias("trace"), "split")
        met = written(index.findings(clean), "admission-contamination").groupBy(F.col("candidate").alias("place")).agg(F.collect_set("finding").alias("met"))
        audited = audited.join(met, "place", "left").withColumn("findings", F.concat("findings", F.coalesce("met", F.array().cast("array<string>")))).drop("met")
    n = config["decisions_per_episode"]
    audited = audited.withColumn("message_indices", F.when(F.size("chosen") >= n, spread(F.col("chosen"), n)))

    fit = audited.where("size(findings) = 0 and message_indices is not null")
    wanted = fit.select("episode_id", F.explode("message_indices").alias("message_index"))
    sizes = windows.fitted(fit.select("episode_id", "messages", "tools", "task_text"), vocabulary, config["max_tokens"], wanted)
    sizes = sizes.groupBy("episode_id").agg(F.bool_or(F.col("dropped").isNull()).alias("over"), F.sort_array(F.collect_list(F.struct("at", "tokens", "messages"))).alias("w"))
    audited = written(audited.join(sizes, "episode_id", "left"), "admission-sized")
    withheld = F.when(F.col("message_indices").isNull(), TOO_FEW).when(F.coalesce("over", F.lit(False)), OVERFLOW)
    rows = audited.select(
        "place", F.col("place").cast("string").alias("candidate"), "task_id", F.sha2("folded", 256).alias("task_digest"), "content_digest", "split", F.col("teacher_model").alias("teacher"),
        F.when(F.size("findings") > 0, F.col("findings")).otherwise(F.array_compact(F.array(withheld))).alias("findings"),
    )
    each = {s: q // len(config["teachers"]) for s, q in config["quotas"].items()}
    decided = written(S.greedy_admission(rows, config["quotas"], each), "admission-decided").select(F.col("candidate").cast("long").alias("place"), "accepted", "reasons")
    others = F.filter("reasons", lambda r: ~r.isin(TOO_FEW, OVERFLOW))
    reasons = F.array_sort(F.array_distinct(F.when(F.size(others) > 0, others).otherwise(F.col("reasons"))))
    unreadable = placed.where("error is not null or identity is null").select("place", "record_sha256", F.lit(False).alias("accepted"), F.array(F.lit(UNREADABLE)).alias("reasons"))
    judged = audited.select("place", "record_sha256").join(decided, "place").select("place", "record_sha256", "accepted", reasons.alias("reasons")).unionByName(unreadable)
    judged = judged.withColumn("quarantined", ~F.col("accepted") & ~F.array_contains("reasons", TOO_FEW))
    taken = audited.join(small_side(written(decided.where("accepted").select("place"), "admission-taken")), "place", "left_semi")
    accepted = taken.select(
        "source_file", "row_index", "record_sha256", "episode_id", "split", "message_indices", "base_commit", F.col("licence").alias("repo_license"), "teacher_model", "success",
        F.transform("w", lambda x: x["tokens"]).alias("window_tokens"), F.transform("w", lambda x: x["messages"]).alias("dropped_messages"),
    )
    return accepted, judged


def write(spark: SparkSession, folder: str, accepted: DataFrame, judged: DataFrame, config: dict, provenance: dict) -> dict:
    """Write an admission into a new folder: accepted rows, the quarantine as JSON lines, the report last."""
    accepted.write.parquet(f"{folder}/accepted")
    lines = judged.where("quarantined").orderBy("place").select(F.to_json(F.struct("reasons", "record_sha256")).alias("value"))
    lines.write.text(f"{folder}/quarantine")
    taken = spark.read.parquet(f"{folder}/accepted")
    table = lambda df, c: {str(r[c]): r["count"] for r in df.groupBy(c).count().collect()}
    report = {
        "version": VERSION, "config": config, "config_sha256": config_digest(config), "code_sha256": code_digest(), **provenance,
        "statistics": {
            "scanned": judged.count(), "accepted": taken.count(), "splits": table(taken, "split"), "teachers": table(taken, "teacher_model"), "outcomes": table(taken, "success"),
            "rejections": table(judged.where("not accepted").select(F.explode("reasons").alias("reason")), "reason"),
        },
    }
    report["status"] = "passed" if report["statistics"]["splits"] == config["quotas"] else "insufficient_eligible_data"
    write_once(spark, f"{folder}/report.json", json.dumps(report, sort_keys=True, allow_nan=False))
    return report


def load(spark: SparkSession, folder: str, config: dict, provenance: dict, files: DataFrame) -> tuple[dict, DataFrame]:
    """(report, accepted) of an admission that passed, is of this code, configuration and provenance, and is whole in itself.

    ``files`` (path) are the verified files of the source."""
    report = json.loads(read_text(spark, f"{folder}/report.json"))
    if report["status"] != "passed" or report["version"] != VERSION:
        raise ValueError("the admission has not passed")
    for name, now in {"config_sha256": config_digest(config), "code_sha256": code_digest(), **provenance}.items():
        if report.get(name) != now:
            raise ValueError(f"{name} has changed since the admission")
    accepted = spark.read.parquet(f"{folder}/accepted")
    faults = {
        "quotas": {r["split"]: r["count"] for r in accepted.groupBy("split").count().collect()} != config["quotas"],
        "an episode twice": not R.repeated(accepted, "episode_id").isEmpty(),
        "a locator twice": not R.repeated(accepted, "source_file", "row_index").isEmpty(),
        "a file outside the source": not accepted.join(files.select(F.col("path").alias("source_file")), "source_file", "left_anti").isEmpty(),
        "a number of decisions": not accepted.where(F.size("message_indices") != config["decisions_per_episode"]).isEmpty(),
    }
    if wrong := [name for name, bad in faults.items() if bad]:
        raise ValueError(f"the admission does not hold: {', '.join(wrong)}")
    return report, accepted


def build_release(episodes: DataFrame, accepted: DataFrame, folder: str, provenance: dict) -> dict:
    """A release of the admitted episodes (located, adapted, with error), audited once more, with its reports."""
    spark = episodes.sparkSession
    rows = R.located(episodes, accepted).drop("base_commit").join(small_side(accepted.select("source_file", "row_index", "split", "base_commit")), ["source_file", "row_index"])
    rows = written(rows.withColumn("episode_id", I.stable_id("source_dataset", "source_record_id")), "release-rows")
    rows = written(A.audit(rows), "release-audited")
    bad = rows.where("error is not null or size(findings) > 0")
    if not bad.isEmpty() or rows.count() != accepted.count():
        raise ValueError("admitted rows are missing or have findings now")
    chosen = accepted.select("episode_id", F.explode("message_indices").alias("message_index"))
    reports = {
        "licenses": {r["x"]: r["count"] for r in rows.groupBy(A.repo_licence().alias("x")).count().collect()},
        "outcomes": {str(r["success"]): r["count"] for r in rows.groupBy("success").count().collect()},
    }
    splits = rows.select("source_record_id", "split")
    return release.build(rows.drop("episode_id", "findings", "split", "error", "source_file", "row_index"), splits, folder, chosen, {**provenance, "reports": reports})
