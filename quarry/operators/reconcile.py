"""Reconciliations between tables: differing members, missing rows, joins with residual conflicts, locators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity as I
from ..scratch import small_side


def differences(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, fault, columns): rows of one side only (``left_only``, ``right_only``), and pairs that differ (``differs``) with the
    names of the columns in which they do; nulls are equal to nulls.  Repeated keys meet each other."""
    a = left.select(*keys, F.struct(*columns).alias("a"))
    b = right.select(*keys, F.struct(*columns).alias("b"))
    unlike = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in columns]))
    both = a.join(b, keys, "full_outer")
    fault = F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").when(F.size(unlike) > 0, "differs")
    return both.select(*keys, fault.alias("fault"), F.when(fault == "differs", unlike).alias("columns")).where("fault is not null")


def unexpected_members(value: Column, expected: list[str]) -> Column:
    """struct(missing, unknown): members of a JSON object against the expected ones, sorted."""
    has = F.json_object_keys(value)
    want = F.array(*map(F.lit, expected))
    return F.struct(F.array_sort(F.array_except(want, has)).alias("missing"), F.array_sort(F.array_except(has, want)).alias("unknown"))


def same_repository(a: Column, b: Column) -> Column:
    return I.repository(I.folded_text(a)).eqNullSafe(I.repository(I.folded_text(b)))


def task_findings(candidates: DataFrame, tasks: DataFrame) -> DataFrame:
    """Candidates (task_id, repo, licence, ..) with ``base_commit`` of their task and ``task_finding``: task_join_missing where no
    task (instance_id, repo, license, base_commit) has their id, task_join_conflict where the task's repository or licence
    is another or its commit is none."""
    t = tasks.select(F.col("instance_id").alias("task_id"), F.col("repo").alias("task_repo"), F.col("license").alias("task_license"), "base_commit", F.lit(True).alias("joined"))
    both = candidates.join(t, "task_id", "left")
    commit = F.coalesce(F.col("base_commit").rlike(r"\A[a-f0-9]{40}\z"), F.lit(False))
    agrees = same_repository(F.col("task_repo"), F.coalesce("repo", F.lit(""))) & F.col("task_license").eqNullSafe(F.col("licence")) & commit
    finding = F.when(F.col("joined").isNull(), "task_join_missing").when(~agrees, "task_join_conflict")
    return both.withColumn("task_finding", finding).drop("task_repo", "task_license", "joined")


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n): keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def located(rows: DataFrame, locators: DataFrame) -> DataFrame:
    """The rows (source_file, row_index, ..) that a written table of locators (source_file, row_index) names."""
    return rows.join(small_side(locators.select("source_file", "row_index").distinct()), ["source_file", "row_index"], "left_semi")


def owners_in_two(rows: DataFrame, owner: str, part: str) -> DataFrame:
    """(owner, n): owners whose rows lie in more than one part."""
    return rows.groupBy(owner).agg(F.countDistinct(part).alias("n")).where("n > 1")
