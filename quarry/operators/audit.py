"""Findings of episodes: provenance, licences, identity, tool interactions, sensitive data in the whole record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .interactions import first_violations

# The licence that sources must declare.
SOURCE_LICENCE = "cc-by-4.0"
SHA40 = r"\A[0-9a-f]{40}\z"


def repo_licence() -> Column:
    return F.try_variant_get(F.try_parse_json("metadata"), "$.repo_license", "string")


def provenance_findings() -> Column:
    """Names of the provenance rules that an episode breaks."""
    none = lambda c: F.coalesce(c, F.lit(False))
    blank = F.regexp_replace(F.coalesce("task_text", F.lit("")), r"(?U)\s+", "") == ""
    rules = {
        "unpinned_source": ~none(F.col("source_revision").rlike(SHA40)),
        "unverified_dataset_license": ~none(F.col("source_license") == SOURCE_LICENCE),
        "unverified_repo_license": ~none(repo_licence().isin(*X.LICENCES)),
        "missing_task_identity": (F.coalesce(F.length("repo"), F.lit(0)) == 0) | blank,
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()]))


def whole_record(episodes: DataFrame) -> Column:
    """JSON of all that an episode holds, its raw record too: what a later reader of the store could see."""
    return F.to_json(F.struct(*sorted(c for c in episodes.columns if not c.startswith("__"))), {"ignoreNullFields": "false"})


def audit(episodes: DataFrame, key: str = "episode_id") -> DataFrame:
    """Episodes with ``findings``, sorted and distinct.  ``key`` names an episode."""
    broken = first_violations(episodes, key)
    own = episodes.withColumn("findings", F.concat(provenance_findings(), X.sensitive_findings(whole_record(episodes))))
    both = own.join(broken, key, "left")
    return both.withColumn("findings", F.array_sort(F.array_distinct(F.concat("findings", F.array_compact(F.array("violation")))))).drop("violation")
