"""Stable ids, group identities and salted splits, as Catalyst expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Namespaces that enter the digests.
SPLIT_ALGORITHM = "sha256_salted_bucket_v1"
GROUP_IDENTITY = "repo_else_task_v1"
UNKNOWN = ("", "none", "null", "unknown")


def stable_id(*parts: Column | str) -> Column:
    """sha256 of the parts, joined by U+001F; a null part counts as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]), 256)


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC, case-folded, runs of white space as one space; null stays null."""
    return text.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


def folded_text(text: Column) -> Column:
    """What ``folded`` gives; texts of ASCII characters, which need small letters and single spaces only, stay in the JVM."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[ \t-\r\x1c-\x1f]+", " "))
    return F.when(text.rlike(r"[^\x00-\x7f]"), folded(F.when(text.rlike(r"[^\x00-\x7f]"), text))).otherwise(plain)


def repository(value: Column) -> Column:
    """owner/name of a folded repository reference, null where it names none."""
    v = F.replace(value, F.lit("\\"), F.lit("/"))
    v = F.regexp_replace(v, r"^(https://github\.com/|http://github\.com/|github\.com/)", "")
    v = F.when(F.contains(v, F.lit("/")), v).otherwise(F.regexp_replace(v, r"^(.*?)__", "$1/"))
    v = F.regexp_replace(F.regexp_replace(v, "/+", "/"), r"^/+|/+$", "")
    v = F.regexp_replace(v, r"\.git$", "")
    return F.when(~v.isin(*UNKNOWN), v)


def group_identity(repo: Column, task: Column) -> Column:
    """repo:<owner/name> of the folded repository, or of a task named after one, or else task:<name>; null if neither."""
    name = F.regexp_replace(task, r"_copy\d+$", "")
    from_task = F.when(name.rlike(r"^[^/]+__.+-\d+$"), F.regexp_replace(name, r"^([^/]+?)__(.+)-\d+$", "$1/$2"))
    by_task = F.when(from_task.isNotNull(), F.concat(F.lit("repo:"), repository(from_task))).when(~name.isin(*UNKNOWN), F.concat(F.lit("task:"), name))
    return F.when(repo.isNotNull() & ~repo.isin(*UNKNOWN), F.concat(F.lit("repo:"), repository(repo))).otherwise(by_task)


def group_digest(identity: Column, salt: str) -> Column:
    nul = F.lit("\x00")
    return F.sha2(F.concat(F.lit(SPLIT_ALGORITHM), nul, F.lit(GROUP_IDENTITY), nul, F.lit(salt), nul, identity), 256)


def bucket(digest: Column, count: int) -> Column:
    """The first 64 bits of a hex digest, unsigned, modulo count."""
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(count)).cast("bigint")


def split_of(bucket_no: Column, ranges: dict[str, tuple[int, int]]) -> Column:
    """The split whose inclusive range holds the bucket; null if none does."""
    out = F.lit(None).cast("string")
    for name, (lo, hi) in ranges.items():
        out = F.when(bucket_no.between(lo, hi), F.lit(name)).otherwise(out)
    return out
