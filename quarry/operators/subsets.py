"""Balanced subsets by hash, and profiles of token counts by source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from . import quantiles as Q


def hash_choice(value: Column, n: Column) -> Column:
    """The sha256 of a text as a whole number, modulo n: eight hex digits at a time."""
    digest = F.sha2(value, 256)
    words = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, 8 * i + 1, F.lit(8)), 16, 10).cast("bigint"))
    modulus = n.cast("bigint")
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda acc, x: (acc * F.lit(1 << 32) + x) % modulus)


def one_decision_each(decisions: DataFrame, seed: int | str) -> DataFrame:
    """Of each episode the decision (episode_id, message_index) that the hash of seed and episode picks, in order of message_index."""
    one = Window.partitionBy("episode_id")
    numbered = decisions.withColumn("__n", F.count("*").over(one)).withColumn("__i", F.row_number().over(one.orderBy("message_index")) - 1)
    picked = hash_choice(F.concat(F.lit(f"{seed}/"), F.col("episode_id")), F.col("__n"))
    return numbered.where(F.col("__i") == picked).drop("__n", "__i")


def balanced(rows: DataFrame, strata: list[str], n: int, seed: int | str, key: str = "episode_id") -> DataFrame:
    """n rows, as many of each stratum, with their ``place`` in a round robin over the strata in seeded order.

    A smaller n of the same rows gives the head of this order.  Each task keeps at most its share of a stratum before the shuffle.
    A stratum with too few rows makes the subset smaller; ``shortfalls`` tells which."""
    groups = [tuple(r) for r in rows.select(*strata).distinct().orderBy(*strata).collect()]  # as many as there are strata
    if not groups:
        return rows.withColumn("place", F.lit(0))
    each = n // len(groups)
    order = F.sha2(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")), 256)
    nth = rows.withColumn("__nth", F.row_number().over(Window.partitionBy(*strata).orderBy(order, key))).where(F.col("__nth") <= each)
    spot = F.lit(None).cast("int")
    for i, group in enumerate(groups):
        spot = F.when(_is(strata, group), i).otherwise(spot)
    return nth.withColumn("place", (F.col("__nth") - 1) * len(groups) + spot).drop("__nth")


def refilled(rows: DataFrame, strata: list[str], n: int, seed: int | str, fits: Callable[[DataFrame], DataFrame], key: str = "episode_id") -> tuple[DataFrame, DataFrame]:
    """(chosen, skipped): as ``balanced``, but a row that does not fit is skipped, and the next of its stratum takes its place.

    ``fits`` gives (key, fits) of rows; it is asked about the heads of the strata only, twice as far each time, until each has enough
    rows or ends.  A smaller n of the same rows gives the head of the larger one's order.  skipped: the strata with the number of rows that were
    passed over, and ``missing``, how many rows a stratum lacks."""
    groups = [tuple(r) for r in rows.select(*strata).distinct().orderBy(*strata).collect()]  # as many as there are strata
    each = n // max(len(groups), 1)
    order = F.sha2(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")), 256)
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(order, key))
    before, upto, judged = 0, max(each, 1), None
    while groups:
        # the limit holds within tasks, before the shuffle
        head = written(rows.withColumn("__nth", place).where(F.col("__nth") <= upto).where(F.col("__nth") > before), "refill-head")
        told = fits(head.drop("__nth")).select(F.col(key).alias("__key"), F.col("fits").alias("__fits"))
        part = written(head.join(told, F.col(key) == F.col("__key"), "left").withColumn("__fits", F.coalesce("__fits", F.lit(False))).drop("__key"), "refill-judged")
        judged = part if judged is None else judged.unionByName(part)
        counts = judged.groupBy(*strata).agg(F.count("*").alias("seen"), F.sum(F.col("__fits").cast("int")).alias("good")).collect()
        if all(r["good"] >= each or r["seen"] < upto for r in counts):
            break
        before, upto = upto, 2 * upto
    if judged is None:
        none = rows.withColumn("place", F.lit(0))
        return none, rows.select(*strata).withColumns({"skipped": F.lit(0).cast("long"), "missing": F.lit(0).cast("long")})
    spot = F.lit(None).cast("int")
    for i, group in enumerate(groups):
        spot = F.when(_is(strata, group), i).otherwise(spot)
    order = Window.partitionBy(*strata).orderBy("__nth")
    ranked = judged.withColumn("__good", F.sum(F.col("__fits").cast("int")).over(order))
    chosen = ranked.where(F.col("__fits") & (F.col("__good") <= each)).withColumn("place", (F.col("__good") - 1) * len(groups) + spot).drop("__nth", "__fits", "__good")
    passed = ~F.col("__fits") & (F.col("__good") < each)
    skipped = ranked.groupBy(*strata).agg(F.count(F.when(passed, 1)).alias("skipped"), F.greatest(each - F.max("__good"), F.lit(0)).cast("long").alias("missing"))
    return chosen, skipped


def _is(strata: list[str], group: tuple) -> Column:
    met = F.lit(True)
    for c, v in zip(strata, group, strict=True):
        met = met & F.col(c).eqNullSafe(F.lit(v))
    return met


def shortfalls(rows: DataFrame, strata: list[str], each: int) -> DataFrame:
    """(strata, n): strata with fewer than ``each`` rows."""
    return rows.groupBy(*strata).agg(F.count("*").alias("n")).where(F.col("n") < each)


def source_profile(rows: DataFrame, source: str, whole: str, window: str, limit: int) -> DataFrame:
    """Per source: episodes, those over the limit as a whole, those without a window (null), and totals, medians, 95th percentiles
    and maxima of both counts."""
    stats = lambda c, name: [F.sum(c).alias(f"{name}_total"), F.max(c).alias(f"{name}_max")]
    found = rows.groupBy(source).agg(
        F.count("*").alias("episodes"), F.count(F.when(F.col(whole) > limit, 1)).alias("oversized"), F.count(F.when(F.col(window).isNull(), 1)).alias("failed"), *stats(whole, "whole"), *stats(window, "window")
    )
    for c, name in ((whole, "whole"), (window, "window")):
        found = Q.joined(found, Q.interpolated(rows, [source], c, {f"{name}_p50": 0.5, f"{name}_p95": 0.95}).drop("n"), [source])
    return found
