"""Exact quantiles of groups of any size, by distributed selection.

Values are counted, dealt by range of (group, value) and written by partition; the counts of each partition and group say which
partition holds a rank, and only these are read again and ranked.  A group of all rows lies in as many partitions as its distinct
values fill, so no task sees more than its share of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written

PART = "__part"


def _same(a: list[str], b: list[str]) -> Column:
    met = F.lit(True)
    for x, y in zip(a, b, strict=True):
        met = met & F.col(x).eqNullSafe(F.col(y))
    return met


def joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Left join on keys of which nulls are equal too."""
    other = [f"__{c}" for c in by]
    return left.join(right.withColumnsRenamed(dict(zip(by, other, strict=True))), _same(by, other), "left").drop(*other)


def dealt(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, __v, __c, __part): each distinct value of a group with its count, in the partition of its range; a folder for each partition."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(counts.repartitionByRange(parts, *by, "__v").withColumn(PART, F.spark_partition_id()), "quantiles", PART)


def values_at(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per group with a value that is not null: by, n (its values), and under each name the value at the rank, from 0, that its function gives for n."""
    keys = by or ["__all"]
    rows = rows.select(*by, value) if by else rows.select(F.lit(0).alias("__all"), value)
    table = dealt(rows, keys, value)
    group = Window.partitionBy(*keys)
    sums = table.groupBy(PART, *keys).agg(F.sum("__c").alias("__m"))
    sums = sums.withColumn("__to", F.sum("__m").over(group.orderBy(PART))).withColumn("n", F.sum("__m").over(group))
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), f(F.col("n")).cast("long").alias("rank")) for k, f in ranks.items()]))
    wanted = sums.select(*keys, PART, "n", (F.col("__to") - F.col("__m")).alias("__from"), "__to", named.alias("w")).where("w.rank >= __from and w.rank < __to")
    wanted = written(wanted.select(*keys, PART, "n", F.col("w.name").alias("__name"), (F.col("w.rank") - F.col("__from")).alias("__rank")), "quantile-ranks")
    renamed = {c: f"__k{i}" for i, c in enumerate([*keys, PART])}
    inside = wanted.withColumnsRenamed(renamed)
    held = sorted(r[0] for r in wanted.select(PART).distinct().collect())  # numbers of partitions; the reader leaves other folders out
    met = table.where(F.col(PART).isin(held)).join(inside.select(*renamed.values()).distinct(), (F.col(PART) == F.col(renamed[PART])) & _same(keys, [renamed[c] for c in keys]), "left_semi")
    met = met.withColumn("__to", F.sum("__c").over(Window.partitionBy(PART, *keys).orderBy("__v")))
    both = met.join(inside, (F.col(PART) == F.col(renamed[PART])) & _same(keys, [renamed[c] for c in keys])).where("__rank < __to and __rank >= __to - __c")
    return both.groupBy(*keys).agg(F.first("n").alias("n"), *[F.max(F.when(F.col("__name") == k, F.col("__v"))).alias(k) for k in ranks]).select(*by, "n", *ranks)


def interpolated(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row per group with a value: by, n, and under each name the quantile, linear between the two values next to (n - 1) * share."""
    place = lambda s: (lambda n: (n - 1) * F.lit(float(s)))
    ranks = {f"{k}__lo": (lambda n, s=s: F.floor(place(s)(n))) for k, s in shares.items()} | {f"{k}__hi": (lambda n, s=s: F.ceil(place(s)(n))) for k, s in shares.items()}
    found = values_at(rows, by, value, ranks)

    def between(k: str, s: float) -> Column:
        at, lo, hi = place(s)(F.col("n")), F.col(f"{k}__lo").cast("double"), F.col(f"{k}__hi").cast("double")
        return F.when(F.col(f"{k}__lo") == F.col(f"{k}__hi"), lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)

    return found.select(*by, "n", *[between(k, s).alias(k) for k, s in shares.items()])


def nearest(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """One row per group with a value: by, n, and under each name the value at round-half-even((n - 1) * share), counted from 0."""
    return values_at(rows, by, value, {k: (lambda n, s=s: F.bround((n - 1) * F.lit(float(s)), 0)) for k, s in shares.items()})
