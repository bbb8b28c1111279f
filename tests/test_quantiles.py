"""Quantiles by distributed selection against NumPy."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import metrics, quantiles


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_equal_numpy(spark, seed):
    rng = random.Random(seed)
    groups = {None: 1, "a": 2, "b": 700, "c": 0, "d": 40}
    rows = [(g, rng.choice([rng.gauss(0, 9), float(rng.randint(0, 3))])) for g, n in groups.items() for _ in range(n)] + [("c", None), ("d", None)]
    shares = {"least": 0.0, "p5": 0.05, "half": 0.5, "p95": 0.95, "most": 1.0}
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = {r.g: r for r in quantiles.interpolated(df, ["g"], "v", shares).collect()}
    assert set(found) == {None, "a", "b", "d"}
    for g, r in found.items():
        values = [v for k, v in rows if k == g and v is not None]
        assert r.n == len(values) and np.allclose([r[s] for s in shares], np.quantile(values, list(shares.values())), rtol=1e-12)
    (whole,) = quantiles.interpolated(df, [], "v", shares).collect()
    assert np.allclose([whole[s] for s in shares], np.quantile([v for _, v in rows if v is not None], list(shares.values())), rtol=1e-12)
    ranked = {r.g: r for r in metrics.nearest_rank(df, ["g"], "v", {"p": 0.35}).collect()}
    assert all(r.p == sorted(v for k, v in rows if k == g and v is not None)[round((r.n - 1) * 0.35)] for g, r in ranked.items())
    lengths = {r.g: r for r in metrics.length_distribution(df, ["g"], "v").collect()}
    assert lengths["c"].n == 0 and lengths["c"].p50 is None and lengths[None].p95 == lengths[None].longest


def test_a_group_of_all_rows_lies_in_all_partitions(spark):
    rows = spark.range(200_000).select(F.lit("x").alias("g"), F.rand(4).alias("v"))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        sizes = [r["count"] for r in quantiles.dealt(rows, ["g"], "v").groupBy("__part").count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert len(sizes) == 20 and sum(sizes) == 200_000 and max(sizes) < 2 * 200_000 / 20


def test_ranks_read_their_partitions_only(spark):
    rows = spark.range(100_000).select((F.col("id") % 2).alias("g"), (F.col("id") * 0.5).alias("v"))
    seen = []
    original = quantiles.dealt

    def spied(*a):
        seen.append(original(*a))
        return seen[-1]

    quantiles.dealt = spied
    try:
        found = quantiles.values_at(rows, ["g"], "v", {"first": lambda n: n * 0, "tenth": lambda n: n * 0 + 9})
        assert sorted(map(tuple, found.collect())) == [(0, 50_000, 0.0, 9.0), (1, 50_000, 0.5, 9.5)]
    finally:
        quantiles.dealt = original
    parts = sorted(r[0] for r in seen[0].where("g = 0 and __v = 0.0 or g = 1 and __v = 0.5").select("__part").distinct().collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    listed = "|".join((f"IN \\({', '.join(map(str, parts))}\\)", f"IN \\({','.join(map(str, parts))}\\)"))
    assert len(parts) == 2 and re.search(rf"PartitionFilters: \[.*__part#\d+ (?:{listed})", plan)


def test_empty_tables_have_no_quantiles(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert quantiles.interpolated(df, ["g"], "v", {"p": 0.5}).count() == 0 and quantiles.nearest(df, [], "v", {"p": 0.5}).count() == 0
