import random

import pytest
from compare import same_rows

from quarry import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    found = catalog.QUERIES[name](spark, sf).toPandas()
    if name in catalog.ORACLE_SQL:
        assert same_rows(found, duck.execute(catalog.ORACLE_SQL[name]).df())
    else:
        assert len(found)


def test_packs_keep_their_invariants(spark, sf):
    from quarry.operators import packing

    packs = catalog.pack_sequences(spark, sf)
    assert packing.pack_violations(packs).where("size(violations) > 0").count() == 0


def test_budget_plan_places_each_sample_once(spark, sf):
    plan = catalog.token_budget_plan(spark, sf).toPandas()
    assert plan["sample_id"].is_unique and (plan["aligned_tokens"] <= 16384).all()
    assert (plan["real_tokens"] > 0).all() and (plan["aligned_tokens"] % 16 == 0).all()


def test_budget_plan_places_every_character(spark):
    sf = "/root/testdata/sf0.01"
    sizes = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars > 0").select("doc_id", "n_chars").toPandas()
    assert (sizes["n_chars"] > 16384).any()
    plan = catalog.token_budget_plan(spark, sf).toPandas()
    placed = plan.groupby(plan["sample_id"].str.split("/").str[0].astype(int))["length"].sum()
    assert placed.to_dict() == sizes.set_index("doc_id")["n_chars"].to_dict()


def test_packs_of_a_realistic_plan_are_nearly_full(spark):
    from quarry.operators import packing

    rng = random.Random(4)
    rows = [(f"s{i}", min(16384, max(200, int(rng.lognormvariate(8.2, 0.9))))) for i in range(6000)]
    plan = packing.token_budget_plan(spark.createDataFrame(rows, "sample_id string, length int"), 16384).toPandas()
    assert plan.groupby("bucket").size().tolist() == [2048, 2048, 1904]
    packs = plan.drop_duplicates(["bucket", "pack"])
    assert packs["real_tokens"].sum() / packs["aligned_tokens"].sum() > 0.999  # tails of the alignment
    assert plan["length"].sum() / (16384 * len(packs)) > 0.98


def test_greedy_admission_counts(spark, sf):
    rows = catalog.greedy_quota_admission(spark, sf).toPandas()
    assert rows["accepted"].sum() <= 200 and (rows["accepted"] == (rows["reasons"].map(len) == 0)).all()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["digest", "n_splits", "n_rows"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_schema_keywords_are_dealt_out_to_all_tasks(spark, sf):
    """The customers are one small file; their schemas are checked in as many tasks as there are partitions."""
    found = catalog.QUERIES["schema_keywords"](spark, sf)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1


def test_many_schemas_accept_as_each_does(spark):
    from pyspark.sql import functions as F

    from quarry.operators import interactions as T

    schemas = [s for s, _ in catalog_schemas()] + ['{"$ref": "#/nowhere"}', "no json", "true"]
    values = spark.createDataFrame([('{"key": 7, "balance": 10, "segment": "A", "codes": [1, 2, 3]}',), ("1",), ("no json",), (None,)], "v string")
    both = values.select(T.schemas_accept(schemas, F.col("v")).alias("many"), F.array(*[T.schema_accepts(F.lit(s), F.col("v")) for s in schemas]).alias("each")).collect()
    assert [r.many for r in both[:3]] == [r.each for r in both[:3]] and both[3].many is None and not any(both[2].many) and any(both[0].many)


def catalog_schemas():
    from quarry.catalog_episodes import KEYWORD_SCHEMAS

    return KEYWORD_SCHEMAS
