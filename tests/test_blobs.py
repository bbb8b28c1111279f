"""The record store: each digest once, and batches that read filters in place of records."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from quarry.sources import blobs


def batch(spark, values):
    return blobs.addressed(spark.createDataFrame([(f'{{"n": {v}}}',) for v in values], "value string"))


def test_each_digest_once(spark, tmp_path):
    rng, folder, all_ = random.Random(1), str(tmp_path / "store"), set()
    for _ in range(4):
        values = [rng.randrange(900) for _ in range(400)]
        blobs.put(batch(spark, values), folder)
        all_ |= set(values)
        assert blobs.read(spark, folder).count() == blobs.read(spark, folder).select("digest").distinct().count() == len(all_)
    refs = batch(spark, [*all_, 5000]).select("ref")
    assert blobs.get(refs, folder).where("intact").count() == len(all_)


def test_filters_hold_every_digest_and_few_others(spark, tmp_path):
    folder = str(tmp_path / "store")
    blobs.put(batch(spark, range(3000)), folder)
    asked = lambda values: batch(spark, values).select("digest", F.substring("digest", 1, 2).alias("prefix2"))
    assert blobs.known(asked(range(3000)), folder).count() == 3000 and blobs.known(asked(range(3000, 9000)), folder).count() == 0
    filters = spark.read.schema(blobs.FILTERS).parquet(f"{folder}/filters/*")
    met = asked(range(3000, 9000)).withColumn("block", blobs._block(F.col("digest"))).join(filters, ["prefix2", "block"])
    assert met.where(blobs._holds(F.col("bits"), blobs._places(F.col("digest")))).count() < 60  # of 6,000


def test_new_records_read_no_records(spark, tmp_path):
    """The store's records are broken after the first batch; new ones go in all the same, known ones would be looked for."""
    folder = str(tmp_path / "store")
    blobs.put(batch(spark, range(500)), folder)
    for f in glob.glob(f"{folder}/records/**/*.parquet", recursive=True):
        with open(f, "wb") as out:
            out.write(b"broken")
    blobs.put(batch(spark, range(10_000, 10_100)), folder)
    assert len(glob.glob(f"{folder}/filters/*/*.parquet")) >= 2
    with pytest.raises(Exception):  # noqa: B017
        blobs.put(batch(spark, [3]), folder)


def test_generations_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blobs, "GENERATIONS", 2)
    folder = str(tmp_path / "store")
    for i in range(5):
        blobs.put(batch(spark, range(10 * i, 10 * i + 15)), folder)
    assert len(blobs._generations(spark, folder)) <= 2 and blobs.read(spark, folder).count() == 55
    blobs.put(batch(spark, range(55)), folder)
    assert blobs.read(spark, folder).count() == 55
