"""Exact and near contamination between splits: digests, LSH bands over MinHash, exact Jaccard.

A text is signed where it is read, so only digests and bands are shuffled, of a digest and split once.  Only texts of different splits
are compared.  In a bucket of a band each text first meets one text of each other split; only those without a finding then meet the
others, so a group of near copies costs about its size.  Shingles are made again, for the texts of candidate pairs only.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BANDS, fingerprint, joined_words, shingle_hashes, shingles, signature, words
from ..scratch import small_side, text_batches, written

THRESHOLD = 0.8
#: Rows of a block of a bucket.
BLOCK_ROWS = 500


def task_index(tasks: DataFrame) -> DataFrame:
    """One row per distinct folded text: digest, shingles (hex digits).  ``tasks`` has the column ``folded``."""
    distinct = tasks.select("folded", F.sha2("folded", 256).alias("digest")).dropDuplicates(["digest"])
    cut = distinct.select("digest", "folded", words(F.col("folded")).alias("words"))
    return cut.select("digest", shingles(F.col("folded"), "words").alias("shingles"))


def fingerprints(tasks: DataFrame) -> DataFrame:
    """One row per distinct text of tasks (digest, folded): digest, n, bands and shingles, each by its first 64 bits."""
    distinct = text_batches(tasks).where("digest is not null").select("digest", "folded").dropDuplicates(["digest"])
    return distinct.select("digest", fingerprint("digest", joined_words(F.col("folded"))).alias("x")).select("digest", "x.*")


def prepared(tasks: DataFrame, *more: str) -> DataFrame:
    """(digest, split, n, bands and the columns ``more``), a written table of the rows of tasks (digest, split, folded), each folded and signed once."""
    rows = text_batches(tasks).where("digest is not null").select("digest", "split", *more, signature("digest", joined_words(F.col("folded"))).alias("x"))
    return written(rows.select("digest", "split", *more, "x.n", "x.bands"), "contamination-signed")


def signed(rows: DataFrame) -> DataFrame:
    """(digest, split, n, bands), a written table of the distinct texts and splits of ``prepared`` rows."""
    return written(rows.select("digest", "split", "n", "bands").dropDuplicates(["digest", "split"]), "contamination-index")


def bands(index: DataFrame) -> DataFrame:
    """(band, value, digest and the other columns) rows of a signed table, or of the digests of one."""
    others = [c for c in index.columns if c != "bands"]
    return index.select(*others, F.posexplode_outer("bands").alias("band", "value"))  # outer: no second signature for a filter


def bucket_links(found: DataFrame, block: int = BLOCK_ROWS) -> DataFrame:
    """Distinct (a, b), a < b, of all digests that share a bucket.  ``found``: written rows (digest, band, value), a digest once a band.

    A bucket of more than ``block`` rows is dealt out in blocks, and each two of its blocks meet by themselves; a pair comes from the
    first band that it shares, so pairs are not shuffled."""
    shared = found.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(shared.select("band", "value", F.monotonically_increasing_id().alias("bucket"), F.ceil(F.col("n") / block).cast("int").alias("blocks")), "contamination-shared")
    held = found.join(small_side(shared), ["band", "value"]).groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("band", F.struct("bucket", "blocks")))).alias("held"))
    at = F.array(*[F.try_element_at("held", F.lit(i))["bucket"] for i in range(BANDS)])
    rows = held.select("digest", at.alias("at"), F.explode("held").alias("band", "x")).select("digest", "at", "band", "x.*")
    rows = written(rows.withColumn("own", F.pmod(F.xxhash64("digest"), "blocks").cast("int")), "contamination-buckets")
    cell, parts = ["bucket", "band", "i", "j"], int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # numbered partitions: cells are small, so by their bytes many of them would come into one task
    left = rows.select("bucket", "band", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), F.col("digest").alias("a"), F.col("at").alias("p")).repartition(parts, *cell)
    right = rows.select("bucket", "band", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("digest").alias("b"), F.col("at").alias("q")).repartition(parts, *cell)
    before = reduce(or_, [(F.col("band") > i) & F.coalesce(F.col("p")[i] == F.col("q")[i], F.lit(False)) for i in range(BANDS - 1)])
    met = left.join(right, cell).where("i < j or a < b").where(~before)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, jaccard) of the pairs at the threshold or above; sets: digest, shingles."""
    sets = sets.select("digest", "shingles")
    both = pairs.join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("jaccard")).where(F.col("jaccard") >= threshold)


def among(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows (digest, ..) of the digests of written pairs (a, b)."""
    met = written(pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct(), "contamination-met")
    return rows.join(small_side(met), "digest", "left_semi")


def sets_of(pairs: DataFrame, tasks: DataFrame) -> DataFrame:
    """(digest, shingles), a written table of the texts of tasks (digest, folded) that written pairs (a, b) name."""
    texts = among(pairs, tasks.select("digest", "folded")).dropDuplicates(["digest"])
    return written(texts.select("digest", shingle_hashes("digest", joined_words(F.col("folded"))).alias("shingles")), "contamination-sets")


def sizes_fit(n: str, m: str, threshold: float = THRESHOLD):
    """Whether two sets of these sizes can be as similar as that."""
    return F.least(n, m) >= threshold * F.greatest(n, m) - 1e-6


def _mixed_buckets(index: DataFrame) -> DataFrame:
    """(band, value, digest, split, n) of the buckets with texts of several splits."""
    rows = bands(index)
    mixed = rows.groupBy("band", "value").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi").select("band", "value")
    return written(rows.join(mixed, ["band", "value"]), "contamination-buckets")


def _across(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of a row of left and one of right that share a bucket and not a split, and whose sizes fit."""
    met = left.select("band", "value", F.col("digest").alias("a"), F.col("split").alias("s"), F.col("n").alias("n_a"))
    met = met.join(right.select("band", "value", F.col("digest").alias("b"), F.col("split").alias("t"), F.col("n").alias("n_b")), ["band", "value"])
    return met.where("s <> t and a <> b").where(sizes_fit("n_a", "n_b", threshold)).select("a", "b").distinct()


def near_pairs(tasks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, jaccard), a < b: candidate pairs of texts of different splits, at the threshold or above.  ``tasks``: ``prepared`` with their texts, ``folded``."""
    rows = _mixed_buckets(signed(tasks))
    pairs = written(_across(rows, rows, threshold).where("a < b"), "contamination-pairs")
    return similar(pairs, sets_of(pairs, tasks), threshold)


def exact_cross_split(tasks: DataFrame) -> DataFrame:
    """Digests that occur in more than one split.  ``tasks``: digest, split."""
    return tasks.groupBy("digest").agg(F.countDistinct("split").alias("n_splits"), F.count("*").alias("n_rows")).where("n_splits > 1")


def findings(tasks: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(digest, split, finding): exact where the same digest is in another split, near where a similar one is.  ``tasks``: ``prepared`` with
    their texts, ``folded``."""
    index = signed(tasks)
    own = index.select("digest", "split")
    in_several = own.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    exact = own.join(in_several, "digest", "left_semi").withColumn("finding", F.lit("cross_split_exact_task"))
    rows = _mixed_buckets(index)

    def found_by(pairs: DataFrame) -> DataFrame:
        # each pair once, whichever of its texts came first
        pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "contamination-pairs")
        met = written(similar(pairs, sets_of(pairs, tasks), threshold).select("a", "b"), "contamination-similar")
        both = met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
        mine = own.select(F.col("digest").alias("a"), "split")
        other = own.select(F.col("digest").alias("b"), F.col("split").alias("t"))
        return mine.join(both, "a").join(other, "b").where("split <> t").select(F.col("a").alias("digest"), "split").distinct()

    first = rows.groupBy("band", "value", "split").agg(F.min(F.struct("digest", "n")).alias("x")).select("band", "value", "split", "x.*")
    near = written(found_by(_across(rows, first, threshold)), "contamination-near")
    left = rows.join(near, ["digest", "split"], "left_anti")
    more = written(found_by(_across(left, rows, threshold)), "contamination-near")
    near = near.unionByName(more).distinct().withColumn("finding", F.lit("cross_split_near_task"))
    return exact.unionByName(near)
