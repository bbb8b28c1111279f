"""Operator 7: mixing sources to target weights by a time-varying curriculum.

Sources in order of code point, null last, have weight schedules over the training time 0 .. 1, here straight lines.
The integral of a schedule is the source's weight.  Weights share a budget of words, at most ``most`` times a source's
size each; what is over goes to the others by weight until none is above (one level for all that are not full, found
from sums over the sources in the order in which they fill).

Documents of a source stand in an order given by a hash of their id, and are read from its start again until the target is
reached; the last is cut there.  A running sum gives each reading its place in the source's demand, and the inverse of
the integrated schedule the training position.  The sum is taken in two steps, over parts of the hash order and
within them, so the largest source needs no task of its own.

A null text has size 0; null sources are one source; rows without an id are left out; rows of one id and source are
documents of their own, told apart by ``copy`` (0, 1, .. by size); an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_side

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: (weight at the end - weight at the start) / (2 * weight) of each schedule.
SLOPES = (0.5, -0.5, 0.0)
SHARE, MOST = 1.5, 2
#: About so many documents form one part of the hash order.
PART_ROWS = 20_000


def source_plan(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, target, slope.  Its windows see one row per source, and so are one task."""
    every = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.row_number().over(every) - 1) % n + 1)
    plan = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = plan.select("source", "source_size", pick(weights).alias("w"), pick(slopes).alias("slope"), F.row_number().over(every).alias("rn"))
    plan = plan.withColumn("full_at", most * 1.0 * F.col("source_size") / F.col("w"))
    fills = Window.orderBy("full_at", "rn")
    full = F.coalesce(F.sum(most * F.col("source_size")).over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(fills.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    plan = plan.withColumn("level", (share * total - full) / rest)
    level = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(Window.partitionBy())
    return plan.select("source", "source_size", "slope", F.least(most * 1.0 * F.col("source_size"), level * F.col("w")).alias("target"))


def readings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = MOST, **plan) -> DataFrame:
    """Each reading of each document: id, source, copy, pass, size, source_size, target, words (taken in this pass) and position.

    A document that is not taken keeps its first row, with no words and no position."""
    sizes = cut(
        docs.select(
            F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.col(id_col).cast("long").cast("string")).alias("place"),
        ).where("id is not null"),
        "op7-sizes",
    )
    digits, parts = 1, 16
    rows = sizes.count()
    while parts * PART_ROWS < rows:
        digits, parts = digits + 1, parts * 16
    sizes = sizes.withColumn("part", F.substring("place", 1, digits))
    sums = sizes.groupBy("source", "part").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source", "part", F.coalesce(before, F.lit(0)).alias("part_start"))
    sums = sums.alias("s").join(source_plan(sizes, most=most, **plan).alias("p"), F.expr("s.source <=> p.source"))
    sums = sums.select(F.col("s.source").alias("src"), F.col("part").alias("p"), "part_start", "source_size", "slope", "target")
    same = Window.partitionBy("source", "part").orderBy("place", "id", "size")
    within = same.rowsBetween(Window.unboundedPreceding, -1)
    nth = F.row_number().over(same)
    placed = sizes.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn("nth", nth)
    # the first row of an id within its part; several rows of one id stand together
    opens = F.when(F.coalesce(F.lag("id").over(same) != F.col("id"), F.lit(True)), F.col("nth"))
    placed = placed.withColumn("opens", opens).withColumn("copy", (F.col("nth") - F.max("opens").over(same.rowsBetween(Window.unboundedPreceding, 0))).cast("int"))
    placed = placed.join(sums, F.expr("source <=> src and part = p")).withColumn("begin", F.expr("part_start + inside"))
    placed = placed.withColumn("demand", F.floor("target").cast("long")).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    placed = placed.withColumn("words", F.expr("greatest(0L, least(size, demand - pass * source_size - begin))"))
    placed = placed.where("words > 0 or pass = 0")
    q = "(pass * source_size + begin + words / 2.0d) / demand"
    inverse = f"if(slope = 0, {q}, (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * {q})) / (2 * slope))"
    return placed.select("id", "source", "copy", F.col("pass").cast("int").alias("pass"), "size", "source_size", "target", "words", F.expr(f"if(words > 0, {inverse}, null)").alias("position"))


def in_training_order(rows: DataFrame, *ties: str) -> DataFrame:
    """Rows range-sorted by their column ``position`` and then by ``ties``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "position", *ties).sortWithinPartitions("position", *ties)


def documents_with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with the column ``copy`` of their readings.  Only rows of repeated ids are numbered."""
    several = cut(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("several")).count().where("count > 1").select("several"), "op7-several")
    if several.isEmpty():
        return docs.withColumn("copy", F.lit(0))
    mark = docs.join(small_side(several), F.col(id_col) == F.col("several"), "left")
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("several", source_col).orderBy(size, text_col)) - 1
    numbered = mark.where("several is not null").withColumn("copy", nth)
    return mark.where("several is null").withColumn("copy", F.lit(0)).unionByName(numbered).drop("several")


ORACLE_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS place
  FROM documents),
plan AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rn FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
    CASE (rn - 1) % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN -0.5::DOUBLE ELSE 0::DOUBLE END AS slope FROM plan),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size / w AS full_at,
    (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, slope, least(2.0::DOUBLE * source_size, (max(CASE WHEN level <= full_at THEN level END) OVER ()) * w) AS target FROM levels),
placed AS (
  SELECT s.*, t.source_size, t.target, t.slope, floor(t.target)::BIGINT AS demand,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begin_at
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passes AS (
  SELECT *, greatest(0, least(size, demand - begin_at)) AS one, greatest(0, least(size, demand - source_size - begin_at)) AS two FROM placed),
q AS (SELECT *, (begin_at + one / 2.0::DOUBLE) / demand AS q FROM passes)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken,
  CASE WHEN one > 0 THEN CASE WHEN slope = 0 THEN q ELSE (slope - 1 + sqrt((1 - slope) * (1 - slope) + 4 * slope * q)) / (2 * slope) END END AS position
FROM q
"""
