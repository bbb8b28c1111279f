"""Deterministic selections: seeded order, strata, quotas, even spreads, and the ordered greedy admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import numbered, small_side, written


def order_key(seed: int | str, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}/"), value.cast("string")), 256)


def top_of_strata(rows: DataFrame, strata: list[str], k: int, key: Column) -> DataFrame:
    """The k first of each stratum by key, with their place (from 1)."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*strata).orderBy(key))).where(F.col("place") <= k)


def even_spread(rows: DataFrame, group: str, order: str, n: int, rounded: bool = False) -> DataFrame:
    """At most n rows of each group at evenly spaced places: i * (size - 1) / (n - 1), cut or rounded half to even."""
    one = Window.partitionBy(group)
    rows = rows.withColumn("at", F.row_number().over(one.orderBy(order)) - 1).withColumn("size", F.count("*").over(one))
    take = F.least(F.lit(n), F.col("size"))
    if rounded:
        place = lambda i: F.bround(i * (F.col("size") - 1) / (take - 1), 0).cast("bigint")
    else:
        place = lambda i: F.floor(i * (F.col("size") - 1) / (take - 1)).cast("bigint")
    places = F.when(take == 1, F.array((F.col("size") - 1).cast("bigint"))).otherwise(F.transform(F.sequence(F.lit(0), (take - 1).cast("int")), place))
    return rows.where(F.array_contains(places, F.col("at"))).drop("size")


#: Stands for every teacher of a split.
EVERY = object()
#: Reasons that the admission itself adds.
DUPLICATE_TASK, DUPLICATE_CONTENT, SPLIT_FULL, TEACHER_FULL = "duplicate_task", "duplicate_content", "split_quota_reached", "teacher_quota_reached"


def _keyed(rows: DataFrame) -> DataFrame:
    """(at, kind, key): the values by which rows exclude each other; a task id and a task digest share one name space."""
    kind = lambda k, c: F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("key"))
    each = F.array_distinct(F.array(kind("task", "task_id"), kind("task", "task_digest"), kind("content", "content_digest")))
    return rows.select("at", F.explode(each).alias("k")).select("at", "k.kind", "k.key").where("key is not null")


def first_of_all(rows: DataFrame) -> DataFrame:
    """The rows that an ordered pass would take if each excludes all later ones that share a key with it.

    In rounds: a row that is the first undecided of all its keys is taken, and those that share a key with it leave.  A
    round is two grouped minima, and as many rounds are needed as exclusions follow one from another."""
    undecided, taken = rows, None
    while True:
        keys = _keyed(undecided)
        least = keys.groupBy("kind", "key").agg(F.min("at").alias("least"))
        blocked = keys.join(least, ["kind", "key"]).groupBy("at").agg(F.bool_or(F.col("at") != F.col("least")).alias("blocked"))
        now = written(undecided.join(blocked, "at", "left").where("not coalesce(blocked, false)").drop("blocked"), "admission-first")
        taken = now if taken is None else taken.unionByName(now)
        gone = _keyed(now).select("kind", "key").distinct()
        rest = keys.join(small_side(written(gone, "admission-keys")), ["kind", "key"], "left_semi").select("at").distinct()
        undecided = written(undecided.join(rest, "at", "left_anti").join(now.select("at"), "at", "left_anti"), "admission-rest")
        if undecided.isEmpty():
            return taken


#: Rows of the first stretch of an ordered pass; a stretch in which no quota fills is followed by one STRETCH_GROWTH times as long.
STRETCH, STRETCH_GROWTH = 4096, 8


def admitted(clean: DataFrame, split_quota: dict[str, int], teacher_quota: dict[str, int]) -> DataFrame:
    """The rows that an ordered pass takes under quotas for each split and each teacher of a split.

    The pass goes on in stretches of the order.  As long as no quota is full it takes what ``first_of_all`` takes of those that share no key with
    a row taken before.  The first quota to fill ends the stretch: what was taken up to there stays, its group leaves, and the next
    stretch begins behind it.  With the last quota the pass ends, so rows behind it are not compared; a quota that never fills makes
    it go on to the last row, in a number of stretches that is a logarithm of theirs.  Without a row of a group nothing of it is full."""
    used: dict[tuple, int] = {}
    limits = {(s, EVERY): n for s, n in split_quota.items()}
    teachers = [(r["split"], r["teacher"]) for r in clean.select("split", "teacher").distinct().collect()]  # as many as there are groups
    limits |= {(s, t): teacher_quota.get(s, 0) for s, t in teachers}
    inside = lambda s, t: F.col("split").eqNullSafe(F.lit(s)) & (F.lit(True) if t is EVERY else F.col("teacher").eqNullSafe(F.lit(t)))
    known = F.col("split").isin(*split_quota) if split_quota else F.lit(False)
    rest, fixed = clean.where(known), None
    for (s, t), n in limits.items():
        if n <= 0:
            rest = rest.where(~inside(s, t))
    limits = {g: n for g, n in limits.items() if n > 0}
    bounds = rest.agg(F.min("at").alias("first"), F.max("at").alias("last")).first()
    if bounds["first"] is None:
        return rest
    begin, length = bounds["first"], STRETCH
    while begin <= bounds["last"] and any(t is not EVERY and (s, EVERY) in limits for s, t in limits):
        stretch = rest.where(F.col("at").between(F.lit(begin), F.lit(begin + length - 1)))
        if fixed is not None:
            taken_keys = small_side(written(_keyed(fixed).select("kind", "key").distinct(), "admission-keys"))
            stretch = stretch.join(_keyed(stretch).join(taken_keys, ["kind", "key"], "left_semi").select("at").distinct(), "at", "left_anti")
        took = first_of_all(written(stretch, "admission-stretch"))
        new: dict[tuple, int] = {}
        for r in took.groupBy("split", "teacher").count().collect():
            for g in ((r["split"], EVERY), (r["split"], r["teacher"])):
                new[g] = new.get(g, 0) + r["count"]
        filled = [g for g, n in limits.items() if used.get(g, 0) + new.get(g, 0) >= n]
        if not filled:
            fixed = took if fixed is None else fixed.unionByName(took)
            used = {g: used.get(g, 0) + new.get(g, 0) for g in used | new}
            begin, length = begin + length, length * STRETCH_GROWTH
            continue
        end = min(took.where(inside(*g)).select("at").orderBy("at").offset(limits[g] - used.get(g, 0) - 1).limit(1).first()["at"] for g in filled)
        stay = written(took.where(F.col("at") <= F.lit(end)), "admission-fixed")
        fixed = stay if fixed is None else fixed.unionByName(stay)
        for r in stay.groupBy("split", "teacher").count().collect():
            for g in ((r["split"], EVERY), (r["split"], r["teacher"])):
                used[g] = used.get(g, 0) + r["count"]
        for group in [g for g, n in limits.items() if used.get(g, 0) >= n]:  # one row may fill a split and its teacher
            rest = rest.where(~inside(*group))
            limits.pop(group)
        begin = end + 1
    return rest.limit(0) if fixed is None else fixed


def greedy_admission(candidates: DataFrame, split_quota: dict[str, int], teacher_quota: dict[str, int]) -> DataFrame:
    """(candidate, accepted, reasons) of candidates in order of ``place`` and ``candidate``.

    A candidate without findings is taken unless its task id, task digest or content was already taken, or its split's or its
    (split, teacher) quota is full.  The reasons of the others follow from what was taken before them, all at once."""
    rows = candidates.select("place", "candidate", "task_id", "task_digest", "content_digest", "split", "teacher", "findings")
    rows, _ = numbered(written(rows, "admission-rows"), ["place", "candidate"], "at")  # written: a range sort reads its rows twice
    rows = written(rows, "admission-candidates")
    took = written(admitted(rows.where(F.size("findings") == 0).drop("findings"), split_quota, teacher_quota), "admission-taken")
    before = _keyed(took).withColumnRenamed("at", "earlier")
    first = small_side(written(before.groupBy("kind", "key").agg(F.min("earlier").alias("earlier")), "admission-first-keys"))
    again = _keyed(rows).join(first, ["kind", "key"]).where("earlier < at").groupBy("at").agg(F.collect_set("kind").alias("again"))
    # where each quota fills: the place of the taken row that fills it, for splits and their teachers
    full_at = lambda quota, *by: took.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("at"))).join(F.broadcast(quota), "split").where("n = q").select(*by, F.col("at").alias("full"))
    spark = rows.sparkSession
    quota = lambda x: spark.createDataFrame(list(x.items()) or [(None, 0)], "split string, q int")
    splits = full_at(quota(split_quota), "split").withColumnRenamed("full", "split_full")
    teachers = full_at(quota(teacher_quota), "split", "teacher").select(F.col("split").alias("s"), F.col("teacher").alias("t"), F.col("full").alias("teacher_full"))
    out = rows.join(again, "at", "left").join(F.broadcast(splits), "split", "left").join(F.broadcast(teachers), F.expr("split <=> s and teacher <=> t"), "left")
    out = out.join(took.select("at", F.lit(True).alias("taken")), "at", "left")
    none = lambda q: ~F.coalesce(F.col("split").isin(*[s for s, n in q.items() if n > 0]), F.lit(False)) if any(n > 0 for n in q.values()) else F.lit(True)
    more = F.array_compact(
        F.array(
            F.when(F.array_contains("again", "task"), F.lit(DUPLICATE_TASK)), F.when(F.array_contains("again", "content"), F.lit(DUPLICATE_CONTENT)),
            F.when(none(split_quota) | F.coalesce(F.col("split_full") < F.col("at"), F.lit(False)), F.lit(SPLIT_FULL)),
            F.when(none(teacher_quota) | F.coalesce(F.col("teacher_full") < F.col("at"), F.lit(False)), F.lit(TEACHER_FULL)),
        )
    )
    return out.select("candidate", F.coalesce("taken", F.lit(False)).alias("accepted"), F.concat(F.coalesce("findings", F.array().cast("array<string>")), more).alias("reasons"))
