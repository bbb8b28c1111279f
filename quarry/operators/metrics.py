"""Aggregations of lengths, losses, outcomes and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles as Q


def length_distribution(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """count, sum, max and interpolated p50 and p95 of a value; empty groups have none."""
    v = F.col(value)
    found = rows.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.max(v).alias("longest"))
    return Q.joined(found, Q.interpolated(rows, by, value, {"p50": 0.5, "p95": 0.95}).drop("n"), by)


def nearest_rank(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Percentiles that are values of the group: the one at round-half-even((n - 1) * share), counted from 0."""
    return Q.nearest(rows, by, value, shares)


def weighted_mean(loss: Column, weight: Column) -> Column:
    return F.sum(loss * weight) / F.sum(weight)


def spikes(epochs: DataFrame, by: str, epoch: str, loss: str, first_limit: float, last_limit: float) -> DataFrame:
    """Ratios of each epoch's loss to the first and to the one before, with a flag where a limit is passed."""
    order = Window.partitionBy(by).orderBy(epoch)
    rows = epochs.withColumn("to_first", F.col(loss) / F.first(loss).over(order)).withColumn("to_last", F.col(loss) / F.lag(loss).over(order))
    return rows.withColumn("spike", F.coalesce((F.col("to_first") > first_limit) | (F.col("to_last") > last_limit), F.lit(False)))


def verifier_outcome(expected: DataFrame, parsed: DataFrame) -> DataFrame:
    """Outcome per task of expected tests (task, test, kind: fail_to_pass or pass_to_pass) against parsed (task, test, status).

    Every expected test stays in the denominator; tests not parsed are missing."""
    both = expected.join(parsed, ["task", "test"], "left")
    passed, fix = F.coalesce(F.col("status") == "PASSED", F.lit(False)), F.col("kind") == "fail_to_pass"
    count = lambda c: F.sum(c.cast("bigint"))
    rows = both.groupBy("task").agg(
        count(fix).alias("fail_to_pass_total"), count(fix & passed).alias("fail_to_pass_passed"), count(fix & F.coalesce(F.col("status") == "FAILED", F.lit(False))).alias("fail_to_pass_failed"),
        count(~fix).alias("pass_to_pass_total"), count(~fix & passed).alias("pass_to_pass_passed"), count(F.col("status").isNull()).alias("missing_tests"),
    )
    extra = parsed.where("status = 'PASSED'").join(expected, ["task", "test"], "left_anti").groupBy("task").agg(F.count("*").alias("extra"))
    rows = rows.join(extra, "task", "left").withColumn("regressions", F.expr("pass_to_pass_total - pass_to_pass_passed"))
    rows = rows.withColumn("progress", F.col("fail_to_pass_passed") / F.col("fail_to_pass_total"))
    rows = rows.withColumn("required_tests_passed", F.expr("fail_to_pass_passed = fail_to_pass_total and regressions = 0"))
    return rows.withColumn("official_passed_match", F.expr("required_tests_passed and extra is null")).drop("extra")


def relative_rms(expected: Column, actual: Column) -> Column:
    """Root mean square of the difference of two vectors over that of the expected one."""
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)
    difference = F.zip_with(actual, expected, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(square(difference) / square(F.transform(expected, lambda x: x.cast("double"))))


def region_counts(records: DataFrame, by: list[str]) -> DataFrame:
    """(by, region, tokens, weighted, weight): tokens of each region of token records, those that learn, and their weight."""
    each = records.select(*by, F.explode(F.arrays_zip("token_regions", "token_loss_weights")).alias("x"))
    w = F.col("x.token_loss_weights").cast("double")
    return each.groupBy(*by, F.col("x.token_regions").alias("region")).agg(F.count("*").alias("tokens"), F.sum((w > 0).cast("bigint")).alias("weighted"), F.sum(w).alias("weight"))


def weighted_losses(rows: DataFrame, by: list[str], loss: str, weight: str, shares: tuple[float, ...] = (0.0, 0.5, 0.9, 1.0)) -> DataFrame:
    """(by, n, weighted, quantiles, fault): the weighted mean of rows' losses and quantiles of the losses.  A group that holds a
    loss or weight that is null, negative or no number, or no weight at all, has a fault instead."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")) | (F.col(c) < 0)
    found = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.bool_or(bad(loss) | bad(weight)).alias("bad"), F.sum(weight).alias("w"), weighted_mean(F.col(loss), F.col(weight)).alias("m"),
    )
    names = {f"__q{i}": s for i, s in enumerate(shares)}
    found = Q.joined(found, Q.interpolated(rows, by, loss, names).drop("n"), by).withColumn("q", F.array(*names))
    fault = F.when(F.col("bad"), "bad_value").when(F.coalesce("w", F.lit(0)) <= 0, "no_weight")
    return found.select(*by, "n", F.when(fault.isNull(), F.col("m")).alias("weighted"), F.when(fault.isNull(), F.col("q")).alias("quantiles"), fault.alias("fault"))


#: The task that is a number and no probability.
REMAINING = "remaining_turns"


def task_losses(rows: DataFrame, by: list[str], tasks: list[str], logits: str, targets: str, mask: str, remaining: tuple[str, str, str]) -> DataFrame:
    """(by, task, active, loss, bad): of each task the mean loss over the rows whose mask is true, and whether one of these has a logit or
    target that is null, no number, infinite or out of range.

    logits, targets and mask are arrays with a member for each of ``tasks``, probabilities: binary cross-entropy of a logit.  ``remaining``
    (predicted logarithm, number, mask) is the task REMAINING: smooth L1 distance to the logarithm of 1 + number."""
    x, t, p, n = F.col("i.x"), F.col("i.t"), F.col(remaining[0]).cast("double"), F.col(remaining[1]).cast("double")
    unit = F.struct(F.lit(REMAINING).alias("task"), p.alias("x"), n.alias("t"), F.col(remaining[2]).alias("on"))
    at = lambda c, i: F.get(c, F.lit(i))
    items = [F.struct(F.lit(k).alias("task"), at(logits, i).cast("double").alias("x"), at(targets, i).cast("double").alias("t"), at(mask, i).alias("on")) for i, k in enumerate(tasks)]
    each = rows.select(*by, F.explode_outer(F.array(*items, unit)).alias("i"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    number = F.col("i.task") == REMAINING
    fits = finite(x) & finite(t) & (t >= 0) & (number | (t <= 1))
    entropy = F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
    far = F.abs(x - F.log1p(t))
    loss = F.when(number, F.when(far < 1, 0.5 * far * far).otherwise(far - 0.5)).otherwise(entropy)
    on = F.coalesce(F.col("i.on"), F.lit(False))
    return each.groupBy(*by, F.col("i.task").alias("task")).agg(F.count(F.when(on, 1)).alias("active"), F.avg(F.when(on & fits, loss)).alias("loss"), F.coalesce(F.bool_or(on & ~fits), F.lit(False)).alias("bad"))


def multitask_losses(rows: DataFrame, by: list[str], tasks: list[str], logits: str, targets: str, mask: str, remaining: tuple[str, str, str], weights: dict[str, float] | None = None) -> DataFrame:
    """(by, total, losses, active, fault): the mean of the tasks' losses, by weight, over the tasks that have active rows.

    A group has a fault instead of a total where an active value is bad or no task of a positive weight is active."""
    weights = {k: 1.0 for k in (*tasks, REMAINING)} if weights is None else weights
    if set(weights) != {*tasks, REMAINING} or any(not 0 <= w < float("inf") for w in weights.values()) or not any(weights.values()):
        raise ValueError("weights must name all tasks, be finite and not negative, and one of them positive")
    each = task_losses(rows, by, tasks, logits, targets, mask, remaining)
    w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("task")), F.lit(0.0))
    w = F.when(F.col("active") > 0, w).otherwise(0.0)
    entries = lambda c: F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("active") > 0, F.struct("task", c)))))
    found = each.groupBy(*by).agg(
        F.sum(F.when(w > 0, w * F.col("loss"))).alias("__loss"), F.sum(w).alias("__weight"), F.bool_or("bad").alias("__bad"), entries("loss").alias("losses"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("task", "active")))).alias("active"),
    )
    fault = F.when(F.col("__bad"), "bad_value").when(F.col("__weight") <= 0, "no_active_task")
    return found.select(*by, F.when(fault.isNull(), F.col("__loss") / F.col("__weight")).alias("total"), "losses", "active", fault.alias("fault"))


def gates(epochs: DataFrame, by: str, epoch: str, loss: str, denominator: str, first_limit: float, last_limit: float) -> DataFrame:
    """``spikes`` with two more flags: whether an epoch covers as much (denominator) as the first one, and whether it passes all."""
    rows = spikes(epochs, by, epoch, loss, first_limit, last_limit)
    covers = F.col(denominator).eqNullSafe(F.first(denominator).over(Window.partitionBy(by).orderBy(epoch)))
    return rows.withColumn("covers", covers).withColumn("passed", F.col("covers") & ~F.col("spike"))


def _log_softmax(logits: Column) -> Column:
    """Logarithms of the softmax of a vector."""
    top = F.array_max(logits)
    total = lambda m: F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - m))) + m
    return F.element_at(F.transform(F.array(total(top)), lambda t: F.transform(logits, lambda x: x - t)), 1)


def divergence(expected: Column, actual: Column) -> Column:
    """struct(kl, agrees, margin): Kullback-Leibler divergence of two vectors of logits, whether their largest member is the same,
    and by how much the expected one's leads its second."""
    double = lambda c: F.transform(c, lambda x: x.cast("double"))
    p, q = _log_softmax(double(expected)), _log_softmax(double(actual))
    kl = F.aggregate(F.zip_with(p, q, lambda a, b: F.exp(a) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    best = lambda c: F.array_position(c, F.array_max(c))
    ranked = F.sort_array(double(expected), asc=False)
    return F.struct(kl.alias("kl"), (best(double(expected)) == best(double(actual))).alias("agrees"), (F.get(ranked, F.lit(0)) - F.get(ranked, F.lit(1))).alias("margin"))


def agreement(rows: DataFrame, by: list[str], found: str, confident: float) -> DataFrame:
    """Per group of ``divergence`` results: rows, mean and 95th percentile of kl, share that agrees, and changed leaders of a margin
    of ``confident`` or more."""
    x = lambda name: F.col(f"{found}.{name}")
    rows = rows.select(*by, found)
    counts = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(x("kl")).alias("mean_kl"), F.avg(x("agrees").cast("double")).alias("agreement"),
        F.count(F.when(~x("agrees") & (x("margin") >= confident), 1)).alias("confident_changes"),
    )
    return Q.joined(counts, Q.interpolated(rows.select(*by, x("kl").alias("__kl")), by, "__kl", {"p95_kl": 0.95}).drop("n"), by)


def vector_differences(expected: Column, actual: Column) -> Column:
    """struct(different, max_abs, relative_l2, scaled_max) of two vectors: unequal members, largest difference, the differences' norm
    over the expected one's, and the largest difference over 1 + the expected member's size."""
    pairs = F.zip_with(expected, actual, lambda a, b: F.struct(a.cast("double").alias("a"), (b.cast("double") - a.cast("double")).alias("d")))
    size = lambda f: F.sqrt(F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(p) * f(p)))
    return F.struct(
        F.size(F.filter(pairs, lambda p: p["d"] != 0)).alias("different"), F.array_max(F.transform(pairs, lambda p: F.abs(p["d"]))).alias("max_abs"),
        (size(lambda p: p["d"]) / size(lambda p: p["a"])).alias("relative_l2"), F.array_max(F.transform(pairs, lambda p: F.abs(p["d"]) / (1 + F.abs(p["a"])))).alias("scaled_max"),
    )
