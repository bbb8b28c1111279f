"""Refilled subsets, best fit over ordered free spaces and masked losses, against plain versions."""

import hashlib
import math
import random

import numpy as np
import pytest

from quarry.operators import metrics, packing, subsets


def naive_best_fit(lengths, room):
    left, out = [], []
    for n in lengths:
        at = min((i for i, free in enumerate(left) if free >= n), key=lambda i: (left[i] - n, i), default=None)
        if at is None:
            at = len(left)
            left.append(room)
        left[at] -= n
        out.append(at)
    return out


def test_best_fit_equals_the_plain_scan():
    rng = random.Random(2)
    for _ in range(300):
        room = rng.choice([8, 20, 100])
        lengths = [rng.randint(1, room) for _ in range(rng.randint(0, 60))]
        assert packing.best_fit(lengths, room) == naive_best_fit(lengths, room)


def naive_refill(rows, n, seed):
    groups = sorted({(a, b) for _, a, b, _ in rows})
    queues = {g: sorted((r for r in rows if (r[1], r[2]) == g), key=lambda r: (hashlib.sha256(f"{seed}/{r[0]}".encode()).hexdigest(), r[0])) for g in groups}
    chosen, skipped = {}, dict.fromkeys(groups, 0)
    for turn in range(n // len(groups)):
        for spot, g in enumerate(groups):
            while queues[g]:
                r = queues[g].pop(0)
                if r[3]:
                    chosen[r[0]] = turn * len(groups) + spot
                    break
                skipped[g] += 1
    return chosen, skipped


@pytest.mark.parametrize("seed", [1, 2])
def test_refill_equals_the_plain_one(spark, seed):
    rng = random.Random(seed)
    rows = [(f"e{i}", rng.random() < 0.3, rng.random() < 0.5, rng.random() < 0.25) for i in range(400)]
    df = spark.createDataFrame(rows, "episode_id string, a boolean, b boolean, ok boolean")
    asked = []

    def fits(head):
        asked.append(head.count())
        return head.select("episode_id", head["ok"].alias("fits"))

    chosen, skipped = subsets.refilled(df, ["a", "b"], 32, 9, fits)
    large, passed = {r.episode_id: r.place for r in chosen.collect()}, {(r.a, r.b): (r.skipped, r.missing) for r in skipped.collect()}
    assert (large, {k: v[0] for k, v in passed.items()}) == naive_refill(rows, 32, 9) and not any(v[1] for v in passed.values())
    assert sum(asked) < len(rows)  # only the heads are asked about
    small = {r.episode_id: r.place for r in subsets.refilled(df, ["a", "b"], 8, 9, fits)[0].collect()}
    assert small == {k: v for k, v in large.items() if v < 8}


def test_refill_of_strata_that_end(spark):
    df = spark.createDataFrame([(f"e{i}", i < 3, i in (0, 5, 6)) for i in range(8)], "episode_id string, a boolean, ok boolean")
    chosen, skipped = subsets.refilled(df, ["a"], 6, 1, lambda head: head.select("episode_id", head["ok"].alias("fits")))
    assert {r.episode_id for r in chosen.collect()} == {"e0", "e5", "e6"}
    assert {r.a: (r.skipped, r.missing) for r in skipped.collect()} == {True: (2, 2), False: (3, 1)}
    chosen, skipped = subsets.refilled(df.limit(0), ["a"], 6, 1, lambda head: head)
    assert chosen.count() == skipped.count() == 0


LOSSES = "g string, x array<double>, t array<double>, m array<boolean>, p double, n double, k boolean"
ARGS = (["g"], ["solved", "regressed"], "x", "t", "m", ("p", "n", "k"))


def test_masked_losses(spark):
    rng = random.Random(3)
    rows = [(g, [rng.gauss(0, 3), rng.gauss(0, 3)], [rng.random(), float(rng.randint(0, 1))], [rng.random() < 0.6, g == "a" and rng.random() < 0.5], rng.gauss(1, 1), float(rng.randint(0, 40)), rng.random() < 0.7) for g in "ab" for _ in range(50)]
    found = {r.g: r for r in metrics.multitask_losses(spark.createDataFrame(rows, LOSSES), *ARGS, {"solved": 2.0, "regressed": 0.5, metrics.REMAINING: 1.0}).collect()}
    for g in "ab":
        own, losses = [r for r in rows if r[0] == g], {}
        for i, name in enumerate(("solved", "regressed")):
            each = [math.log1p(math.exp(r[1][i])) - r[1][i] * r[2][i] for r in own if r[3][i]]
            if each:
                losses[name] = float(np.mean(each))
        far = [abs(r[4] - math.log1p(r[5])) for r in own if r[6]]
        losses[metrics.REMAINING] = float(np.mean([0.5 * d * d if d < 1 else d - 0.5 for d in far]))
        weights = {"solved": 2.0, "regressed": 0.5, metrics.REMAINING: 1.0}
        total = sum(losses[k] * weights[k] for k in losses) / sum(weights[k] for k in losses)
        assert found[g].losses.keys() == losses.keys() and all(abs(found[g].losses[k] - v) < 1e-9 for k, v in losses.items())
        assert abs(found[g].total - total) < 1e-9 and found[g].fault is None and found[g].active["regressed"] == sum(r[3][1] for r in own)


def test_faults_of_masked_losses(spark):
    good = [[0.5, -1.0], [1.0, 0.0], [True, True], 0.3, 2.0, True]
    rows = [("good", *good)]
    for name, at, value in (("nan", 0, [float("nan"), 1.0]), ("range", 1, [1.5, 0.0]), ("null", 0, None), ("negative", 4, -1.0), ("infinite", 3, float("inf"))):
        rows.append((name, *[value if i == at else x for i, x in enumerate(good)]))
    rows += [("idle", *good[:2], [False, False], 0.1, -5.0, False), ("masked", [float("nan"), 1.0], [9.0, 1.0], [False, True], 0.1, None, False), ("null mask", *good[:2], None, 0.1, 1.0, None)]
    found = {r.g: (r.fault, r.total is None) for r in metrics.multitask_losses(spark.createDataFrame(rows, LOSSES), *ARGS).collect()}
    bad = ("bad_value", True)
    assert found == {"good": (None, False), "nan": bad, "range": bad, "null": bad, "negative": bad, "infinite": bad, "idle": ("no_active_task", True), "masked": (None, False), "null mask": ("no_active_task", True)}
    for weights in ({"solved": 1.0}, {"solved": -1.0, "regressed": 1.0, metrics.REMAINING: 1.0}, {"solved": 0.0, "regressed": 0.0, metrics.REMAINING: 0.0}):
        with pytest.raises(ValueError, match="weights"):
            metrics.multitask_losses(spark.createDataFrame(rows, LOSSES), *ARGS, weights)
