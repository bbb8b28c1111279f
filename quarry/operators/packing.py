"""Packing of token sequences: seeded best-fit plan by buckets, ranks, packed arrays, and their figures."""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import numbered

ALIGN = 16
PLAN = "bucket long, pack long, place int, sample_id string, length int, real_tokens int, aligned_tokens int"


def aligned(n: Column, to: int = ALIGN) -> Column:
    return n + F.pmod(-n, F.lit(to))


def epoch_seed(namespace: str, seed: int, epoch: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{namespace}:{seed}:{epoch}".encode("ascii")).digest()[:8], "big")


def best_fit(lengths: list[int], room: int) -> list[int]:
    """Bin of each length, in the given order: the fullest bin it fits, of equal ones the oldest; else a new one."""
    free: list[tuple[int, int]] = []  # (free space, bin) of the open bins, sorted
    out, bins = [], 0
    for n in lengths:
        at = bisect_left(free, (n, -1))
        space, i = free.pop(at) if at < len(free) else (room, bins)
        bins += i == bins
        if space > n:
            insort(free, (space - n, i))
        out.append(i)
    return out


def chunked(samples: DataFrame, size: int) -> DataFrame:
    """Samples (sample_id, length) longer than ``size`` as numbered chunks ``sample_id/0``, ``sample_id/1``, ... of at most that
    length; empty ones and ones without a length are left out."""
    n = F.ceil(F.col("length") / size)
    rows = samples.where("length > 0").select("sample_id", "length", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    return rows.select(
        F.when(F.col("n") == 1, F.col("sample_id")).otherwise(F.concat_ws("/", "sample_id", "chunk")).alias("sample_id"),
        F.least(F.col("length") - F.col("chunk") * size, F.lit(size)).cast("int").alias("length"),
    )


def token_budget_plan(samples: DataFrame, max_tokens: int, align: int = ALIGN, seed: int = 20260904, epoch: int = 0, bucket_size: int = 2048) -> DataFrame:
    """Packs of samples (sample_id, length) within max_tokens.

    A seeded hash order deals the samples into buckets of bucket_size; each bucket is packed by itself, longest
    first (ties: sample_id).  Buckets are independent tasks; the order of packs and members is a seeded hash order too.
    A length outside 1 .. max_tokens raises."""
    if max_tokens <= 0 or max_tokens % align:
        raise ValueError("max_tokens must be a positive multiple of the alignment")
    salt = epoch_seed("quarry-token-budget", seed, epoch)
    fits = F.when(F.col("length").between(1, max_tokens), F.col("length")).otherwise(F.raise_error(F.lit("a length is outside 1 .. max_tokens")).cast("int"))
    order = F.xxhash64("sample_id", F.lit(salt % (1 << 62)))
    dealt, _ = numbered(samples.select("sample_id", fits.cast("int").alias("length"), order.alias("order")), ["order", "sample_id"])
    dealt = dealt.select("sample_id", "length", F.floor(F.col("row_no") / bucket_size).alias("bucket"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "sample_id"], ascending=[False, True], ignore_index=True)
        rng = random.Random(f"{salt}:{rows['bucket'].iloc[0]}")
        rows["pack"] = best_fit(rows["length"].tolist(), max_tokens)
        rows["place"] = [rng.random() for _ in range(len(rows))]
        rows["place"] = rows.groupby("pack")["place"].rank(method="first").astype("int32") - 1
        rows["real_tokens"] = rows.groupby("pack")["length"].transform("sum").astype("int32")
        rows["aligned_tokens"] = rows["real_tokens"] + (-rows["real_tokens"]) % align
        return rows[["bucket", "pack", "place", "sample_id", "length", "real_tokens", "aligned_tokens"]]

    return dealt.groupBy("bucket").applyInPandas(pack, PLAN)


def rank_rows(packs: DataFrame, order: list[str], world: int) -> DataFrame:
    """Numbered packs with their rank; the last packs that do not fill a round are marked dropped."""
    rows, n = numbered(packs, order)
    return rows.withColumn("rank", F.col("row_no") % world).withColumn("dropped", F.col("row_no") >= n - n % world)


def causal(ids: Column, weights: Column) -> Column:
    """struct(inputs, targets, weights): all but the last, all but the first, and the targets' weights."""
    n = F.size(ids)
    return F.struct(F.slice(ids, 1, n - 1).alias("inputs"), F.slice(ids, 2, n - 1).alias("targets"), F.slice(weights, 2, n - 1).alias("weights"))


def pack_sequences(members: DataFrame, align: int = ALIGN, pad: int = 0) -> DataFrame:
    """One row per pack of causal sequences (pack, place, sample_id, ids, weights): flat streams, cumulative lengths, masks.

    The tail is padded to the alignment with target -100, weight 0, segment -1, and counts as a start."""
    seq = causal(F.col("ids"), F.col("weights"))
    rows = members.groupBy("pack").agg(F.sort_array(F.collect_list(F.struct("place", "sample_id", seq.alias("c")))).alias("m"))
    flat = lambda f: F.flatten(F.transform("m", f))
    rows = rows.select(
        "pack", F.transform("m", lambda x: x["sample_id"]).alias("sample_ids"), flat(lambda x: x["c"]["inputs"]).alias("i"), flat(lambda x: x["c"]["targets"]).alias("t"),
        flat(lambda x: x["c"]["weights"]).alias("w"), F.flatten(F.transform("m", lambda x, k: F.array_repeat(k, F.size(x["c"]["inputs"])))).alias("s"),
        F.transform("m", lambda x: F.size(x["c"]["inputs"])).alias("lengths"),
        F.flatten(F.transform("m", lambda x: F.transform(x["c"]["inputs"], lambda _, k: k == 0))).alias("b"),
    )
    tail = F.pmod(-F.size("i"), F.lit(align))
    padded = lambda c, v, t: F.concat(c, F.array_repeat(F.lit(v).cast(t), tail))
    sums = F.aggregate("lengths", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return rows.select(
        "pack", "sample_ids", padded("i", pad, "int").alias("input_ids"), padded("t", -100, "int").alias("target_ids"), padded("w", 0, "float").alias("loss_weights"),
        padded("s", -1, "int").alias("segment_ids"), F.concat("b", F.transform(F.array_repeat(F.lit(0), tail), lambda _, k: k == 0)).alias("starts"),
        sums.alias("cu_seqlens"), F.size("i").alias("real_tokens"), (F.size("i") + tail).alias("aligned_tokens"),
    )


def pack_violations(packs: DataFrame) -> DataFrame:
    """Names of the invariants that each packed row breaks."""
    n = F.size("input_ids")
    rules = {
        "length": (F.size("target_ids") != n) | (F.size("loss_weights") != n) | (F.size("segment_ids") != n) | (F.size("starts") != n),
        "alignment": (n % ALIGN != 0) | (n != F.col("aligned_tokens")) | (n - F.col("real_tokens") >= ALIGN),
        "cumulative": (F.element_at("cu_seqlens", 1) != 0) | (F.element_at("cu_seqlens", -1) != F.col("real_tokens")) | (F.size("cu_seqlens") != F.size("sample_ids") + 1),
        "padding": F.exists(F.arrays_zip("segment_ids", "target_ids", "loss_weights"), lambda x: (x["segment_ids"] < 0) & ((x["target_ids"] != -100) | (x["loss_weights"] != 0))),
        "starts": F.size(F.filter("starts", lambda x: x)) != F.size("sample_ids") + F.when(n > F.col("real_tokens"), 1).otherwise(0),
        "samples": F.size("sample_ids") != F.size(F.array_distinct("sample_ids")),
        "weights": F.exists("loss_weights", lambda x: (x < 0) | F.isnan(x)),
    }
    return packs.select("pack", F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])).alias("violations"))


def utilization(packs: DataFrame) -> DataFrame:
    """Totals of packs (n, longest, real_tokens, aligned_tokens): utilization against padding each sequence to the longest of its pack."""
    total = packs.agg(
        F.count("*").alias("packs"), F.sum("real_tokens").alias("real_tokens"), F.sum("aligned_tokens").alias("aligned_tokens"), F.sum(F.col("n") * F.col("longest")).alias("padded_tokens")
    )
    return total.withColumn("packed_utilization", F.col("real_tokens") / F.col("aligned_tokens")).withColumn("padded_utilization", F.col("real_tokens") / F.col("padded_tokens"))


def padded_rows(rows: DataFrame, width: int, pad: int = 0) -> DataFrame:
    """Causal sequences (sample_id, ids, weights), each padded on its own to ``width``; a longer one has no row of its own and is
    marked: input_ids, target_ids (-100 in the padding), loss_weights, real_tokens, fits."""
    c = causal(F.col("ids"), F.col("weights"))
    rows = rows.select("sample_id", c.alias("c")).withColumn("n", F.size("c.inputs"))
    fits, rest = F.col("n") <= width, F.greatest(F.lit(width) - F.col("n"), F.lit(0))
    filled = lambda x, v, kind: F.when(fits, F.concat(F.col(x), F.array_repeat(F.lit(v).cast(kind), rest)))
    return rows.select(
        "sample_id", filled("c.inputs", pad, "int").alias("input_ids"), filled("c.targets", -100, "int").alias("target_ids"), filled("c.weights", 0, "float").alias("loss_weights"),
        F.col("n").alias("real_tokens"), fits.alias("fits"),
    )
