"""Operator 6: n-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of distinct 3-word shingles reaches a threshold.

* Documents with the same set form one class (128-bit sum of the set); only its smallest id goes on.
* All sets are ordered alike: shingles that are frequent by a heavy-hitter summary last, then by hash.  With a
  threshold t, a set of n has the l-prefix of its first n - ceil(t n) + l shingles, and two sets over the threshold share
  at least min(l, l') shingles of their prefixes.  Each document takes the l of the least estimated cost: shingle
  postings to read, and candidates to verify, at most (postings / l).
* Stars first: each document meets only the most central document of each posting list.  After these links are closed,
  only documents of different components meet, by tokens that can be the first they share; a pair is counted on both
  prefixes before it is verified.  So a group of near copies costs about its size and not its square, and still no link
  between components is missed.
* Candidates are verified on whole sets; shingles are equal by 64 hash bits, whole sets by 128.

Nulls, empty texts and texts of white space have an empty set and link with nothing; rows of one id with different texts
each have their own; rows without an id are left out; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordhash as W
from .common import components, cut, small_side, text_batches

SHINGLE = 3
PERCENT = 90
#: Choices of l; the cost model weighs verifying one candidate as so many postings read.
MATCHES, VERIFY_COST = (1, 2, 4, 8, 16), 30
#: So many partners of one document are verified by one task.
SHARE = 500
#: At most so many shingles are ordered as frequent (a broadcast of 16 bytes each); others keep their hash order.
FREQUENT = 1 << 17
#: A task sums shingle counts over so many shingles before it passes on those it met twice or more.
CHUNK = 2_000_000


def shingle_sets(texts: pa.Array, k: int):
    """(row, sorted distinct shingle hashes) of each row; words are lower-cased A-Z."""
    for b in W.blocks(texts):
        words = W.FIRST.spans(b.data, b.starts, b.ends, True)
        grams = W.FIRST.grams(words, k)
        for i in range(len(b)):
            lo, hi = int(b.first[i]), int(b.first[i + 1])
            if hi - lo >= k:
                found = np.sort(grams[lo : hi - k + 1])
                yield b.row + i, found[np.concatenate(([True], found[1:] != found[:-1]))]
            else:
                yield b.row + i, W.FIRST.grams(words[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64)


def _frequent(batches, k: int):
    """Shingles met twice or more within a chunk of distinct sets of this task, with counts."""
    def flush(kept):
        values, counts = np.unique(np.concatenate(kept), return_counts=True)
        twice = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(values[twice].view(np.int64)), pa.array(counts[twice])], names=["token", "c"])

    kept, total, seen = [], 0, set()
    for batch in W.slices(batches):
        for _, s in shingle_sets(W.column(batch, "text"), k):
            if len(s) and (sign := (len(s), int(s.sum()))) not in seen:
                seen.add(sign)
                kept.append(s)
                total += len(s)
                if total >= CHUNK:
                    yield flush(kept)
                    kept, total, seen = [], 0, set()
    if kept:
        yield flush(kept)


def _prefixes(batches, k: int, percent: int, frequent):
    tokens, counts = frequent.value
    for batch in W.slices(batches):
        ids, out = W.column_long(batch, "id"), []
        for row, s in shingle_sets(W.column(batch, "text"), k):
            n = len(s)
            sign = (int(s.sum()), int(W.mix(s ^ np.uint64(0x9E3779B97F4A7C15)).sum())) if n else (0, 0)
            size = min(n, n - (n * percent + 99) // 100 + max(MATCHES))
            df = np.zeros(n, np.int64)
            if len(tokens) and n:
                at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                df = np.where(tokens[at] == s, counts[at], 0)
            # in order: those not frequent by hash, then the frequent by count
            prefix = s[np.argsort(df, kind="stable")[:size]] if df.any() else s[:size]
            out.append((ids[row], n, sign, prefix))
        signed = lambda j: pa.array(np.array([x[2][j] for x in out], np.uint64).view(np.int64))
        flat = np.concatenate([x[3] for x in out]) if out else np.zeros(0, np.uint64)
        at = np.concatenate(([0], np.cumsum([len(x[3]) for x in out]))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), signed(0), signed(1), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))],
            names=["id", "n", "sign_a", "sign_b", "prefix"],
        )


def _sets(batches, k: int, keep=()):
    for batch in W.slices(batches):
        sets = [s for _, s in shingle_sets(W.column(batch, "text"), k)]
        at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
        items = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).view(np.int64)))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], batch.column("id"), items], names=[*keep, "id", "items"])


def _verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b), an already written table, whose whole sets are similar enough.

    A document with very many partners is dealt out in shares of SHARE partners, each with a copy of its set."""
    sets = partial(_sets, k=k)
    shares = cut(pairs.groupBy("a").agg(((F.count("*") - 1) / SHARE).cast("int").alias("last")), "op6-shares")
    dealt = pairs.join(small_side(shares), "a").select("a", F.col("b").alias("id"), F.pmod(F.xxhash64("b"), F.col("last") + 1).cast("int").alias("share"))
    seconds = docs.join(small_side(cut(dealt, "op6-dealt")), "id").select("a", "share", "id", "text")
    seconds = seconds.mapInArrow(partial(sets, keep=("a", "share")), "a long, share int, id long, items array<long>")
    seconds = seconds.select("a", "share", F.col("id").alias("b"), F.col("items").alias("items_b"))
    firsts = docs.join(small_side(shares.select(F.col("a").alias("id"), "last")), "id").select("last", "id", "text")
    firsts = firsts.mapInArrow(partial(sets, keep=("last",)), "last int, id long, items array<long>")
    firsts = firsts.select(F.col("id").alias("a"), F.col("items").alias("items_a"), F.explode(F.sequence(F.lit(0), "last")).alias("share"))
    common = F.size(F.array_intersect("items_a", "items_b")).cast("long")
    return seconds.join(firsts, ["a", "share"]).where((100 + percent) * common >= percent * (F.size("items_a") + F.size("items_b"))).select("a", "b")


def prefix_rows(reps: DataFrame, percent: int) -> DataFrame:
    """Rows (id, n, l, centre, token, pos) of the tokens that occur in two or more prefixes, of each document's own
    l-prefix: pos, the token's place in its set's order; centre, the share of such tokens in the longest prefix."""
    rows = reps.select("id", F.posexplode("prefix").alias("pos", "token"))
    df = cut(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "op6-df")
    rows = rows.join(df, "token").join(reps.select("id", "n", F.size("prefix").alias("size")), "id")
    one, least = Window.partitionBy("id"), f"((n * {percent} + 99) div 100)"  # an overlap that links is at least this
    within = lambda k: F.sum(F.expr(f"if(pos < n - {least} + {k}, df - 1, 0)")).over(one)
    options = [F.when(F.expr(f"{k} <= {least}"), F.struct((within(k) * (1 + VERIFY_COST / k)).alias("cost"), F.lit(k).alias("l"))) for k in MATCHES]
    rows = rows.select(
        "id", "n", "token", "pos", "size", F.array_min(F.array_compact(F.array(*options)))["l"].alias("l"),
        F.count("*").over(one).alias("c"),
    )
    # Two sets over the threshold share max(MATCHES) tokens of their longest prefixes, or all that the overlap has.
    rows = rows.where(f"c >= least({max(MATCHES)}, {least}) and pos < n - {least} + l")
    return rows.select("id", "n", F.expr("cast(l as int)").alias("l"), F.expr("cast(1000 * c div size as int)").alias("centre"), "token", "pos")


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: id (named ``id``), n_shingles, component_id."""
    spark = docs.sparkSession
    docs = text_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    top = (
        docs.select("text").mapInArrow(partial(_frequent, k=k), "token long, c long")
        .groupBy("token").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "token").limit(FREQUENT).toPandas()
    )
    tokens, counts = top["token"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    order = np.argsort(tokens)
    frequent = spark.sparkContext.broadcast((tokens[order], counts[order]))
    signed = cut(
        docs.mapInArrow(partial(_prefixes, k=k, percent=percent, frequent=frequent), "id long, n long, sign_a long, sign_b long, prefix array<long>"), "op6-signed"
    )
    classes = cut(signed.groupBy("n", "sign_a", "sign_b").agg(F.min("id").alias("rep")), "op6-classes")
    reps = signed.join(small_side(classes.where("n > 0").select(F.col("rep").alias("id"))), "id", "left_semi")
    rows = cut(prefix_rows(reps, percent), "op6-rows")

    links = cut(_verify(cut(_stars(rows, percent), "op6-stars"), docs, k, percent), "op6-star-links")
    label = cut(components(links), "op6-labels").withColumnRenamed("component", "label")
    rows = rows.join(small_side(label), "id", "left").withColumn("label", F.coalesce("label", "id"))
    rest = cut(_crossing(rows, percent), "op6-crossing")
    rest = cut(_verify(rest, docs, k, percent), "op6-links")
    joined = cut(components(links.unionByName(rest)), "op6-joined") if rest.limit(1).count() else label.withColumnRenamed("label", "component")
    # copies follow their class's smallest id
    of_class = classes.join(small_side(joined.withColumnRenamed("id", "rep")), "rep", "left").select("n", "sign_a", "sign_b", F.coalesce("component", "rep").alias("class_component"))
    of_class = cut(of_class, "op6-class-labels")
    return signed.select("id", "n", "sign_a", "sign_b").join(of_class, ["n", "sign_a", "sign_b"]).select(
        "id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class_component")).otherwise(F.col("id")).alias("component_id")
    )


def _stars(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of a document and the most central of a posting list, that share half of the smaller prefix or more.

    The most central has the fewest tokens of its own: the original among its edited copies."""
    hub = rows.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct((-F.col("centre")).alias("far"), "id", "n")).alias("hub")).where("c > 1")
    hub = cut(hub.selectExpr("token", "hub.id as hub", "hub.n as hub_n"), "op6-hubs")
    pairs = rows.join(hub, "token").where(f"id <> hub and 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)")
    pairs = pairs.groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("c"), F.first(F.expr("least(n, hub_n)")).alias("n"))
    return pairs.where(f"2 * c >= n - (n * {percent} + 99) div 100").select("a", "b")


def _crossing(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share as many prefix tokens as their prefixes require.

    Two sets of n and n' link when they share ``over`` = ceil(t (n + n') / (1 + t)) shingles or more.  Then at least so many
    stand from the first shared one on, in either order, so only documents that both have so many left meet by a token.
    A list's hub is its most central document; one of any two components differs from the hub's, so only such
    documents look for partners.  A met pair must share ``over`` less what the ends of the sets, behind the prefixes, can
    add at most: the longer the prefix a document took, the more."""
    least = f"((n * {percent} + 99) div 100)"
    heads = rows.withColumn("rest", F.col("n") - F.col("pos")).where(f"{100 + percent} * rest >= {percent} * (n + {least})")
    lists = heads.groupBy("token").agg(
        F.min(F.struct((-F.col("centre")).alias("far"), "id", "label")).alias("hub"), F.min("label").alias("lo"), F.max("label").alias("hi"),
        F.max("rest").alias("most_rest"), F.min("n").alias("least_n"),
    )
    lists = cut(lists.where("lo <> hi").selectExpr("token", "hub.label as hub", "most_rest", "least_n"), "op6-lists")
    heads = cut(heads.join(lists, "token").select("token", "id", "n", "label", "rest", "hub", "most_rest", "least_n"), "op6-heads")
    enough = lambda rest, total: f"{100 + percent} * least({rest}) >= {percent} * ({total})"
    seekers = heads.where("label <> hub and " + enough("rest, most_rest", f"n + greatest(least_n, {least})")).select("token", "id", "n", "label", "rest", "hub")
    pairs = seekers.alias("x").join(heads.select("token", "id", "n", "label", "rest").alias("y"), "token")
    pairs = pairs.where(f"x.label <> y.label and (y.label = x.hub or x.id < y.id) and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
    pairs = pairs.where(enough("x.rest, y.rest", "x.n + y.n"))
    pairs = cut(pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct(), "op6-met")
    # the prefixes of the documents that met
    met = small_side(cut(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id"), "op6-met-ids"))
    own = rows.join(met, "id").groupBy("id").agg(F.collect_list("token").alias("own"), F.first("n").alias("n"), (F.first(F.expr(least)) - F.first("l")).alias("behind"))
    own = cut(own, "op6-prefixes")
    both = pairs.join(own.selectExpr("id a", "own own_a", "n n_a", "behind behind_a"), "a").join(own.selectExpr("id b", "own own_b", "n n_b", "behind behind_b"), "b")
    over = f"(({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent})"
    return both.where(f"size(array_intersect(own_a, own_b)) >= {over} - greatest(behind_a, behind_b)").select("a", "b")
