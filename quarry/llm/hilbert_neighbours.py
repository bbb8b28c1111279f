"""Operator 5: nearest neighbours on shifted space-filling curves, completed to the exact answer.

Equal vectors form one entry (with its smallest ids, as many as an answer can hold).  Each of ``curves`` curves
projects all entries to a few random orthogonal directions, shifts them and orders them by their Hilbert key.  Spark range-partitions
(curve, key) and numbers the entries of each curve in order.  An entry's number gives its block of the curve;
a query goes to the blocks that its window of 2 * reach + 1 neighbours touches, and keeps the nearest of them by
8-bit copies of the vectors.  The windows of all curves merge, and the exact distance of the k-th best of them bounds the query's
answer: nothing farther can belong to it.

Then all entries, in the order of one finer curve, are read in runs.  A query leaves out a run only where the ball around the run
lies wholly beyond its bound; in the others every entry within the bound is ranked by its original components.  The answer is
exact whatever the table's size and groups; windows and 8-bit copies only decide how much is left out.  Vectors with
structure leave out most runs; for vectors without (independent directions in 64 dimensions) every query meets every entry.

Numbers, not keys, cut the blocks, so they all have the same size whatever the keys are.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part; of rows of one
id the least vector stands; an empty table, or one without queries, gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_side

CURVES, REACH, DIMENSIONS, BITS, SEED = 12, 512, 10, 2, 7
BLOCK = 4096
NEAREST = 10
#: Neighbours of a query that a curve passes on, and that are ranked exactly, by distance of the 8-bit copies.
PASSED, RANKED = 24, 40
#: Bits of the curve that orders the entries for the exact pass, entries of a run, bytes of query vectors that one pass holds.
FINE_BITS, RUN, ROUND_BYTES = 6, 256, 8 << 20
#: Pairs whose components are compared at a time.
PAIRS = 16_384


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of cell numbers below 2**bits, as unsigned 64-bit numbers.

    Gray-code walk from the highest bit down: at each level the cell's quadrant is read in the current frame, and the
    frame is reflected and turned for the level below (J. Skilling, "Programming the Hilbert curve", 2004)."""
    x = cells.astype(np.uint32).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = np.uint32((1 << level) - 1)
        for i in range(n):
            set_here = (x[i] >> np.uint32(level)) & np.uint32(1)
            swap = np.where(set_here, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_here, low, swap)
            x[i] ^= swap
    x = np.bitwise_xor.accumulate(x, axis=0)
    turn = np.zeros(x.shape[1], np.uint32)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> np.uint32(level)) & np.uint32(1), np.uint32((1 << level) - 1), np.uint32(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint32(level)) & np.uint32(1)).astype(np.uint64)
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _curve_keys(full: np.ndarray, rng: np.random.Generator, dims: int, bits: int, centre, spread) -> np.ndarray:
    """The entries' keys on the next curve of rng."""
    axes = np.linalg.qr(rng.standard_normal((full.shape[1], full.shape[1])))[0][:, :dims]
    shift = rng.uniform(-0.5, 0.5, axes.shape[1])  # in cells
    y = (full - centre) @ axes / spread  # about one standard deviation is one
    cells = np.clip(np.floor((y + 2) / 4 * (1 << bits) + shift), 0, (1 << bits) - 1)
    return hilbert_keys(cells, bits).astype(np.int64)


def _keys(batches, curves: int, dims: int, bits: int, seed: int, centre, spread):
    """(curve, key, id, code, scale) of each entry on each curve; the code has a byte for each component."""
    for batch in batches:
        ids, full = batch.column("id"), _matrix(batch.column("v"))
        if not len(full):
            continue
        scale = np.maximum(np.abs(full).max(axis=1), 1e-300) / 127
        code = np.rint(full / scale[:, None]).astype(np.int8)
        at = np.arange(0, code.size + 1, code.shape[1], dtype=np.int32)
        codes = pa.Array.from_buffers(pa.binary(), len(code), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(code))])
        rng = np.random.Generator(np.random.PCG64(seed))
        for curve in range(curves):
            key = _curve_keys(full, rng, dims, bits, centre, spread)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), curve, np.int32)), pa.array(key), ids, codes, pa.array(scale)], names=["curve", "key", "id", "code", "scale"])


def _fine_keys(batches, dims: int, seed: int, centre, spread):
    """(key, id, v) of each entry on one curve of FINE_BITS bits."""
    for batch in batches:
        full = _matrix(batch.column("v"))
        if len(full):
            key = _curve_keys(full, np.random.Generator(np.random.PCG64(seed)), dims, FINE_BITS, centre, spread)
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column("id"), batch.column("v")], names=["key", "id", "v"])


def _numbered(batches):
    """Adds (part, number of the row within its part)."""
    part, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        rows = pa.array(np.arange(n, n + batch.num_rows))
        n += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), rows], names=[*batch.schema.names, "part", "row"])


def _near(table: pa.Table, reach: int, passed: int) -> pa.Table:
    """The nearest of one block to each query that reaches it, by the 8-bit copies."""
    kind, number, ids, scale = (table[c].to_numpy() for c in ("asks", "number", "id", "scale"))
    code = np.frombuffer(b"".join(table["code"].to_pylist()), np.int8).reshape(len(ids), -1).astype(np.float32) * scale[:, None].astype(np.float32)
    here = np.flatnonzero(~kind)
    here = here[np.argsort(number[here], kind="stable")]
    order, vectors = number[here], code[here]
    norms = (vectors * vectors).sum(axis=1)
    out_q, out_c, out_d = [], [], []
    for q in np.flatnonzero(kind):
        lo, hi = np.searchsorted(order, (number[q] - reach, number[q] + reach + 1))
        d = norms[lo:hi] - 2 * (vectors[lo:hi] @ code[q])
        d[order[lo:hi] == number[q]] = np.inf  # itself
        best = np.argpartition(d, passed)[:passed] if len(d) > passed else np.arange(len(d))
        best = best[np.isfinite(d[best])]
        out_q.append(np.full(len(best), ids[q]))
        out_c.append(ids[here[lo + best]])
        out_d.append(d[best])
    join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    return pa.table({"query": join(out_q, np.int64), "id": join(out_c, np.int64), "d": join(out_d, np.float64)})


def _complete(batches, asked, k: int):
    """(query, id, score) of the entries that may be among the k nearest of each query of ``asked`` (ids, vectors, bounds).

    Products find the pairs within a bound, with a margin for their rounding; these are compared component by component
    in order, as Spark's sum would."""
    queries, q, limit = asked.value
    limit = limit.copy()
    for batch in batches:
        ids, full = batch.column("id").to_numpy(), _matrix(batch.column("v"))
        rounding = 4 * (full.shape[1] + 4) * 2.0**-53
        for start in range(0, len(ids), RUN):
            v, own = full[start : start + RUN], ids[start : start + RUN]
            middle = v.mean(axis=0)
            near, at = v - middle, q - middle
            size, far = (near * near).sum(axis=1), (at * at).sum(axis=1)
            # beyond the ball: left out; the comparisons are so that a NaN (overflow) is not
            met = np.flatnonzero(~(np.sqrt(far) * (1 - rounding) - np.sqrt(size.max()) * (1 + rounding) > limit * (1 + 1e-12)))
            for some in np.array_split(met, max(1, -(-len(met) * len(v) // (1 << 21)))):
                if not len(some):
                    continue
                d = size + far[some, None] - 2 * (at[some] @ near.T)
                margin = rounding * (np.sqrt(size.max()) + np.sqrt(far[some])) ** 2
                d[own == queries[some, None]] = np.inf  # itself
                most = limit[some] ** 2 * (1 + 1e-12)
                if len(v) > k:
                    most = np.fmin(most, np.partition(d, k - 1, axis=1)[:, k - 1] + margin)
                row, col = np.nonzero(~(d > (most + margin)[:, None]) & (own != queries[some, None]))
                score = np.zeros(len(row))
                for i in range(0, len(row), PAIRS):
                    apart = v[col[i : i + PAIRS]] - q[some[row[i : i + PAIRS]]]
                    apart *= apart
                    for j in range(apart.shape[1]):
                        score[i : i + PAIRS] += apart[:, j]
                score = np.sqrt(score)
                order = np.lexsort((own[col], score, row))
                row, col, score = row[order], col[order], score[order]
                first = np.concatenate(([0], np.flatnonzero(np.diff(row)) + 1)) if len(row) else np.zeros(0, int)
                place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
                last = place == k - 1
                limit[some[row[last]]] = np.fmin(limit[some[row[last]]], score[last])
                keep = (place < k) & ~(score > limit[some[row]])
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(queries[some[row[keep]]]), pa.array(own[col[keep]]), pa.array(score[keep])], names=["query", "id", "score"])


def nearest(
    vectors: DataFrame, queries: str, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST,
    curves: int = CURVES, reach: int = REACH, dims: int = DIMENSIONS, bits: int = BITS, seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by Euclidean distance of each row that satisfies ``queries``
    (an expression over ``id``), itself left out, ties to the smaller id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(sound)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = lengths["n"]
    rows = cut(rows.where(F.size("v") == width).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))), "op5-rows")  # -0.0 becomes 0.0
    twice = cut(rows.groupBy("id").count().where("count > 1").select("id"), "op5-twice")
    if not twice.isEmpty():
        one = rows.join(small_side(twice), "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
        rows = cut(rows.join(small_side(twice), "id", "left_anti").unionByName(one), "op5-single")
    # entries: distinct vectors; an answer needs the k + 1 smallest ids of each at most
    members = rows.withColumn("h", F.xxhash64("v")).withColumn("g", F.hash("v"))
    entry = members.groupBy("h", "g").agg(F.min("id").alias("entry"))
    of = cut(members.select("id", "h", "g").join(entry, ["h", "g"]).select("id", "entry"), "op5-of")
    several = of.groupBy("entry").agg(F.count("*").alias("c")).where("c > 1").select("entry")
    copies = of.join(several, "entry", "left_semi").where("id <> entry")
    copies = cut(_first(copies, "entry", ("id",), k + 1), "op5-copies")
    entries = rows.join(of.where("id = entry").select("id"), "id", "left_semi")

    moments = entries.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.var_pop("x").alias("s")).orderBy("i").collect()
    centre, spread = np.array([x["m"] for x in moments]), float(np.sqrt(np.mean([x["s"] for x in moments]))) or 1.0
    make = partial(_keys, curves=curves, dims=min(dims, width), bits=bits, seed=seed, centre=centre, spread=spread)
    placed = entries.mapInArrow(make, "curve int, key long, id long, code binary, scale double")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartitionByRange(parts, "curve", "key", "id").sortWithinPartitions("curve", "key", "id")
    placed = cut(placed.mapInArrow(_numbered, "curve int, key long, id long, code binary, scale double, part int, row long"), "op5-placed")
    sizes, starts, total = placed.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect(), [], 0
    for part, n in sizes:  # one row for each partition
        starts.append((part, total))
        total += n
    n_entries = total // curves
    placed = placed.join(F.broadcast(spark.createDataFrame(starts, "part int, start long")), "part")
    placed = placed.select("curve", "id", "code", "scale", (F.col("start") + F.col("row") - F.col("curve").cast("long") * n_entries).alias("number"))
    asked = of.where(F.expr(queries)).select(F.col("entry").alias("id")).distinct()
    asking = placed.join(small_side(cut(asked, "op5-asked")), "id", "left_semi")
    lo, hi = F.expr(f"greatest(number - {reach}, 0) div {BLOCK}"), F.expr(f"least(number + {reach}, {max(n_entries - 1, 0)}) div {BLOCK}")
    asking = asking.select("*", F.lit(True).alias("asks"), F.explode(F.sequence(lo, hi)).alias("block"))
    blocks = placed.select("*", F.lit(False).alias("asks"), F.expr(f"number div {BLOCK}").alias("block")).unionByName(asking)

    def near(table: pa.Table) -> pa.Table:
        return _near(table, reach, PASSED)

    found = blocks.groupBy("curve", "block").applyInArrow(near, "query long, id long, d double")
    found = _first(found.groupBy("query", "id").agg(F.min("d").alias("d")), "query", ("d", "id"), RANKED)
    found = cut(found.select("query", "id"), "op5-found")

    # the exact distance of the k-th best found bounds each query's answer
    wanted = small_side(cut(found.select("id").union(found.select("query")).distinct(), "op5-wanted"))
    originals = cut(entries.join(wanted, "id", "left_semi"), "op5-originals")
    pairs = found.join(originals, "id").join(originals.select(F.col("id").alias("query"), F.col("v").alias("q")), "query")
    pairs = pairs.select("query", "id", F.sqrt(F.aggregate(F.zip_with("v", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)).alias("score"))
    bounds = _first(pairs, "query", ("score", "id"), k).groupBy("query").agg(F.count("*").alias("c"), F.max("score").alias("bound")).where(f"c = {k}")
    bounded = entries.join(small_side(asked), "id", "left_semi").withColumnRenamed("id", "query").join(bounds, "query", "left")
    bounded = cut(bounded.select("query", "v", F.coalesce("bound", F.lit(float("inf"))).alias("bound")), "op5-bounded")

    # every entry within the bound, then the ids that carry them
    ordered = entries.mapInArrow(partial(_fine_keys, dims=min(dims, width), seed=seed, centre=centre, spread=spread), "key long, id long, v array<double>")
    ordered = ordered.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id").select("id", "v")
    ordered, exact = cut(ordered, "op5-ordered"), []
    rounds = max(1, -(-bounded.count() * 8 * width // ROUND_BYTES))
    for i in range(rounds):
        some = bounded.where(F.pmod(F.xxhash64("query"), F.lit(rounds)) == i).toArrow()
        if not len(some):
            continue
        held = spark.sparkContext.broadcast((some["query"].to_numpy(), np.array(some["v"].to_pylist()), some["bound"].to_numpy()))
        exact.append(cut(ordered.mapInArrow(partial(_complete, asked=held, k=k), "query long, id long, score double"), "op5-exact"))
        held.unpersist()
    pairs = asked.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("score")).limit(0)
    for part in exact:
        pairs = pairs.unionByName(part)
    pairs = _first(pairs, "query", ("score", "id"), k)
    pairs = pairs.unionByName(asked.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("score")))  # copies of the query
    ids = pairs.select("query", F.col("id").alias("entry"), "score").withColumn("vec_id", F.col("entry"))
    more = pairs.select("query", F.col("id").alias("entry"), "score").join(copies.select("entry", F.col("id").alias("vec_id")), "entry")
    ids = ids.unionByName(more.select(*ids.columns)).select("query", "score", "vec_id")
    ids = _first(ids, "query", ("score", "vec_id"), k + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    ids = cut(ids, "op5-answers")
    answers = of.where(F.expr(queries)).select(F.col("id").alias("query_id"), F.col("entry").alias("query")).join(ids, "query")
    mine = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    answers = answers.select("query_id", F.posexplode(F.slice(mine, 1, k)).alias("i", "x"))
    return answers.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _first(rows: DataFrame, key: str, order: tuple[str, ...], n: int) -> DataFrame:
    """The first n rows of each key.  Spark limits each task's rows of a key before it shuffles them."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("place", place).where(f"place <= {n}").drop("place")
