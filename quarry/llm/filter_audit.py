"""Operator 12: audit of how filters interact, by a subset-zeta transform.

Each document gets a mask, one bit for each filter that it fails; the last filter fails texts that a smaller id has too.  The
counts of masks of each part (all rows, rows labelled good, rows labelled toxic) become, by one addition for each pair of masks that
differ in a filter, the survivors of every subset of filters.  A step of an order of the filters is then the difference of two
neighbouring subsets, and a filter's Shapley sum a weighted sum of such differences; no order is run over documents.

Copies share every bit but the last, so that bit is counted and not joined: of the rows of a text all but those of its
smallest id fail, and both counts are grouped sums that combine before the shuffle, however many copies a text has.

A null text is empty, a null part the empty string; rows without an id are left out; repeated ids are rows of their
own, all of which carry the labels of the id (a label that any of its rows in ``labels`` has); texts are compared by their SHA-256.
An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import partial
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .common import cut, text_batches

REPEATED = "E"
MEASURES = ("n", "good", "toxic")


_CAPITALS = bytes(range(65, 91))
_MARKS = re.compile(rb"[#$%&*|]")
Filter = Callable[[bytes, list[bytes]], bool]


def fails() -> dict[str, Filter]:
    """The filters on a text alone: whether a document fails, from its UTF-8 bytes and its words."""
    return {
        "A": lambda data, words: len(words) < 50,
        "B": lambda data, words: 100 * len(set(words)) < 65 * len(words),
        "C": lambda data, words: 100 * (len(data) - len(data.translate(None, _CAPITALS))) > 5 * len(data.decode()),
        "D": lambda data, words: _MARKS.search(data) is not None,
    }


def _judged(batches: Iterator[pa.RecordBatch], filters: tuple[Filter, ...]) -> Iterator[pa.RecordBatch]:
    for batch in W.slices(batches):
        digests, masks = [], []
        for text in batch.column("text").cast(pa.binary()):
            data = text.as_py()
            words = data.split()  # at the same six characters as the pattern
            digests.append(hashlib.sha256(data).digest())
            masks.append(sum(bool(f(data, words)) << i for i, f in enumerate(filters)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())], names=["id", "part", "digest", "mask"])


def masked(docs: DataFrame, labels: DataFrame, filters: dict[str, Filter], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """One row per id, text and mask of the filters on texts: id, digest, mask, parts (of each part the rows and the labelled rows)."""
    texts = text_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    slim = texts.where("id is not null").mapInArrow(partial(_judged, filters=tuple(filters.values())), "id long, part string, digest binary, mask int")
    marks = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(*[F.max((F.col(c) == 1).cast("long")).alias(m) for m, c in (("good", "quality"), ("toxic", "toxic"))])
    rows = slim.join(marks, "id", "left").groupBy("id", "digest", "mask", "part")
    rows = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES[1:]])
    # both groupings keep the join's partitions: they only gather the rows of an id
    return rows.groupBy("id", "digest", "mask").agg(F.array_sort(F.collect_list(F.struct("part", *MEASURES))).alias("parts"))


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Filter], id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: the rows that fail exactly the filters of ``mask``; its highest bit is that of repeated texts."""
    rows = cut(masked(docs, labels, filters, id_col, text_col, part_col), "op12-masks")
    spread = lambda df, mask: df.select(mask.alias("mask"), F.inline("parts")).groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES])
    again = F.col("mask").bitwiseOR(F.lit(1 << len(filters)))
    every = spread(rows, again)
    first = rows.groupBy("digest", "mask").agg(F.min(F.struct("id", "parts")).alias("first")).select("mask", "first.parts")
    first = cut(spread(first, F.col("mask")), "op12-first")
    less = first.select("part", again.alias("mask"), *[(-F.col(m)).alias(m) for m in MEASURES])
    return every.unionByName(first).unionByName(less).groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES])


def zeta(counts: str, bits: int) -> str:
    """SQL of the sums over all subsets of each mask: one round for each bit, each from the sums of the round before."""
    added = ", ".join(f"'{x}', acc[m].{x} + if(m >> b & 1 = 1, acc[m ^ shiftleft(1, b)].{x}, 0)" for x in MEASURES)
    return f"aggregate(sequence(0, {bits - 1}), {counts}, (acc, b) -> transform(sequence(0, {(1 << bits) - 1}), m -> named_struct({added})))"


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Filter] | None = None, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``filters``: functions of a text and its words, true where it fails; repeated texts come as the last filter, REPEATED."""
    filters = filters or fails()
    names = [*filters, REPEATED]
    bits, whole = len(names), (1 << len(names)) - 1
    # of each part at most 2 ** bits masks
    counts = mask_counts(docs, labels, filters, id_col, text_col, part_col).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*MEASURES)))).alias("of"))
    none = "named_struct('n', 0L, 'good', 0L, 'toxic', 0L)"
    counts = counts.withColumn("counts", F.expr(f"transform(sequence(0, {whole}), m -> coalesce(of[m], {none}))"))
    table = counts.withColumn("within", F.expr(zeta("counts", bits)))
    # survivors of a subset of filters: the masks within its complement
    table = table.select("part", "counts", F.expr(f"transform(sequence(0, {whole}), s -> within[{whole} ^ s])").alias("left"))
    weight = f"factorial(bit_count(s)) * factorial({bits - 1} - bit_count(s))"
    share = f"aggregate(sequence(0, {whole}), 0L, (a, s) -> a + if(s >> b & 1 = 1, 0L, {weight} * (left[s].n - left[s | shiftleft(1, b)].n)))"
    table = table.withColumn("shares", F.expr(f"transform(sequence(0, {bits - 1}), b -> {share})"))
    steps = [
        {"filter_order": "".join(names[x] for x in order), "step": step, "b": b, "done": sum(1 << x for x in order[: step - 1])}
        for order in permutations(range(bits)) for step, b in enumerate(order, 1)
    ]
    each = table.withColumn("s", F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, b: int, done: int>>")))
    each = each.select("*", "s.*").withColumns({"before": F.expr("left[done]"), "after": F.expr("left[done + shiftleft(1, b)]"), "own": F.expr("left[0].n - left[shiftleft(1, b)].n")})
    return each.selectExpr(
        "part", "filter_order", "step", "after.n as kept", "before.n - after.n as removed", "own - before.n + after.n as redundant", "counts[shiftleft(1, b)].n as unique_fails",
        "before.good - after.good as good_lost", "before.toxic - after.toxic as toxic_lost", "shares[b] as shapley",
    )


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents WHERE doc_id IS NOT NULL),
marked AS (
  SELECT part, (len(words) < 50)::INT AS A, (100 * len(list_distinct(words)) < 65 * len(words))::INT AS B,
    (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT AS C, regexp_matches(text, '[#$%&*|]')::INT AS D,
    (doc_id > min(doc_id) OVER (PARTITION BY text))::INT AS E, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
masks AS (
  SELECT part, concat(CASE WHEN A = 1 THEN 'A' ELSE '' END, CASE WHEN B = 1 THEN 'B' ELSE '' END, CASE WHEN C = 1 THEN 'C' ELSE '' END, CASE WHEN D = 1 THEN 'D' ELSE '' END, CASE WHEN E = 1 THEN 'E' ELSE '' END) AS failed,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM marked GROUP BY ALL),
orders AS (
  SELECT '' AS o UNION ALL SELECT o || l FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(o, l)),
steps AS (SELECT o AS filter_order, step::INT AS step, o[step] AS l, o[1:step - 1] AS done FROM orders, (SELECT unnest(range(1, 6)) AS step) WHERE len(o) = 5),
each AS (
  SELECT part, filter_order, step, l, n, good, toxic, failed, contains(failed, l) AS fails, regexp_matches(failed, '[' || done || '-]') AS gone FROM masks, steps),
summed AS (
  SELECT part, filter_order, step, l, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT fails), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE gone AND fails), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE failed = l), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND fails), 0)::BIGINT AS toxic_lost
  FROM each GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, l)::BIGINT AS shapley FROM summed
"""
