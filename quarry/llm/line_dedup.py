"""Operator 10: line dedup over overlapping windows of three lines.

A text's lines are its pieces between line feeds, without spaces, tabs and carriage returns at their ends; empty lines
stay and take no part.  A window is three consecutive lines (of those that take part) of one document.  A window also
found earlier (smaller id, or same document, earlier line) marks its three lines; marked lines go.  Windows are judged
on the input.  The first occurrence of every window is a grouped minimum (combined before the shuffle), and only
windows that occur again meet their documents.

Texts with fewer than three lines have no window and stay whole; a null text stays null (kept: empty); rows without an id are left out; repeated ids:
their rows share marks; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SPAN = 3


def repeated_positions(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(id, at): the windows that start at line ``at`` (from 0, all lines counted) of a document and also earlier."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(" \t\r")).alias("x")))
    lines = F.filter(lines, lambda s: s["x"] != "")
    slim = docs.select("id", F.transform(lines, lambda s: F.struct(s["at"].alias("at"), F.xxhash64(s["x"]).alias("a"), F.hash(s["x"]).alias("b"))).alias("l"))
    each = F.transform(F.sequence(F.lit(1), F.size("l") - (span - 1)), lambda i: F.slice("l", i, span))
    # outer: Spark then infers no filter that would make the windows twice
    windows = slim.select("id", F.when(F.size("l") >= span, each).alias("w")).select("id", F.explode_outer("w").alias("w")).where("w is not null")
    lines_at = F.transform("w", lambda x: x["at"])
    rows = windows.select(
        "id", lines_at.alias("lines"), F.xxhash64(*[F.col("w")[j]["a"] for j in range(span)]).alias("h"), F.hash(*[F.col("w")[j]["b"] for j in range(span)]).alias("g")
    )
    rows = cut(rows.select("h", "g", "id", F.col("lines")[0].alias("at"), F.array_max("lines").alias("last"), "lines"), "op10-windows")
    first = rows.groupBy("h", "g").agg(F.count("*").alias("c"), F.min(F.struct("id", "at")).alias("first")).where("c > 1").select("h", "g", "first")
    first = cut(first, "op10-first")  # a table of its own, so that Spark can split a window that very many lines share
    return rows.join(first, ["h", "g"]).where("struct(id, at) <> first").select("id", "lines")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """One row per document: id, n_lines, n_removed, kept (its lines that stay, as they were)."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    marks = repeated_positions(docs, span).groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone"))
    both = docs.join(marks, "id", "left").withColumn("lines", F.split("text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")  # by a hash set: linear in the lines
    kept = F.transform(stay, lambda i: F.get("lines", i))
    return both.select(
        "id", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")).alias("kept"),
    )


ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
own AS (
  SELECT doc_id, pos, x, row_number() OVER w AS i, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2, lead(pos, 1) OVER w AS pos1, lead(pos, 2) OVER w AS pos2
  FROM (SELECT doc_id, pos, trim(raw, ' ' || chr(9) || chr(13)) AS x FROM lines) WHERE x <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
marked AS (
  SELECT doc_id, pos, pos1, pos2 FROM (SELECT *, row_number() OVER (PARTITION BY x, x1, x2 ORDER BY doc_id, pos) AS n FROM own WHERE x2 IS NOT NULL) WHERE n > 1),
gone AS (
  SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, pos FROM marked UNION ALL SELECT doc_id, pos1 FROM marked UNION ALL SELECT doc_id, pos2 FROM marked)),
kept AS (
  SELECT l.doc_id, string_agg(l.raw, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS kept, count(*) AS n_lines, count(g.pos) AS n_removed
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
