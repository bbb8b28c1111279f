"""Registered sources and looks into their files: identities from raw rows, point lookups, first rows, footers, previews."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..plans.policy import exact_keys
from ..scratch import read_text
from . import traces

SOURCE_KEYS = {"source_id", "adapter", "revision", "declared_license", "folder", "patterns"}
#: Columns that an identity needs, by adapter.
IDENTITY_COLUMNS = {
    "openthoughts_agent": ["task"], "open_swe_traces": ["repo", "instance_id"], "orchard_swe": ["metadata"], "nebius_swe_agent": ["instance_id"], "nebius_openhands": ["repo", "instance_id"],
}


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """The registry (JSON: a list of sources) as rows; unknown members, adapters, repeated ids or open patterns raise."""
    sources = json.loads(read_text(spark, path))
    for s in sources:
        exact_keys(s, SOURCE_KEYS, "source")
        traces.adapter(s["adapter"])
        if not s["patterns"] or s["folder"].startswith("/") or ".." in s["folder"].split("/"):
            raise ValueError(f"source {s['source_id']}: no patterns, or a folder outside the storage root")
    if len({s["source_id"] for s in sources}) != len(sources):
        raise ValueError("a source is registered twice")
    rows = [tuple(s[k] for k in ("source_id", "adapter", "revision", "declared_license", "folder", "patterns")) for s in sources]
    return spark.createDataFrame(rows, "source_id string, adapter string, revision string, declared_license string, folder string, patterns array<string>")


def json_or(value: Column, default: Column) -> Column:
    """A JSON text as a variant; the default where it does not parse or is null."""
    return F.coalesce(F.try_parse_json(value), default)


def _meta(name: str) -> Column:
    return F.try_variant_get(F.try_parse_json("metadata"), f"$.{name}", "string")


def identity(adapter: str, whole: bool = True) -> Column:
    """The group identity of a raw row, null where it names none.  ``whole`` counts a repository that the row states for
    nebius_swe_agent too; held-out identities of that source go by the task alone."""
    none = F.lit(None).cast("string")
    parts = {
        "openthoughts_agent": (none, F.col("task")), "orchard_swe": (_meta("repo"), _meta("instance_id")),
        "nebius_swe_agent": (none, F.col("instance_id")),
    }
    traces.adapter(adapter)
    repo, task = parts.get(adapter) or (F.col("repo"), F.col("instance_id"))
    if adapter == "nebius_swe_agent" and whole:
        repo = F.col("repo")
    return I.group_identity(I.folded_text(repo.cast("string")), I.folded_text(task.cast("string")))


def identity_scan(spark: SparkSession, root: str, patterns: list[str], adapter: str) -> DataFrame:
    """(source_file, row_index, identity) of a source's files, from the columns that identities need and no others."""
    wanted = IDENTITY_COLUMNS[adapter]
    known = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root).columns
    if missing := sorted(set(wanted) - set(known)):
        raise ValueError(f"the files of {adapter} lack {', '.join(missing)}")
    rows = traces.scan(spark, root, patterns, wanted)
    return rows.select("source_file", "row_index", identity(adapter, whole=False).alias("identity"))


def identity_and_text(rows: DataFrame, adapter: str) -> DataFrame:
    """Raw rows with their identity and ``task_text``: the first user message that is not blank, else ''."""
    if adapter == "nebius_swe_agent" and "repo" not in rows.columns:
        rows = rows.withColumn("repo", F.lit(None).cast("string"))
    column = next(c for c in ("messages", "conversations", "trajectory") if c in rows.columns)
    items = F.try_variant_get(F.try_parse_json(traces.as_json(rows, column)), "$", "array<variant>")

    def text(m):
        of = lambda k: F.nullif(F.try_variant_get(m, f"$.{k}", "string"), F.lit(""))
        return F.coalesce(of("content"), of("text"), F.lit(""))

    users = F.filter(items, lambda m: (F.try_variant_get(m, "$.role", "string") == "user") & (F.regexp_replace(text(m), r"(?U)\s+", "") != ""))
    return rows.withColumn("identity", identity(adapter)).withColumn("task_text", F.coalesce(text(F.get(users, F.lit(0))), F.lit("")))


def lookup(rows: DataFrame, column: str, value) -> DataFrame:
    """The one row with a value; the filter reaches the files.  None, or several, is an error when the row is read."""
    n = F.count("*").over(_everything())
    met = rows.where(F.col(column) == F.lit(value)).limit(2)
    checked = met.withColumn("__n", n)
    found = checked.where(F.when(F.col("__n") == 1, True).otherwise(F.raise_error(F.lit(f"{column} is not unique")).cast("boolean"))).drop("__n")
    if met.isEmpty():
        raise LookupError(f"no row with this {column}")
    return found


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy()  # over two rows at most


def first_rows(rows: DataFrame) -> DataFrame:
    """The first row of each scanned file."""
    return rows.where("row_index = 0")


def footers(spark: SparkSession, root: str, patterns: list[str]) -> DataFrame:
    """(path, bytes, n_rows, n_row_groups, schema_sha256) of the selected Parquet files; tasks read the footers only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root)
    path = F.regexp_replace("path", "^.*?" + traces.F_quote(root.rstrip("/").split("://")[-1]) + "/", "")
    names = files.select(path.alias("path"), F.col("path").alias("uri"), F.col("length").alias("bytes")).where(F.col("path").rlike(traces.pattern_regex(patterns)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, groups, schema = [], [], []
            for uri in batch.column("uri").to_pylist():
                store, place = pyarrow.fs.FileSystem.from_uri(uri)
                with store.open_input_file(place) as f:
                    meta = pq.ParquetFile(f).metadata
                n.append(meta.num_rows)
                groups.append(meta.num_row_groups)
                schema.append(hashlib.sha256(str(meta.schema.to_arrow_schema().remove_metadata()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("bytes"), pa.array(n, pa.int64()), pa.array(groups, pa.int32()), pa.array(schema, pa.string())], names=["path", "bytes", "n_rows", "n_row_groups", "schema_sha256"])

    return names.repartition("path").mapInArrow(read, "path string, bytes long, n_rows long, n_row_groups int, schema_sha256 string")


def schema_histogram(found: DataFrame) -> DataFrame:
    """Files, rows and bytes of each schema among ``footers``."""
    return found.groupBy("schema_sha256").agg(F.count("*").alias("files"), F.sum("n_rows").alias("n_rows"), F.sum("bytes").alias("bytes"))


def summary(value, limit: int = 80, members: int = 8):
    """Shape of a value of one collected row: types, lengths, the first members of objects and the first item of lists."""
    if isinstance(value, Row):
        value = value.asDict()
    if isinstance(value, dict):
        return {"type": "object", "keys": len(value), "members": {k: summary(v, limit, members) for k, v in list(value.items())[:members]}}
    if isinstance(value, (list, tuple)):
        return {"type": "array", "length": len(value), "first": summary(value[0], limit, members) if value else None}
    if isinstance(value, (str, bytes)):
        return {"type": type(value).__name__, "length": len(value), "preview": value[:limit]}
    return {"type": type(value).__name__, "value": value}


def preview(rows: DataFrame, n: int = 1, limit: int = 80) -> list[dict]:
    """``summary`` of the first n rows in their files' order."""
    return [summary(r, limit) for r in rows.orderBy("source_file", "row_index").limit(n).collect()]


def merged(*objects: Column) -> Column:
    """JSON objects as one; of equal members the last one's value stays."""
    maps = [F.coalesce(F.try_variant_get(F.try_parse_json(o), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")) for o in objects]

    def over(first: Column, more: Column) -> Column:
        return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(more, k)), more)

    return F.to_json(reduce(over, maps))


def valid_text(data: Column) -> Column:
    """struct(valid, text) of bytes: whether they are UTF-8, and their text with marks in place of broken sequences."""
    return F.struct(F.is_valid_utf8(data.cast("string")).alias("valid"), F.make_valid_utf8(data.cast("string")).alias("text"))
