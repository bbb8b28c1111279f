"""Scratch tables in the folder that all executors share, numbering of sorted rows, write-once files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of some ten or hundred bytes that may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: Bytes of rows that Python gets at a time; Spark's own bound, kept for values, is too large where all rows hold long texts.
BATCH_BYTES = 8 << 20
#: Options of a Parquet table whose rows may hold hundreds of thousands of values: row groups end after some MB of them.  Spark's reader takes up to
#: 4,096 rows of a row group at once, whatever their size.
LONG_ROWS = {"parquet.block.size": str(1 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "8"}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the session's checkpoint folder.  Where neither is set, a session on one machine gets a
    temporary folder; on a cluster that is an error, for each machine would write to a disk of its own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, name: str, *folders: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, read back: later steps start from it, also after executors are lost.  ``folders``:
    columns by whose values it lies in folders, so that readers can leave some out.  ``options``: the writer's."""
    path = f"{shared_dir(df.sparkSession)}/quarry/{name}-{uuid.uuid4().hex}"
    write = df.write.options(**options)
    write.partitionBy(*folders).parquet(path) if folders else write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_batches(rows: DataFrame) -> DataFrame:
    """``rows``, its session's Arrow batches bounded by BATCH_BYTES unless the session has a bound of its own."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", rows.sparkSession.conf
    if conf.get(key) == "67108864b":  # Spark's default
        conf.set(key, f"{BATCH_BYTES}b")
    return rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark an already written side for broadcast if it has at most ``rows`` rows; else leave it to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def numbered(rows: DataFrame, order: list[str], name: str = "row_no") -> tuple[DataFrame, int]:
    """(rows with their place in the order, from 0, their number).

    Rows are range partitioned and numbered within their partition; a partition starts behind the rows of those before it, so
    no task sees more than its share."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "numbered")
    starts, total = [], 0
    for part, n in sorted(dealt.groupBy("__part").count().collect()):  # one row for each partition
        starts.append((part, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(starts, "__part int, __start long")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    placed = dealt.withColumn(name, within).join(F.broadcast(offsets), "__part")
    return placed.withColumn(name, F.col(name) + F.col("__start")).drop("__part", "__start"), total


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """A small text file of any store Spark can write, that must not exist yet."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path).collect())
