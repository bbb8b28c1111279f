"""New records of a landing folder into the content-addressed store, each digest once.

Within a stream state drops repeats for a watermark's time; across restarts and streams the store's own anti-join does,
so a batch that runs again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import blobs


def landing(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """JSON lines (value: the whole line) as they arrive."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def ingest(rows: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Append the canonical JSON of each line to the store; runs over what is there and stops."""
    stamped = blobs.addressed(rows.where(F.trim("value") != "")).where("payload is not null").withColumn("seen", F.current_timestamp())
    once = stamped.withWatermark("seen", "1 hour").dropDuplicatesWithinWatermark(["digest"])

    def append(batch: DataFrame, _: int) -> None:
        blobs.put(batch, store)

    return once.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
