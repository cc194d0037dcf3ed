"""Incremental jobs on Structured Streaming.

Every job drains what has landed and stops (availableNow), writes one folder
per micro-batch and overwrites that folder when a batch is replayed, so a
restart after a lost executor or driver neither loses nor repeats rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from storyweave.operators.dedup import first_by_url, new_items


KEPT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("content_hash", T.StringType())])


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def earlier_batches(spark: SparkSession, folder: str, batch_id: int, schema: T.StructType) -> DataFrame:
    """Rows written by batches before this one."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], schema)
    rows = spark.read.option("basePath", folder).schema(
        T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    ).parquet(folder)
    return rows.where(F.col("batch") < batch_id).drop("batch")


def ingest_stream(
    landed: DataFrame, parse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str
) -> StreamingQuery:
    """Landed payloads to items, each canonical URL once for ever. ``parse``
    turns a batch of payload rows into raw items."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        raw = parse(batch)
        firsts = first_by_url(raw.withColumn("_arrival", F.struct("source_id", "entry_no", "url")), "_arrival").drop(
            "_arrival", "duplicates"
        )
        known = earlier_batches(spark, out, batch_id, T.StructType([T.StructField("url_hash", T.StringType())]))
        new_items(firsts, known).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        landed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stage_stream(
    rows: DataFrame, stage: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], out: str, checkpoint: str
) -> StreamingQuery:
    """Drain a backlog through one stage. ``stage`` gets a batch and what
    earlier batches kept, as (item_id, content_hash), and returns (kept,
    failed); bad rows land in ``failed`` and never stop the batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        known = earlier_batches(batch.sparkSession, f"{out}/kept", batch_id, KEPT)
        kept, failed = stage(batch, known)
        kept.write.mode("overwrite").parquet(f"{out}/kept/batch={batch_id}")
        failed.write.mode("overwrite").parquet(f"{out}/failed/batch={batch_id}")

    return (
        rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
