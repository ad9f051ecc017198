"""Basket statistics kept up to date by Structured Streaming; extensions beyond the batch operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wicker.functions.items import clean_items
from wicker.session import ensure_checkpoint_dir


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """start, event_type, n, total of tumbling windows over (ts, event_type, value); later rows than the watermark are dropped."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n of sessions that end after a gap without events; an event exactly a gap later begins another.

    Spark joins sessions that only touch, so the gap is a microsecond shorter there."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", f"{gap} -1 microseconds").alias("s"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), (F.col("s.end") + F.expr("INTERVAL 1 MICROSECOND")).alias("end"), "n")


def document_frequencies(records: DataFrame) -> DataFrame:
    """item, df over a stream of (key, loaded_at, items); records delivered again within the watermark count once."""
    once = records.withWatermark("loaded_at", "180 days").dropDuplicatesWithinWatermark(["key"])
    items = once.select(F.explode(clean_items(F.col("items"))).alias("item"))
    return items.groupBy("item").agg(F.count(F.lit(1)).alias("df"))


def upsert_frequencies(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep a folder of document frequencies current: each batch writes a whole new version beside the last.

    The batch number names the version, so a batch that is run again after a failure replaces its own output.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/version={number}")

    return stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The last version that ``upsert_frequencies`` has written."""
    every = spark.read.parquet(table)
    last = every.agg(F.max("version")).first()[0]
    return every.where(F.col("version") == last).drop("version")


def run_to_end(spark: SparkSession, source: Callable[[SparkSession], DataFrame], name: str) -> DataFrame:
    """Process all that is there into a table in the shared checkpoint folder; no row goes to the driver.

    Each batch writes a whole new version beside the last, as complete output is; the last one is returned."""
    stream = source(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    last = [None]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/version={number}")
        last[0] = number

    started = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}-progress")
    started.trigger(availableNow=True).start().awaitTermination()
    if last[0] is None:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{folder}/version={last[0]}")
