"""Streams over the event and recipe tables, run to their end."""

from __future__ import annotations

import glob
import os

from pyspark.sql import functions as F

from wicker.plans.sqltext import clean
from wicker.session import read_table
from wicker.streaming import basket_stats


def _stream(spark, d, name):
    """A file stream over a table (its folder, or the folder of its one file with that file picked out)."""
    schema = read_table(spark, d, name).schema
    reader = spark.readStream.schema(schema)
    path = f"{d}/{name}.parquet"
    if glob.glob(f"{path}/*.parquet"):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))


def _windows(spark, d):
    run = lambda s: basket_stats.windowed_counts(_stream(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), "400 days", "1 day")
    out = basket_stats.run_to_end(spark, run, "wicker_windows")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def _sessions(spark, d):
    run = lambda s: basket_stats.sessions(_stream(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id"), "30 minutes", "400 days")
    out = basket_stats.run_to_end(spark, run, "wicker_sessions")
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n").alias("n_events"), F.max("n").alias("longest"))


def _frequencies(spark, d):
    def run(s):
        rows = _stream(s, d, "raw_recipes").select(F.col("raw_id").alias("key"), "loaded_at", F.col("ner").alias("items"))
        return basket_stats.document_frequencies(rows)

    return basket_stats.run_to_end(spark, run, "wicker_frequencies")


QUERIES = {
    "stream_windows": (
        _windows,
        "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) n, round(sum(value), 4) total FROM events GROUP BY 1, 2",
    ),
    "stream_sessions": (
        _sessions,
        """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END s FROM events),
        n AS (SELECT user_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g),
        c AS (SELECT user_id, k, count(*) n FROM n GROUP BY 1, 2) SELECT user_id, count(*) n_sessions, sum(n)::BIGINT n_events, max(n) longest FROM c GROUP BY 1""",
    ),
    "stream_item_df": (
        _frequencies,
        f"""SELECT item, count(*) df FROM (SELECT DISTINCT raw_id, {clean('x')} item FROM (SELECT raw_id, unnest(ner) x FROM raw_recipes)) WHERE item <> '' GROUP BY 1""",
    ),
}
