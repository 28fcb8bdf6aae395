"""Streams over the events table, JSON Lines round trips, and their SQL over the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from viaduct.sources.lines import read_lines, shared_folder, write_lines
from viaduct.streaming.progress import chunks, deliver, rolling, upsert

EVENT = "event_id long, user_id long, event_type string, value double"


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _stream(spark, sf_dir):
    # the pattern takes a single file as well as a folder
    return chunks(spark, f"{sf_dir}/events.parquet*", _events(spark, sf_dir).schema)


def str_1(spark, sf_dir):
    """Chunks by event type, written as JSON Lines and delivered one file a batch."""
    path = f"{shared_folder(spark)}/chunks"
    write_lines(_events(spark, sf_dir).select("event_id", "user_id", "value", "event_type"), path, "event_type")
    delivered = deliver(chunks(spark, path, EVENT, "json"))
    return delivered.groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"), F.min("value").alias("low"))


def str_3(spark, sf_dir):
    touched = _stream(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"), F.max("value").alias("high"))
    return upsert(touched, "user_id")


def str_5(spark, sf_dir):
    stream = _stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp"))
    return upsert(rolling(stream, "at", "event_type", "value", "2 hours", "1 hour", "400 days"), "event_type", "began")


def snk_2(spark, sf_dir):
    path = f"{shared_folder(spark)}/lines"
    write_lines(_events(spark, sf_dir).select("event_id", "user_id", "event_type", "value"), path)
    return read_lines(spark, path, EVENT)


QUERIES = {"str_1": str_1, "str_3": str_3, "str_5": str_5, "snk_2": snk_2, "src_17": snk_2}

_LINES = "SELECT event_id, user_id, event_type, value FROM events"
ORACLE_SQL = {
    "str_1": "SELECT event_type, count(*) AS n, max(event_id) AS last_event, min(value) AS low FROM events GROUP BY event_type",
    "str_3": "SELECT user_id, count(*) AS n, max(event_id) AS last_event, max(value) AS high FROM events GROUP BY user_id",
    "str_5": "WITH w AS (SELECT event_type, value, date_trunc('hour', ts) AS s FROM events UNION ALL SELECT event_type, value, date_trunc('hour', ts) - INTERVAL '1' HOUR FROM events) SELECT event_type, CAST(epoch(s) AS BIGINT) AS began, count(*) AS n, min(value) AS low, max(value) AS high FROM w GROUP BY event_type, s",
    "snk_2": _LINES,
    "src_17": _LINES,
}
