"""Structured Streaming jobs that take what is available, chunk by chunk, and keep their state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.sources.lines import shared_folder


def chunks(spark: SparkSession, path: str, schema, format: str = "parquet", per_trigger: int = 1) -> DataFrame:
    """A file stream of ``per_trigger`` files a batch; files seen are in the query's checkpoint."""
    return spark.readStream.schema(schema).format(format).option("maxFilesPerTrigger", per_trigger).load(path)


def deliver(stream: DataFrame, mode: str = "append", root: str | None = None) -> DataFrame:
    """Runs the stream over all files there are; its rows with the number of their ``batch``.

    A batch overwrites its own folder, so one that is run again after a failure leaves no rows
    twice. Called again with the same ``root``, files delivered before are skipped.
    """
    spark = stream.sparkSession
    root = root or shared_folder(spark)
    out = f"{root}/rows"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")
    put = lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def upsert(stream: DataFrame, *keys: str, root: str | None = None) -> DataFrame:
    """Runs a stateful aggregate whose batches give the rows they touched; the newest row of each key."""
    rest = [c for c in stream.columns if c not in keys]
    touched = deliver(stream, "update", root)
    newest = touched.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x"))
    return newest.select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def rolling(stream: DataFrame, at: str, key: str, value: str, length: str, slide: str, late: str) -> DataFrame:
    """Count, least and largest value of each sliding window and key; rows later than ``late`` are left out."""
    windows = stream.withWatermark(at, late).groupBy(F.window(at, length, slide).alias("w"), key)
    found = windows.agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    return found.select(key, F.unix_timestamp("w.start").alias("began"), "n", "low", "high")
