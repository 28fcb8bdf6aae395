"""Refresh cursors of sources, committed together with the rows they stand for.

A refresh writes its rows into a folder of its own and then, as the last thing, one commit record that names the folder and the
cursor. Rows count once their commit stands, so a refresh that ends in between leaves nothing: the next one begins
at the same cursor and takes the same number. A cursor is the newest commit of its source.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATE = "seed_snapshot_id string, recent_changes_cursor string, replication_sequence long"
COMMIT = f"source_id string, number long, folder string, mode string, last_successful_refresh_at string, state struct<{STATE.replace(' string', ':string').replace(' long', ':long')}>"


def _commits(spark: SparkSession, root: str) -> DataFrame:
    """Commit records, none where no refresh has ended yet. Of records of one number, which only two refreshes of one source at a
    time can leave, the one of the least folder holds."""
    spark.createDataFrame([], COMMIT).write.mode("ignore").json(f"{root}/commits")
    found = spark.read.schema(COMMIT).json(f"{root}/commits", recursiveFileLookup=True)
    first = Window.partitionBy("source_id", "number").orderBy("folder")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def load_cursors(spark: SparkSession, root: str) -> DataFrame:
    """The cursor of each source that has one: ``source_id, number, mode, last_successful_refresh_at, state``."""
    newest = _commits(spark, root).groupBy("source_id").agg(F.max_by(F.struct("number", "mode", "last_successful_refresh_at", "state"), "number").alias("c"))
    return newest.select("source_id", "c.*")


def stage(rows: DataFrame, root: str) -> str:
    """Writes rows that don't count yet; the name of their folder."""
    folder = uuid.uuid4().hex
    rows.write.parquet(f"{root}/rows/{folder}")
    return folder


def commit(cursors: DataFrame, root: str, folder: str) -> None:
    """Commits the rows of a folder with ``cursors(source_id, number, mode, last_successful_refresh_at, state)``: all
    sources in one file, which stands whole or not at all."""
    records = cursors.select("source_id", "number", F.lit(folder).alias("folder"), "mode", "last_successful_refresh_at", "state")
    records.coalesce(1).write.mode("append").option("ignoreNullFields", "false").json(f"{root}/commits")


def committed_rows(spark: SparkSession, root: str, schema, source: str = "source_id") -> DataFrame:
    """Rows of all refreshes that ended: those whose folder a commit of their source names."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{root}/rows/none")
    rows = spark.read.schema(schema).parquet(f"{root}/rows", recursiveFileLookup=True)
    named = rows.withColumn("folder", F.element_at(F.split(F.input_file_name(), "/"), -2))
    known = _commits(spark, root).select(F.col("source_id").alias(source), "folder").distinct()
    return named.join(known, [source, "folder"], "left_semi").drop("folder")


def refresh(changes: DataFrame, root: str, at: str, source: str = "source_id", sequence: str = "sequence") -> DataFrame:
    """Takes the changes beyond each source's cursor, all of them where it has none, and moves the cursors on; the cursors."""
    spark = changes.sparkSession
    known = load_cursors(spark, root).select(F.col("source_id").alias("_of"), F.col("number").alias("_number"), F.col("state.replication_sequence").alias("_upto"), F.col("state.seed_snapshot_id").alias("_seed"))
    fresh = changes.join(known, changes[source] == known["_of"], "left").where(F.col("_upto").isNull() | (F.col(sequence) > F.col("_upto")))
    folder = stage(fresh.select(changes.columns), root)
    taken = spark.read.schema(changes.schema).parquet(f"{root}/rows/{folder}").groupBy(F.col(source).alias("source_id")).agg(F.max(sequence).cast("long").alias("upto"))
    met = taken.join(known, taken["source_id"] == known["_of"], "left")
    seed = F.coalesce("_seed", F.lit(folder))
    state = F.struct(seed.alias("seed_snapshot_id"), F.lit(None).cast("string").alias("recent_changes_cursor"), F.col("upto").alias("replication_sequence"))
    mode = F.when(F.col("_of").isNull(), "full_seed").otherwise("incremental")
    commit(met.select("source_id", (F.coalesce("_number", F.lit(0)) + 1).alias("number"), mode.alias("mode"), F.lit(at).alias("last_successful_refresh_at"), state.alias("state")), root, folder)
    return load_cursors(spark, root)
