"""JSON Lines sink and source, and the shared folder that jobs put files into."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Only a session on this machine alone gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="viaduct-"))
    return sc.getCheckpointDir().rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{uuid.uuid4().hex}"


def write_lines(df: DataFrame, path: str, *chunk_by: str) -> None:
    """One record a line with nulls kept; one folder of files a value of ``chunk_by``."""
    df.write.partitionBy(*chunk_by).option("ignoreNullFields", "false").json(path)


def read_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """Typed records; blank lines are skipped and a line that doesn't parse fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
