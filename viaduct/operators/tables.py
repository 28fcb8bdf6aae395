"""Tables put down in the shared folder between jobs, and joins on keys that may be hot.

What is put down is read back as a plain scan: a lost executor costs the tasks it ran, plans start anew
and sizes are those of the files, where a checkpoint would keep the estimates of the plan before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.sources.lines import shared_folder


def _put(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table of their own in the shared folder."""
    return _put(df, shared_folder(df.sparkSession))


class Rounds:
    """Puts down what each round of a loop leaves. Two folders take turns, so disk holds two rounds however many run; only
    the table put down last is to be read after the next one stands."""

    def __init__(self, spark):
        self.folder, self.turn = shared_folder(spark), 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.turn ^= 1
        return _put(df, f"{self.folder}/{self.turn}")


def heavy_rows(left: DataFrame, right: DataFrame, key: str, share: int = 50) -> DataFrame:
    """The rows of ``right``, which has one a key, for keys with more than a ``share``-th of the left
    rows: fewer than ``share`` rows, put down."""
    most = max(1000, left.count() // share)
    heavy = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    return cut(right.join(F.broadcast(heavy.select(key)), key, "left_semi"))


def join_skewed(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row a key. The heavy keys' right rows are
    broadcast and their left rows stay where they are; all others meet by shuffle."""
    few = heavy_rows(left, right, key)
    if few.isEmpty():
        return left.join(right, key, how)
    rest = left.join(F.broadcast(few.select(key)), key, "left_anti").join(right, key, how)
    return left.join(F.broadcast(few), key).unionByName(rest)


def join_counted(left: DataFrame, right: DataFrame, key: str, share: int = 50) -> DataFrame:
    """``left`` joined with ``right``, which stands on disk with one row a key and the number ``n`` of the left rows that have it:
    as ``join_skewed``, without a pass to find the heavy keys."""
    total, top = right.agg(F.sum("n"), F.max("n")).first()
    most = max(1000, (total or 0) // share)
    rest = left.join(right.where(F.col("n") <= most).drop("n"), key)
    if (top or 0) <= most:
        return rest
    return left.join(F.broadcast(right.where(F.col("n") > most).drop("n")), key).unionByName(rest)


def join_spread(left: DataFrame, right: DataFrame, counts: DataFrame, key: str, how: str = "left", share: int = 50, salts: int = 32) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and may have wide ones. Keys with more than a ``share``-th of
    the left rows, whose numbers ``n`` are in ``counts``, have their right row copied ``salts`` times and their left rows
    spread over the copies; nothing but their names is broadcast."""
    counts = cut(counts)
    total, top = counts.agg(F.sum("n"), F.max("n")).first()
    most = max(1000, (total or 0) // share)
    if (top or 0) <= most:
        return left.join(right, key, how)
    heavy = F.broadcast(counts.where(F.col("n") > most).select(key))
    copies = right.join(heavy, key, "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = left.join(heavy, key, "left_semi").withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    return spread.join(copies, [key, "_salt"], how).drop("_salt").unionByName(left.join(heavy, key, "left_anti").join(right, key, how))


def join_small(left: DataFrame, right: DataFrame, keys: list[str], most: int = 100_000, salts: int = 32) -> DataFrame:
    """``left`` joined with ``right``, which has few rows as a rule. Up to ``most`` rows, counted, are broadcast; more
    are copied ``salts`` times and meet the left rows, spread over the copies, by shuffle."""
    if right.count() <= most:
        return left.join(F.broadcast(right), keys)
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, "_salt"]).drop("_salt")
