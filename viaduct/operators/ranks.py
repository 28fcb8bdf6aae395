"""Places and running sums in an order, over all rows or inside a key that may hold most of them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viaduct.operators.tables import cut


def sums_before(rows: DataFrame, name: str, amount: str, order: list[str], key: list[str] | None = None, per_task: int = 100_000) -> DataFrame:
    """``rows`` with ``name``, the sum of ``amount`` over the rows before each in an order that leaves no ties, inside a ``key`` if given.

    Rows are dealt to ranges of key and order and put down. A range adds up its own rows; where a key goes on from one range to
    the next, it begins there with the sums of the ranges before, of which there is a row a key and range.
    """
    key = key or []
    parts = max(1, math.ceil(rows.count() / per_task))
    ranged = cut(rows.repartitionByRange(parts, *key, *order).withColumn("_part", F.spark_partition_id()))
    each = ranged.groupBy(*key, "_part").agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select(*key, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*key, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn("_own", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    # a null key is a key: null-safe
    met = F.lit(True)
    starts = starts.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("_part").alias("_at"), "_start")
    for c in key:
        met = met & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = out.join(starts, (F.col("_part") == F.col("_at")) & met)
    return joined.withColumn(name, F.col("_start") + F.col("_own")).select(*rows.columns, name)


def position(rows: DataFrame, *order: str, key: list[str] | None = None, per_task: int = 100_000) -> DataFrame:
    """Rows with their ``position`` from 0 in an order that leaves no ties, over all or inside a ``key``."""
    return sums_before(rows.withColumn("_one", F.lit(1).cast("long")), "position", "_one", list(order), key, per_task).drop("_one")
