"""Byte-balanced sharding by Karmarkar-Karp differencing.

Equal texts form one indivisible group. Each task turns its groups into partial partitions of
one loaded shard and empty others, and repeatedly combines the two with the largest spread, the
heavy shards of one onto the light shards of the other. What remains of a task is one partial
partition, a tuple of ``shards`` sums; those tuples are differenced in the same way.

Defined results: a null text counts as no bytes and is grouped with empty ones; equal texts stay
together whatever their weight, so one group heavier than a fair share fills a shard alone and
the others are balanced without it; repeated rows get slots of their own; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viaduct.llm.common import cut, join_skewed, table


def difference(partials: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partial partitions, rows of k sums in any order.

    Returns ``to`` with ``to[i, s]`` the final shard of shard s of row i, and the final sums.
    """
    n, k = partials.shape
    order = np.argsort(-partials, axis=1, kind="stable")
    sums = [row[o] for row, o in zip(partials, order, strict=True)]
    made: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        down = np.argsort(-total, kind="stable")
        sums[a] = sums[b] = None
        made.append((a, b, down))
        sums.append(total[down])
        heapq.heappush(heap, (-int(sums[-1][0] - sums[-1][-1]), n + len(made) - 1))
    rank = np.zeros((n + len(made), k), np.int32)  # shard of each place of a node
    if n:
        rank[-1] = np.arange(k)
    for j in range(len(made) - 1, -1, -1):
        a, b, down = made[j]
        place = np.empty(k, np.int32)
        place[down] = rank[n + j]  # shard by place before sorting
        rank[a], rank[b] = place, place[::-1]
    to = np.zeros((n, k), np.int32)
    if n:
        np.put_along_axis(to, order, rank[:n], axis=1)
    return to, sums[-1] if n else np.zeros(k, np.int64)


def assign_groups(groups: DataFrame, shards: int = 16, per_task: int = 50_000) -> DataFrame:
    """``(grp, bytes)``, one row a group, to ``(grp, shard)``.

    The driver holds a tuple of ``shards`` sums for every ``per_task`` groups, no group.
    """
    import pandas as pd

    tasks = max(1, math.ceil(groups.count() / per_task))

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "grp"], ascending=[False, True])
        first = np.zeros((len(pdf), shards), np.int64)
        first[:, 0] = pdf["bytes"]
        to, _ = difference(first)
        return pd.DataFrame({"grp": pdf["grp"], "bytes": pdf["bytes"], "task": pdf["task"], "part": to[:, 0]})

    dealt = groups.withColumn("task", F.pmod(F.xxhash64("grp"), F.lit(tasks)).cast("int"))
    kind = groups.schema["grp"].dataType.simpleString()
    local = cut(dealt.groupBy("task").applyInPandas(within, f"grp {kind}, bytes long, task int, part int"))
    sums = np.zeros((tasks, shards), np.int64)
    for r in local.groupBy("task", "part").agg(F.sum("bytes").alias("b")).collect():
        sums[r.task, r.part] = r.b
    to, _ = difference(sums)
    rows = [(t, p, int(to[t, p])) for t in range(tasks) for p in range(shards)]
    final = groups.sparkSession.createDataFrame(rows, "task int, part int, shard int")
    return local.join(F.broadcast(final), ["task", "part"]).select("grp", "shard")


def number_slots(rows: DataFrame, key: str, order: list[str], per_task: int = 100_000) -> DataFrame:
    """Adds ``slot``, gapless from 0 within ``key``: rows are numbered inside blocks chosen by
    hash, and a block starts where the counts of the blocks before it end."""
    blocks = max(1, math.ceil(rows.count() / per_task))
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = dealt.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(key, "_block").orderBy(*order)
    out = dealt.withColumn("_row", F.row_number().over(inside)).join(starts, [key, "_block"])
    return out.withColumn("slot", F.col("_start") + F.col("_row") - 1).drop("_block", "_row", "_start")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot; only digests and sizes leave the scan."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = docs.select("doc_id", (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.unhex(F.sha2(data, 256)).alias("grp"))
    base = cut(base)
    placed = assign_groups(base.groupBy("grp").agg(F.sum("size").alias("bytes")), shards)
    rows = cut(join_skewed(base, cut(placed), "grp").select("doc_id", "size", "text_crc32", "shard"))
    return number_slots(rows, "shard", ["doc_id", "size", "text_crc32"])


def op5_sharding(spark, sf_dir):
    out = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
