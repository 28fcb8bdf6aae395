"""Chunked artifacts of a runtime: edge geometries, service patterns and place layers, in the shape each is delivered in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The field that holds the records of a kind's payload, and their columns.
KINDS = {
    "service_patterns": ("patterns", "id string, mode string, stops array<string>, tripCount long"),
    "service_places": ("places", "id string, name string, lat double, lon double, patterns long"),
    "registry_places": ("places", "id string, name string, lat double, lon double, links array<string>"),
}


def write_payloads(records: DataFrame, kind: str, path: str, chunk: str, per_task: int = 10_000) -> None:
    """Records ``(…, chunk)`` as payloads of their chunk, a line each of at most ``per_task`` records, and a manifest of what each
    chunk holds."""
    field, columns = KINDS[kind]
    names = [c.split()[0] for c in columns.split(", ")]
    counts = records.groupBy(chunk).agg(F.count("*").alias("records"))
    blocks = F.ceil(F.col("records") / per_task).cast("int")
    dealt = records.join(counts, chunk).withColumn("block", F.pmod(F.xxhash64("id"), blocks))
    whole = dealt.groupBy(chunk, "block").agg(F.to_json(F.struct(F.collect_list(F.struct(*names)).alias(field))).alias("payload"))
    whole.select(F.col(chunk).alias("chunk"), "payload").write.json(f"{path}/chunks")
    counts.select(F.col(chunk).alias("chunk"), "records").write.json(f"{path}/manifest")


def load_payloads(spark: SparkSession, kind: str, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Records of the chunks, of the ``wanted(chunk)`` only if given. A chunk that doesn't hold what the manifest says, or a
    payload without the field, fails the job."""
    field, columns = KINDS[kind]
    chunks = spark.read.schema("chunk string, payload string").json(f"{path}/chunks")
    said = spark.read.schema("chunk string, records long").json(f"{path}/manifest")
    if wanted is not None:
        chunks, said = (df.join(wanted.select("chunk"), "chunk", "left_semi") for df in (chunks, said))
    inner = F.from_json("payload", f"struct<{field}:array<struct<{', '.join(c.replace(' ', ':', 1) for c in columns.split(', '))}>>>")[field]
    bad = F.raise_error(F.concat(F.lit("no records in chunk "), F.col("chunk")))
    held = chunks.select("chunk", F.explode(F.coalesce(inner, bad.cast(f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in columns.split(', '))}>>"))).alias("x"))
    off = held.groupBy("chunk").agg(F.count("*").alias("n")).join(said, "chunk", "full").where(~F.col("n").eqNullSafe(F.col("records")))
    if not off.isEmpty():
        raise ValueError("chunks and manifest disagree")
    return held.select("chunk", "x.*")
