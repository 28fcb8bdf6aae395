"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256, exact record headers apart from them with that
digest, and records are rebuilt by joining the two; every payload read is hashed again and a
mismatch fails the job. Of equal payloads of at least ``least`` bytes the record with the largest
page id is the response and the others revisit it; smaller payloads are always responses.

Records have ids of their own: a response of a payload of at least ``least`` bytes is named after the
digest, so that revisits can refer to it, all others at random. The page id stands in a field of
its own. Pages carry no date, so ``WARC-Date`` is a parameter.

Defined results: null html is an empty payload; a null url is written as ``about:blank`` and line
ends in urls are percent-encoded; a null page id sorts below all others; among rows that repeat
the largest page id of a payload one is the response and the rest revisit that id; empty tables
give empty archives; other columns are ignored; payload length is bounded by Spark's own limit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viaduct.llm.common import cut, join_counted, join_spread, scratch, table

CRLF = "\r\n"
# Fixed value: the name that WARC/1.1 gives to this kind of revisit.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def archive_root(spark: SparkSession) -> str:
    """A new folder below the shared one the session names."""
    return f"{scratch(spark)}/warc-{uuid.uuid4().hex}"


def facts(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    return pages.select("page_id", "url", payload.alias("payload")).select("page_id", "url", "payload", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("digest"))


def write_archive(pages: DataFrame, root: str, least: int = 1000, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes ``payloads`` and ``headers`` below ``root``. Equal payloads meet in map-side partial
    aggregates, so a payload that fills a third of the rows is shuffled once a task."""
    rows = facts(pages)
    payloads = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    payloads.write.option("compression", "zstd").parquet(f"{root}/payloads")

    light = rows.select("page_id", "url", "payload_bytes", "digest", F.sha1("payload").alias("payload_digest"))
    large = light.where(F.col("payload_bytes") >= least)
    chosen = cut(large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")))
    joined = join_counted(large, chosen, "digest")
    # repeats of the chosen page id: only those rows are ranked
    same = joined.where(F.col("page_id").eqNullSafe(F.col("keeper")))
    small = light.where(F.col("payload_bytes") < least).withColumn("keeper", F.lit(None).cast(light.schema["page_id"].dataType))
    other = joined.where(~F.col("page_id").eqNullSafe(F.col("keeper"))).unionByName(small)
    ranked = same.withColumn("_r", F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url")))
    whole = ranked.withColumn("record_type", F.when(F.col("_r") == 1, "response").otherwise("revisit")).drop("_r")
    whole = whole.union(other.withColumn("record_type", F.when(F.col("payload_bytes") < least, "response").otherwise("revisit")))
    uri = F.coalesce(F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit("about:blank"))
    revisit = F.col("record_type") == "revisit"
    page = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    urn = lambda x: F.concat(F.lit("<urn:uuid:"), x, F.lit(">"))
    named = urn(F.regexp_replace(F.substring("digest", 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    referred = (F.col("record_type") == "response") & (F.col("payload_bytes") >= least)
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.when(referred, named).otherwise(urn(F.uuid()))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("X-Page-ID", page(F.col("page_id"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", named), line("X-Refers-To-Page-ID", page(F.col("keeper"))))).otherwise(line("Content-Type", F.lit("text/html; charset=utf-8"))),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )
    out = whole.select(header.cast("binary").alias("header"), "digest")
    out.write.option("compression", "zstd").parquet(f"{root}/headers")


def read_headers(spark: SparkSession, root: str) -> DataFrame:
    """Headers with their fields parsed from the bytes."""
    raw = spark.read.parquet(f"{root}/headers")
    text = F.decode("header", "UTF-8")
    field = lambda name: F.regexp_extract(text, f"\r\n{name}: ([^\r]*)\r\n", 1)
    given = lambda name: F.nullif(field(name), F.lit(""))
    return raw.select("header", "digest", field("WARC-Record-ID").alias("record_id"), given("X-Page-ID").alias("page_id"), field("WARC-Target-URI").alias("uri"), field("WARC-Type").alias("record_type"), given("X-Refers-To-Page-ID").alias("refers_to"), given("WARC-Refers-To").alias("refers_to_id"), F.regexp_extract(field("WARC-Payload-Digest"), "sha1:(.*)", 1).alias("payload_digest"), field("Content-Length").cast("long").alias("content_length"))


def read_payloads(spark: SparkSession, root: str) -> DataFrame:
    """Stored payloads; one whose bytes don't hash to its name fails the job."""
    raw = spark.read.parquet(f"{root}/payloads")
    good = F.sha2("payload", 256) == F.col("digest")
    return raw.select("digest", F.when(good, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("corrupt payload "), F.col("digest"))).cast("binary")).alias("payload"))


def rebuild(spark: SparkSession, root: str) -> DataFrame:
    """Original records: exact header, payload of the response or of what a revisit refers to, and the record as it stands in a WARC file."""
    # a payload that many records share is copied, and they are spread over the copies
    counts = spark.read.parquet(f"{root}/headers").groupBy("digest").agg(F.count("*").alias("n"))
    whole = join_spread(read_headers(spark, root), read_payloads(spark, root), counts, "digest")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return whole.withColumn("record", F.concat("header", body, F.lit((CRLF * 2).encode())))


def op3_warc(spark, sf_dir):
    root = archive_root(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    write_archive(pages, root)
    kind = pages.schema["page_id"].dataType
    # a record's own bytes: what follows its header, or for a revisit what it refers to
    body = F.substring("record", F.length("header") + 1, F.length("record") - F.length("header") - 4)
    whole = F.length(body) == F.col("content_length")
    back = rebuild(spark, root).withColumn("body", F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(body)).withColumn("framed", whole)
    digest = F.sha1("body")
    agreed = F.when(F.col("framed") & (digest == F.col("payload_digest")), digest).otherwise(F.raise_error(F.lit("payload and header disagree")).cast("string"))
    number = lambda c: F.when(F.col(c) != "null", F.col(c)).cast(kind)
    return back.select(number("page_id").alias("page_id"), F.length("body").cast("long").alias("payload_bytes"), agreed.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
