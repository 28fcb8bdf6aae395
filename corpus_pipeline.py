"""Corpus pipeline: language ID, near duplicates, benchmark leaks, secrets, packing.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and reread as the next
stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.llm import decontamination, language, neardup, packing, secrets
from viaduct.llm.common import scratch, table


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with the language found as their ``lang``.

    Rejected are null, empty and letterless texts, and all where no document has both a text and a
    ``lang`` to learn from. Rows that repeat stay, a wrong or missing ``lang`` is put right.
    """
    carried = docs.select("doc_id", "text", "lang", F.struct(*[F.col(c) for c in docs.columns]).alias("carried"))
    known = language.learn_prototypes(docs.where(~F.coalesce(language.held_out(F.col("doc_id")), F.lit(False))))
    found = language.predict_language(carried, *known).where(F.col("lang_pred") != language.UND)
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col("carried")[c].alias(c) for c in docs.columns])


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class, a null one last; texts without a word are no
    one's copies unless doc_id and text repeat."""
    return neardup.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and items without a word
    are in no text."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; ``n_chars`` follows it, null for a null text. No row goes."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places; a null or empty text is one piece, the end token."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_identified),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Hypervectors, MinHash and the CGK walk aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
