"""Helpers shared by the corpus operators: words, hashing, and the core's tables, skewed joins and components."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.operators.graphs import star_components as components  # noqa: F401
from viaduct.operators.tables import cut, heavy_rows, join_counted, join_skewed, join_small, join_spread  # noqa: F401
from viaduct.sources.lines import shared_root as scratch  # noqa: F401

WORD = re.compile(r"\w+")
MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[str]:
    """Lower-cased word characters runs of a whole text."""
    return WORD.findall(text.lower()) if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser over uint64 values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Every byte that is no word character of ASCII, as a blank.
_BLANKS = bytes(i if chr(i).isalnum() or i == 95 else 32 for i in range(128)).ljust(256)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the ``words`` of a text."""
    from xxhash import xxh3_64_intdigest

    if not text:
        return np.zeros(0, np.uint64)
    text = text.lower()
    found = text.encode().translate(_BLANKS).split() if text.isascii() else WORD.findall(text)
    return np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found))


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a whole text.

    A text with fewer words than ``size`` has one shingle of all its words; no word, none.
    """
    w = word_hashes(text)
    if not len(w):
        return w
    n = min(size, len(w))
    acc = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - n + 1 + i]
    return np.unique(mix64(acc + np.uint64(n)))


def row_key(*columns: str):
    """128 bits that stand for a row's doc_id and text, null and empty told apart."""
    plain = lambda c: F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.encode(F.concat(*[plain(c) for c in columns], F.lit("\n")), "UTF-8")))
