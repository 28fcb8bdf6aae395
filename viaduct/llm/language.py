"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector. An n-gram binds the permuted vectors of its letters
(``roll(a, 2) * roll(b, 1) * c``), a text bundles its n-grams by addition, a language prototype
bundles all texts of the language. A text gets the language of the prototype with the largest
cosine. Runs of non-letters are one boundary symbol with a vector of its own.

Defined results: null text, empty text and text without a letter give ``und`` with score 0;
with no learned language everything is ``und``; ties go to the language that sorts first; rows
repeat as they come; very long texts are bundled whole; other columns are kept aside.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

M = 1 << 20
UND = "und"
SCALE = 1 << 15


class Encoder:
    """Text to hypervector. Letter vectors come from a counter-based generator keyed by the
    code point, so every executor derives the same ones; n-gram vectors of the first
    ``cached`` n-grams are kept, later ones are bound when needed."""

    def __init__(self, dim: int, cached: int = 8192, seed: int = 7):
        self.dim, self.cached, self.seed = dim, cached, seed
        self.symbol = np.full(0x110000, -1, np.int32)
        self.letters = np.zeros((0, dim), np.int8)
        self.count = 0
        self._add(np.array([0]))
        self.codes = np.zeros(0, np.int64)
        self.rows = np.zeros(0, np.int64)
        self.grams = np.zeros((cached, dim), np.float32)
        self.used = 0

    def _add(self, points: np.ndarray) -> None:
        for p in points.tolist():
            if p and not chr(p).isalpha():
                self.symbol[p] = 0
                continue
            bits = np.random.Generator(np.random.Philox(key=[self.seed, p])).integers(0, 2, self.dim, np.int8)
            if self.count == len(self.letters):
                self.letters = np.concatenate([self.letters, np.zeros((max(64, self.count), self.dim), np.int8)])
            self.letters[self.count] = bits * 2 - 1
            self.symbol[p] = self.count
            self.count += 1

    def ngrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigram codes and their counts; empty if the text has no letter."""
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
        ids = self.symbol[points]
        if (ids < 0).any():
            self._add(np.unique(points[ids < 0]))
            ids = self.symbol[points]
        if not ids.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] != 0) | (ids[:-1] != 0)
        s = np.concatenate([[0], ids[keep], [0]]).astype(np.int64)
        return np.unique((s[:-2] * M + s[1:-1]) * M + s[2:], return_counts=True)

    def bind(self, codes: np.ndarray) -> np.ndarray:
        a, b, c = codes // (M * M), codes // M % M, codes % M
        return np.roll(self.letters[a], 2, 1) * np.roll(self.letters[b], 1, 1) * self.letters[c]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """float32 vectors of sorted distinct codes."""
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        new = codes[~known][: self.cached - self.used]
        if len(new):
            self.grams[self.used : self.used + len(new)] = self.bind(new)
            codes_, rows = np.concatenate([self.codes, new]), np.concatenate([self.rows, np.arange(self.used, self.used + len(new))])
            order = np.argsort(codes_)
            self.codes, self.rows, self.used = codes_[order], rows[order], self.used + len(new)
            return self.vectors(codes)
        if known.all():
            return self.grams[self.rows[at]]
        out = np.empty((len(codes), self.dim), np.float32)
        out[known] = self.grams[self.rows[at[known]]]
        out[~known] = self.bind(codes[~known])
        return out

    def bundle(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One row per text; the n-grams of the block are taken 4096 at a time."""
        union = np.unique(np.concatenate([c for c, _ in texts])) if texts else np.zeros(0, np.int64)
        out = np.zeros((len(texts), self.dim), np.float32)
        for i in range(0, len(union), 4096):
            part = union[i : i + 4096]
            weight = np.zeros((len(texts), len(part)), np.float32)
            for k, (codes, counts) in enumerate(texts):
                lo, hi = np.searchsorted(codes, [part[0], part[-1] + 1])
                weight[k, np.searchsorted(part, codes[lo:hi])] = counts[lo:hi]
            out += weight @ self.vectors(part)
        return out


_encoders: dict[tuple[int, int], Encoder] = {}


def encoder(dim: int, seed: int) -> Encoder:
    return _encoders.setdefault((dim, seed), Encoder(dim, seed=seed))


def learn_prototypes(labelled: DataFrame, dim: int = 1024, seed: int = 7, max_languages: int = 4096) -> tuple[list[str], np.ndarray]:
    """Prototypes from ``(text, lang)``; rows with a null in either are skipped.

    Each task bundles its texts by language, so a row of ``dim`` sums per task and language is
    shuffled. What reaches the driver is languages x dim, and more than ``max_languages`` fail.
    """
    import pyarrow as pa

    def sums(batches):
        e, totals = encoder(dim, seed), {}
        for batch in batches:
            grams: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams.setdefault(lang, []).append(e.ngrams(text))
            for lang, found in grams.items():
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([n for _, n in found]), len(codes))
                v = totals.setdefault(lang, np.zeros(dim))
                for i in range(0, len(codes), 4096):
                    v += counts[i : i + 4096].astype(np.float32) @ e.vectors(codes[i : i + 4096])
        if totals:
            yield pa.RecordBatch.from_pydict({"lang": list(totals), "v": [v.astype(np.int64).tolist() for v in totals.values()]}, pa.schema([("lang", pa.string()), ("v", pa.list_(pa.int64()))]))

    partial = labelled.select("text", "lang").where("text is not null and lang is not null").mapInArrow(sums, "lang string, v array<bigint>")
    rows = partial.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").limit(max_languages + 1).collect()
    if len(rows) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    out = np.array([[p.x for p in r.v] for r in rows], np.float64).reshape(len(rows), dim)
    return [r.lang for r in rows], out


def predict_language(docs: DataFrame, names: list[str], prototypes: np.ndarray, seed: int = 7, block: int = 32) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (cosine, at least 0); only ``text`` is looked at."""
    import pyarrow as pa

    dim = prototypes.shape[1]
    # whole numbers, so that sums are exact and don't hang on the block a text is in
    unit = np.rint(prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12) * SCALE)

    def predict(batches):
        e = encoder(dim, seed)
        for batch in batches:
            texts, langs, scores = batch.column("text"), [], []
            for i in range(0, len(texts), block):
                grams = [e.ngrams(t) for t in texts.slice(i, block).to_pylist()]
                v = e.bundle(grams)
                v = v.astype(np.float64)
                cos = v @ unit.T / (SCALE * np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)) if names else np.zeros((len(grams), 1))
                best = cos.argmax(1)
                for k, (codes, _) in enumerate(grams):
                    none = not len(codes) or not names
                    langs.append(UND if none else names[best[k]])
                    scores.append(0.0 if none else float(min(1.0, max(0.0, cos[k, best[k]]))))
            arrays = [c for n, c in zip(batch.schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    base = docs.drop("lang_pred", "score")
    schema = StructType([*base.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return base.mapInArrow(predict, schema)


def held_out(doc_id) :
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, dim: int = 1024) -> DataFrame:
    """Learn from the documents that are not held out, then predict all of them."""
    learned = learn_prototypes(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))), dim)
    return predict_language(docs, *learned)


def op10_language(spark, sf_dir):
    from viaduct.llm.common import table

    docs = table(spark, sf_dir, "documents")
    names, prototypes = learn_prototypes(docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(False))))
    out = predict_language(docs.select("doc_id", "text"), names, prototypes)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
