"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on histograms of binned statistics with the logistic loss, under monotonic
constraints on chosen statistics (a rising share of symbols, repeats or capitals can only lower
the score), and flattened into numpy node arrays that score a block of documents at once.

Training reads a bounded sample: the labelled documents with the least hash of doc_id, at most
``sample`` (a documented parameter) of them. Everything else covers all documents.

Defined results: null and empty texts have no word and fail the base rule; texts of any length are
read whole; of labelled rows that repeat a doc_id the text with the least hash is learned from; repeated rows are scored each; without a label of either class the method keeps what
passes the base rule; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
#: statistic: direction in which the score may move as it grows (0: free)
FEATURES = {
    "n_words": 0,
    "mean_word": 0,
    "symbols_per_word": -1,
    "dup_lines": -1,
    "repeat_words": -1,
    "upper_share": -1,
    "digit_share": 0,
    "alpha_words": 1,
    "exclamations": -1,
    "short_lines": -1,
    "distinct_words": 0,
    "top_word": -1,
}


def base_stats(text: str | None) -> tuple[int, int, int, int, int, list[str]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words."""
    text = text or ""
    words = WORD.findall(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif WORD.search(line):
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeats = 0
    if len(set(windows)) < len(windows):
        counts, until = Counter(windows), 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeats += i + 3 - max(until, i)
                until = i + 3
    return len(words), sum(map(len, words)), len(SYMBOL.findall(text)), dup, repeats, words


def features(text: str | None, base: tuple) -> list[float]:
    n, chars, symbols, dup, repeats, words = base
    text = text or ""
    size, lines = max(1, len(text)), text.split("\n")
    some = max(1, n)
    ascii_ = text.encode("ascii", "ignore")
    upper = len(ascii_) - len(ascii_.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(ascii_) - len(ascii_.translate(None, b"0123456789"))
    counts = Counter(words)
    return [
        float(n),
        chars / some,
        symbols / some,
        dup / len(lines),
        repeats / some,
        upper / size,
        digits / size,
        sum(w.rstrip(".,;:!?").isalpha() for w in words) / some,
        text.count("!") / some,
        sum(len(x) < 30 for x in lines) / len(lines),
        len(counts) / some,
        max(counts.values(), default=0) / some,
    ]


@dataclass
class Forest:
    """All trees in flat arrays: a node goes left where ``x[feature] <= threshold``; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row; every tree is walked by all rows at once."""
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots.tolist():
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(inner, down, at)
            out += self.value[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 5) -> Forest:
    """Boosted trees for the logistic loss. A split on a constrained feature must order its sides,
    and the sides' subtrees keep to either side of the middle of their values."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    bias = float(np.log(share / (1 - share)))
    score = np.full(len(y), bias)
    nodes: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}
    roots = []

    def add() -> int:
        for k, v in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", 0.0)):
            nodes[k].append(v)
        return len(nodes["value"]) - 1

    def grow(rows, g, h, level, lo, hi):
        me = add()
        nodes["value"][me] = rate * float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), lo, hi))
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j in range(x.shape[1]):
                k = len(edges[j]) + 1
                gs = np.cumsum(np.bincount(code[rows, j], g[rows], k))[:-1]
                hs = np.cumsum(np.bincount(code[rows, j], h[rows], k))[:-1]
                ns = np.cumsum(np.bincount(code[rows, j], minlength=k))[:-1]
                left, right = np.clip(-gs / (hs + ridge), lo, hi), np.clip(-(total_g - gs) / (total_h - hs + ridge), lo, hi)
                loss = lambda v, a, b: a * v + 0.5 * (b + ridge) * v * v
                gain = -loss(left, gs, hs) - loss(right, total_g - gs, total_h - hs)
                ok = (ns >= least) & (len(rows) - ns >= least) & (signs[j] * (right - left) >= 0)
                gain = np.where(ok, gain, -np.inf)
                if len(gain) and gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (gain[i], (j, i, left[i], right[i]))
            whole = np.clip(-total_g / (total_h + ridge), lo, hi)
            if best[1] and best[0] + total_g * whole + 0.5 * (total_h + ridge) * whole * whole <= 1e-6:
                best = (0, None)
        if best[1]:
            j, i, left, right = best[1]
            middle = (left + right) / 2
            sides = [(lo, hi), (lo, hi)]
            if signs[j] > 0:
                sides = [(lo, middle), (middle, hi)]
            elif signs[j] < 0:
                sides = [(middle, hi), (lo, middle)]
            nodes["feature"][me], nodes["threshold"][me] = j, float(edges[j][i])
            goes = code[rows, j] <= i
            nodes["left"][me] = grow(rows[goes], g, h, level + 1, *sides[0])
            nodes["right"][me] = grow(rows[~goes], g, h, level + 1, *sides[1])
        return me

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
        one = Forest(*(np.array(nodes[k]) for k in nodes), np.array(roots[-1:]), 0.0)
        score += one.raw(x)
    return Forest(*(np.array(nodes[k]) for k in nodes), np.array(roots), bias)


def train(docs: DataFrame, labels: DataFrame, sample: int = 8000, **kw) -> Forest | None:
    """Forest from at most ``sample`` labelled documents; None without both classes.

    The chosen ids, at most ``sample`` longs, are broadcast so that no text is shuffled.
    """
    chosen = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(chosen), "doc_id")
    stats = score_frame(found, None, ["doc_id", "quality", "h"]).groupBy("doc_id").agg(F.min(F.struct("h", "quality", "x")).alias("r")).select("doc_id", "r.quality", "r.x")
    rows = sorted(stats.select("doc_id", "quality", "x").collect())
    y = np.array([float(r.quality) for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.array([r.x for r in rows]), y, np.array(list(FEATURES.values())), **kw)


def score_frame(docs: DataFrame, forest: Forest | None, keep: list[str], block: int = 2000) -> DataFrame:
    """``keep`` columns with the base statistics, the features ``x`` and the log odds ``score`` (0 without a forest)."""
    import pyarrow as pa

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                part = batch.slice(i, block)
                base, x = [], []
                for t in part.column("text"):
                    t = t.as_py()
                    b = base_stats(t)
                    base.append(b[:5])
                    x.append(features(t, b))
                score = forest.raw(np.array(x)) if forest is not None else np.zeros(len(x))
                columns = [part.column(c) for c in keep] + [pa.array(c, pa.int64()) for c in zip(*base, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(x, pa.list_(pa.float64())), pa.array(score, pa.float64())], [*keep, *names, "x", "score"])

    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, " + ", ".join(f"{n} long" for n in names) + ", x array<double>, score double")


def assess(docs: DataFrame, labels: DataFrame, cut_off: float = 0.0, **kw) -> DataFrame:
    """doc_id, the base statistics, base_failed, kept and the score (log odds of good quality)."""
    out = score_frame(docs, train(docs, labels, **kw), ["doc_id"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("score") >= cut_off)).alias("kept"), "score")


def op1_quality(spark, sf_dir):
    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
