"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

Texts are sequences of lower-cased words. The CGK walk from a word emits one symbol a step and
moves on or stays by a random bit of step and symbol, which turns edits into few mismatches of the
walk. Walks of an item start at its minimisers, walks of a document at the same kind of places, so
each item is tried from several starts; a walk is as long as the item's size class asks. Repeated
samples of walk positions are hashed, documents look them up among the items, and every candidate
is verified by the exact edit distance between the item and the best stretch of the document, unless
counts of words or pairs of words rule a leak out.

Recall: a start is found by a table if the sampled positions agree; ``walks`` x ``tables`` samples
from every start, of fewer positions for short items, find an item with a fifth of its words edited,
the most that verification accepts, in about 98 cases of a hundred (measured in the tests by length).

Defined results: null, empty or wordless texts and items have no leak; items below ``min_words``
words, where one edit would already pass the limit, are found where their words stand in a row
unchanged; a document repeated is found each time; equal items are all reported; any length is
scanned whole; empty tables give no leaks. Items are broadcast in blocks of at most ``per_block``
and about ``per_block_chars`` characters, one pass of the documents a block, so their number is
unbounded and memory isn't.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from viaduct.llm.common import cut, table, word_hashes

PLACE = [StructField(n, LongType()) for n in ("start", "end", "edits")]
DROP = np.uint64(63)


def minimisers(h: np.ndarray, w: int) -> np.ndarray:
    """Sorted places of the least word hash in every ``w`` consecutive words."""
    return text_minimisers(np.append(h, np.uint64(0)), np.array([0, len(h) + 1]), w)


def text_minimisers(h: np.ndarray, begin: np.ndarray, w: int) -> np.ndarray:
    """Sorted places of the ``minimisers`` of texts that begin at ``begin``, the last of which is the end; ``h``
    has one more word behind each text."""
    ends, marks = begin[1:] - 1, np.zeros(len(h), bool)
    if len(h) > w:
        least, at = h[: len(h) - w].copy(), np.arange(len(h) - w)
        inside = np.ones(len(h) - w, bool)
        for i in range(w):
            part = h[i : len(h) - w + i]
            less = part < least
            at[less] = np.nonzero(less)[0] + i
            np.minimum(least, part, out=least)
            # windows over the word behind a text
            inside[ends[(ends >= i) & (ends - i < len(inside))] - i] = False
        marks[at[inside]] = True
    size = ends - begin[:-1]
    for a, n in ((int(begin[d]), int(size[d])) for d in np.nonzero((size > 0) & (size < w))[0]):
        marks[a + int(h[a : a + n].argmin())] = True
    return np.nonzero(marks)[0]


class Filter:
    """Tells of numbers whether their leading bits are among those of ``known``: 32 places or more for
    each, up to ``2**most`` in all."""

    def __init__(self, known: np.ndarray, most: int = 20):
        bits = min(most, len(known).bit_length() + 5)
        self.shift = np.uint64(64 - bits)
        self.places = np.zeros(1 << bits, bool)
        self.places[known >> self.shift] = True

    def __call__(self, numbers: np.ndarray) -> np.ndarray:
        return self.places[numbers >> self.shift]


class Sampler:
    """The random bits and samples: ``walks`` walks, and for each size class and walk ``tables``
    samples of positions below twice the class size: ``picks``, or one fewer in classes of up to 32."""

    def __init__(self, largest: int, walks: int, tables: int, picks: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.classes = [1 << i for i in range(2, largest.bit_length())]
        self.steps = 2 * self.classes[-1]
        self.factors = rng.integers(0, 2**63, (walks, self.steps), np.uint64) * np.uint64(2) + np.uint64(1)
        self.samples = [[[np.sort(rng.choice(2 * c, min(picks - (c <= 32), 2 * c), replace=False)) for _ in range(tables)] for _ in range(walks)] for c in self.classes]

    def keys(self, h: np.ndarray, starts: np.ndarray, used: set[int]):
        """Yields (class, walk, table, keys, last symbols) for walks over ``h`` from ``starts``; ``h`` has a 0
        behind each text, on which a walk stays: keys with a 0 end with one."""
        for walk, factors in enumerate(self.factors):
            wanted: dict[int, list] = defaultdict(list)
            for c in used:
                for t, picks in enumerate(self.samples[c][walk]):
                    for j in picks.tolist():
                        wanted[j].append((c, t, j == picks[-1]))
            at, sums = starts.copy(), {}
            for j in range(max(wanted, default=-1) + 1):
                symbols = h[at]
                products = symbols * factors[j]
                for c, t, last in wanted.get(j, ()):
                    key = sums[c, t] = sums[c, t] + products if (c, t) in sums else products
                    if last:
                        yield c, walk, t, key, symbols
                at += (products >> DROP).view(np.int64)


def best_stretch(item: list, text: list) -> tuple[int, int]:
    """(edits, end) of the stretch of ``text`` nearest to ``item``: Myers' bit vectors over words."""
    m = len(item)
    mask, high, peq = (1 << m) - 1, 1 << (m - 1), {}
    for i, w in enumerate(item):
        peq[w] = peq.get(w, 0) | 1 << i
    up, down, score, best, end = mask, 0, m, m, 0
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & mask
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        up, down = mh | ~(xv | ph) & mask, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Finder:
    """Items of a block and their tables."""

    def __init__(self, items: list[tuple[int, str]], ratio: float, min_words: int, walks: int, tables: int, picks: int):
        hashed = [(i, word_hashes(t).tolist()) for i, t in items]
        self.items = [x for x in hashed if len(x[1]) >= min_words]
        self.short: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for i, w in hashed:
            if 0 < len(w) < min_words:
                self.short[len(w)][int(self.row_hash(np.array(w, np.uint64), len(w))[0])].append((i, w))
        self.allowed = [int(ratio * len(w)) for _, w in self.items]
        self.words = [frozenset(w) for _, w in self.items]
        self.found = {}
        if not self.items:
            return
        lengths = [len(w) for _, w in self.items]
        self.w = max(1, min(8, min(lengths) // 3))
        self.sampler = Sampler(max(lengths), walks, tables, picks)
        classes = np.array([self.size_class(n) for n in lengths])
        self.used = {*classes.tolist()}
        self.lengths, self.most = np.array(lengths), np.array(self.allowed)
        h, begin = joined([np.array(w, np.uint64) for _, w in self.items])
        self.pairs = Filter(np.delete(self.row_hash(h, 2), np.concatenate([begin[1:-1] - 1, begin[1:-1] - 2, begin[-1:] - 2])), 24)
        starts = text_minimisers(h, begin, self.w)
        which = np.searchsorted(begin, starts, "right") - 1
        for c in self.used:
            mine = classes[which] == c
            for _, walk, t, key, last in self.sampler.keys(h, starts[mine], {c}):
                order = np.nonzero(last)[0]
                if len(order):
                    order = order[np.argsort(key[order], kind="stable")]
                    items = which[mine][order]
                    self.found[c, walk, t] = (key[order], Filter(key[order]), items, starts[mine][order] - begin[items])

    @staticmethod
    def row_hash(h: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the rows of ``n`` words."""
        acc = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for i in range(n):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
        return acc

    def verbatim(self, h: np.ndarray) -> list[tuple]:
        """(item_id, start, end, 0) of the first place of each short item in a text."""
        found: dict = {}
        for n, items in self.short.items():
            rows = self.row_hash(h, n)
            for at in np.nonzero(np.isin(rows, np.array([*items], np.uint64)))[0].tolist():
                for i, w in items[int(rows[at])]:
                    if (i, tuple(w)) not in found and h[at : at + n].tolist() == w:
                        found[i, tuple(w)] = (i, at, at + n, 0)
        return [*found.values()]

    def size_class(self, n: int) -> int:
        return n.bit_length() - 3 if n >= 4 else 0

    def enough_pairs(self, h: np.ndarray, begin: np.ndarray, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether candidates can be leaks: an edit breaks at most two of the pairs of neighbouring words of an
        item, the others stand in the stretch, so it has that many pairs of any items."""
        d, item = at // len(self.items), at % len(self.items)
        n, k = self.lengths[item], self.most[item]
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.pairs(self.row_hash(h, 2)))])
        size = begin[d + 1] - 1 - begin[d]
        lo, hi = np.clip(first - k, 0, size), np.clip(first + n + k, 0, size)
        pairs = before[begin[d] + np.maximum(lo, hi - 1)] - before[begin[d] + lo]
        return pairs >= n - 1 - 2 * k

    def leaks(self, hashes: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """(item_id, start, end, edits) by text; texts as word hashes."""
        out: list[list] = [self.verbatim(h) if self.short else [] for h in hashes]
        if not self.items:
            return out
        h, begin = joined(hashes)
        starts = text_minimisers(h, begin, self.w)
        found = [np.zeros(0, np.int64)]
        for c, walk, t, key, last in self.sampler.keys(h, starts, self.used):
            if (c, walk, t) not in self.found:
                continue
            sorted_keys, maybe, which, place = self.found[c, walk, t]
            likely = np.nonzero(maybe(key))[0]
            likely = likely[last[likely] != 0]
            lo, hi = np.searchsorted(sorted_keys, key[likely]), np.searchsorted(sorted_keys, key[likely], "right")
            n = hi - lo
            hit = np.nonzero(n)[0]
            if len(hit):
                lo, n, s = lo[hit], n[hit], starts[likely[hit]]
                row = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
                s = np.repeat(s, n)
                d = np.searchsorted(begin, s, "right") - 1
                # text, item and where in the text the item would begin, in one number
                found.append(((d * len(self.items) + which[row]) << 32) + (s - begin[d] - place[row] + (1 << 31)))
        seen = np.unique(np.concatenate(found))
        best: dict[tuple[int, int], tuple] = {}
        at, first = seen >> 32, (seen & 0xFFFFFFFF) - (1 << 31)
        if len(seen):
            near = self.enough_pairs(h, begin, at, first)
            at, first = at[near], first[near]
        plain = [x.tolist() for x in hashes] if len(at) > 8 * len(hashes) else None
        for d, item, first in zip((at // len(self.items)).tolist(), (at % len(self.items)).tolist(), first.tolist(), strict=True):
            w, k = self.items[item][1], self.allowed[item]
            lo, hi = max(0, first - k), max(0, first + len(w) + k)
            part = plain[d][lo:hi] if plain else hashes[d][lo:hi].tolist()
            if len(self.words[item].intersection(part)) < len(self.words[item]) - k:
                continue  # an edit loses one word of the item at most
            edits, end = best_stretch(w, part)
            if edits <= k and ((d, item) not in best or (edits, lo + end) < best[d, item][:2]):
                back = best_stretch(w[::-1], part[:end][::-1])[1]
                best[d, item] = (edits, lo + end, lo + end - back)
        for (d, item), (edits, end, start) in sorted(best.items()):
            out[d].append((self.items[item][0], start, end, edits))
        return out


def joined(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts behind each other, each with a 0 behind it, and where they begin, with the end."""
    pad = np.zeros(1, np.uint64)
    h = np.concatenate([x for y in hashes for x in (y, pad)]) if hashes else pad
    return h, np.cumsum([0] + [len(x) + 1 for x in hashes])


def item_blocks(benchmark: DataFrame, per_block: int, per_block_chars: int):
    """Broadcasts of ``(item_id, text)``, one block at a time."""
    items = benchmark.where("text is not null").select("item_id", "text")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, math.ceil(size.n / per_block), math.ceil(size.chars / per_block_chars))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        yield blocks, benchmark.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in rows])


def grouped(texts, most: int = 60_000):
    """Word hashes of texts in groups of about ``most`` words."""
    group, size = [], 0
    for text in texts:
        group.append(word_hashes(text.as_py()))
        size += len(group[-1])
        if size > most:
            yield group
            group, size = [], 0
    if group:
        yield group


def find_leaks(docs: DataFrame, benchmark: DataFrame, ratio: float = 0.2, min_words: int = 5, walks: int = 3, tables: int = 4, picks: int = 4, per_block: int = 20_000, per_block_chars: int = 50_000_000) -> DataFrame:
    """One row a leak: doc_id, item_id and the word span and edits of the stretch of the document
    nearest to the item, within ``ratio`` edits a word."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [docs.schema["doc_id"], benchmark.schema["item_id"]]
    schema = StructType([StructField(f.name, f.dataType) for f in fields] + PLACE)
    kinds = [to_arrow_type(f.dataType) for f in schema]
    out = None
    for _, shared in item_blocks(benchmark, per_block, per_block_chars):

        def look(batches, shared=shared):
            finder = Finder(shared.value, ratio, min_words, walks, tables, picks)
            for batch in batches:
                found = [leaks for group in grouped(batch.column("text")) for leaks in finder.leaks(group)]
                rows = [(doc, *leak) for doc, leaks in zip(batch.column("doc_id").to_pylist(), found, strict=True) for leak in leaks]
                columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.names)

        part = docs.select("doc_id", "text").mapInArrow(look, schema)
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, ratio: float = 0.2, min_words: int = 5, walks: int = 3, tables: int = 4, picks: int = 4, per_block: int = 20_000, per_block_chars: int = 50_000_000) -> DataFrame:
    """Documents without a leak, all columns as they are. What a block of items leaves is written
    down before the next block, so one block is in memory at a time."""
    import pyarrow as pa

    for blocks, shared in item_blocks(benchmark, per_block, per_block_chars):

        def clean(batches, shared=shared):
            finder = Finder(shared.value, ratio, min_words, walks, tables, picks)
            for batch in batches:
                keep = [not leaks for group in grouped(batch.column("text")) for leaks in finder.leaks(group)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
        if blocks > 1:
            docs = cut(docs)
    return docs


def op7_decontamination(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
