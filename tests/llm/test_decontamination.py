"""Decontamination against exact edit distance."""

import cProfile
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from viaduct.llm import decontamination as d
from viaduct.llm.common import word_hashes


def plain_best(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != v), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(rng, item, share):
    out = []
    for w in item:
        r = rng.random()
        if r < share / 3:
            continue
        out.append(f"e{rng.randint(0, 9**6)}" if r < 2 * share / 3 else w)
        if 2 * share / 3 <= r < share:
            out.append(f"i{rng.randint(0, 9**6)}")
    return out


def edited_to(rng, item, edits):
    """``item`` after exactly so many edits at different places."""
    out = [[w] for w in item]
    for at in rng.sample(range(len(item)), edits):
        kind = rng.randrange(3)
        out[at] = [] if kind == 0 else [f"e{rng.randint(0, 9**6)}"] if kind == 1 else [f"i{rng.randint(0, 9**6)}", *out[at]]
    return [w for x in out for w in x]


def hashes(words):
    return word_hashes(" ".join(words))


def vocabulary(rng):
    weights = [1 / (i + 1) for i in range(3000)]
    return lambda n: [f"w{x}" for x in rng.choices(range(3000), weights, k=n)]


def test_stretch_is_the_edit_distance():
    rng = random.Random(1)
    for _ in range(300):
        item = [rng.choice("abcd") for _ in range(rng.randint(1, 90))]
        text = [rng.choice("abcd") for _ in range(rng.randint(0, 120))]
        edits, end = d.best_stretch(item, text)
        assert edits == plain_best(item, text)
        assert edits == min(plain_best(item, text[:end]), len(item))


def test_minimisers_depend_on_their_neighbours_only():
    h = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    whole, part = d.minimisers(h, 6), d.minimisers(h[100:200], 6)
    assert set(part + 100) <= set(whole)
    assert np.diff(whole).max() <= 6


@pytest.mark.parametrize("share,shortest,longest,least", [(0.1, 15, 60, 0.99), (0.2, 5, 14, 0.95), (0.2, 15, 23, 0.95), (0.2, 24, 60, 0.97), (0.2, 61, 200, 0.97)])
def test_recall(share, shortest, longest, least):
    """Share found of the copies that lie within the limit, at a tenth and at a fifth of the words edited."""
    rng = random.Random(2)
    some = vocabulary(rng)
    items = [(i, " ".join(some(rng.randint(shortest, longest)))) for i in range(300)]
    finder = d.Finder(items, 0.2, 5, 3, 4, 4)
    hit = tried = 0
    for i, text in items:
        copy = edited_to(rng, text.split(), int(share * len(text.split())))
        (found,) = finder.leaks([hashes(some(200) + copy + some(200))])
        hit, tried = hit + (i in [x[0] for x in found]), tried + 1
        for item, start, end, edits in found:
            assert edits <= finder.allowed[item]
    assert hit >= least * tried, hit / tried


def test_no_false_leak():
    rng = random.Random(2)
    some = vocabulary(rng)
    finder = d.Finder([(i, " ".join(some(rng.randint(15, 60)))) for i in range(300)], 0.2, 5, 3, 4, 4)
    assert not any(finder.leaks([hashes(some(3000)) for _ in range(20)]))


def test_short_items_are_found_as_they_stand():
    finder = d.Finder([(1, "Alpha beta"), (2, "gamma"), (3, "alpha beta gamma delta"), (4, "?!"), (5, "alpha, BETA")], 0.2, 5, 3, 4, 4)
    texts = ["x alpha beta gamma delta y alpha beta", "alpha x beta", "beta alpha", "", "gamma"]
    got = [sorted(x) for x in finder.leaks([word_hashes(t) for t in texts])]
    assert got == [[(1, 1, 3, 0), (2, 3, 4, 0), (3, 1, 5, 0), (5, 1, 3, 0)], [], [], [], [(2, 0, 1, 0)]]


def test_spans_blocks_and_odd_rows(spark):
    rng = random.Random(3)
    some = vocabulary(rng)
    items = [" ".join(some(20)) for _ in range(30)]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)] + [(90, None, "x"), (91, "", "x"), (92, "too short by far", "x"), (93, items[3], "x")], "item_id long, text string, doc_id string")
    long = " ".join(some(30_000) + items[7].split() + some(30_000))
    rows = [(1, "Before " + items[3].upper() + ", after"), (2, None), (3, ""), (4, " ".join(some(500))), (5, long), (6, items[0]), (6, items[0]), (7, "far: too short by far.")]
    docs = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, text string, leaks int, item_id string")
    want = [(1, 3, 1, 21, 0), (1, 93, 1, 21, 0), (5, 7, 30_000, 30_020, 0), (6, 0, 0, 20, 0), (6, 0, 0, 20, 0), (7, 92, 1, 5, 0)]
    for limit in ({}, {"per_block": 7}, {"per_block_chars": 300}):
        assert sorted(map(tuple, d.find_leaks(docs, bench, **limit).collect())) == want
        kept = d.drop_contaminated(docs, bench, **limit)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    named = bench.withColumn("item_id", F.concat(F.lit("q"), F.col("item_id").cast("string")))
    assert {r.item_id for r in d.find_leaks(docs, named).collect()} == {"q3", "q93", "q7", "q0", "q92"}
    assert d.find_leaks(docs.limit(0), bench).count() == 0
    assert d.find_leaks(docs, bench.limit(0)).count() == 0
    assert d.drop_contaminated(docs, bench.limit(0)).count() == len(rows)


def calls(work) -> int:
    """Calls that Python makes during ``work``; those that a map makes of a C function aren't among them."""
    seen = cProfile.Profile()
    seen.runcall(work)
    return sum(x.callcount for x in seen.getstats())


def test_hashing_makes_no_call_a_word():
    import xxhash

    fresh = " ".join(f"new{i}," for i in range(20_000))
    assert calls(lambda: word_hashes(fresh)) < 50
    for text in ("A_b-C\x1fd\x00e\u00a0f  9.5%\n", "\u0130stanbul \u03a3\u039f\u03a3 na\u00efve\u2014\u6f22\u5b57, e\u0301", "\u212aelvin \u212a", "...", "x"):
        assert word_hashes(text).tolist() == [xxhash.xxh3_64_intdigest(w) for w in re.findall(r"\w+", text.lower())]


def test_items_are_walked_together():
    rng = random.Random(4)
    some = vocabulary(rng)
    items = [(i, " ".join(some(rng.randint(15, 60)))) for i in range(400)]
    few, many = (calls(lambda n=n: d.Finder(items[:n], 0.2, 5, 3, 4, 4)) for n in (100, 400))
    assert many - few < 300 * 30


def test_minimisers_of_texts_put_together():
    rng = np.random.default_rng(5)
    for w in (1, 2, 5, 8):
        texts = [rng.integers(1, 4 if n % 2 else 2**63, n).astype(np.uint64) for n in (0, 1, w - 1, w, w + 1, 3, 0, 40, 41, 7, 2, 0)]
        h, begin = d.joined(texts)
        want = {int(b + i + x[i : i + w].argmin()) for x, b in zip(texts, begin, strict=False) for i in range(max(1, len(x) - w + 1)) if len(x)}
        assert d.text_minimisers(h, begin, w).tolist() == sorted(want)


def test_pairs_spare_comparisons_and_lose_no_leak(monkeypatch):
    rng = random.Random(6)
    some = vocabulary(rng)
    items = [(i, " ".join(some(rng.randint(5, 60)))) for i in range(300)]
    texts = []
    for _, text in items:
        item = text.split()
        texts.append(hashes([*some(rng.randint(0, 300)), *edited_to(rng, item, rng.randint(0, len(item) // 5)), *some(rng.randint(0, 300))]))
    finder, tried = d.Finder(items, 0.2, 5, 3, 4, 4), []

    def asked(self, h, begin, at, first):
        near = enough(self, h, begin, at, first)
        tried.append((len(near), int(near.sum())))
        return near

    enough = d.Finder.enough_pairs
    monkeypatch.setattr(d.Finder, "enough_pairs", asked)
    got = finder.leaks(texts)
    monkeypatch.setattr(d.Finder, "enough_pairs", lambda self, h, begin, at, first: np.ones(len(at), bool))
    assert got == finder.leaks(texts) and sum(map(len, got)) >= 285
    assert 2 * tried[0][1] < tried[0][0]
