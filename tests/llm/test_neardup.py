"""Near-duplicate classes against all-pairs brute force on small fixtures."""

import random

import numpy as np
import pytest

from viaduct.llm import neardup
from viaduct.llm.common import components, shingles

SCHEMA = "doc_id long, text string, node string, key int, n int"


def brute(texts):
    sets = {i: set(shingles(t).tolist()) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                lo, hi = sorted((root(a), root(b)))
                parent[hi] = lo
    return {i: root(i) for i in ids}


def brute_links(texts):
    sets = {i: frozenset(shingles(t).tolist()) for i, t in texts.items()}
    distinct = set(sets.values()) - {frozenset()}
    near = lambda a, b: a != b and len(a & b) >= 0.8 * len(a | b)
    return {i: sum(near(s, o) for o in distinct) if s else 0 for i, s in sets.items()}


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 5000)}"
    texts = {}
    while len(texts) < n:
        base = [word() for _ in range(rng.choice([3, 5, 40, 120]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, max(0, len(base) // 40))):
                copy[rng.randrange(len(copy))] = word()
            texts[len(texts)] = " ".join(copy)
    return texts


def test_bands():
    bands, rows = neardup.choose_bands(0.8, 0.995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.995 and bands <= 16


def test_classes_match_brute_force(spark):
    texts = corpus(250, 1) | {900: "", 901: None, 902: "?!", 903: "one", 904: "One."}
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in texts.items()], SCHEMA)
    found = neardup.near_classes(df).collect()
    assert {r.doc_id: r.class_id for r in found} == brute(texts)
    assert {r.doc_id: r.n_links for r in found} == brute_links(texts)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(400):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(150)] = f"x{rng.randint(0, 10**6)}"
        texts[i] = " ".join(copy)
    df = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in texts.items()], SCHEMA)
    found = neardup.near_classes(df, small=4).collect()
    want = brute(texts)
    assert {r.doc_id: r.class_id for r in found} == want
    assert {r.doc_id: r.n_links for r in found} == brute_links(texts)
    kept = {r.doc_id for r in neardup.drop_near_duplicates(df).collect()}
    assert kept == set(want.values())


def test_repeats_nulls_and_empty(spark):
    rows = [(None, "a b c d e f", "x", 1, 2), (7, "a b c d e f", "x", 1, 2), (7, "a b c d e f", "x", 1, 2), (8, None, "x", 1, 2), (8, None, "x", 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.class_id for r in neardup.near_classes(df).collect()) == [7, 7, 7, 8, 8]
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [7, 8]
    assert neardup.near_classes(df.limit(0)).count() == 0
    assert neardup.drop_near_duplicates(df.limit(0)).count() == 0


def test_compare_block_links_all_components():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**60, 5000))
    sets = [np.sort(np.concatenate([base[: 4500 + 20 * i], rng.integers(0, 2**60, 5)])) for i in range(20)]
    found = neardup.compare_block([(i, i, s) for i, s in enumerate(sets)], [], 0.8)
    assert len(found) == 19
    assert len(neardup.compare_block([(0, 0, sets[0])], [(1, 1, sets[1]), (2, 2, rng.integers(0, 9, 3))], 0.8)) == 1


@pytest.mark.parametrize("edges,want", [([], {}), ([(1, 2), (2, 3), (9, 8)], {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}), ([(i, i + 1) for i in range(60)], {i: 0 for i in range(61)})])
def test_components(spark, edges, want):
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
