"""N-gram Jaccard join by MinHash banding.

Documents are sets of five-word shingles. Signature rows per band and the number of bands follow
from the target recall at the threshold; documents are shuffled on band hashes and pairs are
verified on their full shingle sets. Documents with equal sets are one node from the start.

Large groups never meet as all pairs. A small bucket gives its pairs, a large one links its members
to a few leaders picked by hash. Verified links form components; then every large bucket that
still holds several components is compared whole, block against block, in tasks of bounded size:
two documents of one bucket are either in one class already or compared exactly. Links are counted
the same way in every class: each block of its texts is compared with each other one and gives one
count a text, so no link within a class goes missing and no pair is written out.

Joins on a node, a class or a leader that may hold a large share of all rows go through
``join_skewed``: the few heavy keys are broadcast, the rest is shuffled.

Defined results: a text without a word (null, empty, punctuation) is a class of its own document;
texts below five words have one shingle; repeated rows and equal sets share a class; any length is
read whole; an empty table gives no rows; other columns are kept aside. ``class_id`` is the least
doc_id of the class (nulls last), ``n_links`` the links of the document's text to texts with other
shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viaduct.llm.common import components, cut, heavy_rows, join_skewed, mix64, row_key, shingles, table


def choose_bands(threshold: float, recall: float, max_bands: int = 16) -> tuple[int, int]:
    """(bands, rows): most rows, so fewest false candidates, for which at most ``max_bands`` bands
    find a pair at the threshold with the target recall."""
    best = (max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold))), 1)
    for rows in range(2, 33):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands > max_bands:
            break
        best = (bands, rows)
    return best


def band_hashes(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash a band of the MinHash values of a shingle set."""
    k = bands * rows
    seeds = mix64(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    a, b = seeds[:k] | np.uint64(1), seeds[k:]
    low = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(values), 2048):
        part = np.multiply.outer(a, values[i : i + 2048])
        part += b[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    acc = np.arange(1, bands + 1, dtype=np.uint64)
    for column in low.reshape(bands, rows).T:
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + column)
    return acc


def signatures(docs: DataFrame, bands: int, rows: int, size: int) -> DataFrame:
    """doc_id, rid, node, n, bands: ``node`` hashes the shingle set, null if there is none; ``rid`` the row."""
    import pyarrow as pa

    def sign(batches):
        for batch in batches:
            node, n, found = [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py(), size)
                n.append(len(s))
                if len(s):
                    at = np.arange(1, len(s) + 1, dtype=np.uint64)
                    node.append(int(mix64(np.array([np.bitwise_xor.reduce(mix64(s + at)) + np.uint64(len(s))]))[0].astype(np.int64)))
                    found.append(band_hashes(s, bands, rows).astype(np.int64))
                else:
                    node.append(None)
                    found.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "rid", "node", "n", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", row_id(), "text")
    return base.mapInArrow(sign, f"doc_id {kind}, rid binary, node long, n int, bands array<bigint>")


def row_id():
    return row_key("doc_id", "text").alias("rid")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float, most: int = 100_000) -> DataFrame:
    """(u, v) of those pairs whose sets reach the threshold. ``u`` may be the leader of a large share
    of the pairs: its set is broadcast if it has at most ``most`` shingles, and a longer one meets
    the sets of like length by shuffle; ``v`` is in a bounded number of pairs a band."""
    pairs = cut(pairs)
    left, right = (sets.select(F.col("node").alias(end), F.col("s").alias(f"s{end}")) for end in "uv")
    few = heavy_rows(pairs, left, "u").where(F.size("su") <= most)
    keys = F.broadcast(few.select("u"))
    both = pairs.join(keys, "u", "left_anti").join(right, "v").join(left, "u")
    both = both.unionByName(pairs.join(keys, "u", "left_semi").join(right, "v").join(F.broadcast(few), "u"))
    shared = F.size(F.array_intersect("su", "sv"))
    near = shared >= F.lit(threshold) * (F.size("su") + F.size("sv") - shared) - 1e-9
    length = F.least(F.size("su"), F.size("sv")) >= F.lit(threshold) * F.greatest(F.size("su"), F.size("sv")) - 1e-9
    return both.where(length).where(near).select("u", "v")


def near_matrix(left: list, members: list, threshold: float) -> np.ndarray:
    """Which of ``members``, whose first are ``left``, are near each of ``left``."""
    sizes = np.array([len(s) for _, _, s in members], np.int64)
    vocabulary, at = np.unique(np.concatenate([s for _, _, s in members]), return_inverse=True)
    row = np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    lo, shared = 0, np.zeros((len(left), len(members)), np.float32)
    for start in range(0, len(vocabulary), 2048):
        hi = np.searchsorted(at, start + 2048)
        dense = np.zeros((len(members), min(2048, len(vocabulary) - start)), np.float32)
        dense[row[lo:hi], at[lo:hi] - start] = 1
        shared += dense[: len(left)] @ dense.T
        lo = hi
    total = sizes[: len(left), None] + sizes[None, :] - shared
    return shared >= threshold * total - 1e-6


def compare_block(left: list, right: list, threshold: float) -> list[tuple[int, int]]:
    """Links between members ``(node, component, set)`` of different components, one list against
    another or, with no ``right``, against itself; pairs that earlier links have joined are left out."""
    members = left + right
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for i, j in zip(*np.nonzero(near_matrix(left, members, threshold)), strict=True):
        if j >= len(left) if right else j > i:
            a, b = root(members[i][1]), root(members[j][1])
            if a != b:
                parent[a] = b
                found.append((members[i][0], members[j][0]))
    return found


def count_block(left: list, right: list, threshold: float) -> list[tuple[int, int]]:
    """(node, links) of one list against another or, with no ``right``, against itself."""
    near = near_matrix(left, left + right, threshold)
    if right:
        near = near[:, len(left) :]
        counts = [*near.sum(axis=1), *near.sum(axis=0)]
    else:
        counts = near.sum(axis=1) - 1
    return [(node, int(n)) for (node, _, _), n in zip(left + right, counts, strict=True) if n]


def blockwise(groups: DataFrame, sets: DataFrame, compare, columns: list[str], threshold: float, block: int = 256) -> DataFrame:
    """Runs ``compare`` on each pair of blocks of the groups ``(key, node, component, n_group)``."""
    import pandas as pd

    blocks = F.ceil(F.col("n_group") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("node", "key"), blocks).cast("int")
    dealt = groups.withColumn("blocks", blocks).withColumn("b", mine)
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b", "node", "component")
    dealt = dealt.join(sets, "node")

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(n), int(c), np.asarray(s)) for n, c, s in zip(pdf["node"], pdf["component"], pdf["s"], strict=True)]
        x, y = int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
        left = [r for r, b in zip(rows, pdf["b"], strict=True) if b == x]
        right = [r for r, b in zip(rows, pdf["b"], strict=True) if b != x]
        found = compare(left, right, threshold) if left and (right or x == y) else []
        return pd.DataFrame(found, columns=columns, dtype="int64")

    return dealt.groupBy("key", "x", "y").applyInPandas(task, ", ".join(f"{c} long" for c in columns))


def compare_rest(rest: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links across components inside buckets ``(key, node, component, n_group)``."""
    return blockwise(rest, sets, compare_block, ["u", "v"], threshold)


def count_links(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(node, n_links) of ``members`` (node, component, n_group) from all pairs of each class."""
    whole = blockwise(members.withColumn("key", F.col("component")), sets, count_block, ["node", "n"], threshold)
    return whole.groupBy("node").agg(F.sum("n").alias("n_links"))


def near_classes(docs: DataFrame, threshold: float = 0.8, size: int = 5, recall: float = 0.995, small: int = 8, leaders: int = 3, counted: bool = True) -> DataFrame:
    """One row a document: doc_id, rid, class_id, keeper, n_links; ``keeper`` is the rid of the document that stays.

    Without ``counted`` links aren't counted and ``n_links`` is null.
    """
    bands, rows = choose_bands(threshold, recall)
    signed = cut(signatures(docs, bands, rows, size))
    # equal sets are one node, and one of their rows lends its text
    first = lambda *c: F.min(F.struct(F.col(c[0]).isNull().alias("none"), F.col(c[0]).alias("doc_id"), F.col(c[1]).alias("rid"))).alias("first")
    worded = signed.where("node is not null")
    nodes = worded.groupBy("node").agg(first("doc_id", "rid"), F.count("*").alias("copies")).select("node", "first.doc_id", "first.rid", "copies")
    nodes = cut(nodes)
    lender = nodes.select("node", "rid")
    member = worded.select("node", F.posexplode("bands").alias("band", "hash")).select(F.xxhash64("band", "hash").alias("key"), "node").distinct()
    shared = member.groupBy("key").agg(F.count("*").alias("n_bucket"), *[F.min_by("node", F.xxhash64("node", F.lit(i))).alias(f"l{i}") for i in range(leaders)]).where("n_bucket > 1")
    full = cut(join_skewed(member, shared, "key"))
    few = full.where(F.col("n_bucket") <= small)
    pairs = few.groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("m"))
    pairs = pairs.select(F.explode("m").alias("u"), "m").select("u", F.explode("m").alias("v")).where("u < v")
    many = full.where(F.col("n_bucket") > small)
    stars = many.select("node", F.explode(F.array_distinct(F.array(*[f"l{i}" for i in range(leaders)]))).alias("l")).where("node <> l")
    stars = stars.select(F.col("l").alias("u"), F.col("node").alias("v"))
    pairs = pairs.union(stars).distinct()

    wanted = full.select("node").distinct().join(lender, "node")
    texts = docs.select(row_id(), "text").join(wanted, "rid").dropDuplicates(["rid"])
    sets = cut(shingle_sets(texts, size))
    links = cut(verify(pairs, sets, threshold))
    joined = components(links)
    label = lambda df: df.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = label(many.select("key", "node", F.col("n_bucket").alias("n_group")))
    split = open_.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    rest = open_.join(split, "key", "left_semi")
    more = cut(compare_rest(rest, sets, threshold).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    if not more.isEmpty():
        joined = components(links.union(more).distinct())
    # only texts with a copy or a link have more to tell than their own row
    told = nodes.join(joined, "node", "left").where("copies > 1 or component is not null").withColumn("component", F.coalesce("component", "node"))
    told = cut(told.select("node", "component", "doc_id", "rid"))
    classes = told.groupBy("component").agg(first("doc_id", "rid"), F.count("*").alias("n_group")).select("component", F.col("first.doc_id").alias("class_id"), F.col("first.rid").alias("keeper"), "n_group")
    told = cut(join_skewed(told.select("node", "component"), classes, "component"))
    if counted:
        found = count_links(told.where("n_group > 1").select("node", "component", "n_group"), sets, threshold)
        told = cut(told.join(found, "node", "left"))
    else:
        told = told.withColumn("n_links", F.lit(None).cast("long"))
    known = told.select("node", "class_id", "keeper", "n_links", F.lit(True).alias("told"))
    plain = signed.select("doc_id", "rid", "node")
    out = join_skewed(plain.where("node is not null"), known, "node", "left")
    alone = plain.where("node is null").select("node", "doc_id", "rid", F.lit(None).cast(docs.schema["doc_id"].dataType).alias("class_id"), F.lit(None).cast("binary").alias("keeper"), F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("boolean").alias("told"))
    out = out.unionByName(alone)
    # a null class_id is a class of documents without an id, as long as there is one
    own = lambda c, mine: F.when(F.col("told"), F.col(c)).otherwise(F.col(mine)).alias(c)
    return out.select("doc_id", "rid", own("class_id", "doc_id"), own("keeper", "rid"), (F.coalesce("n_links", F.lit(0).cast("long")) if counted else F.col("n_links")).alias("n_links"))


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    import pyarrow as pa

    def sets(batches):
        for batch in batches:
            found = [shingles(t.as_py(), size).astype(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "s"])

    return texts.select("node", "text").mapInArrow(sets, "node long, s array<bigint>")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the least doc_id; of rows that repeat its doc_id and
    text the one whose columns have the least hash stays."""
    found = near_classes(docs, counted=False)
    drop = cut(found.where("rid <> keeper").select("rid").distinct())
    carried = docs.select(row_id(), F.struct(*[F.col(c) for c in docs.columns]).alias("carried"))
    rest = carried.join(drop, "rid", "left_anti")
    numbered = rest.withColumn("copy", F.row_number().over(Window.partitionBy("rid").orderBy(F.xxhash64(F.to_json("carried")))))
    return numbered.where("copy = 1").select("carried.*")


def op9_ngram_join(spark, sf_dir):
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links")
