"""Queries that do more than their SQL for comparison, against brute force."""

import math

from viaduct.operators import spatial, stations
from viaduct.plans import graph, places

TABLES = "/root/testdata/sf0.001"


def metres(a, b):
    (y, x), (v, u) = ([math.radians(c) for c in p] for p in (a, b))
    h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


def plain_stems(rows):
    out = {}
    for k, name, *at in rows:
        near = [other for j, other, *p in rows if j != k and metres(at, p) <= 3e4]
        full = " " in name and name in near
        out[k] = name if full or not any(name.split(" ")[0] == o.split(" ")[0] for o in near) else name.split(" ")[0]
    return out


def test_stems_far_north_and_apart(spark):
    rows = [(1, "st paul", 69.9, 20.0), (2, "st anne", 69.9, 20.7), (3, "ix one", 10.0, 5.0), (4, "ix two", 10.0, 5.5), (5, "ab cd ef", -0.09, -0.09), (6, "ab cd gh", 0.09, 0.09), (7, "ab ef", -0.09, -0.09), (8, "solo", 1.0, 1.0)]
    got = {r.k: r.stem for r in stations.stems(spark.createDataFrame(rows, "k long, name string, lat double, lon double")).collect()}
    # a saint alone is no place; two points 28 km apart share two words, and the third one
    assert got == {1: "st paul", 2: "st anne", 3: "ix one", 4: "ix two", 5: "ab cd", 6: "ab cd", 7: "ab", 8: "solo"}


def test_gr_13_links_by_all_orders(spark):
    nation = {r.c_custkey: r.c_nationkey for r in spark.read.parquet(f"{TABLES}/customer.parquet").collect()}
    top = {k: k for k in nation}

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    first = {}
    for r in spark.read.parquet(f"{TABLES}/orders.parquet").collect():
        if r.o_custkey in nation:
            a, b = root(r.o_custkey), root(first.setdefault((r.o_orderdate, nation[r.o_custkey]), r.o_custkey))
            top[max(a, b)] = min(a, b)
    want = {k: root(k) for k in nation}
    assert {r.id: r.component for r in graph.gr_13(spark, TABLES).collect()} == want
    customers = spark.createDataFrame([(k, k // 10) for k in range(6)] + [(9, 9)], "c_custkey long, c_nationkey int")
    orders = spark.createDataFrame([(1, 0, "a"), (2, 1, "a"), (3, 1, "b"), (4, 2, "b"), (5, 9, "a"), (9, 3, "c")], "o_orderkey long, o_custkey long, o_orderdate string")
    assert {r.id: r.component for r in graph.shared_dates(orders, customers).collect()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 9: 9}


def test_jn_12_reaches_beyond_the_next_cell(spark):
    points = [(1, 60.9, 10.24), (2, 60.9, -0.01), (3, 40.0, 5.0)]
    nodes = [(1, 60.9, 10.51), (2, 60.9, 10.0), (3, 60.9, -0.3), (4, 61.05, 0.1), (5, 40.1, 5.1), (6, 40.17, 5.0), (7, 40.0, 5.24)]
    met = spatial.near_pairs(spark.createDataFrame(points, "k long, lat double, lon double"), spark.createDataFrame(nodes, "node long, nlat double, nlon double"), 2e4)
    got = {(r.k, r.node): r.m for r in met.collect()}
    want = {(k, n): metres(p, q) for k, *p in points for n, *q in nodes if metres(p, q) <= 2e4}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 0.01 for x in want) and {(1, 1), (2, 3)} <= want.keys()


def test_jn_12_on_a_whole_table(spark):
    d = "/root/testdata/sf0.01"
    points = [(r.c_custkey, 36 + r.c_custkey * 37 % 250 / 10, -9 + r.c_custkey * 53 % 340 / 10) for r in spark.read.parquet(f"{d}/customer.parquet").collect()]
    nodes = [(r.s_suppkey, 36 + r.s_suppkey * 91 % 250 / 10, -9 + r.s_suppkey * 17 % 340 / 10) for r in spark.read.parquet(f"{d}/supplier.parquet").collect()]
    want = set()
    for k, *p in points:
        near = sorted((metres(p, q), n) for n, *q in nodes if abs(p[0] - q[0]) < 0.2 and metres(p, q) <= 2e4)
        want |= {(k, n) for _, n in near[:3]}
    assert {(r.k, r.node) for r in places.QUERIES["jn_12"](spark, d).collect()} == want
