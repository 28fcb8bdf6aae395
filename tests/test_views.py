"""Manifests, lines, labels and URL states on small fixtures with known results."""

import pytest
from pyspark.sql import functions as F

from viaduct.functions import urls
from viaduct.operators import manifests, polylines, rails, views

LINE = "array<struct<x:double,y:double>>"


def one(spark, expr, **columns):
    """The value of an expression over one row of literals ``name=(value, type)``."""
    schema = ", ".join(f"{n} {t}" for n, (_, t) in columns.items()) or "none int"
    return spark.createDataFrame([tuple(v for v, _ in columns.values()) or (None,)], schema).select(expr.alias("v")).first().v


def test_a_circle_of_targets_fails(spark):
    schema = "target string, source_ids array<string>, inputs array<string>, active boolean"
    good = spark.createDataFrame([("a", [], ["b", "c"], True), ("b", [], ["c"], True), ("c", [], [], True), ("d", [], [], False)], schema)
    assert {r.target: r.depth for r in manifests.target_closure(good, good.where("target = 'a'")).collect()} == {"a": 0, "b": 1, "c": 2}
    bad = good.union(spark.createDataFrame([("e", [], ["f"], True), ("f", [], ["e"], True)], schema))
    with pytest.raises(ValueError, match="circle"):
        manifests.target_closure(bad, bad.where("target = 'e'"))
    for asked in (["d"], ["x"]):
        with pytest.raises(Exception, match="active|unknown"):
            manifests.resolve_targets(good, asked).collect()


@pytest.mark.parametrize("href,want", [("b.zip", "http://h/x/b.zip"), ("/b.zip", "http://h/b.zip"), ("https://o/b", "https://o/b"), ("//o/b", "http://o/b")])
def test_addresses_from_a_page(spark, href, want):
    assert one(spark, manifests.resolve_href(F.col("b"), F.col("h")), b=("http://h/x/y?z=1/2", "string"), h=(href, "string")) == want


def test_shapes(spark):
    points = [(48.0, 2.0), (48.1, 2.0), (48.2, 2.0), (48.3, 2.0)]
    kind = "array<struct<lat:double,lon:double>>"
    cut = lambda a, b: polylines.shape_between(F.col("p"), F.struct(F.lit(a).alias("lat"), F.lit(2.0).alias("lon")), F.struct(F.lit(b).alias("lat"), F.lit(2.0).alias("lon")))
    get = lambda a, b: one(spark, cut(a, b), p=(points, kind))
    assert [r.lat for r in get(48.101, 48.299)] == [48.101, 48.2, 48.299]  # ends put on the stops
    assert [r.lat for r in get(48.11, 48.27)] == [48.11, 48.1, 48.2, 48.3, 48.27]  # beyond 350 m they are added
    assert get(48.3, 48.0) is None and get(40.0, 48.2) is None


def test_lines_on_the_map(spark):
    p = [(0.0, 0.0), (0.1, 0.0), (0.3, 0.0), (0.35, 0.0), (1.0, 0.0)]
    assert [r.x for r in one(spark, polylines.decimate(F.col("p"), 0.3), p=(p, LINE))] == [0.0, 0.3, 1.0]
    assert one(spark, polylines.to_polyline(F.lit(0.5), F.lit(2.0), F.col("p")), p=(p, LINE)) == 2.0
    assert one(spark, polylines.to_polyline(F.lit(3.0), F.lit(4.0), F.col("p")), p=([(0.0, 0.0)], LINE)) == 5.0
    assert [r.x for r in one(spark, polylines.concat_lines(F.array("p", "p", F.reverse("p"))), p=(p[:2], LINE))] == [0.0, 0.1, 0.0, 0.1, 0.0]


def test_a_network_is_stitched(spark):
    """Two tracks whose ends lie 100 m apart, a third that ends 20 m from the middle of the first, a fourth apart."""
    rows = [("a", 0, 48.0, 2.0), ("a", 1, 48.0, 2.004), ("b", 0, 48.0009, 2.004), ("b", 1, 48.01, 2.004), ("c", 0, 48.00018, 2.0021), ("c", 1, 48.004, 2.0021), ("d", 0, 48.5, 2.0), ("d", 1, 48.502, 2.0)]
    nodes, edges = rails.build_network(spark.createDataFrame(rows, "line string, i int, lat double, lon double"))
    assert nodes.select("component").distinct().count() == 2 and edges.where("src = dst").count() == 0
    assert edges.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("back")), ["src", "dst"]).where("w = back").count() == edges.count()


def test_labels_keep_their_place(spark):
    rows = [(1, 1, "Paris", "city-lbl", 0.0, 0.0, 5, False), (1, 2, "Lyon", "city-lbl", 5.0, 5.0, 9, False), (1, 3, "Nice", "city-lbl", 500.0, 0.0, 1, False), (2, 1, "Paris", "city-lbl", 0.0, 0.0, 5, True), (2, 2, "Lyon", "city-lbl", 5.0, 5.0, 9, False)]
    df = spark.createDataFrame(rows, "frame long, k long, name string, kind string, x double, y double, priority int, placed boolean")
    boxed = df.select("frame", "k", "priority", "placed", views.label_box(F.col("name"), F.col("kind"), F.col("x"), F.col("y")).alias("box"))
    assert {(r.frame, r.k) for r in views.pack_labels(boxed, 9).collect()} == {(1, 2), (1, 3), (2, 1)}
    assert {(r.frame, r.k) for r in views.pack_labels(boxed, 1).collect()} == {(1, 2), (2, 1)}


@pytest.mark.parametrize("state", ["#v1;t=a,b%2Dc;fi=3;fp=9;ll=10-70;rt=1;ui.q=x%20y", "#v1;t=;fi=1;fp=0;rt=0"])
def test_a_state_comes_back(spark, state):
    back = one(spark, urls.parse_strict(F.col("h")), h=(state, "string"))
    assert back.error is None and back.trip == ("a,b-c" if "a," in state else "") and back.round_trip == ("rt=1" in state)
    assert one(spark, urls.parse_lossy(F.col("h")), h=("#v9", "string")).interest == 1


def test_percentiles_take_the_larger_of_two(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 2.0), ("b", None)], "k string, v double")
    assert {r.k: r.p50 for r in views.percentiles(df, "k", "v", {"p50": 0.5}).collect()} == {"a": 5.0, "b": 2.0}
