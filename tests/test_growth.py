"""Rows that share a place meet others once: no step lists more rows than places give, unless they are the result."""

import duckdb

from tests.compare import database, difference
from viaduct.operators import artifacts, rails, spatial, stations, views
from viaduct.plans import feed

TABLES = "/root/testdata/sf0.001"


def widest(df):
    """The rows of ``df`` and the most rows that a step of its last job gave."""
    rows = df.collect()

    def most(node):
        name = node.getClass().getSimpleName()
        inner = node.executedPlan() if name == "AdaptiveSparkPlanExec" else node.plan() if name.endswith("QueryStageExec") else None
        own = node.metrics().get("numOutputRows")
        kids = [inner] if inner is not None else [node.children().apply(i) for i in range(node.children().size())]
        return max([own.get().value() if own.isDefined() else 0] + [most(k) for k in kids])

    return rows, most(df._jdf.queryExecution().executedPlan())


def clicks(spark, copies):
    return spark.range(copies).selectExpr("id AS k", "0.0D AS x", "0.001D * (id % 2) AS y")


def bundle(spark, number):
    """Lines through nearly one point, of three points each."""
    return spark.range(number).selectExpr("id AS line", "array(named_struct('x', -0.01D, 'y', 0.0D), named_struct('x', 0.01D, 'y', id / 1e6D), named_struct('x', 0.02D, 'y', 0.3D)) AS p")


def test_jn_18_clicks_at_one_place_meet_a_line_once(spark):
    rows, most = widest(spatial.on_route(clicks(spark, 300), bundle(spark, 300), 0.05, 0.004))
    assert {r.k for r in rows} == set(range(300)) and most < 20_000


def test_jn_24_clicks_at_one_place_meet_a_line_once(spark):
    rows, most = widest(spatial.line_under(clicks(spark, 300), bundle(spark, 300), 0.05, 0.002))
    assert {(r.k, r.line) for r in rows if r.k % 2 == 0} == {(k, 0) for k in range(0, 300, 2)} and len(rows) == 300 and most < 20_000


def test_jn_24_takes_the_nearest_of_equals_by_key_and_steep_lines(spark):
    p = lambda *q: [{"x": float(x), "y": float(y)} for x, y in q]
    lines = spark.createDataFrame([(7, p((0.1, -0.3), (0.1, 0.3))), (5, p((0.1, 0.3), (0.1, -0.3))), (1, p((0.1021, -0.3), (0.1021, 0.3))), (9, p((-0.3, -0.3), (0.3, 0.2)))], "line long, p array<struct<x:double,y:double>>")
    at = spark.createDataFrame([(1, 0.1, 0.2), (2, 0.1001, 0.2), (3, 0.0, -0.05), (4, 0.0, 0.2)], "k long, x double, y double")
    assert {r.k: r.line for r in spatial.line_under(at, lines, 0.05, 0.002).collect()} == {1: 5, 2: 5, 3: 9}


def test_jn_23_clicks_at_one_place_meet_a_marker_once(spark):
    at = spark.range(200).selectExpr("id AS k", "id % 2 * 100.0D AS x", "10.0D AS y")
    marks = spark.range(400).selectExpr("id AS entry", "0.5D AS ex", "10.0D AS ey", "5.0D AS r")
    rows, most = widest(spatial.hit_test(at, marks, 48.0))
    assert {(r.k, r.entry, r.m) for r in rows} == {(k, 0, 0.5) for k in range(0, 200, 2)} and most < 5_000


def test_jn_23_rounds_of_cells_find_what_all_pairs_do(spark):
    at = [(k, float(k * 37 % 211), float(k * 53 % 199)) for k in range(300)]
    marks = [(e, float(e * 91 % 97), float(e * 17 % 199), float(e % 30)) for e in range(900)]
    want = {}
    for k, x, y in at:
        near = [(((x - ex) ** 2 + (y - ey) ** 2) ** 0.5, e) for e, ex, ey, r in marks if ((x - ex) ** 2 + (y - ey) ** 2) ** 0.5 <= max(8, r + 4)]
        if near:
            want[k] = min(near)[1]
    got = spatial.hit_test(spark.createDataFrame(at, "k long, x double, y double"), spark.createDataFrame(marks, "entry long, ex double, ey double, r double"), 48.0)
    assert {r.k: r.entry for r in got.collect()} == want and 0 < len(want) < 300


def test_ct_5_places_meet_once_and_walks_decide_the_rest(spark):
    nodes = spark.range(400).selectExpr("id AS node", "48.0D AS lat", "2.0D + (id % 2) / 10 AS lon")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (900, 0), (900, 7)], "src long, dst long")
    df = artifacts.close_without_edge(nodes, edges, (5_000.0, 9_000.0))
    got = {(r.u, r.v): (r.band, r.hops) for r in df.collect()}
    hops = {(0, 1): 0, (1, 2): 0, (2, 3): 0, (3, 4): 0, (0, 2): 2, (1, 3): 2, (2, 4): 2, (0, 3): 3, (1, 4): 3, (0, 7): 2, (1, 7): 3}
    want = {(u, v): (5_000 if u % 2 == v % 2 else 9_000, hops.get((u, v))) for u in range(400) for v in range(u + 1, 400)}
    assert got == {p: x for p, x in want.items() if x[1] != 0} and df.count() == len(got)
    # neither sorted nor shuffled: pairs are listed once, where their places meet, and no table of them is put down
    assert "SortAggregate" not in (plan := df._jdf.queryExecution().executedPlan().toString()) and "Generate explode" in plan and "Join LeftAnti" not in plan


def test_fn_m24_equal_boxes_meet_once(spark):
    box = lambda x: f"named_struct('left', {x}D, 'right', {x}D + 300, 'top', 0.0D, 'bottom', 300.0D)"
    labels = spark.range(120).selectExpr("id % 2 AS frame", "id AS k", f"CASE WHEN id % 3 = 0 THEN {box('100')} ELSE {box('120')} END AS box")
    rows, most = widest(views.overlapping_labels(labels))
    want = {(f, a, b) for f in (0, 1) for a in range(f, 120, 2) for b in range(a + 2, 120, 2)}
    assert {(r.frame, r.a, r.b) for r in rows} == want and len(rows) == len(want) and most < 2.5 * len(want)


def test_jn_1_places_of_a_code_meet_once(spark):
    here = spark.range(300).selectExpr("id AS k", "array('a', 'b') AS codes", "48.0D + id % 2 AS lat", "2.0D AS lon")
    refs = spark.range(300).selectExpr("id AS r", "array('a') AS codes", "48.0D AS nlat", "2.0D + (id % 3) / 10 AS nlon")
    rows, most = widest(stations.match_by_code(here, refs))
    assert {(r.k, r.r) for r in rows} == {(k, 0) for k in range(300)} and most < 5_000


def test_src_4_of_equal_places_the_first_in_the_file(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM read_parquet('{TABLES}/part.parquet')) TO '{tmp_path}/part.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (l_orderkey % 3 AS l_orderkey, l_suppkey % 5 AS l_suppkey) FROM read_parquet('{TABLES}/lineitem.parquet')) TO '{tmp_path}/lineitem.parquet'")
    con = database(str(tmp_path))
    con.execute("SET threads = 1")
    assert difference(spark, con, feed.QUERIES["src_4"], feed.ORACLE_SQL["src_4"], str(tmp_path)) is None


def test_jn_10_and_jn_9_parents_at_one_place_meet_a_place_once(spark):
    kids = spark.range(200).selectExpr("id AS k", "'paris' AS key", "48.0D AS lat", "2.0D AS lon")
    many = spark.range(300).selectExpr("id AS cluster", "'Paris' AS name", "48.0D AS lat", "2.0D + (id % 2) / 100 AS lon", "id % 4 AS stations")
    for found in (stations.route_parents(kids, many), stations.urban_parents(kids, many)):
        rows, most = widest(found)
        assert {(r.k, r.parent) for r in rows} == {(k, None) for k in range(200)} and most < 10_000


def test_jn_10_a_child_is_not_its_own_parent(spark):
    kids = spark.createDataFrame([(1, "paris", 48.0, 2.0), (2, "paris", 48.0, 2.0), (9, "paris", 48.0, 2.0)], "k long, key string, lat double, lon double")
    clusters = spark.createDataFrame([(1, "Paris", 48.0, 2.0, 9), (2, "Paris", 48.0, 2.001, 8), (3, "Paris", 48.0, 2.0, 7), (4, "Paris", 48.0, 2.0, 7)], "cluster long, name string, lat double, lon double, stations int")
    assert {r.k: r.parent for r in stations.route_parents(kids, clusters).collect()} == {1: 2, 2: 1, 9: 1}


def test_jn_15_and_jn_13_list_pairs_where_places_meet(spark):
    nodes = spark.range(700).selectExpr("id AS node", "48.0D AS lat", "2.0D + (id % 2) / 10 AS lon")
    rows, most = widest(spatial.close_pairs(nodes, 8_000.0))
    assert {(r.u, r.v) for r in rows} == {(u, v) for u in range(700) for v in range(u + 1, 700)} and len(rows) == 700 * 699 // 2 and most < 1.6 * len(rows)
    some = spatial.near_places(nodes, nodes.selectExpr("lat AS nlat", "lon AS nlon"), 8_000.0)
    assert some.count() == 4


def test_jn_12_nodes_at_one_place_are_no_more_than_asked(spark):
    points = spark.range(300).selectExpr("id AS k", "48.0D AS lat", "2.0D AS lon")
    nodes = spark.range(300).selectExpr("id AS node", "48.0D AS nlat", "2.0D + (id % 2) / 100 AS nlon")
    rows, most = widest(spatial.at_places(points, spatial.first_near(points, nodes, 20_000.0, "node", k=3)))
    assert {(r.k, r.n, r.node) for r in rows} == {(k, n, 2 * n - 2) for k in range(300) for n in (1, 2, 3)} and most < 2_000


def trips(spark, number):
    return spark.range(number).selectExpr("id AS trip", "48.0D AS lat", "2.0D + (id % 2) / 1000 AS lon", "48.01D AS blat", "2.0D AS blon")


def test_gr_16_trips_of_one_place_are_snapped_once(spark):
    nodes = spark.range(300).selectExpr("id AS node", "48.0D + id / 1e5 AS lat", "2.0D AS lon", "id % 2 AS component")
    rows, most = widest(rails.snaps(trips(spark, 200).withColumnRenamed("trip", "k"), nodes))
    assert len(rows) == 1_600 and {r.k for r in rows} == set(range(200)) and most < 3_000


def test_var_19_trips_of_one_kind_are_routed_once(spark):
    seen = []

    def found(some):
        seen.append(some.count())
        return some.select("trip", "lon")

    got = {r.trip: r.lon for r in rails.per_kind(trips(spark, 50), rails.ENDS, found).collect()}
    assert seen == [2] and got == {k: 2.0 + k % 2 / 1000 for k in range(50)}
