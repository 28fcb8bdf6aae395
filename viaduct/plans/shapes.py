"""Lines and rail networks: vectors as lines on a map, customers as points of their nation's line, suppliers as
tracks, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from viaduct.operators import polylines as p
from viaduct.operators import graphs, rails, ranks, spatial
from viaduct.plans import scalars as s
from viaduct.plans.feed import read
from viaduct.plans.places import HALTS, at, halts, q_at

C = F.col
XY = "{'x': embedding[2 * i + 1]::DOUBLE, 'y': embedding[2 * i + 2]::DOUBLE}"
LINES = f"v AS (SELECT vec_id, list_transform(generate_series(0, 31), lambda i: {XY}) AS p FROM embeddings), r AS (SELECT vec_id, i, p[i].x AS x, p[i].y AS y, lag(p[i].x) OVER w AS px, lag(p[i].y) OVER w AS py FROM (SELECT *, unnest(generate_series(1, 32)) AS i FROM v) WINDOW w AS (PARTITION BY vec_id ORDER BY i))"


def lines(spark, d):
    """32 points a vector."""
    get = lambda i: F.get("embedding", i.cast("int")).cast("double")
    return read(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(get(2 * i).alias("x"), get(2 * i + 1).alias("y"))).alias("p"))


def _rows(spark, d):
    return lines(spark, d).select(C("vec_id").alias("line"), F.posexplode("p").alias("i", "q")).select("line", "i", "q.x", "q.y")


def wn_5(spark, d):
    return p.midpoint(_rows(spark, d)).select(C("line").alias("vec_id"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


WN_5 = f"WITH {LINES}, l AS (SELECT *, coalesce(sqrt(pow(x - px, 2) + pow(y - py, 2)), 0) AS d FROM r), c AS (SELECT *, sum(d) OVER (PARTITION BY vec_id ORDER BY i) AS run, sum(d) OVER (PARTITION BY vec_id) / 2 AS half FROM l), h AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY i) AS n FROM c WHERE run >= half) SELECT vec_id, round(px + (x - px) * (half - (run - d)) / d, 6) AS x, round(py + (y - py) * (half - (run - d)) / d, 6) AS y FROM h WHERE n = 1"


def wn_6(spark, d):
    thin = p.decimate(C("p"), 0.3)
    return lines(spark, d).select("vec_id", F.size(thin).cast("long").alias("kept"), F.round(F.aggregate(thin, F.lit(0.0), lambda a, q: a + q["x"]), 6).alias("sum_x"))


WN_6 = f"WITH RECURSIVE {LINES}, k(vec_id, i, ax, ay, n, sx) AS (SELECT vec_id, 1, x, y, 1, x FROM r WHERE i = 1 UNION ALL SELECT r.vec_id, (r.i)::INT, CASE WHEN far THEN r.x ELSE ax END, CASE WHEN far THEN r.y ELSE ay END, n + far::INT, sx + CASE WHEN far THEN r.x ELSE 0 END FROM (SELECT k.*, r.x, r.y, r.i AS j, pow(r.x - ax, 2) + pow(r.y - ay, 2) >= 0.3 * 0.3 OR r.i = 32 AS far FROM k JOIN r ON r.vec_id = k.vec_id AND r.i = k.i + 1) AS z JOIN r ON r.vec_id = z.vec_id AND r.i = z.j) SELECT vec_id, n::BIGINT AS kept, round(sx, 6) AS sum_x FROM k WHERE i = 32"


def _ways(spark, d):
    return halts(spark, d).select(C("country").cast("long").alias("line"), C("k").alias("i"), "lat", "lon")


_WAYS = f"{HALTS}, g AS (SELECT country::BIGINT AS line, k AS i, lat, lon, lag(lat) OVER w AS blat, lag(lon) OVER w AS blon, row_number() OVER w - 1 AS n FROM halts WINDOW w AS (PARTITION BY country ORDER BY k))"
_STEP = s.q_hav("blat", "blon", "lat", "lon")


def wn_7(spark, d):
    return p.lengths(_ways(spark, d))


WN_7 = f"WITH {_WAYS} SELECT line, coalesce(sum(round({_STEP})), 0)::BIGINT AS metres FROM g GROUP BY line"


def wn_8(spark, d):
    return p.densify(_ways(spark, d), 50_000.0).select("line", C("i").cast("long").alias("i"), "j", (F.round("lat", 6) + 0.0).alias("lat"), (F.round("lon", 6) + 0.0).alias("lon"))


WN_8 = f"WITH {_WAYS}, c AS (SELECT *, greatest(ceil({_STEP} / 50000), 1)::INT AS pieces FROM g WHERE n > 0), j AS (SELECT *, unnest(generate_series(1, pieces))::INT AS j FROM c) SELECT line, n AS i, j, round(blat + (lat - blat) * (j / pieces), 6) + 0.0 AS lat, round(blon + (lon - blon) * (j / pieces), 6) + 0.0 AS lon FROM j UNION ALL SELECT line, n, 0, round(lat, 6) + 0.0, round(lon, 6) + 0.0 FROM g WHERE n = 0"


def wn_9(spark, d):
    """A line in three parts that share their ends, one point written twice."""
    parts = F.array(F.slice("p", 1, 12), F.slice("p", 12, 9), F.array(F.get("p", F.lit(19)), F.get("p", F.lit(19))), F.slice("p", 20, 13))
    whole = p.concat_lines(parts)
    return lines(spark, d).select("vec_id", F.size(whole).cast("long").alias("points"), (whole == C("p")).alias("same"))


def wn_10(spark, d):
    found = p.shape_rows(_ways(spark, d), _asked(spark, d), 300_000.0, 1_500_000.0)
    return found.groupBy("line").agg(F.count("*").alias("points"), F.round(F.sum("lat"), 6).alias("sum_lat"))


def _asked(spark, d):
    """Two places to look for on each line."""
    k = C("line")
    put = lambda a, b, p: [v.alias(f"{p}{n}") for n, v in zip(("lat", "lon"), at(k, a, b), strict=True)]
    return _ways(spark, d).select("line").distinct().select("line", *put(91, 17, "a"), *put(13, 29, "b"))


_ASKED = f"{_WAYS}, q AS (SELECT line, n, lat, lon, {q_at('line', 91, 17, names='alat,alon')}, {q_at('line', 13, 29, names='zlat,zlon')} FROM g), da AS (SELECT *, {s.q_hav('lat', 'lon', 'alat', 'alon')} AS d1, {s.q_hav('lat', 'lon', 'zlat', 'zlon')} AS d2 FROM q), st AS (SELECT line, arg_min(n, (d1, n)) AS i1, min(d1) AS m1 FROM da GROUP BY line), en AS (SELECT line, arg_min(n, (d2, n)) AS i2, min(d2) AS m2 FROM da JOIN st USING (line) WHERE n >= i1 GROUP BY line)"
WN_10 = f"WITH {_ASKED}, ok AS (SELECT * FROM st JOIN en USING (line) WHERE i2 > i1 AND m1 <= 1500000 AND m2 <= 1500000) SELECT line, i2 - i1 - 1 + CASE WHEN any_value(m1) > 300000 THEN 2 ELSE 1 END + CASE WHEN any_value(m2) > 300000 THEN 2 ELSE 1 END AS points, round(sum(CASE WHEN n > i1 AND n < i2 THEN lat WHEN n = i1 THEN CASE WHEN m1 > 300000 THEN lat ELSE 0 END + alat WHEN n = i2 THEN CASE WHEN m2 > 300000 THEN lat ELSE 0 END + zlat ELSE 0 END), 6) AS sum_lat FROM ok JOIN q USING (line) GROUP BY line, i1, i2"


def jn_14(spark, d):
    """Nearest points of a line as their places in it, from 0."""
    numbered = ranks.position(_ways(spark, d), "i", key=["line"])
    found = p.nearest_rows(numbered.select("line", C("position").alias("i"), "lat", "lon"), _asked(spark, d))
    return found.select("line", "start", F.round("d1", 2).alias("d1"), "finish", F.round("d2", 2).alias("d2"))


def flt_17(spark, d):
    return lines(spark, d).select("vec_id", p.meets_view(C("p"), (0.2, 0.3, 0.2, 0.3)).alias("hit"))


def flt_14(spark, d):
    from viaduct.functions.geo import boxes_overlap

    box = lines(spark, d).select("vec_id", p.line_box(C("p")).alias("b"))
    return box.select("vec_id", boxes_overlap({c: C(f"b.{c}") for c in ("x0", "x1", "y0", "y1")}, {"x0": F.lit(0.1), "x1": F.lit(0.3), "y0": F.lit(-0.3), "y1": F.lit(-0.1)}).alias("hit"))


def flt_18(spark, d):
    """Whole lines, and for every third one its ends alone."""
    p_ = C("p")
    return lines(spark, d).select("vec_id", p.straight_suspect(F.get("p", F.lit(0)), F.element_at("p", -1), F.when(C("vec_id") % 3 > 0, p_)).alias("suspect"))


FLT_18 = f"WITH {LINES}, c AS (SELECT vec_id, sqrt(pow(p[32].x - p[1].x, 2) + pow(p[32].y - p[1].y, 2)) AS chord FROM v), l AS (SELECT vec_id, sum(sqrt(pow(x - px, 2) + pow(y - py, 2))) AS way FROM r GROUP BY vec_id) SELECT vec_id, CASE WHEN chord <= 0.005 THEN false WHEN vec_id % 3 = 0 THEN true ELSE way / chord < 1.02 END AS suspect FROM c JOIN l USING (vec_id)"


def ag_23(spark, d):
    box = p.line_box(C("p"), F.struct(F.lit(0.0).alias("x"), F.lit(0.25).alias("y")))
    return lines(spark, d).select("vec_id", box.alias("b")).select("vec_id", "b.*")


def fn_m15(spark, d):
    return lines(spark, d).select("vec_id", F.round(p.to_polyline(F.lit(0.1), F.lit(-0.1), C("p")), 9).alias("away"))


def q_away(x: str, y: str) -> str:
    dx, dy = "(x - px)", "(y - py)"
    t = f"(CASE WHEN {dx}*{dx} + {dy}*{dy} > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (({x} - px) * {dx} + ({y} - py) * {dy}) / ({dx}*{dx} + {dy}*{dy}))) ELSE 0.0::DOUBLE END)"
    return f"sqrt(pow({x} - (px + {t} * {dx}), 2) + pow({y} - (py + {t} * {dy}), 2))"


def _clicks(spark, d):
    k = C("s_suppkey")
    return read(spark, d, "supplier").select(k.alias("k"), (k * 37 % 250 / 500.0 - 0.25).alias("x"), (k * 53 % 340 / 500.0 - 0.34).alias("y"))


_CLICKS = "c AS (SELECT s_suppkey AS k, s_suppkey * 37 % 250 / 500.0::DOUBLE - 0.25::DOUBLE AS cx, s_suppkey * 53 % 340 / 500.0::DOUBLE - 0.34::DOUBLE AS cy FROM supplier)"


def jn_24(spark, d):
    """The line under a click: the nearest of all lines within a radius."""
    return spatial.line_under(_clicks(spark, d), lines(spark, d).select(C("vec_id").alias("line"), "p"), 0.05, 0.002).withColumnRenamed("line", "vec_id")


JN_24 = f"WITH {LINES}, {_CLICKS}, m AS (SELECT k, vec_id, min({q_away('cx', 'cy')}) AS m FROM r, c WHERE px IS NOT NULL GROUP BY ALL) SELECT k, arg_min(vec_id, (m, vec_id)) AS vec_id FROM m WHERE m <= 0.002 GROUP BY k"


def var_37(spark, d):
    return spatial.endpoint_cells(lines(spark, d).select(C("vec_id").alias("line"), "p"), 0.05).groupBy("cy", "cx").agg(F.count("*").alias("segments"))


_GRID = f"{LINES}, e AS (SELECT DISTINCT vec_id, i, unnest([floor(y / 0.05::DOUBLE)::BIGINT, floor(py / 0.05::DOUBLE)::BIGINT]) AS gy, unnest([floor(x / 0.05::DOUBLE)::BIGINT, floor(px / 0.05::DOUBLE)::BIGINT]) AS gx, x, y, px, py FROM r WHERE px IS NOT NULL)"


def jn_18(spark, d):
    grid = lines(spark, d).select(C("vec_id").alias("line"), "p")
    return spatial.on_route(_clicks(spark, d), grid, 0.05, 0.004).select("k")


JN_18 = f"WITH {_GRID}, {_CLICKS} SELECT DISTINCT k FROM c JOIN e ON abs(floor(cy / 0.05::DOUBLE)::BIGINT - gy) <= 1 AND abs(floor(cx / 0.05::DOUBLE)::BIGINT - gx) <= 1 WHERE {q_away('cx', 'cy')} <= 0.004"


def var_34(spark, d):
    return lines(spark, d).select("vec_id", F.round(F.get(F.reverse("p"), F.lit(4))["x"], 9).alias("x5"))


def prj_5(spark, d):
    coded = F.transform("p", lambda q: F.struct(F.round(q["x"] * 100_000).cast("int").alias("lat_e5"), F.round(q["y"] * 100_000).cast("int").alias("lon_e5")))
    back = p.decode_e5(coded)
    return lines(spark, d).select("vec_id", F.round(F.get(back, F.lit(2))["lat"], 5).alias("lat3"), F.round(F.get(back, F.lit(2))["lon"], 5).alias("lon3"), F.size(back).cast("long").alias("n"))


def prj_12(spark, d):
    """Nations as border records: polygons and groups of polygons with rings of one to five points."""
    k = C("n_nationkey")
    ring = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: F.array(i.cast("double"), k.cast("double")))
    poly = F.array(ring(k % 5 + 1), ring(k % 3 + 1))
    record = F.when(k % 2 == 0, F.to_json(F.struct(F.lit("P").alias("t"), poly.alias("c")))).when(k % 7 > 0, F.to_json(F.struct(F.lit("M").alias("t"), F.array(poly, F.array(ring(k % 4 + 1))).alias("c")))).otherwise("{}")
    shapes = p.polygons(record)
    return read(spark, d, "nation").select("n_nationkey", F.size(shapes).cast("long").alias("polygons"), F.size(F.flatten(shapes)).cast("long").alias("rings"))


PRJ_12 = "WITH n AS (SELECT n_nationkey AS k, (k % 5 >= 2)::INT + (k % 3 >= 2)::INT AS r1, (k % 4 >= 2)::INT AS r2 FROM nation) SELECT k AS n_nationkey, CASE WHEN k % 2 = 0 THEN (r1 > 0)::BIGINT WHEN k % 7 > 0 THEN (r1 > 0)::BIGINT + r2 ELSE 0 END AS polygons, CASE WHEN k % 2 = 0 THEN r1 WHEN k % 7 > 0 THEN r1 + r2 ELSE 0 END::BIGINT AS rings FROM n"

# --- rail networks ---------------------------------------------------------------------------

TRACK = {"south": 48.0, "west": 2.0, "high": 50, "wide": 70, "step": 1000.0}


def tracks(spark, d):
    """A straight track a supplier, all in a few kilometres."""
    k = C("s_suppkey")
    end = lambda i, a, b: F.struct(F.lit(i).alias("i"), *[v.alias(n) for n, v in zip(("lat", "lon"), at(k, a, b, **TRACK), strict=True)])
    rows = read(spark, d, "supplier").select(k.alias("line"), F.explode(F.array(end(0, 37, 53), end(1, 91, 17))).alias("q"))
    return rows.select("line", "q.i", "q.lat", "q.lon")


_ID = lambda y, x: f"(round({y} * 100000)::BIGINT * 67108864 + round({x} * 100000)::BIGINT + 33554432)"
_W = lambda m: f"greatest(round({m}), 1)::BIGINT"
_COMP = "{n}0(node, root) AS (SELECT DISTINCT src, src FROM {e} UNION SELECT e.dst, c.root FROM {n}0 c JOIN {e} e ON e.src = c.node WHERE e.dst <> c.root), {n} AS (SELECT node, min(root) AS component FROM (SELECT * FROM {n}0 UNION ALL SELECT src, src FROM {e}) GROUP BY node)"
_CELLS = "abs(floor(a.lat / 0.001::DOUBLE) - floor(b.lat / 0.001::DOUBLE)) <= 1 AND abs(floor(a.lon / 0.001::DOUBLE) - floor(b.lon / 0.001::DOUBLE)) <= 1"
_AB = s.q_hav("a.lat", "a.lon", "b.lat", "b.lon")
NETWORK = f"""tr AS (SELECT s_suppkey AS line, {q_at('s_suppkey', 37, 53, **TRACK, names='blat,blon')}, {q_at('s_suppkey', 91, 17, **TRACK)} FROM supplier),
cu AS (SELECT *, greatest(ceil({_STEP} / 500), 1)::INT AS pieces FROM tr), pj AS (SELECT *, unnest(generate_series(0, pieces))::INT AS j FROM cu),
pt AS (SELECT line, j, CASE j WHEN 0 THEN blat WHEN pieces THEN lat ELSE blat + (lat - blat) * (j / pieces) END AS lat, CASE j WHEN 0 THEN blon WHEN pieces THEN lon ELSE blon + (lon - blon) * (j / pieces) END AS lon, pieces FROM pj),
pn AS (SELECT *, {_ID('lat', 'lon')} AS node, lag({_ID('lat', 'lon')}) OVER w AS bnode, lag(lat) OVER w AS blat, lag(lon) OVER w AS blon FROM pt WINDOW w AS (PARTITION BY line ORDER BY j)),
nd AS (SELECT node, arg_min(lat, (line, j)) AS lat, arg_min(lon, (line, j)) AS lon FROM pn GROUP BY node),
ends AS (SELECT DISTINCT node FROM pn WHERE j = 0 OR j = pieces), en AS (SELECT * FROM nd WHERE node IN (SELECT node FROM ends)),
e0 AS (SELECT bnode AS u, node AS v, {_W(_STEP)} AS w FROM pn WHERE bnode IS NOT NULL AND bnode <> node), b0 AS (SELECT u, v, w FROM e0 UNION ALL SELECT v, u, w FROM e0),
s1 AS (SELECT a.node AS u, b.node AS v, {_W(_AB)} AS w FROM en a JOIN en b ON a.node <> b.node AND {_CELLS} WHERE {_AB} <= 120),
e1 AS MATERIALIZED (SELECT u AS src, v AS dst, min(w) AS w FROM (SELECT * FROM b0 UNION ALL SELECT * FROM s1) GROUP BY ALL),
{_COMP.format(n='c1', e='e1')},
lone AS (SELECT src AS node, any_value(component) AS component FROM e1 JOIN c1 ON src = node GROUP BY src HAVING count(*) = 1),
sg AS (SELECT l.node, p.lat, p.lon, e.src, e.dst, x.lat AS slat, x.lon AS slon, y.lat AS tlat, y.lon AS tlon FROM lone l JOIN nd p ON p.node = l.node JOIN e1 e ON e.src < e.dst JOIN c1 ON c1.node = e.src AND c1.component <> l.component JOIN nd x ON x.node = e.src JOIN nd y ON y.node = e.dst WHERE l.node <> e.src AND l.node <> e.dst),
lm AS (SELECT *, (slon - lon) * 111320.0 * greatest(cos(radians(lat)), 0.1) AS ax, (slat - lat) * 111320.0 AS ay, (tlon - lon) * 111320.0 * greatest(cos(radians(lat)), 0.1) - (slon - lon) * 111320.0 * greatest(cos(radians(lat)), 0.1) AS dx, (tlat - lat) * 111320.0 - (slat - lat) * 111320.0 AS dy FROM sg),
tt AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) AS t FROM lm WHERE dx * dx + dy * dy > 0),
ne AS (SELECT *, slat + (tlat - slat) * t AS plat, slon + (tlon - slon) * t AS plon FROM tt WHERE sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)) <= 25),
na AS (SELECT *, {_ID('plat', 'plon')} AS pn2 FROM ne), lg AS (SELECT pn2, plat, plon, node AS n, lat AS y, lon AS x FROM na UNION ALL SELECT pn2, plat, plon, src, slat, slon FROM na UNION ALL SELECT pn2, plat, plon, dst, tlat, tlon FROM na),
s2 AS (SELECT n AS u, pn2 AS v, {_W(s.q_hav('y', 'x', 'plat', 'plon'))} AS w FROM lg WHERE n <> pn2),
n2 AS (SELECT * FROM nd UNION ALL SELECT pn2, arg_min(plat, (plat, plon)), arg_min(plon, (plat, plon)) FROM na WHERE pn2 NOT IN (SELECT node FROM nd) GROUP BY pn2),
e2 AS MATERIALIZED (SELECT src, dst, min(w) AS w FROM (SELECT * FROM e1 UNION ALL SELECT u, v, w FROM s2 UNION ALL SELECT v, u, w FROM s2) GROUP BY ALL),
{_COMP.format(n='c2', e='e2')},
s3 AS (SELECT a.node AS u, b.node AS v, {_W(_AB)} AS w FROM n2 a JOIN n2 b ON a.node <> b.node AND {_CELLS} JOIN c2 x ON x.node = a.node JOIN c2 y ON y.node = b.node WHERE x.component <> y.component AND {_AB} <= CASE WHEN a.node IN (SELECT node FROM ends) OR b.node IN (SELECT node FROM ends) THEN 150 ELSE 60 END),
e3 AS MATERIALIZED (SELECT src, dst, min(w) AS w FROM (SELECT * FROM e2 UNION ALL SELECT u, v, w FROM s3) GROUP BY ALL),
{_COMP.format(n='c3', e='e3')}"""


_networks: dict = {}


def network(spark, d):
    """Nodes and edges of the stitched network of all tracks: built once a session, put down and shared by the queries on it."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _networks:
        _networks[key] = rails.build_network(tracks(spark, d))
    return _networks[key]


def gr_14(spark, d):
    nodes, edges = network(spark, d)
    return edges.join(nodes.select(C("node").alias("src"), "component"), "src").select("src", "dst", "w", "component")


def jn_16(spark, d):
    nodes, edges, ends = rails.track_graph(tracks(spark, d))
    edges = rails.least_parallel(edges.union(rails.both_ways(rails.endpoint_stitches(nodes, ends))))
    return rails.segment_stitches(nodes, edges)[1]


def jn_17(spark, d):
    """The stitches of components over tracks as they are laid, none before."""
    nodes, edges, ends = rails.track_graph(tracks(spark, d))
    return rails.component_stitches(nodes, edges, ends)


JN_17 = f"WITH RECURSIVE {NETWORK}, e9 AS (SELECT u AS src, v AS dst, min(w) AS w FROM b0 GROUP BY ALL), {_COMP.format(n='c9', e='e9')} SELECT a.node AS u, b.node AS v, {_W(_AB)} AS w FROM nd a JOIN nd b ON a.node < b.node AND {_CELLS} JOIN c9 x ON x.node = a.node JOIN c9 y ON y.node = b.node WHERE x.component <> y.component AND {_AB} <= CASE WHEN a.node IN (SELECT node FROM ends) OR b.node IN (SELECT node FROM ends) THEN 150 ELSE 60 END"


def st_1(spark, d):
    """Tracks of even and odd suppliers as two networks in one."""
    half = lambda k: rails.track_graph(tracks(spark, d).where(f"line % 2 = {k}"))
    return rails.merge_networks(half(0), half(1))[1]


def snk_4(spark, d):
    nodes, edges, _ = rails.track_graph(tracks(spark, d))
    return rails.export_edges(edges)


def src_32(spark, d):
    """Segments written and read again, with their ends checked."""
    from viaduct.sources.lines import shared_folder

    nodes, edges, _ = rails.track_graph(tracks(spark, d))
    path = shared_folder(spark)
    nodes.write.parquet(f"{path}/nodes"), rails.export_edges(edges).write.parquet(f"{path}/segments")
    return rails.load_network(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/segments"))


def var_23(spark, d):
    return rails.track_graph(tracks(spark, d))[0].select("node", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


def _trips(spark, d):
    k = C("s_suppkey") + 1
    (lat, lon), (blat, blon) = at(k, 7, 11, **TRACK), at(k, 29, 31, **TRACK)
    return read(spark, d, "supplier").select(C("s_suppkey").cast("long").alias("trip"), lat.alias("lat"), lon.alias("lon"), blat.alias("blat"), blon.alias("blon"))


_TRIPS = f"tp AS (SELECT s_suppkey::BIGINT AS trip, {q_at('(s_suppkey + 1)', 7, 11, **TRACK)}, {q_at('(s_suppkey + 1)', 29, 31, **TRACK, names='blat,blon')} FROM supplier)"
_SNAP = lambda n, y, x, k, nodes: f"{n}0 AS (SELECT trip, node, round({s.q_hav(y, x, 'n.lat', 'n.lon')})::BIGINT AS m, row_number() OVER (PARTITION BY trip ORDER BY {s.q_hav(y, x, 'n.lat', 'n.lon')}, node) AS r FROM tp, {nodes} n WHERE {s.q_hav(y, x, 'n.lat', 'n.lon')} <= 5000), {n} AS (SELECT trip, node, m FROM (SELECT *, min(m) OVER (PARTITION BY trip) AS best FROM {n}0 WHERE r <= {k}) WHERE m <= best + 300)"


def gr_16(spark, d):
    nodes, _ = network(spark, d)
    found = rails.per_kind(_trips(spark, d), rails.ENDS, lambda trips: rails.topology(trips, nodes))
    return found.select("trip", "from_candidates", "from_nearest", F.size("from_components").cast("long").alias("from_components"), "to_candidates", "to_nearest", F.size("to_components").cast("long").alias("to_components"), "shared")


_SIDES = f"WITH RECURSIVE {NETWORK}, {_TRIPS}, {_SNAP('sa', 'tp.lat', 'tp.lon', 8, 'n2')}, {_SNAP('sb', 'tp.blat', 'tp.blon', 8, 'n2')}"
# a node without an edge is a component of its own, as a track whose ends meet leaves it
GR_16 = f"{_SIDES}, ga AS (SELECT trip, count(*) AS n, min(m) AS m, list(DISTINCT coalesce(component, node)) AS c FROM sa LEFT JOIN c3 USING (node) GROUP BY trip), gb AS (SELECT trip, count(*) AS n, min(m) AS m, list(DISTINCT coalesce(component, node)) AS c FROM sb LEFT JOIN c3 USING (node) GROUP BY trip) SELECT trip, ga.n AS from_candidates, ga.m AS from_nearest, len(ga.c) AS from_components, gb.n AS to_candidates, gb.m AS to_nearest, len(gb.c) AS to_components, coalesce(list_has_any(ga.c, gb.c), false) AS shared FROM tp LEFT JOIN ga USING (trip) LEFT JOIN gb USING (trip)"


def var_22(spark, d):
    """Sorted component ids of the snap candidates of a trip's start."""
    nodes, _ = network(spark, d)
    return rails.per_kind(_trips(spark, d), rails.ENDS, lambda trips: rails.topology(trips, nodes)).select("trip", F.array_join(F.transform("from_components", lambda c: c.cast("string")), ",").alias("components")).where("components is not null")


def _best(spark, d, most):
    nodes, edges = network(spark, d)
    return rails.per_kind(_trips(spark, d), rails.ENDS, lambda trips: rails.best_routes(trips, nodes, edges, most, k=3))


def gr_11(spark, d):
    return _best(spark, d, 3_000.0)


def var_20(spark, d):
    """The same under a bound that some trips don't keep."""
    return _best(spark, d, 1_200.0)


def _q_best(most: int) -> str:
    return f"{_q_routes(most)} SELECT trip, min(score) AS score, arg_min(source, (score, source, node)) AS from_node, arg_min(node, (score, source, node)) AS to_node, arg_min(cost, (score, source, node)) AS metres FROM ro GROUP BY trip"


def _q_routes(most: int) -> str:
    return f"WITH RECURSIVE {NETWORK}, {_TRIPS}, {_SNAP('sa', 'tp.lat', 'tp.lon', 3, 'n2')}, {_SNAP('sb', 'tp.blat', 'tp.blon', 3, 'n2')}, dj(source, node, cost, hop) AS (SELECT DISTINCT node, node, 0::BIGINT, 0 FROM sa UNION SELECT source, dst, min(cost + w), hop + 1 FROM dj JOIN e3 ON src = node WHERE hop < 40 AND cost + w <= {most} GROUP BY source, dst, hop), ds AS (SELECT source, node, min(cost) AS cost FROM dj GROUP BY ALL), ro AS (SELECT sa.trip, cost + sa.m + sb.m AS score, source, ds.node, cost FROM sa JOIN sb USING (trip) JOIN tp USING (trip) JOIN ds ON ds.source = sa.node AND ds.node = sb.node WHERE cost + sa.m + sb.m <= {most} AND (source <> ds.node OR round({s.q_hav('tp.lat', 'tp.lon', 'tp.blat', 'tp.blon')}) <= 350))"


_FAR = lambda a, b, c, e: f"{s.q_hav(a, b, c, e)} > 350"
VAR_19 = f"""{_q_routes(3000)}, be AS (SELECT trip, arg_min(source, (score, source, node)) AS a, arg_min(node, (score, source, node)) AS b FROM ro GROUP BY trip),
t(source, node, path) AS (SELECT DISTINCT a, a, [a] FROM be UNION ALL SELECT t.source, e3.dst, list_append(path, e3.dst) FROM t JOIN e3 ON e3.src = t.node JOIN ds x ON x.source = t.source AND x.node = e3.src JOIN ds y ON y.source = t.source AND y.node = e3.dst AND x.cost + e3.w = y.cost),
pa AS (SELECT trip, min(path) AS path FROM be JOIN t ON t.source = a AND t.node = b GROUP BY trip HAVING len(min(path)) > 1),
li AS (SELECT trip, count(*) AS n, sum(lat) AS total, arg_min(lat, i) AS y0, arg_min(lon, i) AS x0, arg_max(lat, i) AS y1, arg_max(lon, i) AS x1 FROM (SELECT trip, unnest(path) AS node, generate_subscripts(path, 1) AS i FROM pa) JOIN n2 USING (node) GROUP BY trip)
SELECT trip, n + ({_FAR('y0', 'x0', 'tp.lat', 'tp.lon')})::INT + ({_FAR('y1', 'x1', 'tp.blat', 'tp.blon')})::INT AS points, round(total + tp.lat + tp.blat - CASE WHEN {_FAR('y0', 'x0', 'tp.lat', 'tp.lon')} THEN 0 ELSE y0 END - CASE WHEN {_FAR('y1', 'x1', 'tp.blat', 'tp.blon')} THEN 0 ELSE y1 END, 6) AS sum_lat FROM li JOIN tp USING (trip)"""
VAR_21 = f"WITH RECURSIVE {NETWORK}, pr AS (SELECT line AS trip, arg_min(node, j) AS a, arg_max(node, j) AS b FROM pn GROUP BY line), dj(source, node, cost, hop) AS (SELECT DISTINCT a, a, 0::BIGINT, 0 FROM pr UNION SELECT source, dst, min(cost + w), hop + 1 FROM dj JOIN e3 ON src = node WHERE hop < 60 AND cost + w <= 6000 GROUP BY source, dst, hop) SELECT trip, min(cost) AS cost, a AS start, b AS goal FROM pr JOIN dj ON source = a AND node = b GROUP BY ALL"


def var_19(spark, d):
    """The line of each trip's best route, with the trip's own ends."""
    nodes, edges = network(spark, d)

    def drawn(trips):
        best = rails.best_routes(trips, nodes, edges, 3_000.0, k=3, paths=True)
        lines_ = rails.route_lines(best.select("trip", "path"), nodes, trips)
        return lines_.select("trip", F.size("points").cast("long").alias("points"), F.round(F.aggregate("points", F.lit(0.0), lambda t, q: t + q["lat"]), 6).alias("sum_lat"))

    return rails.per_kind(_trips(spark, d), rails.ENDS, drawn)


def var_21(spark, d):
    """The way along the network between the ends of each track, found with its goal in view."""
    nodes, edges = network(spark, d)
    at_ends = tracks(spark, d).groupBy("line").agg(F.min_by(rails.node_id(C("lat"), C("lon")), "i").alias("start"), F.max_by(rails.node_id(C("lat"), C("lon")), "i").alias("goal"))
    trips = at_ends.select(C("line").alias("trip"), "start", "goal")

    def routes(some):
        found, _ = graphs.goal_routes(edges, nodes.select("node", "lat", "lon"), some, 6_000)
        return found.select("trip", "cost", F.get("path", F.lit(0)).alias("start"), F.element_at("path", -1).alias("goal"))

    return rails.per_kind(trips, ["start", "goal"], routes)


QUERIES = {n: globals()[n] for n in ("wn_5", "wn_6", "wn_7", "wn_8", "wn_9", "wn_10", "jn_14", "flt_14", "flt_17", "flt_18", "ag_23", "fn_m15", "jn_24", "jn_18", "var_37", "var_34", "prj_5", "prj_12", "gr_14", "jn_16", "jn_17", "st_1", "snk_4", "src_32", "var_23", "gr_16", "var_22", "gr_11", "var_20", "var_19", "var_21")}
ORACLE_SQL = {
    "wn_5": WN_5, "wn_6": WN_6, "wn_7": WN_7, "wn_8": WN_8, "wn_10": WN_10, "flt_18": FLT_18, "jn_24": JN_24, "jn_18": JN_18, "prj_12": PRJ_12, "jn_17": JN_17, "gr_16": GR_16, "gr_11": _q_best(3000), "var_20": _q_best(1200), "var_19": VAR_19, "var_21": VAR_21,
    "wn_9": "SELECT vec_id, 32::BIGINT AS points, true AS same FROM embeddings",
    "jn_14": f"WITH {_ASKED} SELECT line, i1 AS start, round(m1, 2) AS d1, i2 AS finish, round(m2, 2) AS d2 FROM st JOIN en USING (line)",
    "flt_14": f"WITH {LINES} SELECT vec_id, min(x) <= 0.3 AND max(x) >= 0.1 AND min(y) <= -0.1 AND max(y) >= -0.3 AS hit FROM r GROUP BY vec_id",
    "flt_17": f"WITH {LINES} SELECT vec_id, bool_or((x BETWEEN 0.2 AND 0.3 AND y BETWEEN 0.2 AND 0.3) OR coalesce(least(x, px) <= 0.3 AND greatest(x, px) >= 0.2 AND least(y, py) <= 0.3 AND greatest(y, py) >= 0.2 AND px IS NOT NULL, false)) AS hit FROM r GROUP BY vec_id",
    "ag_23": f"WITH {LINES} SELECT vec_id, least(min(x), 0) AS x0, greatest(max(x), 0) AS x1, least(min(y), 0.25) AS y0, greatest(max(y), 0.25) AS y1 FROM r GROUP BY vec_id",
    "fn_m15": f"WITH {LINES} SELECT vec_id, round(min({q_away('0.1', '-0.1')}), 9) AS away FROM r WHERE px IS NOT NULL GROUP BY vec_id",
    "var_37": f"WITH {_GRID} SELECT gy AS cy, gx AS cx, count(*) AS segments FROM e GROUP BY ALL",
    "var_34": f"WITH {LINES} SELECT vec_id, round(x, 9) AS x5 FROM r WHERE i = 28",
    "prj_5": f"WITH {LINES} SELECT vec_id, round(round(x * 100000) / 100000, 5) AS lat3, round(round(y * 100000) / 100000, 5) AS lon3, 32::BIGINT AS n FROM r WHERE i = 3",
    "gr_14": f"WITH RECURSIVE {NETWORK} SELECT src, dst, w, component FROM e3 JOIN c3 ON src = node",
    "jn_16": f"WITH RECURSIVE {NETWORK} SELECT least(u, v) AS u, greatest(u, v) AS v, min(w) AS w FROM s2 GROUP BY 1, 2",
    "st_1": f"WITH RECURSIVE {NETWORK} SELECT src, dst, w FROM e3",
    "snk_4": f"WITH RECURSIVE {NETWORK} SELECT u AS src, v AS dst, min(w) AS w FROM b0 WHERE u < v GROUP BY ALL",
    "src_32": f"WITH RECURSIVE {NETWORK} SELECT u AS src, v AS dst, min(w) AS w FROM b0 GROUP BY ALL",
    "var_23": f"WITH RECURSIVE {NETWORK} SELECT node, round(lat, 5) AS lat, round(lon, 5) AS lon FROM nd",
    "var_22": f"{_SIDES} SELECT trip, string_agg(component::VARCHAR, ',' ORDER BY component) AS components FROM (SELECT DISTINCT trip, coalesce(component, node) AS component FROM sa LEFT JOIN c3 USING (node)) GROUP BY trip",
}
