"""Finished tables: overlays, audits, bundles, routes on the city graph, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from viaduct.functions import geo, text
from viaduct.operators import artifacts as a
from viaduct.operators import graphs, rails, ranks, views
from viaduct.plans import graph as g
from viaduct.plans import scalars as s
from viaduct.plans.feed import read
from viaduct.plans.manifests import _pick
from viaduct.plans.places import HALTS, halts

C = F.col


def _links(spark, d, table: str, key: str, nation: str):
    return read(spark, d, table).select(C(nation).cast("long").alias("src"), (C(key) % 25).alias("dst"), (C(key) % 500 + 5).alias("w"))


def ct_1(spark, d):
    return a.aggregate_targets(_links(spark, d, "customer", "c_custkey", "c_nationkey"), _links(spark, d, "supplier", "s_suppkey", "s_nationkey"))


_LINKS = "SELECT c_nationkey::BIGINT AS src, c_custkey % 25 AS dst, c_custkey % 500 + 5 AS w FROM customer"
_LINKS2 = "SELECT s_nationkey::BIGINT AS src, s_suppkey % 25 AS dst, s_suppkey % 500 + 5 AS w FROM supplier"


def ct_2(spark, d):
    """Stations that an authority table lists as customer-facing."""
    listed = read(spark, d, "nation").where("n_regionkey in (1, 3)").select(C("n_nationkey").alias("s_nationkey"))
    return read(spark, d, "supplier").join(listed, "s_nationkey", "left_semi").select("s_suppkey")


def ct_3(spark, d):
    mapping = read(spark, d, "supplier").where("s_acctbal > 3000").select(C("s_suppkey").alias("old_id"), (C("s_nationkey") + 1_000_000).cast("long").alias("new_id"))
    return a.overlay(read(spark, d, "lineitem").select("l_orderkey", C("l_suppkey").alias("city")), "city", mapping).groupBy("city").agg(F.count("*").alias("rows"))


def ct_5(spark, d):
    """Halts within 60 km of each other that no edge of customers with like keys joins."""
    nodes = halts(spark, d).select(C("k").alias("node"), "lat", "lon")
    k = C("c_custkey")
    edges = read(spark, d, "customer").select(k.alias("src"), F.explode(F.array(k + 1, k + 37, k + 53)).alias("dst"))
    return a.close_without_edge(nodes, edges, (20_000.0, 45_000.0, 60_000.0))


CT_5 = f"""WITH {HALTS}, e0 AS (SELECT c_custkey AS u, unnest([c_custkey + 1, c_custkey + 37, c_custkey + 53]) AS v FROM customer), e AS (SELECT u, v FROM e0 UNION SELECT v, u FROM e0), n AS (SELECT x.k AS u, y.k AS v, {s.q_hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} AS m FROM halts x JOIN halts y ON x.k < y.k WHERE m <= 60000), l AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.u = n.u AND e.v = n.v)), o AS (SELECT l.u, l.v, e.v AS x FROM l JOIN e ON e.u = l.u), t2 AS (SELECT DISTINCT o.u, o.v FROM o JOIN e ON e.u = o.x AND e.v = o.v), t3 AS (SELECT DISTINCT o.u, o.v FROM o JOIN e p ON p.u = o.x JOIN e q ON q.u = p.v AND q.v = o.v)
SELECT l.u, l.v, CASE WHEN m <= 20000 THEN 20000 WHEN m <= 45000 THEN 45000 ELSE 60000 END AS band, CASE WHEN t2.u IS NOT NULL THEN 2 WHEN t3.u IS NOT NULL THEN 3 END AS hops FROM l LEFT JOIN t2 ON l.u = t2.u AND l.v = t2.v LEFT JOIN t3 ON l.u = t3.u AND l.v = t3.v"""


def ct_6(spark, d):
    facts = read(spark, d, "documents").agg(F.count("*").alias("documents"), F.count_distinct("lang").alias("languages"), F.count_if(C("text").isNull()).alias("empty"), F.max("n_chars").alias("longest"))
    return a.gates(facts, {"documents": 200, "languages": 5}, {"empty": 0, "longest": 15_000})


def ct_7(spark, d):
    stops = read(spark, d, "lineitem").select(C("l_orderkey").alias("pattern"), C("l_suppkey").alias("place"))
    links = read(spark, d, "supplier").where("s_acctbal > 2000").select(C("s_suppkey").alias("place"), C("s_nationkey").alias("city"))
    return a.service_places(stops, links)


def ct_8(spark, d):
    nodes = read(spark, d, "nation").select(C("n_nationkey").cast("long").alias("id"))
    pairs = read(spark, d, "customer").select(C("c_nationkey").cast("long").alias("a"), (C("c_custkey") % 27).alias("b")).distinct()
    edges = graphs.cut(_links(spark, d, "supplier", "s_suppkey", "s_nationkey"))
    return a.pair_audit(pairs, edges, nodes)


CT_8 = f"WITH RECURSIVE e AS ({_LINKS2}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(id, node) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT FROM nation UNION SELECT id, dst FROM r JOIN b ON src = node) SELECT a, b, EXISTS (SELECT 1 FROM r WHERE id = a AND node = p.b) AS reachable FROM (SELECT DISTINCT c_nationkey::BIGINT AS a, c_custkey % 27 AS b FROM customer) p WHERE NOT EXISTS (SELECT 1 FROM e WHERE src = a AND dst = p.b)"


def ct_9(spark, d):
    return a.backlog(read(spark, d, "customer"), "c_nationkey", C("c_acctbal") < 0)


def ct_10(spark, d):
    return a.rail_profile(halts(spark, d).select(C("country").alias("city"), "k", "lat", "lon"), 2_900.0)


_FAR = s.q_hav("min(lat)", "min(lon)", "max(lat)", "max(lon)")


def prj_4(spark, d):
    k = C("s_suppkey")
    rows = read(spark, d, "supplier").select(k, _pick(["N1", "n2", "ZZ", " ", None, "QQ"], k).alias("code"))
    names = read(spark, d, "nation").where("n_nationkey < 20").select(F.concat(F.lit("N"), C("n_nationkey").cast("string")).alias("iso"), "n_name")
    return rows.join(names, F.upper(C("code")) == C("iso"), "left").select("s_suppkey", a.country_label(C("code"), C("n_name"), {"ZZ": "Elsewhere"}).alias("label"))


def prj_6(spark, d):
    rows = read(spark, d, "customer").select(C("c_nationkey").alias("a"), (C("c_custkey") % 30).cast("int").alias("b"), C("c_custkey").alias("pos"))
    return a.rekey_geometries(rows, read(spark, d, "nation").select(C("n_nationkey").alias("id"), C("n_name").alias("name")))


def prj_7(spark, d):
    k = C("s_suppkey")
    return a.places(read(spark, d, "supplier").select(k.alias("place_id"), F.when(k % 3 == 0, "registry").alias("role"), (k * 91 % 9_000_000).cast("int").alias("lat_e5"), (-k * 17).cast("int").alias("lon_e5"), F.when(k % 2 == 0, k % 9).alias("patterns")))


def prj_9(spark, d):
    """Meta data of a bundle: counts and where its artifacts lie. Their names."""
    count = lambda t, n: read(spark, d, t).agg(F.count("*").alias(n))
    return count("customer", "stations").crossJoin(count("nation", "cities")).crossJoin(count("orders", "edges")).select("*", F.lit("cities.json").alias("cities_path"), F.lit("edges.json").alias("edges_path"))


def prj_11(spark, d):
    """An output narrowed to a bundle: which tables stay and how many rows they have."""
    parts = {"cities": read(spark, d, "nation").select("n_nationkey", "n_name"), "edges": ct_1(spark, d).select("src", "dst", "w"), "aliases": read(spark, d, "part").select("p_name", "p_size").distinct()}
    rows = [t.agg(F.count("*").alias("rows")).select(F.lit(n).alias("artifact"), "rows", F.lit(len(t.columns)).alias("columns")) for n, t in parts.items()]
    return rows[0].union(rows[1]).union(rows[2])


def var_8(spark, d):
    runs = text.long_digit_runs(C("s_name"))
    return read(spark, d, "supplier").select("s_suppkey", a.station_id(F.when(C("s_suppkey") % 3 > 0, F.get(runs, F.lit(0))), C("s_name")).alias("station_id"))


def val_4(spark, d):
    t = {n: read(spark, d, n) for n in ("nation", "orders", "part")}
    cities = read(spark, d, "customer").select(C("c_custkey").alias("city"), C("c_nationkey").alias("country"))
    return a.bundle_findings({"nation": 25, "orders": 1, "part": 2}, t, cities, 23)


def val_5(spark, d):
    """Artifacts written as JSON and read again as what they should be: nothing is lost and nothing doubled."""
    from viaduct.sources.feeds import read_document, write_document
    from viaduct.sources.lines import shared_folder

    path = shared_folder(spark)
    rows = read(spark, d, "nation").select("n_nationkey", "n_name", F.when(C("n_nationkey") % 2 == 0, C("n_regionkey")).alias("region"))
    write_document(rows, path)
    return read_document(spark, path, "n_nationkey int, n_name string, region int")


def val_6(spark, d):
    k = C("o_orderkey")
    key = F.when(k % 11 == 0, "nokey").otherwise(F.concat_ws("-", C("o_custkey").cast("string"), (k % 25).cast("string")))
    minutes = F.when(k % 13 == 0, F.lit(None).cast("double")).when(k % 17 == 0, F.lit(-1.0)).otherwise(C("o_totalprice"))
    return a.planner_findings(read(spark, d, "orders").select(key.alias("key"), minutes.alias("minutes")))


def val_10(spark, d):
    k = C("s_suppkey")
    return a.authority(read(spark, d, "supplier").select(k.alias("k"), _pick(["Q5", None, "x", None, "Q77"], k).alias("qid"), F.when(k % 3 == 0, F.concat(F.lit("87"), k.cast("string"))).alias("uic"), C("s_name").alias("raw")))


VAL_10 = """WITH r AS (SELECT s_suppkey AS k, ['Q5', NULL, 'x', NULL, 'Q77'][1 + s_suppkey % 5] AS qid, CASE WHEN s_suppkey % 3 = 0 THEN '87' || s_suppkey END AS uic, s_name FROM supplier)
SELECT k, coalesce('wikidata_qid:' || qid || ',', '') || coalesce('uic_code:' || uic || ',', '') || 'source_record:' || s_name AS refs, concat_ws(',', CASE WHEN qid LIKE 'Q%' THEN 'wikidata_qid_accepted:95' WHEN qid = 'x' THEN 'wikidata_qid_invalid:0' END, CASE WHEN uic IS NOT NULL THEN 'identifier_exact:90' END, CASE WHEN qid IS NULL AND uic IS NULL THEN 'source_carry_forward:60' END) AS evidence, CASE WHEN qid LIKE 'Q%' THEN 'resolved' WHEN qid = 'x' THEN 'needs_review' WHEN uic IS NOT NULL THEN 'resolved' ELSE 'provisional' END AS status FROM r"""


def var_32(spark, d):
    """Edges of parsed route keys."""
    names = read(spark, d, "nation").select(C("n_name").alias("name"))
    keys = read(spark, d, "customer").select(F.concat_ws("-", F.concat(F.lit("NATION_"), C("c_nationkey").cast("string")), F.concat(F.lit("NATION_"), (C("c_custkey") % 30).cast("string"))).alias("key"), C("c_custkey").alias("minutes")).groupBy("key").agg(F.min("minutes").alias("minutes"))
    edges, invalid = a.route_edges(None, keys, names)
    return edges.union(invalid.select(F.lit(None).cast("string"), "key", F.lit(-1).cast("long")))


VAR_32 = "WITH k AS (SELECT c_nationkey AS a, c_custkey % 30 AS b, min(c_custkey) AS minutes FROM customer GROUP BY 1, 2) SELECT CASE WHEN b < 25 THEN 'NATION_' || a END AS a, CASE WHEN b < 25 THEN 'NATION_' || b ELSE 'NATION_' || a || '-NATION_' || b END AS b, CASE WHEN b < 25 THEN minutes ELSE -1 END AS minutes FROM k"


def var_55(spark, d):
    """Keys of edges that a graph of some nations can't hold."""
    nodes = read(spark, d, "nation").where("n_regionkey <> 4").select(C("n_nationkey").cast("long").alias("id"))
    return graphs.invalid_edges(nodes, _links(spark, d, "supplier", "s_suppkey", "s_nationkey"))


VAR_55 = f"SELECT DISTINCT src || '-' || dst AS edge_key FROM ({_LINKS2}) WHERE src = dst OR src IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 4) OR dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 4)"


# --- routes on the city graph ----------------------------------------------------------------


def var_25(spark, d):
    """Paths of all nodes from one, rebuilt from the edges of least ways."""
    return g._paths(graphs.distances(g.directed(spark, d), g.one(spark, 5)))


def var_27(spark, d):
    return g._paths(graphs.distances(g.both_ways(spark, d), g.one(spark, 11)))


def gr_10(spark, d):
    """Routes within a bound from each nation to another, their goals in view."""
    places = g.cities(spark, d).select(C("id").alias("node"), "lat", "lon")
    trips = places.select(C("node").alias("trip"), C("node").alias("start"), ((C("node") * 7 + 3) % 25).alias("goal"))
    routes, _ = graphs.goal_routes(g.both_ways(spark, d), places, trips, 60)
    return g._paths(routes.withColumnRenamed("trip", "node")).withColumnRenamed("node", "trip")


GR_10 = f"WITH RECURSIVE {g.BOTH}, r(source, node, cost, hop) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, 0::BIGINT, 0 FROM nation UNION SELECT source, dst, min(cost + w), hop + 1 FROM r JOIN e ON src = node WHERE hop < 12 GROUP BY source, dst, hop), dist AS (SELECT source, node, min(cost) AS cost FROM r GROUP BY ALL), t(source, node, path) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, [n_nationkey::BIGINT] FROM nation UNION ALL SELECT t.source, e.dst, list_append(path, e.dst) FROM t JOIN e ON e.src = t.node JOIN dist a ON a.source = t.source AND a.node = e.src JOIN dist b ON b.source = t.source AND b.node = e.dst AND a.cost + e.w = b.cost) SELECT source AS trip, any_value(cost) AS cost, array_to_string(min(path), '>') AS path FROM t JOIN dist USING (source, node) WHERE node = (source * 7 + 3) % 25 AND cost <= 60 GROUP BY source"


def _drawn(spark, d):
    """Geometries of the edges between nations with keys of one parity: a bend half way."""
    n = g.cities(spark, d)
    end = lambda c: n.select(C("id").alias(c), C("lat").alias(f"y{c}"), C("lon").alias(f"x{c}"))
    e = g.both_ways(spark, d).where("src % 2 = dst % 2").join(end("src"), "src").join(end("dst"), "dst")
    point = lambda y, x: F.struct(y.alias("lat"), x.alias("lon"))
    return e.select("src", "dst", F.array(point(C("ysrc"), C("xsrc")), point((C("ysrc") + C("ydst")) / 2, C("xsrc")), point(C("ydst"), C("xdst"))).alias("points"))


def gr_9(spark, d):
    paths = graphs.distances(g.both_ways(spark, d), g.one(spark, 0)).select(C("node").alias("trip"), "path").where("size(path) > 1")
    lines = rails.path_lines(paths, g.cities(spark, d), _drawn(spark, d))
    return lines.select("trip", F.size("points").cast("long").alias("points"), F.round(F.aggregate("points", F.lit(0.0), lambda t, q: t + q["lat"]), 6).alias("sum_lat"))


GR_9 = g._walk(g.BOTH, "0") + f", {g.CITIES}, h AS (SELECT node AS trip, unnest(path[1:-2]) AS a, unnest(path[2:]) AS b, generate_subscripts(path[2:], 1) AS i FROM best WHERE len(path) > 1), q AS (SELECT trip, i, x.lat AS ya, y.lat AS yb, x.lon AS xa, y.lon AS xb, a % 2 = b % 2 AS bent FROM h JOIN cities x ON x.id = a JOIN cities y ON y.id = b), p AS (SELECT trip, i * 3 AS i, ya AS lat, xa AS lon FROM q UNION ALL SELECT trip, i * 3 + 1, (ya + yb) / 2, xa FROM q WHERE bent UNION ALL SELECT trip, i * 3 + 2, yb, xb FROM q), o AS (SELECT *, lag(lat) OVER w AS blat, lag(lon) OVER w AS blon FROM p WINDOW w AS (PARTITION BY trip ORDER BY i)) SELECT trip, count(*) AS points, round(sum(lat), 6) AS sum_lat FROM o WHERE blat IS NULL OR lat <> blat OR lon <> blon GROUP BY trip"


def so_4(spark, d):
    """Suggestions in order: more interest first, then less detour, then as they come."""
    found = graphs.suggestions(g.cities(spark, d), g.both_ways(spark, d), g.TRIP)
    return ranks.position(found.withColumn("less", -C("interest")), "less", "detour", "id").select("id", "interest", "after_stop", "detour", C("position").cast("long").alias("rank"))


def _suggested(trip: list[int]) -> str:
    """Suggestions in SQL from all distances: interior cities of a leg's path, then cities near its midpoint."""
    sources = ", ".join(map(str, sorted(set(trip))))
    legs = ", ".join(f"({i}, {x}::BIGINT, {y}::BIGINT)" for i, (x, y) in enumerate(zip(trip, trip[1:], strict=False)))
    return f"""WITH RECURSIVE {g.BOTH}, {g.CITIES}, r(source, node, cost, hop) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, 0::BIGINT, 0 FROM nation WHERE n_nationkey IN ({sources}) UNION SELECT source, dst, min(cost + w), hop + 1 FROM r JOIN e ON src = node WHERE hop < 12 GROUP BY source, dst, hop), ds AS (SELECT source, node, min(cost) AS cost FROM r GROUP BY ALL),
t(source, node, path) AS (SELECT DISTINCT source, source, [source] FROM ds UNION ALL SELECT t.source, e.dst, list_append(path, e.dst) FROM t JOIN e ON e.src = t.node JOIN ds x ON x.source = t.source AND x.node = e.src JOIN ds y ON y.source = t.source AND y.node = e.dst WHERE x.cost + e.w = y.cost),
bp AS (SELECT source, node, min(path) AS path FROM t GROUP BY ALL), lg AS (SELECT i, a, b, cost, path FROM (VALUES {legs}) AS l(i, a, b) JOIN ds ON ds.source = a AND ds.node = b JOIN bp ON bp.source = a AND bp.node = b WHERE len(path) > 2),
li AS (SELECT * FROM cities WHERE interest >= 7 AND id NOT IN ({sources})),
inn AS (SELECT i, 0 AS kind, pos - 2 AS rank, id, 0::BIGINT AS detour FROM (SELECT i, unnest(path) AS id, generate_subscripts(path, 1) AS pos, len(path) AS n FROM lg) WHERE pos > 1 AND pos < n AND id IN (SELECT id FROM li)),
nr AS (SELECT lg.i, 1 AS kind, li.id AS rank, li.id, x.cost + y.cost - lg.cost AS detour FROM lg JOIN cities p ON p.id = lg.a JOIN cities q ON q.id = lg.b JOIN li ON NOT list_contains(lg.path, li.id) JOIN ds x ON x.source = lg.a AND x.node = li.id JOIN ds y ON y.source = lg.b AND y.node = li.id WHERE {s.q_hav('li.lat', 'li.lon', '((p.lat + q.lat) / 2)', '((p.lon + q.lon) / 2)')} / 1000 < least(0.4 * {s.q_hav('p.lat', 'p.lon', 'q.lat', 'q.lon')} / 1000, 120)),
sg AS (SELECT id, arg_min(i, (i, kind, rank)) AS after_stop, arg_min(detour, (i, kind, rank)) AS detour FROM (SELECT * FROM inn UNION ALL SELECT * FROM nr WHERE detour > 0 AND detour < 180) GROUP BY id)"""


GR_7 = _suggested(g.TRIP) + " SELECT id, interest, after_stop, detour FROM sg JOIN cities USING (id)"
SO_4 = _suggested(g.TRIP) + " SELECT id, interest, after_stop, detour, row_number() OVER (ORDER BY interest DESC, detour, id) - 1 AS rank FROM sg JOIN cities USING (id)"
_LEGS = ", ".join(f"({i + 1}, {x}::BIGINT, {y}::BIGINT)" for i, (x, y) in enumerate(zip(g.TRIP, g.TRIP[1:], strict=False)))
GR_8 = _suggested(g.TRIP) + f" SELECT i, a, b, cost, len(path)::INT AS stops FROM (VALUES {_LEGS}) AS l(i, a, b) LEFT JOIN ds ON ds.source = a AND ds.node = b LEFT JOIN bp ON bp.source = a AND bp.node = b"


def so_9(spark, d):
    """Patterns in the order an artifact is written in."""
    rows = read(spark, d, "lineitem").select(C("l_returnflag").alias("source"), C("l_suppkey").alias("route"), C("l_orderkey").alias("id")).distinct()
    return ranks.position(rows, "source", "route", "id").select("source", "route", "id", C("position").cast("long").alias("position"))


# --- curves and cameras ----------------------------------------------------------------------

# Paddings and budgets by zoom.
CITY_PADDING = [(3, 28), (5, 30), (7, 34), (10, 42)]
LABEL_BUDGET = [(3, 20), (4.5, 28), (6, 38), (7.5, 52), (9, 68), (10, 84)]
NETWORK_PADDING = [(3, 124), (5, 136), (7, 148), (10, 164)]


def _zoomed(spark, d):
    return read(spark, d, "customer").select("c_custkey", (C("c_custkey") % 130 / 10.0).alias("zoom"))


_ZOOMED = "z AS (SELECT c_custkey, c_custkey % 130 / 10.0::DOUBLE AS zoom FROM customer)"


def fn_m10(spark, d):
    return _zoomed(spark, d).select("c_custkey", F.round(geo.curve(C("zoom"), LABEL_BUDGET), 9).alias("value"))


def fn_m12(spark, d):
    half_up = lambda c: F.floor(c + 0.5).cast("long")
    return _zoomed(spark, d).select("c_custkey", *[half_up(geo.curve(C("zoom"), x)).alias(n) for n, x in (("city_padding", CITY_PADDING), ("label_budget", LABEL_BUDGET), ("network_padding", NETWORK_PADDING))])


def threshold_between(zoom, threshold):
    """A label threshold between whole zooms; ``threshold`` maps a zoom to interest and population."""
    lo, hi = F.floor(zoom), F.ceil(zoom)
    t = zoom - lo
    (i0, p0), (i1, p1) = threshold(lo), threshold(hi)
    return i0 + (i1 - i0) * t, F.floor(p0 + (p1 - p0) * t + 0.5).cast("long")


def var_36(spark, d):
    interest, pop = threshold_between(C("zoom"), lambda z: (10.0 - z * 0.5, 1_000_000.0 - z * z * 7001))
    return _zoomed(spark, d).select("c_custkey", F.round(interest, 9).alias("interest"), pop.alias("pop"))


def fn_m8(spark, d):
    """A camera zoomed in by one about a place on the screen of 800 by 600 pixels."""
    rows = s.points(spark, d).where("zoom < 12")
    cx, cy = geo.mercator(C("lat"), C("lon"))
    inside = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    now, then = geo.scale_for_zoom(C("zoom")), geo.scale_for_zoom(C("zoom") + 1)
    ax, ay = C("k") % 800 - 400.0, C("k") % 600 - 300.0
    lat, lon = geo.unproject(inside(cx + ax / now - ax / then), inside(cy + ay / now - ay / then))
    return rows.select("k", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


_X = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, (lon + 180) / 360 + ax / (256 * pow(2, zoom)) - ax / (256 * pow(2, zoom + 1))))"
_Y = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi()) + ay / (256 * pow(2, zoom)) - ay / (256 * pow(2, zoom + 1))))"
FN_M8 = f"WITH c AS (SELECT *, k % 800 - 400.0::DOUBLE AS ax, k % 600 - 300.0::DOUBLE AS ay FROM {s.POINTS_SQL} WHERE zoom < 12) SELECT k, round(degrees(atan(sinh(pi() * (1 - 2 * {_Y})))), 6) AS lat, round({_X} * 360 - 180, 6) AS lon FROM c"
FN_M8 = FN_M8.replace("sinh(pi() * (1 - 2 * " + _Y + "))", "((exp(pi() * (1 - 2 * " + _Y + ")) - exp(-pi() * (1 - 2 * " + _Y + "))) / 2)")


def fn_d6(spark, d):
    from viaduct.sources.feeds import now_rfc3339

    return read(spark, d, "region").select("r_regionkey", now_rfc3339().rlike("^20[0-9]{2}-[01][0-9]-[0-3][0-9]T[0-2][0-9]:[0-5][0-9]:[0-5][0-9]Z$").alias("form"))


def str_2(spark, d):
    """Events delivered by a stream that is stopped and taken up again after more came: each file once."""
    from viaduct.sources.lines import shared_folder, write_lines
    from viaduct.streaming.progress import chunks, deliver

    path, root = shared_folder(spark), shared_folder(spark)
    events = read(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    schema = "event_id long, user_id long, event_type string, value double"
    write_lines(events.where("value < 20"), f"{path}/part=1")
    deliver(chunks(spark, f"{path}/*", schema, "json"), root=root)
    write_lines(events.where("value >= 20 or value is null"), f"{path}/part=2")
    return deliver(chunks(spark, f"{path}/*", schema, "json"), root=root).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("events"))


def str_10(spark, d):
    """The last event of each burst, a burst ending where its user is idle for half an hour."""
    e = read(spark, d, "events")
    later = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("later", later).where("later is null or later > ts + interval 30 minutes").select("user_id", "event_id")


QUERIES = {n: globals()[n] for n in ("ct_1", "ct_2", "ct_3", "ct_5", "ct_6", "ct_7", "ct_8", "ct_9", "ct_10", "prj_4", "prj_6", "prj_7", "prj_9", "prj_11", "var_8", "val_4", "val_5", "val_6", "val_10", "var_32", "var_55", "var_25", "var_27", "gr_10", "gr_9", "so_4", "so_9", "fn_m10", "fn_m12", "var_36", "fn_m8", "fn_d6", "str_2", "str_10")} | {"src_18": val_5, "snk_1": val_5}
ORACLE_SQL = {
    "ct_5": CT_5, "ct_8": CT_8, "val_10": VAL_10, "var_32": VAR_32, "var_55": VAR_55, "gr_9": GR_9, "gr_7": GR_7, "gr_8": GR_8, "so_4": SO_4, "fn_m8": FN_M8,
    "ct_1": f"SELECT src, dst, min(w) AS w FROM ({_LINKS} UNION ALL {_LINKS2}) GROUP BY ALL",
    "ct_2": "SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 OR n_regionkey = 3",
    "ct_3": "SELECT CASE WHEN s_acctbal > 3000 THEN s_nationkey + 1000000 ELSE l_suppkey END::BIGINT AS city, count(*) AS rows FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1",
    "ct_6": "WITH f AS (SELECT count(*) AS n, count(DISTINCT lang) AS l, count(*) - count(text) AS e, max(n_chars) AS m FROM documents) SELECT 'documents' AS gate, n AS value, 200::BIGINT AS bound, n >= 200 AS passed FROM f UNION ALL SELECT 'languages', l, 5, l >= 5 FROM f UNION ALL SELECT 'empty', e, 0, e <= 0 FROM f UNION ALL SELECT 'longest', m, 15000, m <= 15000 FROM f",
    "ct_7": "SELECT l_suppkey AS place, count(DISTINCT l_orderkey) AS patterns, any_value(CASE WHEN s_acctbal > 2000 THEN s_nationkey END) AS city FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey",
    "ct_9": "SELECT c_nationkey, count(*) AS stations, count(*) FILTER (WHERE c_acctbal < 0) AS backlog FROM customer GROUP BY c_nationkey",
    "ct_10": f"WITH {HALTS} SELECT country AS city, count(*) AS terminals, round({_FAR} / 1000, 3) AS spread_km, CASE WHEN count(*) > 1 AND {_FAR} / 1000 > 2900 THEN 'centroid' ELSE 'main_station' END AS anchor FROM halts GROUP BY country",
    "prj_4": "SELECT s_suppkey, ['NATION_1', 'NATION_2', 'Elsewhere', 'Unknown', 'Unknown', 'QQ'][1 + s_suppkey % 6] AS label FROM supplier",
    "prj_6": "SELECT x.n_name AS a, y.n_name AS b, max(c_custkey) AS pos FROM customer JOIN nation x ON c_nationkey = x.n_nationkey JOIN nation y ON c_custkey % 30 = y.n_nationkey GROUP BY 1, 2",
    "prj_7": "SELECT s_suppkey AS place_id, CASE WHEN s_suppkey % 3 = 0 THEN 'registry' ELSE 'service' END AS role, s_suppkey * 91 % 9000000 / 100000.0::DOUBLE AS lat, -s_suppkey * 17 / 100000.0::DOUBLE AS lon, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 9 ELSE 0 END AS patterns FROM supplier",
    "prj_9": "SELECT (SELECT count(*) FROM customer) AS stations, (SELECT count(*) FROM nation) AS cities, (SELECT count(*) FROM orders) AS edges, 'cities.json' AS cities_path, 'edges.json' AS edges_path",
    "prj_11": f"SELECT 'cities' AS artifact, count(*) AS rows, 2 AS columns FROM nation UNION ALL SELECT 'edges', count(*), 3 FROM (SELECT DISTINCT src, dst FROM ({_LINKS} UNION ALL {_LINKS2})) UNION ALL SELECT 'aliases', count(*), 2 FROM (SELECT DISTINCT p_name, p_size FROM part)",
    "var_8": "SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN 'station-uic-' || s_name[10:] ELSE 'station-sncf-supplier-' || s_name[10:] END AS station_id FROM supplier",
    "val_4": "SELECT 'orders_count' AS finding, count(*) AS value FROM orders UNION ALL SELECT 'part_count', count(*) FROM part UNION ALL SELECT 'country_bounds', c_custkey FROM customer WHERE c_nationkey >= 23",
    "val_5": "SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS region FROM nation",
    "val_6": "WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'nokey' ELSE o_custkey || '-' || (o_orderkey % 25) END AS key FROM orders) SELECT key, CASE WHEN key = 'nokey' THEN 'key' ELSE 'minutes' END AS finding FROM r WHERE key = 'nokey' OR k % 13 = 0 OR k % 17 = 0",
    "var_25": g._walk(g.DIRECTED, "5") + " SELECT node, cost, array_to_string(path, '>') AS path FROM best JOIN dist USING (node)",
    "var_27": g._walk(g.BOTH, "11") + " SELECT node, cost, array_to_string(path, '>') AS path FROM best JOIN dist USING (node)",
    "gr_10": GR_10,
    "so_9": "SELECT l_returnflag AS source, l_suppkey AS route, l_orderkey AS id, row_number() OVER (ORDER BY l_returnflag, l_suppkey, l_orderkey) - 1 AS position FROM (SELECT DISTINCT l_returnflag, l_suppkey, l_orderkey FROM lineitem)",
    "fn_m10": f"WITH {_ZOOMED} SELECT c_custkey, round({s.q_curve('zoom', LABEL_BUDGET)}, 9) AS value FROM z",
    "fn_m12": f"WITH {_ZOOMED} SELECT c_custkey, floor({s.q_curve('zoom', CITY_PADDING)} + 0.5)::BIGINT AS city_padding, floor({s.q_curve('zoom', LABEL_BUDGET)} + 0.5)::BIGINT AS label_budget, floor({s.q_curve('zoom', NETWORK_PADDING)} + 0.5)::BIGINT AS network_padding FROM z",
    "var_36": f"WITH {_ZOOMED}, f AS (SELECT *, floor(zoom) AS a, ceil(zoom) AS b, zoom - floor(zoom) AS t FROM z) SELECT c_custkey, round(10 - a * 0.5 + (b - a) * -0.5 * t, 9) AS interest, floor(1000000 - a * a * 7001 + (a * a - b * b) * 7001 * t + 0.5)::BIGINT AS pop FROM f",
    "fn_d6": "SELECT r_regionkey, true AS form FROM region",
    "str_2": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events FROM events GROUP BY event_type",
    "str_10": "WITH e AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events) SELECT user_id, event_id FROM e WHERE nx IS NULL OR nx > ts + INTERVAL '30' MINUTE",
}
ORACLE_SQL |= {"src_18": ORACLE_SQL["val_5"], "snk_1": ORACLE_SQL["val_5"]}
