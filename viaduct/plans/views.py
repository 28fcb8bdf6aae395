"""Labels, filters, statistics, URL states, chunks and audits over the tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.functions import geo, text, urls
from viaduct.operators import build, feed, ranks, views
from viaduct.operators import manifests as m
from viaduct.plans import scalars as s
from viaduct.plans.feed import read
from viaduct.plans.manifests import _list, _pick
from viaduct.plans.places import HALTS, halts

C = F.col
text_of = lambda c: c.cast("string")


# --- timetable scans -------------------------------------------------------------------------


def _routes(spark, d):
    return read(spark, d, "part").select(C("p_partkey").alias("route"), F.concat(_pick(["|Bus|", "|ICE|", "|Tram", "x"], C("p_size")), text_of(C("p_partkey"))).alias("route_id"), (C("p_size") * 3 % 120).alias("route_type"))


_ROUTES = "rt AS (SELECT p_partkey AS route, ['|Bus|', '|ICE|', '|Tram', 'x'][1 + p_size % 4] || p_partkey AS route_id, p_size * 3 % 120 AS route_type FROM part)"


def src_2(spark, d):
    return _routes(spark, d).where(feed.rail_route(C("route_id"), C("route_type"), "de-delfi-gtfs")).select("route", "route_type")


def src_3(spark, d):
    return feed.last_per(_routes(spark, d).select("route", "route_type", C("route").alias("pos")), "route", "pos").select("route", "route_type")


def _trips(spark, d):
    k = C("l_orderkey")
    return read(spark, d, "lineitem").select(k.alias("trip"), C("l_partkey").alias("route"), C("l_linestatus").alias("service"), F.when(C("l_linenumber") > 3, C("l_returnflag")).alias("headsign"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("pos"))


def src_5(spark, d):
    """Rail trips but those with a coach stop: the least of a supplier's keys stands for its stop's name."""
    rail = _routes(spark, d).where(feed.rail_route_type(C("route_type"))).select("route")
    stop = F.concat(_pick(["StopPoint:OCETrain-", "StopPoint:OCECar-", "StopPoint:OCETrain-"], C("l_suppkey")), text_of(C("l_suppkey")))
    coach = read(spark, d, "lineitem").where(feed.coach_stop(F.lit("sncf-fr-gtfs"), stop)).select(C("l_orderkey").alias("trip")).distinct()
    return feed.last_per(_trips(spark, d).join(rail, "route"), "trip", "pos").join(coach, "trip", "left_anti").select("trip", "route")


_LAST = "(l_linenumber, l_partkey, l_suppkey, l_quantity)"


def src_6(spark, d):
    known = _routes(spark, d).where("route_type < 100").select("route", "route_type")
    return feed.last_per(_trips(spark, d).join(known, "route"), "trip", "pos").select("trip", "route", "service", "headsign", "route_type")


# --- labels and markers ----------------------------------------------------------------------


def labels(spark, d) -> DataFrame:
    k = C("p_partkey")
    kind = _pick(["city-lbl", "city-lbl trip-lbl", "city-lbl top"], k)
    box = views.label_box(C("p_name"), kind, (k * 37 % 900).cast("double"), (k * 53 % 600).cast("double"))
    return read(spark, d, "part").select(C("p_size").alias("frame"), k.alias("k"), box.alias("box"), (k * 7 % 101).alias("priority"), (k % 9 == 0).alias("placed"))


_LABELS = """lb AS (SELECT p_size AS frame, p_partkey AS k, p_partkey * 7 % 101 AS priority, p_partkey % 9 = 0 AS placed, (p_partkey * 37 % 900)::DOUBLE AS l, (p_partkey * 53 % 600)::DOUBLE AS y, [10, 12, 11][1 + p_partkey % 3] AS font, p_name FROM part), bx AS (SELECT frame, k, priority, placed, l, l + greatest(20, floor(length(p_name) * font * 0.58::DOUBLE + 0.5) + 4) AS r, y - 2 AS t, y + font + 4 AS b FROM lb)"""


def fn_m24(spark, d):
    return views.overlapping_labels(labels(spark, d))


def so_6(spark, d):
    return views.pack_labels(labels(spark, d), 8)


SO_6 = f"""WITH RECURSIVE {_LABELS}, o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY placed DESC, priority DESC, k) AS i FROM bx),
w(frame, i, k, got, ok) AS (SELECT frame, i, k, [{{'l': l, 'r': r, 't': t, 'b': b}}], true FROM o WHERE i = 1
 UNION ALL SELECT n.frame, n.i, n.k, CASE WHEN fit THEN list_append(got, {{'l': n.l, 'r': n.r, 't': n.t, 'b': n.b}}) ELSE got END, fit FROM (SELECT o.*, w.got, len(w.got) < 8 AND len(list_filter(w.got, lambda x: x.l <= o.r AND o.l <= x.r AND x.t <= o.b AND o.t <= x.b)) = 0 AS fit FROM w JOIN o ON o.frame = w.frame AND o.i = w.i + 1) n)
SELECT frame, k, row_number() OVER (PARTITION BY frame ORDER BY i) - 1 AS rank FROM w WHERE ok"""


def var_42(spark, d):
    k = C("p_partkey")
    shown = views.label_text(C("p_name"), F.when(k % 10 == 0, k % 7), k % 10 == 1, F.when(k % 4 > 0, k % 200), 2)
    return read(spark, d, "part").select("p_partkey", shown.alias("label"))


VAR_42 = f"SELECT p_partkey, CASE WHEN p_partkey % 10 > 0 AND p_partkey % 4 > 0 THEN p_name || ' (' || {s.q_minutes('(p_partkey % 200)', '0min')} || ')' WHEN p_partkey % 10 = 0 THEN (p_partkey % 7 + 1) || '. ' || p_name WHEN p_partkey % 10 = 1 THEN 'via ' || p_name ELSE p_name END AS label FROM part"


def var_43(spark, d):
    return read(spark, d, "part").select("p_partkey", views.marker_radius(C("p_size") % 11, C("p_partkey") % 24 / 2.0).alias("radius"))


VAR_43 = "WITH r AS (SELECT p_partkey, CASE WHEN p_size % 11 >= 9 THEN 6.0 WHEN p_size % 11 >= 7 THEN 4.5 WHEN p_size % 11 >= 5 THEN 3.5 ELSE 2.5 END::DOUBLE * CASE WHEN p_partkey % 24 <= 8 THEN 0.8 WHEN p_partkey % 24 <= 12 THEN 1.0 WHEN p_partkey % 24 <= 16 THEN 1.3 ELSE 1.6 END::DOUBLE AS x FROM part) SELECT p_partkey, greatest(2, floor(x + 0.5))::INT AS radius FROM r"


def so_8(spark, d):
    k = C("c_custkey")
    return views.top_rendered(read(spark, d, "customer").select(k.alias("k"), (k % 10).alias("interest"), (k * 7919 % 500_000).alias("pop")), 7_000)


# --- times, legs and trips -------------------------------------------------------------------


def _reach(spark, d):
    k = C("c_custkey")
    return read(spark, d, "customer").select(k.alias("k"), F.when(k % 7 > 0, k * 13 % 1500).alias("minutes"), (k % 50 == 0).alias("pinned"), (k % 10).alias("interest"), (36.0 + k * 37 % 250 / 10.0).alias("lat"))


def flt_12(spark, d):
    return views.leg_filter(_reach(spark, d), 60, 900).select("k")


def so_5(spark, d):
    """Cities within two hours in order of time and key, numbered."""
    near = _reach(spark, d).where("minutes <= 120").select("k", "minutes")
    return ranks.position(near, "minutes", "k").select("k", C("position").cast("long").alias("position"))


def ag_21(spark, d):
    return views.trip_stats(halts(spark, d).select(C("country").alias("trip"), C("k").alias("i"), C("segment").alias("country"), "lat", "lon"))


AG_21 = f"WITH {HALTS}, t AS (SELECT country AS trip, segment, lat, lon, lag(lat) OVER w AS blat, lag(lon) OVER w AS blon FROM halts WINDOW w AS (PARTITION BY country ORDER BY k)) SELECT trip, count(*) AS stops, count(DISTINCT segment) AS countries, round(coalesce(sum({s.q_hav('blat', 'blon', 'lat', 'lon')}), 0) / 1000, 3) AS km FROM t GROUP BY trip"


def ag_22(spark, d):
    return views.leg_bound(read(spark, d, "orders").select(C("o_custkey").alias("trip"), F.when(C("o_orderstatus") != "P", C("o_orderkey") % 1700).alias("minutes")))


def ag_24(spark, d):
    return views.render_counts(_reach(spark, d), 60, 900, (40.0, 55.0), 4)


def ag_18(spark, d):
    return views.percentiles(read(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


AG_18 = "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(CASE WHEN i = least(n - 1, floor(0.5 * n)) THEN value END) AS p50, max(CASE WHEN i = least(n - 1, floor(0.95 * n)) THEN value END) AS p95 FROM r GROUP BY event_type"


def ag_19(spark, d):
    return views.last_values(read(spark, d, "events"), "event_type", "value", "event_id")


def ag_20(spark, d):
    """Characters of the documents from the sources of one family."""
    return read(spark, d, "documents").where(C("source").startswith("src1")).agg(F.sum("n_chars").cast("long").alias("bytes"))


def var_45(spark, d):
    """The newest event of a user that names an engine."""
    return m.running_last(read(spark, d, "events").where(C("event_type").isin("click", "signup")).select("user_id", "event_id", C("event_type").alias("kind")), "user_id", "event_id").select("user_id", "kind")


def var_46(spark, d):
    """The first event of a user whose value isn't nothing."""
    e = read(spark, d, "events").where("event_type = 'view' and value <> 0")
    return e.groupBy("user_id").agg(F.min_by("value", "event_id").alias("duration"))


def str_4(spark, d):
    """Of the results for a customer the one of the newest request."""
    return m.running_last(read(spark, d, "orders").select("o_custkey", C("o_orderkey").alias("version"), "o_orderstatus"), "o_custkey", "version")


def str_6(spark, d):
    return m.last_rows(read(spark, d, "events").select("event_type", "event_id"), "event_type", "event_id", 5_000)


def str_7(spark, d):
    """Events of another log, numbered on after one's own, under a prefix."""
    e = read(spark, d, "events")
    own = e.where("event_type <> 'error'").select("event_id", C("event_type").alias("scope"))
    last = own.agg(F.max("event_id").alias("top"))
    other = e.where("event_type = 'error'").crossJoin(F.broadcast(last)).select((C("top") + 1 + C("event_id")).alias("event_id"), F.concat(F.lit("relay/"), "event_type").alias("scope"))
    return own.union(other)


def var_49(spark, d):
    lo, hi = views.clamp_legs(C("o_orderkey") % 2000, C("o_custkey") % 1440, F.lit(720))
    return read(spark, d, "orders").select("o_orderkey", lo.alias("lo"), hi.alias("hi"))


def var_48(spark, d):
    """Restored states: names that exist, and ranges in order."""
    known = read(spark, d, "nation").where("n_regionkey <> 1").select(C("n_nationkey").alias("c_nationkey"))
    lo, hi = views.clamp_legs(C("c_custkey") % 2000, C("c_custkey") % 70, F.lit(1440))
    return read(spark, d, "customer").join(known, "c_nationkey", "left_semi").select("c_custkey", lo.alias("lo"), hi.alias("hi"))


# --- edges and geometry ----------------------------------------------------------------------


def jn_19(spark, d):
    g = read(spark, d, "customer").groupBy(C("c_nationkey").alias("a"), (C("c_custkey") % 25).cast("int").alias("b")).agg(F.min("c_custkey").alias("geom"))
    e = read(spark, d, "supplier").select(C("s_nationkey").alias("a"), (C("s_suppkey") % 25).cast("int").alias("b")).distinct()
    return views.augment(e, g)


JN_19 = "WITH g AS (SELECT c_nationkey AS a, (c_custkey % 25)::INT AS b, min(c_custkey) AS geom FROM customer GROUP BY 1, 2), e AS (SELECT DISTINCT s_nationkey AS a, (s_suppkey % 25)::INT AS b FROM supplier) SELECT e.a, e.b, coalesce(f.geom, r.geom) AS geom, f.geom IS NULL AS reversed FROM e LEFT JOIN g f ON e.a = f.a AND e.b = f.b LEFT JOIN g r ON e.a = r.b AND e.b = r.a WHERE f.geom IS NOT NULL OR r.geom IS NOT NULL"


def gr_12(spark, d):
    k = C("o_orderkey")
    rows = read(spark, d, "orders").select(k.alias("edge"), (k * 37 % 400_000).cast("double").alias("direct"), F.when(k % 5 > 0, (k * 91 % 900_000).cast("double")).alias("rail"), F.when(k % 3 > 0, (k * 17 % 500_000).cast("double")).alias("shape"))
    return views.geometry_choice(rows)


_PLAUSIBLE = "CASE WHEN direct < 1 THEN rail <= 1000 WHEN direct < 1000 THEN rail <= direct + 20000 WHEN direct < 30000 THEN rail <= greatest(direct * 6, direct + 5000) WHEN direct < 100000 THEN rail <= direct * 4 WHEN direct < 300000 THEN rail <= direct * 3 ELSE rail <= direct * 2.5 END"
GR_12 = f"WITH e AS (SELECT o_orderkey AS edge, o_orderkey * 37 % 400000 AS direct, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey * 91 % 900000 END AS rail, CASE WHEN o_orderkey % 3 > 0 THEN 1 END AS shape FROM orders), o AS (SELECT *, coalesce({_PLAUSIBLE}, false) AND rail IS NOT NULL AS ok FROM e) SELECT edge, CASE WHEN ok THEN 'rail' WHEN shape IS NOT NULL THEN 'shape' ELSE 'straight' END AS geometry, CASE WHEN NOT ok THEN rail END AS rejected_m FROM o"


def fn_s29(spark, d):
    """Keys of two names, of which many have a dash themselves."""
    names = read(spark, d, "part").select(F.regexp_replace("p_name", " ", "-").alias("name")).distinct()
    keys = read(spark, d, "part").select(F.concat(F.regexp_replace("p_name", " ", "-"), F.lit("-"), F.when(C("p_size") % 5 == 0, F.lit("nowhere")).otherwise(F.regexp_replace(F.reverse(F.reverse("p_name")), " ", "-"))).alias("key")).distinct()
    return views.route_keys(keys, names)


FN_S29 = "SELECT DISTINCT replace(p_name, ' ', '-') || '-' || replace(p_name, ' ', '-') AS key, replace(p_name, ' ', '-') AS a, replace(p_name, ' ', '-') AS b FROM part WHERE p_size % 5 > 0"


# --- names, numbers and states ---------------------------------------------------------------


def fn_s6(spark, d):
    return read(spark, d, "pages").select("page_id", F.array_join(text.long_digit_runs(F.concat("html", F.lit(" 0012345678 87654321 123456 87654321"))), ",").alias("runs"))


def fn_s7(spark, d):
    return read(spark, d, "pages").select("page_id", F.array_join(text.digit_runs(C("url")), ",").alias("runs"))


RULES = [
    {"action": "strip_suffix", "match": " widget"},
    {"action": "strip_suffix", "match": " rod", "countries": ["fr", "BE"]},
    {"action": "expand_abbreviation", "match": "red", "replace": "crimson", "sources": ["s1"]},
    {"action": "reject_token", "match": "small"},
    {"action": "expand_abbreviation", "match": "crimson", "replace": "scarlet", "countries": ["DE"], "sources": ["s1", "s2"]},
]


def _ruled(spark, d):
    return read(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), "p_name").alias("name"), _pick(["FR", "de", None], C("p_partkey")).alias("cc"), _pick(["s1", "s2", None, "s1"], C("p_size")).alias("src"))


def fn_s22(spark, d):
    return _ruled(spark, d).select("p_partkey", views.apply_rules(C("name"), C("cc"), C("src"), RULES).alias("shown"))


_RULED = "r AS (SELECT p_partkey, p_name AS n, ['FR', 'de', NULL][1 + p_partkey % 3] AS cc, ['s1', 's2', NULL, 's1'][1 + p_size % 4] AS src FROM part), a AS (SELECT *, CASE WHEN n LIKE '% widget' THEN trim(n[:-8]) ELSE n END AS n1 FROM r), b AS (SELECT *, CASE WHEN cc = 'FR' AND n1 LIKE '% rod' THEN trim(n1[:-5]) ELSE n1 END AS n2 FROM a), c AS (SELECT *, CASE WHEN src = 's1' AND n2 = 'red' THEN 'crimson' ELSE n2 END AS n3 FROM b)"


def flt_22(spark, d):
    """Whether the second rule and the last are in scope of a name."""
    scope = lambda r: views.apply_rules(F.lit("x"), C("cc"), C("src"), [r | {"action": "reject_token", "match": "x"}]).isNull()
    return _ruled(spark, d).select("p_partkey", scope(RULES[1]).alias("second"), scope(RULES[4]).alias("last"))


def fn_s28(spark, d):
    stops = read(spark, d, "conversations").select(C("conv_id").alias("trip"), C("turn").alias("pos"), C("role").alias("stop"))
    return feed.service_patterns(stops, "src|1", F.lit("r2"), "replacement_bus").select("pattern_key", "trip_count")


def fn_s31(spark, d):
    return read(spark, d, "pages").select("page_id", text.file_name_of_url(F.concat("url", _pick(["", "/", "/a.zip", "/b.zip?x=1/2", "?q"], C("page_id")))).alias("file_name"))


def fn_s33(spark, d):
    k = C("p_partkey")
    words = _pick(["Bus station", "Metro Station", "tram stop", "airport railway station", "high-speed rail station", "railway platform", "station complex", "railway station", "London Underground station", "building"], k)
    kind, scope = views.classify_station(F.array(F.lit("place"), words), k % 11 == 0, k % 4 == 0)
    return read(spark, d, "part").select("p_partkey", kind.alias("kind"), scope.alias("scope"))


FN_S33 = "WITH k AS (SELECT p_partkey, ['bus', 'metro', 'tram', 'airport_rail', 'high_speed_rail', 'platform', 'station_complex', 'mainline_rail', 'metro', 'unknown'][1 + p_partkey % 10] AS own FROM part), c AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 AND own IN ('mainline_rail', 'unknown') THEN 'station_complex' ELSE own END AS kind FROM k) SELECT p_partkey, kind, CASE WHEN kind IN ('bus', 'metro', 'tram') THEN 'non_rail_stop' WHEN kind = 'platform' THEN 'platform_area' WHEN kind = 'station_complex' THEN 'interchange_complex' WHEN kind = 'unknown' THEN 'unknown' WHEN p_partkey % 4 = 0 THEN 'station_part' ELSE 'customer_station' END AS scope FROM c"


def fn_s15(spark, d):
    k = C("c_custkey")
    trip = F.slice(F.array(F.concat(F.lit("city-"), text_of(k % 25)), F.lit("a b"), F.concat(F.lit("é:"), text_of(k % 3))), F.lit(1), (k % 4).cast("int"))
    leg = F.when(k % 3 > 0, F.struct((k % 60).alias("min"), (k % 60 + 100).alias("max")))
    ui = F.when(k % 5 == 0, F.create_map(F.lit("q"), F.lit("a;b"), F.lit("map"), F.lit("5/1/2"))).otherwise(F.create_map().cast("map<string,string>"))
    return read(spark, d, "customer").select("c_custkey", urls.to_hash(trip, k % 10, k % 100, leg, k % 2 == 0, ui).alias("hash"))


FN_S15 = "SELECT c_custkey, '#v1;t=' || array_to_string(['city-' || (c_custkey % 25), 'a%20b', '%C3%A9:' || (c_custkey % 3)][1:c_custkey % 4], ',') || ';fi=' || (c_custkey % 10) || ';fp=' || (c_custkey % 100) || CASE WHEN c_custkey % 3 > 0 THEN ';ll=' || (c_custkey % 60) || '-' || (c_custkey % 60 + 100) ELSE '' END || ';rt=' || CASE WHEN c_custkey % 2 = 0 THEN '1' ELSE '0' END || CASE WHEN c_custkey % 5 = 0 THEN ';ui.map=5%2F1%2F2;ui.q=a%3Bb' ELSE '' END AS hash FROM customer"


def _hashes(spark, d):
    k = C("c_custkey")
    forms = ["", "#v2;fi=3", "#v1;t=a,b-2;fi=7;fp=20;ll=30-400;rt=yes", "#v1;t=A;fi=2", "#v1;fi=300", "#v1;fi=x", "#v1;;bad;fp=12;fp=13", "v1;ll=9-3", "#v1;ll=9", "#v1;t=a%2Db,%C3%A9", "#v1;t=a%2", "#v1;t=a%2Db;rt=0;ui.q=x%20y;ui.map=5.5/1/-2;fpm=1"]
    return read(spark, d, "customer").select("c_custkey", _pick(forms, k).alias("hash"))


_STRICT = [("NULL", "''", 1, 0, "NULL", "NULL", "false"), ("'version'",), ("NULL", "'a,b-2'", 7, 20, 30, 400, "true"), ("'t'",), ("'fi'",), ("'fi'",), ("NULL", "''", 1, 13, "NULL", "NULL", "false"), ("'ll'",), ("'ll'",), ("'t'",), ("'t'",), ("NULL", "'a-b'", 1, 0, "NULL", "NULL", "false")]
_BROWSER = [None, None, ("'a,b-2'", 7, 20, "false", 30, 400, "''"), ("'A'", 2, 100, "false", 0, 1440, "''"), ("''", 300, 100, "false", 0, 1440, "''"), ("''", 5, 100, "false", 0, 1440, "''"), ("''", 5, 13, "false", 0, 1440, "''"), ("''", 5, 100, "false", 9, 3, "''"), ("''", 5, 100, "false", 9, 1440, "''"), ("'a-b,é'", 5, 100, "false", 0, 1440, "''"), ("'a%2'", 5, 100, "false", 0, 1440, "''"), ("'a-b'", 5, 100, "true", 0, 1440, "'x y'")]


def _table(rows, names: str) -> str:
    n = len(names.split(","))
    put = lambda r: ", ".join(str(x) for x in (r or ())) + ", NULL" * (n - len(r or ())) if r else ", ".join(["NULL"] * n)
    return f"(VALUES {', '.join(f'({i}, {put(r)})' for i, r in enumerate(rows))}) AS e(i, {names})"


def fn_s16(spark, d):
    return _hashes(spark, d).select("c_custkey", urls.parse_strict(C("hash")).alias("x")).select("c_custkey", "x.*")


def fn_s17(spark, d):
    return _hashes(spark, d).select("c_custkey", urls.parse_lossy(C("hash")).alias("x")).select("c_custkey", "x.*")


def fn_s18(spark, d):
    return _hashes(spark, d).select("c_custkey", urls.parse_browser(C("hash")).alias("x")).select("c_custkey", "x.trip", "x.interest", "x.population", "x.manual", "x.leg_min", "x.leg_max", "x.query", "x.zoom")


def var_50(spark, d):
    forms = ["5.5/48/2", "7/x/2", "1/2", " 3e1/-4.5/.5x", "", "a/1/2", "9/+1/-0"]
    return read(spark, d, "customer").select("c_custkey", urls.parse_view(_pick(forms, C("c_custkey"))).alias("v")).select("c_custkey", "v.zoom", "v.lat", (C("v.lon") + 0.0).alias("lon"))


VAR_50 = "SELECT c_custkey, ([5.5, NULL, NULL, 30, NULL, NULL, 9]::DOUBLE[])[1 + c_custkey % 7] AS zoom, ([48, NULL, NULL, -4.5, NULL, NULL, 1]::DOUBLE[])[1 + c_custkey % 7] AS lat, ([2, NULL, NULL, 0.5, NULL, NULL, 0]::DOUBLE[])[1 + c_custkey % 7] + 0.0::DOUBLE AS lon FROM customer"


def fn_m21(spark, d):
    """Places written in five ways, two of which are none."""
    k = C("c_custkey")
    lat, lon = (k % 90).cast("string"), (k % 180 + 1).cast("string")
    ways = [F.concat(lat, F.lit(".5, -"), lon), F.concat(F.lit(" "), lat, F.lit(" ,"), lon, F.lit(".25")), F.concat(F.lit("x,"), lon), lat, F.concat(lat, F.lit(","), lon, F.lit(",9"))]
    place = geo.parse_place(F.get(F.array(*ways), (k % 5).cast("int")))
    return read(spark, d, "customer").select("c_custkey", place["lat"].alias("lat"), place["lon"].alias("lon"))


FN_M21 = "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_custkey % 90 + 0.5 WHEN 1 THEN c_custkey % 90 WHEN 4 THEN c_custkey % 90 END::DOUBLE AS lat, CASE c_custkey % 5 WHEN 0 THEN -(c_custkey % 180 + 1) WHEN 1 THEN c_custkey % 180 + 1.25 WHEN 4 THEN c_custkey % 180 + 1 END::DOUBLE AS lon FROM customer"


def fn_c5(spark, d):
    """Priority of a reference's segment. A to D."""
    seg = _pick(["A", " b ", "C", "d", "", "x"], C("p_partkey"))
    return read(spark, d, "part").select("p_partkey", build.segment_priority(seg).alias("priority"))


# --- filters ---------------------------------------------------------------------------------


def flt_19(spark, d):
    k = C("s_suppkey").cast("string")
    ways = [F.concat(F.lit("Q"), k), F.concat(F.lit("Q"), k, F.lit("x")), F.concat(F.lit("q"), k), F.concat(F.lit(" Q"), k), F.lit("Q"), F.lit(None).cast("string")]
    return read(spark, d, "supplier").select("s_suppkey", text.wikidata_id(F.get(F.array(*ways), (C("s_suppkey") % 6).cast("int"))).alias("valid"))


KINDS = ["mainline_rail", "high_speed_rail", "metro", "bus", "ferry", "tram", "airport_rail", "unknown"]
SCOPES = ["customer_station", "station_part", "platform_area"]


def _stations(spark, d):
    k = C("s_suppkey")
    return read(spark, d, "supplier").select(k.alias("k"), C("s_nationkey").alias("city"), F.when(k % 6 == 5, "P31").when(k % 5 > 0, F.concat(F.lit("Q"), text_of(k % 37))).alias("qid"), _pick(KINDS, k).alias("kind"), _pick(SCOPES, C("s_nationkey")).alias("scope"), F.when(k % 7 > 0, C("s_nationkey") % 3).alias("complex"))


_STATIONS = f"st AS (SELECT s_suppkey AS k, s_nationkey AS city, CASE WHEN s_suppkey % 6 = 5 THEN 'P31' WHEN s_suppkey % 5 > 0 THEN 'Q' || (s_suppkey % 37) END AS qid, {_list(KINDS)}[1 + s_suppkey % 8] AS kind, {_list(SCOPES)}[1 + s_nationkey % 3] AS scope, CASE WHEN s_suppkey % 7 > 0 THEN s_nationkey % 3 END AS complex FROM supplier)"
_RAIL = "kind IN ('mainline_rail', 'high_speed_rail', 'airport_rail')"


def flt_20(spark, d):
    return _stations(spark, d).where(C("kind").isin("mainline_rail", "high_speed_rail", "airport_rail", "suburban_rail") & C("scope").isin("customer_station", "station_part")).select("k")


def flt_21(spark, d):
    return _stations(spark, d).select("k", C("kind").isin("metro", "tram", "bus", "ferry").alias("non_mainline"))


def flt_24(spark, d):
    return read(spark, d, "part").select("p_partkey", text.in_service(_pick([" exploite ", "ferme", None, "EXPLOITE", ""], C("p_partkey"))).alias("active"))


def flt_25(spark, d):
    """One region: its nations, their customers, those customers' orders, and their lines."""
    keep = read(spark, d, "nation").where("n_regionkey = 2").select(C("n_nationkey").alias("c_nationkey"))
    people = read(spark, d, "customer").join(keep, "c_nationkey", "left_semi").select(C("c_custkey").alias("o_custkey"))
    orders = read(spark, d, "orders").join(people, "o_custkey", "left_semi").select(C("o_orderkey").alias("l_orderkey"))
    return read(spark, d, "lineitem").join(orders, "l_orderkey", "left_semi").groupBy("l_orderkey").agg(F.count("*").alias("lines"))


# --- audits and artifacts --------------------------------------------------------------------


def val_7(spark, d):
    st = _stations(spark, d)
    cities = read(spark, d, "nation").where("n_regionkey <> 3").select(C("n_nationkey").alias("city"))
    complexes = read(spark, d, "region").where("r_regionkey < 2").select(C("r_regionkey").alias("complex"))
    return views.station_findings(st, cities, complexes, st.where("k % 4 = 0").select("k"))


VAL_7 = f"""WITH {_STATIONS}, q AS (SELECT qid FROM st WHERE qid IS NOT NULL GROUP BY qid HAVING count(*) > 1 AND NOT (coalesce(min(complex) = max(complex), false) AND count(complex) = count(*))),
f AS (SELECT k, city IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3) AS a, coalesce(qid LIKE 'P%', false) AS b, coalesce(qid IN (SELECT qid FROM q), false) AS c, kind IN ('metro', 'bus', 'ferry', 'tram') AND scope = 'customer_station' AS e, {_RAIL} AND scope <> 'platform_area' AND k % 4 <> 0 AS g, coalesce(complex >= 2, false) AS h FROM st)
SELECT k, array_to_string(list_filter([CASE WHEN a THEN 'missing_city' END, CASE WHEN b THEN 'invalid_qid' END, CASE WHEN c THEN 'duplicate_qid' END, CASE WHEN e THEN 'not_rail' END, CASE WHEN g THEN 'no_anchor' END, CASE WHEN h THEN 'no_complex' END], lambda x: x IS NOT NULL), ',') AS flags, CASE WHEN a OR b OR c OR e THEN 'block_or_review' ELSE 'accepted_with_warning' END AS action FROM f WHERE a OR b OR c OR e OR g OR h"""


def val_1(spark, d):
    """Customers as offsets of a graph that runs down now and then, orders as its edges."""
    k = C("c_custkey")
    offsets = read(spark, d, "customer").select(k.alias("i"), (k * 10 - (k % 100 == 7).cast("int") * 30).alias("at"))
    edges = read(spark, d, "orders").select(C("o_orderkey").alias("i"), C("o_custkey").alias("target"), F.lit(1).alias("duration"))
    return views.graph_findings(offsets, edges, 140)


VAL_1 = "WITH o AS (SELECT c_custkey AS i, c_custkey * 10 - CASE WHEN c_custkey % 100 = 7 THEN 30 ELSE 0 END AS v FROM customer), z AS (SELECT i, v, lag(v) OVER (ORDER BY i) AS b FROM o) SELECT 'offset_count' AS finding, count(*) AS value FROM o HAVING count(*) <> 141 UNION ALL SELECT 'final_offset', max_by(v, i) FROM o HAVING max_by(v, i) <> (SELECT count(*) FROM orders) UNION ALL SELECT 'offset_order', i FROM z WHERE v < b UNION ALL SELECT 'target_bounds', o_orderkey FROM orders WHERE o_custkey >= 140"


def val_2(spark, d):
    k = C("c_custkey")
    return views.geometry_findings(read(spark, d, "customer").select(k.alias("i"), C("c_nationkey").alias("a"), (k % 25).alias("b"), F.sequence(F.lit(1), (k % 9 + 1).cast("int")).alias("points")), 22)


def val_3(spark, d):
    return views.alias_findings(read(spark, d, "part").select(C("p_partkey").alias("i"), C("p_name").alias("alias"), C("p_size").alias("city")), 48)


def val_14(spark, d):
    """Observed cities as variants: each label, then its aliases, once a city."""
    p = read(spark, d, "part")
    every = p.select(C("p_partkey").alias("city"), F.explode(F.array_distinct(F.concat(F.array(text.normalize_name(C("p_name"))), F.when(C("p_size") > 10, F.array(F.lower("p_brand"), text.normalize_name(C("p_name")))).otherwise(F.array().cast("array<string>"))))).alias("variant"))
    return every


def val_11(spark, d):
    """Sorted labels of a city's stations, each once."""
    return read(spark, d, "supplier").groupBy(C("s_nationkey").alias("station")).agg(F.array_join(F.array_sort(F.collect_set(text.normalize_name(C("s_name")))), ",").alias("labels"))


def st_6(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.array_distinct(text.digit_runs(F.coalesce("text", F.lit(""))))), ",").alias("runs"))


def _chunked(spark, d):
    from viaduct.sources.lines import shared_folder

    rows = halts(spark, d).select("k", "country", "lat", "lon")
    path = shared_folder(spark)
    views.write_chunks(rows, path, ["country"], 40, ("lat", "lon"))
    return rows, path


def ct_4(spark, d):
    """Chunks written with their manifest: the counts and boxes add up to the table's."""
    _, path = _chunked(spark, d)
    return spark.read.json(f"{path}/manifest").agg(F.sum("rows").cast("long").alias("n"), F.min("south").alias("south"), F.max("north").alias("north"), F.min("west").alias("west"), F.max("east").alias("east"))


def st_2(spark, d):
    rows, path = _chunked(spark, d)
    return views.read_chunks(spark, path, views.with_chunk(rows.schema)).select("k", "country", "lat", "lon")


def src_28(spark, d):
    """Only the chunks whose box meets a view, by way of the manifest."""
    rows, path = _chunked(spark, d)
    view = {"west": 0.0, "east": 5.0, "south": 40.0, "north": 45.0}
    seen = spark.createDataFrame([], "file int")
    wanted = m.visible_chunks(spark.read.json(f"{path}/manifest").withColumnRenamed("chunk", "file"), seen, view)
    found = views.read_chunks(spark, path, views.with_chunk(rows.schema), wanted.select(C("file").alias("chunk")))
    return found.where("lon between 0 and 5 and lat between 40 and 45").select("k", "lat", "lon")


def var_52(spark, d):
    bare = F.to_json(F.array(F.struct(C("o_orderkey").alias("k"))))
    whole = F.when(C("o_orderkey") % 2 == 0, bare).otherwise(F.concat(F.lit('{"geometries": '), bare, F.lit("}")))
    got = views.unwrap_payload(whole, "struct<k:bigint>", "geometries")
    return read(spark, d, "orders").select("o_orderkey", F.get(got, F.lit(0))["k"].alias("k"))


def var_54(spark, d):
    return read(spark, d, "nation").where("n_name = 'NATION_7'").select("n_nationkey", "n_regionkey")


QUERIES = {n: globals()[n] for n in ("src_2", "src_3", "src_5", "src_6", "fn_m24", "so_6", "var_42", "var_43", "so_8", "flt_12", "so_5", "ag_21", "ag_22", "ag_24", "ag_18", "ag_19", "ag_20", "var_45", "var_46", "str_4", "str_6", "str_7", "var_49", "var_48", "jn_19", "gr_12", "fn_s29", "fn_s6", "fn_s7", "fn_s22", "flt_22", "fn_s28", "fn_s31", "fn_s33", "fn_s15", "fn_s16", "fn_s17", "fn_s18", "var_50", "fn_m21", "fn_c5", "flt_19", "flt_20", "flt_21", "flt_24", "flt_25", "val_7", "val_1", "val_2", "val_3", "val_14", "val_11", "st_6", "ct_4", "st_2", "src_28", "var_52", "var_54")} | {"st_3": st_2}
_REACH = "r AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 > 0 THEN c_custkey * 13 % 1500 END AS minutes FROM customer)"
ORACLE_SQL = {
    "so_6": SO_6, "var_42": VAR_42, "var_43": VAR_43, "ag_21": AG_21, "ag_18": AG_18, "jn_19": JN_19, "gr_12": GR_12, "fn_s29": FN_S29, "fn_s33": FN_S33, "fn_s15": FN_S15, "var_50": VAR_50, "fn_m21": FN_M21, "val_7": VAL_7, "val_1": VAL_1,
    "src_2": f"WITH {_ROUTES} SELECT route, route_type FROM rt WHERE route_id NOT LIKE '%|Bus|%' AND route_id NOT LIKE '%|Tram%' AND route_type IN (2, 101, 102, 103, 105, 107, 109, 116, 117)",
    "src_3": f"WITH {_ROUTES} SELECT route, route_type FROM rt",
    "src_5": f"WITH {_ROUTES} SELECT l_orderkey AS trip, arg_max(l_partkey, {_LAST}) AS route FROM lineitem JOIN rt ON l_partkey = route WHERE (route_type = 2 OR route_type BETWEEN 100 AND 117) AND l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey % 3 = 1) GROUP BY l_orderkey",
    "src_6": f"WITH {_ROUTES} SELECT l_orderkey AS trip, arg_max(l_partkey, {_LAST}) AS route, arg_max(l_linestatus, {_LAST}) AS service, arg_max([CASE WHEN l_linenumber > 3 THEN l_returnflag END], {_LAST})[1] AS headsign, arg_max(route_type, {_LAST}) AS route_type FROM lineitem JOIN rt ON l_partkey = route WHERE route_type < 100 GROUP BY l_orderkey",
    "fn_m24": f"WITH {_LABELS} SELECT a.frame, a.k AS a, b.k AS b FROM bx a JOIN bx b ON a.frame = b.frame AND a.k < b.k WHERE a.l <= b.r AND b.l <= a.r AND a.t <= b.b AND b.t <= a.b",
    "so_8": "SELECT c_custkey AS k, c_custkey % 10 * 1000000 + c_custkey * 7919 % 500000 AS priority FROM customer ORDER BY priority DESC, k LIMIT 7000",
    "flt_12": f"WITH {_REACH} SELECT k FROM r WHERE k % 50 = 0 OR minutes BETWEEN 60 AND 900",
    "so_5": f"WITH {_REACH} SELECT k, row_number() OVER (ORDER BY minutes, k) - 1 AS position FROM r WHERE minutes <= 120",
    "ag_22": "WITH l AS (SELECT o_custkey AS trip, max(o_orderkey % 1700) FILTER (WHERE o_orderstatus <> 'P') AS top FROM orders GROUP BY o_custkey) SELECT trip, CASE WHEN top IS NULL THEN 1440 ELSE greatest(60, ceil(top / 60.0) * 60) END::BIGINT AS bound FROM l",
    "ag_24": "WITH r AS (SELECT CASE WHEN NOT coalesce(CASE WHEN c_custkey % 7 > 0 THEN c_custkey * 13 % 1500 END BETWEEN 60 AND 900, false) THEN 't' WHEN c_custkey % 10 < 4 THEN 'i' WHEN c_custkey * 37 % 250 / 10.0 NOT BETWEEN 4 AND 19 THEN 'v' ELSE 's' END AS why FROM customer) SELECT count(*) AS cities, count_if(why = 't') AS culled_time, count_if(why = 'i') AS culled_interest, count_if(why = 'v') AS culled_view, count_if(why = 's') AS shown FROM r",
    "ag_19": "SELECT event_type, arg_max(value, event_id) AS last_value, count(*) AS samples FROM events GROUP BY event_type",
    "ag_20": "SELECT sum(n_chars)::BIGINT AS bytes FROM documents WHERE source LIKE 'src1%'",
    "var_45": "SELECT user_id, arg_max(event_type, event_id) AS kind FROM events WHERE event_type IN ('click', 'signup') GROUP BY user_id",
    "var_46": "SELECT user_id, arg_min(value, event_id) AS duration FROM events WHERE event_type = 'view' AND value <> 0 GROUP BY user_id",
    "str_4": "SELECT o_custkey, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey",
    "str_6": "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) WHERE n <= 5000",
    "str_7": "SELECT event_id, event_type AS scope FROM events WHERE event_type <> 'error' UNION ALL SELECT event_id + 1 + (SELECT max(event_id) FROM events WHERE event_type <> 'error'), 'relay/error' FROM events WHERE event_type = 'error'",
    "var_49": "SELECT o_orderkey, least(o_orderkey % 2000, o_custkey % 1440, 720) AS lo, greatest(least(o_orderkey % 2000, 720), least(o_custkey % 1440, 720)) AS hi FROM orders",
    "var_48": "SELECT c_custkey, least(c_custkey % 2000, c_custkey % 70, 1440) AS lo, greatest(least(c_custkey % 2000, 1440), c_custkey % 70) AS hi FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 1)",
    "fn_s6": "SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(html, '[0-9]{7,}'), ['0012345678', '87654321']))), ',') AS runs FROM pages",
    "fn_s7": "SELECT page_id, array_to_string(regexp_extract_all(url, '[0-9]+'), ',') AS runs FROM pages",
    "fn_s22": f"WITH {_RULED} SELECT p_partkey, CASE WHEN n3 = 'small' THEN NULL WHEN n3 = 'crimson' AND cc = 'de' AND src IN ('s1', 's2') THEN 'scarlet' ELSE n3 END AS shown FROM c",
    "flt_22": f"WITH {_RULED} SELECT p_partkey, coalesce(cc = 'FR', false) AS second, coalesce(cc = 'de' AND src IN ('s1', 's2'), false) AS last FROM r",
    "fn_s28": "SELECT k AS pattern_key, count(*) AS trip_count FROM (SELECT 'src|1|r2|replacement_bus|' || string_agg(role, '>' ORDER BY turn) AS k FROM conversations GROUP BY conv_id) GROUP BY k",
    "fn_s31": "WITH u AS (SELECT page_id, regexp_replace(url || ['', '/', '/a.zip', '/b.zip?x=1/2', '?q'][1 + page_id % 5], '[?].*$', '') AS u FROM pages) SELECT page_id, CASE WHEN u LIKE '%/' THEN 'source.bin' ELSE string_split(u, '/')[-1] END AS file_name FROM u",
    "fn_s16": f"SELECT c_custkey, error::VARCHAR AS error, trip::VARCHAR AS trip, interest::BIGINT AS interest, population::BIGINT AS population, leg_min::BIGINT AS leg_min, leg_max::BIGINT AS leg_max, round_trip::BOOLEAN AS round_trip FROM customer JOIN {_table(_STRICT, 'error, trip, interest, population, leg_min, leg_max, round_trip')} ON c_custkey % 12 = i",
    "fn_s17": f"SELECT c_custkey, coalesce(trip, '')::VARCHAR AS trip, coalesce(interest, 1)::BIGINT AS interest, coalesce(population, 0)::BIGINT AS population, leg_min::BIGINT AS leg_min, leg_max::BIGINT AS leg_max, coalesce(round_trip, false)::BOOLEAN AS round_trip FROM customer JOIN {_table(_STRICT, 'error, trip, interest, population, leg_min, leg_max, round_trip')} ON c_custkey % 12 = i",
    "fn_s18": f"SELECT c_custkey, trip::VARCHAR AS trip, interest::BIGINT AS interest, population::BIGINT AS population, manual::BOOLEAN AS manual, leg_min::BIGINT AS leg_min, leg_max::BIGINT AS leg_max, query::VARCHAR AS query, CASE WHEN i = 11 THEN 5.5::DOUBLE END AS zoom FROM customer JOIN {_table(_BROWSER, 'trip, interest, population, manual, leg_min, leg_max, query')} ON c_custkey % 12 = i",
    "fn_c5": "SELECT p_partkey, [4, 3, 2, 1, 1, 1][1 + p_partkey % 6]::INT AS priority FROM part",
    "flt_19": "SELECT s_suppkey, s_suppkey % 6 = 0 AS valid FROM supplier",
    "flt_20": f"WITH {_STATIONS} SELECT k FROM st WHERE {_RAIL} AND scope <> 'platform_area'",
    "flt_21": f"WITH {_STATIONS} SELECT k, kind IN ('metro', 'tram', 'bus', 'ferry') AS non_mainline FROM st",
    "flt_24": "SELECT p_partkey, p_partkey % 5 IN (0, 2, 3) AS active FROM part",
    "flt_25": "SELECT l_orderkey, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 GROUP BY l_orderkey",
    "val_2": "SELECT c_custkey AS i, CASE WHEN c_nationkey >= 22 OR c_custkey % 25 >= 22 THEN 'city_bounds' ELSE 'too_few_points' END AS finding FROM customer WHERE c_nationkey >= 22 OR c_custkey % 25 >= 22 OR c_custkey % 9 = 0",
    "val_3": "SELECT i, CASE WHEN city >= 48 THEN 'city_bounds' ELSE 'not_sorted' END AS finding FROM (SELECT p_partkey AS i, p_name, p_size AS city, lag(p_name) OVER (ORDER BY p_partkey) AS b FROM part) WHERE city >= 48 OR b > p_name",
    "val_14": "SELECT p_partkey AS city, lower(p_name) AS variant FROM part UNION ALL SELECT p_partkey, lower(p_brand) FROM part WHERE p_size > 10",
    "val_11": f"SELECT s_nationkey AS station, string_agg(DISTINCT {s.q_norm('s_name')}, ',' ORDER BY {s.q_norm('s_name')}) AS labels FROM supplier GROUP BY s_nationkey",
    "st_6": "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]+'))), ',') AS runs FROM documents",
    "ct_4": f"WITH {HALTS} SELECT count(*) AS n, min(lat) AS south, max(lat) AS north, min(lon) AS west, max(lon) AS east FROM halts",
    "st_2": f"WITH {HALTS} SELECT k, country, lat, lon FROM halts", "st_3": f"WITH {HALTS} SELECT k, country, lat, lon FROM halts",
    "src_28": f"WITH {HALTS} SELECT k, lat, lon FROM halts WHERE lon BETWEEN 0 AND 5 AND lat BETWEEN 40 AND 45",
    "var_52": "SELECT o_orderkey, o_orderkey AS k FROM orders",
    "var_54": "SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey = 7",
}
