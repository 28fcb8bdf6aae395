"""Stations, clusters and cities over parts, customers and suppliers in the roles of places, each beside its SQL.

The SQL compares all pairs where the operators use a grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.functions import text
from viaduct.operators import spatial, stations
from viaduct.plans import scalars as s
from viaduct.plans.feed import read

C = F.col


def at(k, a: int, b: int, south: float = 36.0, west: float = -9.0, high: int = 250, wide: int = 340, step: float = 10.0):
    return (south + (k * a) % high / step), (west + (k * b) % wide / step)


def q_at(k: str, a: int, b: int, south: float = 36.0, west: float = -9.0, high: int = 250, wide: int = 340, step: float = 10.0, names: str = "lat,lon") -> str:
    y, x = names.split(",")
    return f"{south}::DOUBLE + (({k}*{a})%{high})/{step}::DOUBLE AS {y}, {west}::DOUBLE + (({k}*{b})%{wide})/{step}::DOUBLE AS {x}"


FINE = {"south": 48.0, "west": 2.0, "high": 50, "wide": 70, "step": 100.0}


def stops(spark: SparkSession, d: str) -> DataFrame:
    """Named stations on a grid of a hundredth of a degree."""
    lat, lon = at(C("p_partkey"), 37, 53, **FINE)
    rows = read(spark, d, "part").select(C("p_partkey").alias("k"), C("p_size").alias("size"), lat.alias("lat"), lon.alias("lon"))
    return s.names(spark, d).join(rows, "k")


STOPS = f"stops AS (SELECT k, name, p_size AS size, {q_at('k', 37, 53, **FINE)} FROM {s.NAMES_SQL} JOIN part ON k = p_partkey)"


def halts(spark, d):
    """Coded stations: the number in the name and a national code."""
    lat, lon = at(C("c_custkey"), 37, 53)
    return read(spark, d, "customer").select(C("c_custkey").alias("k"), C("c_name").alias("name"), C("c_nationkey").alias("country"), C("c_mktsegment").alias("segment"), C("c_acctbal").alias("balance"), F.array_union(text.long_digit_runs(C("c_name")), F.array(F.concat(F.lit("87"), F.lpad(C("c_nationkey").cast("string"), 5, "0")))).alias("codes"), lat.alias("lat"), lon.alias("lon"))


HALTS = f"halts AS (SELECT c_custkey AS k, c_name AS name, c_nationkey AS country, c_mktsegment AS segment, c_acctbal AS balance, [c_name[10:], '87' || lpad(c_nationkey::VARCHAR, 5, '0')] AS codes, {q_at('c_custkey', 37, 53)} FROM customer)"


def references(spark, d):
    lat, lon = at(C("s_suppkey"), 91, 17)
    return read(spark, d, "supplier").select(C("s_suppkey").alias("r"), C("s_name").alias("rname"), C("s_nationkey").alias("nation"), F.array_union(text.long_digit_runs(C("s_name")), F.array(F.concat(F.lit("87"), F.lpad(C("s_nationkey").cast("string"), 5, "0")))).alias("codes"), lat.alias("nlat"), lon.alias("nlon"))


REFS = f"refs AS (SELECT s_suppkey AS r, s_name AS rname, s_nationkey AS nation, [s_name[10:], '87' || lpad(s_nationkey::VARCHAR, 5, '0')] AS codes, {q_at('s_suppkey', 91, 17, names='nlat,nlon')} FROM supplier)"
M = s.q_hav("lat", "lon", "nlat", "nlon")
PAIR = s.q_hav("a.lat", "a.lon", "b.lat", "b.lon")


def jn_1(spark, d):
    return stations.match_by_code(halts(spark, d), references(spark, d)).withColumn("m", F.round("m", 2))


JN_1 = f"WITH {HALTS}, {REFS}, p AS (SELECT DISTINCT k, r, {M} AS m FROM halts JOIN refs ON list_has_any(halts.codes, refs.codes)) SELECT k, arg_min(r, (m, r)) AS r, round(min(m), 2) AS m FROM p GROUP BY k"


def jn_2(spark, d):
    """Small parts are the references; a part that shares a code, its key's hundreds, is matched already."""
    all_ = stops(spark, d).drop("name").join(read(spark, d, "part").select(C("p_partkey").alias("k"), C("p_name").alias("name")), "k")
    known = all_.where("size < 15").select(C("k").alias("r"), "name", C("lat").alias("nlat"), C("lon").alias("nlon"))
    matched = all_.where("k % 11 = 0").select("k")
    return stations.match_by_name(all_.where("size >= 15").select("k", "name", "lat", "lon"), known, matched).withColumn("m", F.round("m", 2))


JN_2 = f"WITH {STOPS}, n AS (SELECT k, stops.size, lat, lon, lower(p_name) AS norm FROM stops JOIN part ON k = p_partkey), p AS (SELECT a.k, b.k AS r, {PAIR} AS m FROM n a JOIN n b ON a.norm = b.norm AND a.size >= 15 AND b.size < 15 WHERE a.k % 11 <> 0) SELECT k, arg_min(r, (m, r)) AS r, round(min(m), 2) AS m FROM p WHERE m <= 2000 GROUP BY k"


def _overrides(spark, d):
    return read(spark, d, "lineitem").select(C("l_partkey").alias("raw_id"), C("l_suppkey").alias("target"))


def jn_3(spark, d):
    """Raw ids that several overrides send to different cities."""
    return stations.override_lookup(_overrides(spark, d)).where("targets > 1")


def jn_4(spark, d):
    some = read(spark, d, "part").where("p_size < 17").select(C("p_partkey").alias("raw_id"), (C("p_size") % 7).alias("target"))
    refs = read(spark, d, "lineitem").select(C("l_orderkey").alias("station"), C("l_partkey").alias("raw_id"))
    return stations.resolve_overrides(refs, stations.override_lookup(some, strict=True))


JN_4 = "WITH o AS (SELECT p_partkey AS raw_id, p_size % 7 AS target FROM part WHERE p_size < 17) SELECT l_orderkey AS station, min(target) AS binding, count(DISTINCT target) > 1 AS conflict FROM lineitem LEFT JOIN o ON l_partkey = raw_id GROUP BY l_orderkey"


def jn_8(spark, d):
    return stations.stems(stops(spark, d).select("k", "name", "lat", "lon"))


JN_8 = f"WITH {STOPS}, w AS (SELECT k, lat, lon, {s.q_norm('name')} AS name FROM stops), x AS (SELECT k, lat, lon, name, n, array_to_string(string_split(name, ' ')[1:n], ' ') AS prefix FROM (SELECT *, unnest(generate_series(1, len(string_split(name, ' ')) - 1)) AS n FROM w)), u AS (SELECT * FROM x WHERE {s.q_usable('prefix')}), h AS (SELECT a.k, max(a.n) AS n FROM u a JOIN u b ON a.prefix = b.prefix AND a.k <> b.k WHERE {PAIR} <= 30000 GROUP BY a.k) SELECT w.k, CASE WHEN h.n IS NULL THEN name ELSE array_to_string(string_split(name, ' ')[1:h.n], ' ') END AS stem FROM w LEFT JOIN h USING (k)"


def _clusters(spark, d):
    return stops(spark, d).select(C("k").alias("cluster"), "name", "lat", "lon", (C("size") % 12).alias("stations"))


def jn_9(spark, d):
    """Parents of names with a number or a street in them."""
    kids = stops(spark, d).select("k", text.route_parent_key(C("name")).alias("key"), "lat", "lon").where("key is not null")
    return stations.route_parents(kids, _clusters(spark, d), 60_000.0)


_PARENTS = f"par AS (SELECT k AS parent, name AS pname, {s.q_comparable('name')} AS key, lat, lon, size % 12 AS stations FROM stops WHERE {s.q_eligible('name')} = 'eligible')"


def _ranked(met: str, margin: float) -> str:
    order = "OVER (PARTITION BY k ORDER BY stations DESC, m, pname, parent)"
    return f"(SELECT k, CASE WHEN s2 = stations AND abs(m2 - m) < {margin} THEN NULL ELSE parent END AS parent FROM (SELECT *, row_number() {order} AS i, lead(stations) {order} AS s2, lead(m) {order} AS m2 FROM {met}) WHERE i = 1)"


JN_9 = f"WITH {STOPS}, {_PARENTS}, kid AS (SELECT k, lat, lon, {s.q_route('name')} AS key FROM stops), met AS (SELECT a.k, b.parent, b.pname, b.stations, {PAIR} AS m FROM kid a JOIN par b ON a.key = b.key AND a.k <> b.parent WHERE {PAIR} <= 60000) SELECT * FROM {_ranked('met', 1.0)}"


def jn_10(spark, d):
    """Parents of urban interchanges."""
    urban = text.city_eligibility(C("name")) == "urban_interchange"
    kids = stops(spark, d).where(urban).select("k", text.urban_parent_key(C("name")).alias("key"), "lat", "lon")
    return stations.urban_parents(kids, _clusters(spark, d))


JN_10 = f"WITH {STOPS}, {_PARENTS}, kid AS (SELECT k, lat, lon, {s.q_urban('name')} AS key FROM stops WHERE {s.q_eligible('name')} = 'urban_interchange'), met AS (SELECT a.k, b.parent, b.pname, b.stations, {PAIR} AS m FROM kid a JOIN par b ON a.key = b.key AND a.k <> b.parent WHERE {PAIR} <= 15000), big AS (SELECT a.k, b.parent, b.pname, b.stations, {PAIR} AS m FROM kid a JOIN par b ON a.k <> b.parent AND b.stations >= 10 AND {s.q_usable('b.key')} WHERE a.k NOT IN (SELECT k FROM met) AND {PAIR} <= 5000) SELECT * FROM {_ranked('met', 1.0)} UNION ALL SELECT * FROM {_ranked('big', 250.0)}"


def jn_11(spark, d):
    return stations.duplicate_cities(stops(spark, d).select("k", "name", "lat", "lon"))


JN_11 = f"WITH {STOPS}, n AS (SELECT k, lat, lon, {s.q_norm('name')} AS norm FROM stops) SELECT a.k AS a, b.k AS b, round({PAIR})::BIGINT AS metres FROM n a JOIN n b ON a.norm = b.norm AND a.k < b.k WHERE round({PAIR}) <= 25000"


def _sides(spark, d):
    return halts(spark, d).select("k", "lat", "lon"), references(spark, d).select(C("r").alias("node"), "nlat", "nlon")


_NEAR = f"{HALTS}, {REFS}, hit AS (SELECT k, r AS node, {M} AS m FROM halts, refs)"


def jn_12(spark, d):
    points, nodes = _sides(spark, d)
    return spatial.at_places(points, spatial.first_near(points, nodes, 20_000.0, "node", k=3)).select("k", "node", C("n").cast("long").alias("n"), F.round("m", 2).alias("m"))


JN_12 = f"WITH {_NEAR}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY m, node) AS n FROM hit WHERE m <= 20000) SELECT k, node, n, round(m, 2) AS m FROM r WHERE n <= 3"


def jn_13(spark, d):
    points, nodes = _sides(spark, d)
    met = spatial.local_candidates(spatial.near_places(points, nodes, 60_000.0), ["lat", "lon"], 15_000.0)
    return spatial.of_places(met, points, nodes, ["lat", "lon"], ["nlat", "nlon"], "node").select("k", "node")


JN_13 = f"WITH {_NEAR}, r AS (SELECT *, min(m) OVER (PARTITION BY k) AS best FROM hit WHERE m <= 60000) SELECT k, node FROM r WHERE m <= best + 15000"


def jn_15(spark, d):
    nodes = references(spark, d).select(C("r").alias("node"), C("nlat").alias("lat"), C("nlon").alias("lon"))
    return spatial.close_pairs(nodes, 400_000.0).select("u", "v")


JN_15 = f"WITH {REFS} SELECT a.r AS u, b.r AS v FROM refs a JOIN refs b ON a.r < b.r WHERE {s.q_hav('a.nlat', 'a.nlon', 'b.nlat', 'b.nlon')} <= 400000"


def jn_20(spark, d):
    p = read(spark, d, "part")
    country = F.element_at(F.array(F.lit("FR"), F.lit("fr"), F.lit("DE"), F.lit(None)), (C("p_size") % 4 + 1).cast("int"))
    return stations.label_lookup(p.select(C("p_partkey").alias("q"), C("p_name").alias("label"), F.array("p_brand", "p_type").alias("aliases"), country.alias("country")))


JN_20 = f"WITH p AS (SELECT * FROM part WHERE p_size % 4 <> 2), v AS (SELECT p_partkey AS q, {s.q_norm('p_name')} AS label, 0 AS prio FROM p UNION ALL SELECT p_partkey, {s.q_norm('p_brand')}, 1 FROM p UNION ALL SELECT p_partkey, {s.q_norm('p_type')}, 1 FROM p) SELECT label, arg_min(q, (prio, q)) AS q, min(prio) AS prio FROM v WHERE label <> '' GROUP BY label"

INSEE = ["75101", "75115", "69382", "13207", "31555", "69123", "75056", "59350"]


def jn_21(spark, d):
    code = lambda k: F.element_at(F.array(*[F.lit(c) for c in INSEE]), (k % len(INSEE) + 1).cast("int"))
    rows = read(spark, d, "lineitem").select(C("l_suppkey").alias("station"), code(C("l_partkey")).alias("insee"), (C("l_orderkey") * 10 + C("l_linenumber")).alias("pos"), "l_partkey")
    first = rows.groupBy("station", "pos").agg(F.min_by("insee", "l_partkey").alias("insee"))
    cities = spark.createDataFrame([("75056", "Paris"), ("69123", "Lyon"), ("31555", "Toulouse")], "insee string, city string")
    return stations.first_by_commune(first, cities)


JN_21 = f"WITH r AS (SELECT l_suppkey AS station, arg_min({s._list(INSEE)}[1 + l_partkey % 8], (l_orderkey * 10 + l_linenumber, l_partkey)) AS insee FROM lineitem GROUP BY 1) SELECT station, CASE WHEN insee LIKE '751%' OR insee = '75056' THEN 'Paris' WHEN insee LIKE '6938%' OR insee = '69123' THEN 'Lyon' ELSE 'Toulouse' END AS city FROM r WHERE insee NOT LIKE '13%' AND insee <> '59350'"


def jn_22(spark, d):
    nation = read(spark, d, "nation")
    cities = nation.where("n_regionkey < 3").select(C("n_name").alias("name"), F.concat(F.lit("c"), C("n_regionkey").cast("string")).alias("cc"), C("n_nationkey").alias("city"))
    hints = read(spark, d, "supplier").join(nation, C("s_nationkey") == C("n_nationkey")).select(C("s_suppkey").alias("k"), F.concat(F.lit(" "), F.lower("n_name")).alias("hint"), F.concat(F.lit("C"), (C("n_regionkey") + (C("s_suppkey") % 10 == 0).cast("int")).cast("string")).alias("cc"))
    return stations.by_hint(hints, cities)


JN_22 = "SELECT s_suppkey AS k, CASE WHEN n_regionkey < 3 AND s_suppkey % 10 <> 0 THEN n_nationkey END AS city, NOT (n_regionkey < 3 AND s_suppkey % 10 <> 0) AS unmatched FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def jn_23(spark, d):
    """Customers as clicks on a map of a thousand pixels, suppliers as its markers."""
    clicks = read(spark, d, "customer").select(C("c_custkey").alias("k"), (C("c_custkey") * 37 % 1009).cast("double").alias("x"), (C("c_custkey") * 53 % 997).cast("double").alias("y"))
    marks = read(spark, d, "supplier").select(C("s_suppkey").alias("entry"), (C("s_suppkey") * 91 % 1009).cast("double").alias("ex"), (C("s_suppkey") * 17 % 997).cast("double").alias("ey"), (C("s_suppkey") % 30).cast("double").alias("r"))
    return spatial.hit_test(clicks, marks, 48.0).withColumn("m", F.round("m", 6))


JN_23 = "WITH p AS (SELECT c_custkey AS k, s_suppkey AS entry, sqrt(pow(c_custkey * 37 % 1009 - s_suppkey * 91 % 1009, 2) + pow(c_custkey * 53 % 997 - s_suppkey * 17 % 997, 2)) AS m FROM customer, supplier WHERE m <= greatest(8, s_suppkey % 30 + 4)) SELECT k, arg_min(entry, (m, entry)) AS entry, round(min(m), 6) AS m FROM p GROUP BY k"


def ag_5(spark, d):
    rows = halts(spark, d).select(F.concat_ws("|", "country", "segment").alias("cluster"), "name", "lat", "lon", F.floor("balance").cast("long").alias("priority"))
    return stations.city_clusters(rows)


AG_5 = f"WITH {HALTS} SELECT country || '|' || segment AS cluster, count(*) AS stations, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, max(floor(balance))::BIGINT AS priority, count(DISTINCT name) AS aliases FROM halts GROUP BY 1"


def _stemmed(spark, d):
    """Stations with the stem of their name: its first word."""
    return stops(spark, d).select(F.split_part(text.normalize_name(C("name")), F.lit(" "), F.lit(1)).alias("stem"), "k", "name", "lat", "lon", "size")


def ag_7(spark, d):
    return stations.leader_clusters(_stemmed(spark, d).select("stem", "k", "lat", "lon"))


def ag_6(spark, d):
    """Clusters of a timetable without references: stems, leaders, then the cluster's figures."""
    rows = _stemmed(spark, d)
    keyed = rows.join(stations.leader_clusters(rows.select("stem", "k", "lat", "lon")), ["stem", "k"])
    return stations.city_clusters(keyed.select(F.concat_ws("-", F.lit("gtfs-basic"), F.lit("zz"), "stem", "cluster").alias("cluster"), "name", "lat", "lon", C("size").alias("priority")))


_WALK = f"""WITH RECURSIVE {STOPS}, o AS (SELECT string_split({s.q_norm('name')}, ' ')[1] AS stem, k, name, size, lat, lon FROM stops), n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY lat, lon, k) AS i FROM o),
w(i, k, stem, ys, xs, cluster) AS (SELECT i, k, stem, [lat], [lon], 0::BIGINT FROM n WHERE i = 1
 UNION ALL SELECT n.i, n.k, n.stem, CASE WHEN hit IS NULL THEN list_append(ys, lat) ELSE ys END, CASE WHEN hit IS NULL THEN list_append(xs, lon) ELSE xs END, coalesce(hit, len(ys))::BIGINT
 FROM (SELECT n.*, w.ys, w.xs, list_min(list_filter(generate_series(0, len(ys) - 1), lambda c: {s.q_hav('ys[c + 1]', 'xs[c + 1]', 'n.lat', 'n.lon')} <= 30000)) AS hit FROM w JOIN n ON n.stem = w.stem AND n.i = w.i + 1) n)"""
AG_7 = f"{_WALK} SELECT stem, k, cluster FROM w"
AG_6 = f"{_WALK} SELECT 'gtfs-basic-zz-' || stem || '-' || cluster AS cluster, count(*) AS stations, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, max(size) AS priority, count(DISTINCT name) AS aliases FROM w JOIN n USING (stem, k) GROUP BY 1"


def _voters(spark, d):
    return s.names(spark, d).select(F.floor(C("k") / 5).cast("long").alias("city"), "name", "k")


_VOTERS = f"(SELECT k // 5 AS city, name, k FROM {s.NAMES_SQL})"


def q_votes(voters: str) -> str:
    """The display-name vote in SQL: all names' common prefix, the majority's prefix, the majority's name."""
    clean = s.q_title(s.q_clean("x"))
    final = lambda x: f"(CASE WHEN {s.q_clean(x)} = '' THEN 'Unknown' ELSE {clean.replace('(x)', f'({x})')} END)"
    tokens = "CASE WHEN c = 'Unknown' THEN 1 ELSE len(string_split(norm, ' ')) END"
    return f"""r AS (SELECT city, name, {s.q_norm('name')} AS norm FROM {voters}), t AS (SELECT city, name, CASE WHEN norm = '' THEN [] ELSE string_split(norm, ' ') END AS w FROM r),
sz AS (SELECT city, count(*) AS n, min(len(w)) AS least, any_value(name) AS sole FROM t GROUP BY city),
p AS (SELECT city, j, len(w) AS long, array_to_string(w[1:j], ' ') AS prefix FROM (SELECT *, unnest(generate_series(1, len(w))) AS j FROM t)),
cm AS (SELECT city, arg_max(prefix, j) AS common FROM (SELECT city, prefix, j, count(*) AS v FROM p GROUP BY ALL) JOIN sz USING (city) WHERE v = n AND j <= least GROUP BY city),
mj AS (SELECT city, arg_min(prefix, (-v, -j, strlen(prefix), prefix)) AS major FROM (SELECT city, prefix, j, count(*) AS v FROM p WHERE j < long GROUP BY ALL) WHERE v >= 2 AND {s.q_usable('prefix')} GROUP BY city),
cl AS (SELECT city, c, count(*) AS v FROM (SELECT city, {final('name')} AS c FROM t) GROUP BY ALL), cq AS (SELECT *, {s.q_norm('c')} AS norm FROM cl),
mo AS (SELECT city, arg_min(c, (-v, -({s.q_usable('norm')})::INT, -({tokens}), -strlen(norm), strlen(c), c)) AS most FROM cq WHERE norm <> '' GROUP BY city),
vote AS (SELECT city, CASE WHEN n = 1 THEN {final('sole')} ELSE coalesce(CASE WHEN {s.q_usable('common')} THEN {final('common')} END, CASE WHEN major IS NOT NULL THEN {final('major')} END, most, 'Unknown') END AS display_name FROM sz LEFT JOIN cm USING (city) LEFT JOIN mj USING (city) LEFT JOIN mo USING (city))"""


def ag_8(spark, d):
    return stations.display_names(_voters(spark, d).select("city", "name"))


def ag_9(spark, d):
    return stations.name_priorities(read(spark, d, "part").select(C("p_name").alias("name"), (C("p_size") % 5).alias("priority")))


def ag_10(spark, d):
    """Clusters of a country with their parents put in their place first, and then counted."""
    rows = halts(spark, d).select(C("country").alias("cluster"), "name", "lat", "lon", F.lit(1).alias("priority"))
    parents = read(spark, d, "nation").where("n_regionkey <> n_nationkey and n_nationkey % 3 = 0").select(C("n_nationkey").alias("cluster"), C("n_regionkey").alias("parent"))
    return stations.city_clusters(stations.remap_clusters(rows, parents)).drop("priority")


AG_10 = f"WITH {HALTS} SELECT coalesce(n_regionkey, country) AS cluster, count(*) AS stations, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(DISTINCT name) AS aliases FROM halts LEFT JOIN nation ON country = n_nationkey AND n_regionkey <> n_nationkey AND n_nationkey % 3 = 0 GROUP BY 1"


def ag_11(spark, d):
    return stations.complexes(halts(spark, d).select(F.when(C("balance") > 0, C("country")).alias("complex"), "k", "lat", "lon"))


AG_11 = f"WITH {HALTS} SELECT country AS complex, min(k) AS first_station, count(*) AS members, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM halts WHERE balance > 0 GROUP BY country"


def _holders(spark, d):
    k = C("s_suppkey")
    return read(spark, d, "supplier").select(k.alias("k"), F.when(k % 5 > 0, F.concat(F.lit("Q"), (k % 37).cast("string"))).alias("qid"), F.when(k % 7 > 0, C("s_nationkey") % 3).alias("complex"))


_HOLDERS = "h AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 > 0 THEN 'Q' || (s_suppkey % 37) END AS qid, CASE WHEN s_suppkey % 7 > 0 THEN s_nationkey % 3 END AS complex FROM supplier)"


def ag_12(spark, d):
    return stations.qid_holders(_holders(spark, d)).select("k", "qid", "holders")


def ag_13(spark, d):
    return stations.qid_holders(_holders(spark, d)).where("holders > 1").select("qid", "same_complex").distinct()


def ag_14(spark, d):
    rows = s.names(spark, d).join(read(spark, d, "part"), C("k") == C("p_partkey"))
    return stations.merge_cities(rows.select(C("k").alias("pos"), "name", F.element_at(F.array(F.lit("FR"), F.lit("de ")), (C("p_size") % 2 + 1).cast("int")).alias("cc"), F.when(C("p_size") > 5, C("p_size").cast("long") * 1000).alias("pop")))


AG_14 = f"WITH c AS (SELECT k AS pos, name, {s.q_stem('name')} || '|' || CASE p_size % 2 WHEN 0 THEN 'fr' ELSE 'de' END AS key, CASE WHEN p_size > 5 THEN p_size::BIGINT * 1000 END AS pop FROM {s.NAMES_SQL} JOIN part ON k = p_partkey) SELECT key, arg_max(pos, (coalesce(pop, 0), pos)) AS city, max(pop) AS pop, arg_max(name, (NOT {s.q_qualified('name')}, strlen(name), pos)) AS canonical, count(*) AS variants FROM c GROUP BY key"


def _bounded(spark, d):
    n = read(spark, d, "nation").select(C("n_nationkey").alias("city"), (40.0 + C("n_nationkey") / 10.0).alias("lat"), F.lit(2.0).alias("lon"))
    return n, halts(spark, d).select(C("country").alias("city"), "lat", "lon", "k")


def ag_15(spark, d):
    return stations.city_bounds(*_bounded(spark, d))


_BOUNDS = "round(least(min(lat), 40.0::DOUBLE + n_nationkey / 10.0::DOUBLE), 6) AS south, round(greatest(max(lat), 40.0::DOUBLE + n_nationkey / 10.0::DOUBLE), 6) AS north, round(least(min(lon), 2.0::DOUBLE), 6) AS west, round(greatest(max(lon), 2.0::DOUBLE), 6) AS east"
AG_15 = f"WITH {HALTS} SELECT n_nationkey AS city, {_BOUNDS} FROM nation JOIN halts ON country = n_nationkey GROUP BY n_nationkey"


def var_6(spark, d):
    """Cities without a member station keep no box."""
    cities, members = _bounded(spark, d)
    return stations.city_bounds(cities, members.where("k % 90 < 20"))


VAR_6 = f"WITH {HALTS}, b AS (SELECT n_nationkey AS city, {_BOUNDS} FROM nation JOIN halts ON country = n_nationkey WHERE k % 90 < 20 GROUP BY n_nationkey) SELECT n_nationkey AS city, south, north, west, east FROM nation LEFT JOIN b ON city = n_nationkey"


def wn_4(spark, d):
    return stations.primary_memberships(read(spark, d, "lineitem").select(C("l_suppkey").alias("city"), C("l_partkey").alias("station")).distinct())


def wn_11(spark, d):
    return stations.distinct_aliases(read(spark, d, "part").select(C("p_name").alias("alias"), C("p_size").alias("city"), C("p_partkey").alias("pos")))


def fn_s21(spark, d):
    return stations.canonical_names(s.names(spark, d).select((C("k") % 90).alias("city"), "name", C("k").alias("pos")))


FN_S21 = f"SELECT k % 90 AS city, arg_max(name, (NOT {s.q_qualified('name')}, strlen(name), k)) AS name FROM {s.NAMES_SQL} GROUP BY 1"


def _ranked_names(spark, d):
    return _voters(spark, d).select("city", "name", (C("k") % 7 % 3).alias("priority"), C("k").alias("pos"))


_QUALITY = f"(-({s.q_usable(s.q_norm('name'))})::INT, -(CASE WHEN {s.q_norm('name')} = '' THEN 0 ELSE len(string_split({s.q_norm('name')}, ' ')) END), -strlen({s.q_norm('name')}), k)"
_PREFERRED = f"pf AS (SELECT city, arg_min(name, (-(k % 7 % 3), {_QUALITY})) AS name FROM {_VOTERS} WHERE k % 7 % 3 > 0 GROUP BY city)"


def var_2(spark, d):
    return stations.preferred_names(_ranked_names(spark, d))


def var_3(spark, d):
    """Priorities are taken away from two cities in three, so all ways of choosing are used."""
    names = _ranked_names(spark, d).withColumn("priority", F.when(C("city") % 3 == 0, C("priority")).otherwise(0))
    return stations.cluster_names(names)


VAR_3 = f"WITH {_PREFERRED}, {q_votes(_VOTERS)} SELECT city, coalesce(CASE WHEN city % 3 = 0 THEN name END, display_name) AS name FROM vote LEFT JOIN pf USING (city)"


def var_24(spark, d):
    nodes = references(spark, d).select(C("r").alias("node"), C("nlat").alias("lat"), C("nlon").alias("lon"))
    return spatial.cell_index(nodes, 2.5).withColumn("nodes", F.array_join(F.transform("nodes", lambda x: x.cast("string")), ","))


VAR_24 = f"WITH {REFS} SELECT floor(nlat / 2.5)::BIGINT AS cy, floor(nlon / 2.5)::BIGINT AS cx, string_agg(r::VARCHAR, ',' ORDER BY r) AS nodes FROM refs GROUP BY 1, 2"


def fn_m26(spark, d):
    lat, lon = at(C("s_suppkey"), 37, 53, **FINE)
    blat, blon = at(C("s_suppkey"), 91, 17, **FINE)
    ends = read(spark, d, "supplier").select(C("s_suppkey").alias("segment"), lat.alias("lat"), lon.alias("lon"), blat.alias("blat"), blon.alias("blon"))
    return spatial.segment_cells(ends, 0.1).select("segment", "cy", "cx")


FN_M26 = f"WITH g AS (SELECT s_suppkey AS segment, {q_at('s_suppkey', 37, 53, **FINE)}, {q_at('s_suppkey', 91, 17, **FINE, names='blat,blon')} FROM supplier), y AS (SELECT *, unnest(generate_series(floor(least(lat, blat) / 0.1::DOUBLE)::BIGINT - 1, floor(greatest(lat, blat) / 0.1::DOUBLE)::BIGINT + 1)) AS cy FROM g) SELECT segment, cy, unnest(generate_series(floor(least(lon, blon) / 0.1::DOUBLE)::BIGINT - 1, floor(greatest(lon, blon) / 0.1::DOUBLE)::BIGINT + 1)) AS cx FROM y"


def val_12(spark, d):
    own = C("k") % 3 == 0
    rows = halts(spark, d).select("k", "lat", "lon", F.when(own, C("lat") + 0.001).alias("alat"), F.when(own, C("lon") - 0.002).alias("alon"))
    return stations.rail_anchors(rows)


VAL_12 = f"WITH {HALTS} SELECT k, round({s.q_hav('lat', 'lon', '(lat + 0.001::DOUBLE)', '(lon - 0.002::DOUBLE)')})::BIGINT AS metres FROM halts WHERE k % 3 = 0"

QUERIES = {n: globals()[n] for n in ("jn_1", "jn_2", "jn_3", "jn_4", "jn_8", "jn_9", "jn_10", "jn_11", "jn_12", "jn_13", "jn_15", "jn_20", "jn_21", "jn_22", "jn_23", "ag_5", "ag_6", "ag_7", "ag_8", "ag_9", "ag_10", "ag_11", "ag_12", "ag_13", "ag_14", "ag_15", "wn_4", "wn_11", "fn_s21", "var_2", "var_3", "var_6", "var_24", "fn_m26", "val_12")}
ORACLE_SQL = {
    "jn_1": JN_1, "jn_2": JN_2, "jn_4": JN_4, "jn_8": JN_8, "jn_9": JN_9, "jn_10": JN_10, "jn_11": JN_11, "jn_12": JN_12, "jn_13": JN_13, "jn_15": JN_15, "jn_20": JN_20, "jn_21": JN_21, "jn_22": JN_22, "jn_23": JN_23,
    "ag_5": AG_5, "ag_6": AG_6, "ag_7": AG_7, "ag_10": AG_10, "ag_11": AG_11, "ag_14": AG_14, "ag_15": AG_15, "fn_s21": FN_S21, "var_3": VAR_3, "var_6": VAR_6, "var_24": VAR_24, "fn_m26": FN_M26, "val_12": VAL_12,
    "jn_3": "SELECT l_partkey AS raw_id, min(l_suppkey) AS target, count(DISTINCT l_suppkey) AS targets FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1",
    "ag_8": f"WITH {q_votes(_VOTERS)} SELECT city, display_name FROM vote",
    "ag_9": "SELECT p_name AS name, max(p_size % 5) AS priority FROM part GROUP BY p_name",
    "ag_12": f"WITH {_HOLDERS} SELECT k, qid, count(*) OVER (PARTITION BY qid) AS holders FROM h WHERE qid IS NOT NULL",
    "ag_13": f"WITH {_HOLDERS} SELECT qid, coalesce(min(complex) = max(complex), false) AND count(complex) = count(*) AS same_complex FROM h WHERE qid IS NOT NULL GROUP BY qid HAVING count(*) > 1",
    "wn_4": "SELECT l_suppkey AS city, l_partkey AS station, l_partkey = min(l_partkey) OVER (PARTITION BY l_suppkey) AS is_primary FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)",
    "wn_11": "SELECT p_name AS alias, p_size AS city, min(p_partkey) AS pos FROM part GROUP BY 1, 2",
    "var_2": f"WITH {_PREFERRED} SELECT city, name FROM pf",
}
