"""Files made of the test tables and read back: archives, GeoPackages, GeoJSON, station lists, registry folders, cursors."""

from __future__ import annotations

from pyspark.sql import functions as F

from viaduct.plans.feed import read
from viaduct.plans.shapes import lines
from viaduct.sources import feeds, runtime
from viaduct.sources.lines import shared_folder
from viaduct.streaming import cursors

C = F.col


def src_9(spark, d):
    """Parts as stops in nested members of archives, read in ranges."""
    folder = shared_folder(spark)
    rows = read(spark, d, "part").select(C("p_partkey").alias("stop_id"), C("p_name").alias(" stop_name "), C("p_size").alias("size"))
    feeds.write_archives(rows.repartition(3), folder, "feed/latest/stops.txt")
    return feeds.read_member(spark, folder, "stops.txt", ["stop_id", "stop_name", "size", "zone"], split=20_000).drop("archive", "pos")


SRC_9 = "SELECT p_partkey::VARCHAR AS stop_id, p_name AS stop_name, p_size::VARCHAR AS size, NULL::VARCHAR AS zone FROM part"


def _references(spark, d):
    k = C("p_partkey")
    digits = lambda c, n: F.lpad(c.cast("string"), n, "0")
    place = F.concat_ws(", ", (36.0 + k * 37 % 250 / 10.0).cast("string"), (-9.0 + k * 53 % 340 / 10.0).cast("string"))
    rows = read(spark, d, "part").select(
        C("p_name").alias("NOM"), F.when(k % 11 > 0, place).otherwise("nowhere").alias("Position_Geographique"), (75100 + k % 30).cast("string").alias("CodeINSEE"),
        F.concat_ws(";", F.concat(F.lit("00"), digits(k, 8)), F.lit("12"), digits(87_000_000 + k, 8)).alias("codes_uic"), k.cast("string").alias("id"),
    )
    folder = shared_folder(spark)
    rows.write.option("header", True).csv(folder)
    return folder


def src_10(spark, d):
    """Parts as a list of reference stations with codes of seven digits and more."""
    return feeds.station_list(spark, _references(spark, d)).select("id", "name", "insee", "lat", "lon", F.array_join("codes", ";").alias("codes"))


def src_11(spark, d):
    """The registry's reading: every code in order, districts as their commune."""
    found = feeds.station_list(spark, _references(spark, d), least=1, normalise=True)
    return found.select("id", "name", "insee", "lat", "lon", F.array_join("codes", ";").alias("codes"))


_REF = "SELECT p_partkey::VARCHAR AS id, p_name AS name, {insee} AS insee, 36.0::DOUBLE + p_partkey * 37 % 250 / 10.0::DOUBLE AS lat, -9.0::DOUBLE + p_partkey * 53 % 340 / 10.0::DOUBLE AS lon, {codes} AS codes FROM part WHERE p_partkey % 11 > 0"
_LONG = "('00' || lpad(p_partkey::VARCHAR, 8, '0'))", "(87000000 + p_partkey)::VARCHAR"
SRC_10 = _REF.format(insee="(75100 + p_partkey % 30)::VARCHAR", codes=f"{_LONG[0]} || ';' || {_LONG[1]}")
SRC_11 = _REF.format(insee="CASE WHEN p_partkey % 30 BETWEEN 1 AND 20 THEN '75056' ELSE (75100 + p_partkey % 30)::VARCHAR END", codes=f"{_LONG[0]} || ';12;' || {_LONG[1]}")


def _shown(points):
    return points.groupBy("i").agg(F.count("*").alias("points"), F.round(F.sum("lat"), 5).alias("lat"), F.round(F.sum("lon"), 5).alias("lon"))


def src_12(spark, d):
    """Vectors as features of one GeoJSON document; those out of use are left out."""
    point = F.transform("p", lambda q: F.array(q["x"], q["y"]))
    shape = F.struct(F.lit("LineString").alias("type"), point.alias("coordinates"))
    kind = F.struct(F.when(C("vec_id") % 3 == 0, "FERME").when(C("vec_id") % 3 == 1, " exploite").alias("mnemo"))
    folder = shared_folder(spark)
    feeds.write_document(lines(spark, d).select(C("vec_id").alias("id"), kind.alias("properties"), shape.alias("geometry")), folder, '{"features": [', "]}")
    return _shown(feeds.geojson_lines(spark, folder))


def src_13(spark, d):
    """Vectors as railways and tramways of GeoPackages, read in ranges of rows."""
    folder = shared_folder(spark)
    way = F.transform("p", lambda q: F.struct(q["y"].alias("lat"), q["x"].alias("lon")))
    kind = F.when(C("vec_id") % 3 == 0, "tram").when(C("vec_id") % 3 == 1, "rail").otherwise("narrow_gauge")
    feeds.write_geopackages(lines(spark, d).select(way.alias("p"), kind.alias("fclass")).repartition(3), folder)
    return _shown(feeds.geopackage_lines(spark, folder, split=100))


_USED = "SELECT i, count(*) AS points, round(sum(y), 5) AS lat, round(sum(x), 5) AS lon FROM (SELECT vec_id, unnest(generate_series(0, 31)) AS i, unnest([embedding[2 * j + 1]::DOUBLE FOR j IN generate_series(0, 31)]) AS x, unnest([embedding[2 * j + 2]::DOUBLE FOR j IN generate_series(0, 31)]) AS y FROM embeddings WHERE vec_id % 3 > 0) GROUP BY i"


def snk_3(spark, d):
    """Suppliers in the registry's three folders, read back from them."""
    folders = feeds.registry_folders(shared_folder(spark))
    rows = read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    rows.write.json(folders["observations"])
    rows.groupBy("s_nationkey").agg(F.count("*").alias("n")).write.json(folders["canonical"])
    rows.where("s_nationkey < 5").write.json(folders["audit"])
    count = lambda name: spark.read.json(folders[name]).agg(F.lit(name).alias("folder"), F.count("*").alias("records"))
    return count("observations").union(count("canonical")).union(count("audit"))


SNK_3 = "SELECT 'observations' AS folder, count(*) AS records FROM supplier UNION ALL SELECT 'canonical', count(DISTINCT s_nationkey) FROM supplier UNION ALL SELECT 'audit', count(*) FROM supplier WHERE s_nationkey < 5"


def snk_6(spark, d):
    """Events refreshed in three steps, one of which ends before its commit; the cursors and the rows that count."""
    root = shared_folder(spark)
    rows = read(spark, d, "events").select(C("event_type").alias("source_id"), C("event_id").cast("long").alias("sequence"))
    top = rows.agg(F.max("sequence")).first()[0]
    cursors.refresh(rows.where(C("sequence") <= top // 3), root, "2026-01-01T00:00:00Z")
    cursors.stage(rows.where(C("sequence") <= top // 2), root)
    cursors.refresh(rows.where(C("sequence") <= 2 * (top // 3)), root, "2026-01-02T00:00:00Z")
    found = cursors.refresh(rows, root, "2026-01-03T00:00:00Z")
    held = cursors.committed_rows(spark, root, rows.schema).groupBy("source_id").agg(F.count("*").alias("records"), F.count_distinct("sequence").alias("distinct_records"))
    return found.join(held, "source_id").select("source_id", "mode", C("state.replication_sequence").alias("upto"), "records", "distinct_records")


SNK_6 = "SELECT event_type AS source_id, 'incremental' AS mode, max(event_id) AS upto, count(*) AS records, count(DISTINCT event_id) AS distinct_records FROM events GROUP BY 1"

def src_29(spark, d):
    """Orders as patterns over their parts, chunked by priority and loaded back."""
    stops = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(C("l_partkey").cast("string"))).alias("stops"), F.count("*").alias("tripCount"))
    rows = read(spark, d, "orders").join(stops, C("o_orderkey") == C("l_orderkey")).select(C("o_orderkey").cast("string").alias("id"), C("o_orderpriority").alias("mode"), "stops", "tripCount", C("o_orderpriority").alias("part"))
    path = shared_folder(spark)
    runtime.write_payloads(rows, "service_patterns", path, "part", 500)
    return runtime.load_payloads(spark, "service_patterns", path).select("chunk", "id", "mode", F.array_join("stops", ">").alias("stops"), "tripCount")


SRC_29 = "SELECT o_orderpriority AS chunk, o_orderkey::VARCHAR AS id, o_orderpriority AS mode, string_agg(DISTINCT l_partkey::VARCHAR, '>' ORDER BY l_partkey::VARCHAR) AS stops, count(*) AS tripCount FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority"


def src_30(spark, d):
    """Suppliers as places, chunked by nation; the chunks of one region are loaded."""
    k = C("s_suppkey")
    rows = read(spark, d, "supplier").select(k.cast("string").alias("id"), C("s_name").alias("name"), (36.0 + k * 37 % 250 / 10.0).alias("lat"), (-9.0 + k * 53 % 340 / 10.0).alias("lon"), (k % 17).cast("long").alias("patterns"), C("s_nationkey").cast("string").alias("part"))
    path = shared_folder(spark)
    runtime.write_payloads(rows, "service_places", path, "part")
    wanted = read(spark, d, "nation").where("n_regionkey = 3").select(C("n_nationkey").cast("string").alias("chunk"))
    return runtime.load_payloads(spark, "service_places", path, wanted)


SRC_30 = "SELECT s_nationkey::VARCHAR AS chunk, s_suppkey::VARCHAR AS id, s_name AS name, 36.0::DOUBLE + s_suppkey * 37 % 250 / 10.0::DOUBLE AS lat, -9.0::DOUBLE + s_suppkey * 53 % 340 / 10.0::DOUBLE AS lon, (s_suppkey % 17)::BIGINT AS patterns FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 3"

QUERIES = {"src_29": src_29, "src_30": src_30, "src_9": src_9, "src_10": src_10, "src_11": src_11, "src_12": src_12, "src_13": src_13, "snk_3": snk_3, "snk_6": snk_6}
ORACLE_SQL = {"src_29": SRC_29, "src_30": SRC_30, "src_9": SRC_9, "src_10": SRC_10, "src_11": SRC_11, "src_12": _USED, "src_13": _USED, "snk_3": SNK_3, "snk_6": SNK_6}
