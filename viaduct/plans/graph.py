"""City-graph queries over nations, as linked by orders between their customers and suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viaduct.operators import graphs
from viaduct.operators.ranks import position, sums_before
from viaduct.operators.tables import cut, join_counted
from viaduct.plans.feed import read


def raw_edges(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("src"))
    b = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("dst"))
    line = read(spark, d, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("o_orderkey"))
    rows = line.join(b, "l_suppkey").join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey").join(a, "o_custkey")
    return rows.where((F.col("src") * 7 + F.col("dst") * 13) % 11 < 2).select("src", "dst", (F.col("o_orderkey") % 590 + 10).alias("w"))


RAW = "raw AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, l_orderkey % 590 + 10 AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE (c_nationkey * 7 + s_nationkey * 13) % 11 < 2)"
DIRECTED = f"{RAW}, e AS (SELECT src, dst, min(w) AS w FROM raw GROUP BY 1, 2)"
BOTH = f"{RAW}, e AS (SELECT src, dst, min(w) AS w FROM (SELECT src, dst, w FROM raw UNION ALL SELECT dst, src, w FROM raw) WHERE src <> dst GROUP BY 1, 2)"


def _walk(edges: str, source: str, hops: int = 12) -> str:
    """Distances from one node, then the least tight path; ``hops`` exceeds the longest best path here."""
    return f"WITH RECURSIVE {edges}, r(node, cost, hop) AS (SELECT {source}::BIGINT, 0::BIGINT, 0 UNION SELECT dst, min(cost + w), hop + 1 FROM r JOIN e ON src = node WHERE hop < {hops} GROUP BY dst, hop), dist AS (SELECT node, min(cost) AS cost FROM r GROUP BY node), t(node, path) AS (SELECT {source}::BIGINT, [{source}::BIGINT] UNION ALL SELECT e.dst, list_append(path, e.dst) FROM t JOIN e ON e.src = t.node JOIN dist a ON a.node = e.src JOIN dist b ON b.node = e.dst AND a.cost + e.w = b.cost), best AS (SELECT node, min(path) AS path FROM t GROUP BY node)"


def directed(spark, d):
    return graphs.cut(graphs.least_parallel(raw_edges(spark, d)))


def both_ways(spark, d):
    return graphs.cut(graphs.undirected(raw_edges(spark, d)))


def one(spark, k):
    return spark.createDataFrame([(k,)], "id long")


def _paths(df):
    return df.select("node", "cost", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def gr_1(spark, d):
    return directed(spark, d).groupBy("src").agg(F.count("*").alias("degree"), F.min("w").alias("nearest"))


def gr_2(spark, d):
    return _paths(graphs.distances(directed(spark, d), one(spark, 3)).where("node in (1, 7, 12, 19)"))


def gr_3(spark, d):
    return graphs.distances(directed(spark, d), one(spark, 3), limit=45, paths=False).select("node", "cost")


def gr_4(spark, d):
    nodes = read(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").cast("long").alias("id"))
    return graphs.invalid_edges(nodes, raw_edges(spark, d))


def gr_5(spark, d):
    return _paths(graphs.distances(both_ways(spark, d), one(spark, 0)))


def gr_6(spark, d):
    nodes = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return graphs.distances(both_ways(spark, d), nodes, paths=False).select("source", "node", "cost")


GR_6 = f"WITH RECURSIVE {BOTH}, r(source, node, cost, hop) AS (SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, 0::BIGINT, 0 FROM nation UNION SELECT source, dst, min(cost + w), hop + 1 FROM r JOIN e ON src = node WHERE hop < 12 GROUP BY source, dst, hop) SELECT source, node, min(cost) AS cost FROM r GROUP BY 1, 2"


def cities(spark, d):
    k = F.col("n_nationkey").cast("long")
    return read(spark, d, "nation").select(k.alias("id"), F.col("n_name").alias("name"), (36.0 + (k * 37) % 25 / 10.0).alias("lat"), (-9.0 + (k * 53) % 34 / 10.0).alias("lon"), (k % 7 + 3).cast("int").alias("interest"), (k * 7919 % 500_000).alias("pop"))


CITIES = "cities AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, 36.0::DOUBLE + ((n_nationkey*37)%25)/10.0::DOUBLE AS lat, -9.0::DOUBLE + ((n_nationkey*53)%34)/10.0::DOUBLE AS lon, (n_nationkey % 7 + 3)::INT AS interest, n_nationkey * 7919 % 500000 AS pop FROM nation)"
TRIP = [0, 9, 4]


def gr_7(spark, d):
    return graphs.suggestions(cities(spark, d), both_ways(spark, d), TRIP)


def gr_8(spark, d):
    """Legs of a trip: time and path of each consecutive pair, and the way that remains from its end."""
    trip = spark.createDataFrame([(i, x) for i, x in enumerate(TRIP)], "i int, id long")
    legs = trip.withColumn("a", F.lag("id").over(Window.orderBy("i"))).where("a is not null").select("i", "a", F.col("id").alias("b"))
    found = graphs.distances(both_ways(spark, d), trip.select("id").distinct())
    joined = legs.join(found.select(F.col("source").alias("a"), F.col("node").alias("b"), "cost", "path"), ["a", "b"], "left")
    return joined.select("i", "a", "b", "cost", F.size("path").alias("stops"))


def shared_dates(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Components of the customer graph that links customers sharing an order date and nation."""
    rows = orders.join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    hub = rows.groupBy("o_orderdate", "c_nationkey").agg(F.min("o_custkey").alias("dst"))
    edges = rows.join(hub, ["o_orderdate", "c_nationkey"]).select(F.col("o_custkey").alias("src"), "dst").distinct()
    return graphs.components(customers.select(F.col("c_custkey").alias("id")), graphs.cut(edges))


def gr_13(spark, d):
    return shared_dates(read(spark, d, "orders"), read(spark, d, "customer"))


GR_13 = "WITH RECURSIVE rows AS (SELECT o_custkey, o_orderdate, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey), hub AS (SELECT o_orderdate, c_nationkey, min(o_custkey) AS dst FROM rows GROUP BY 1, 2), e AS (SELECT DISTINCT o_custkey AS src, dst FROM rows JOIN hub USING (o_orderdate, c_nationkey) WHERE o_custkey <> dst), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r(id, node) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT id, dst FROM r JOIN b ON src = node) SELECT id, min(node) AS component FROM r GROUP BY id"


def gr_15(spark, d):
    return graphs.least_parallel(raw_edges(spark, d))


def so_1(spark, d):
    rows = cities(spark, d).select("id", (-F.col("interest")).alias("less"), (-F.col("pop")).alias("fewer"), "name")
    return position(rows, "less", "fewer", "name").select("id", (F.col("position") + 1).cast("int").alias("position"))


def search(cities_: DataFrame, query: str, limit: int) -> DataFrame:
    return cities_.where(F.lower("name").contains(query.lower())).orderBy(F.desc("interest"), F.desc("pop"), "name").limit(limit)


def so_2(spark, d):
    return search(cities(spark, d), "1", 4).select("id", "name", "interest", "pop")


def so_3(spark, d):
    """Whole documents searched for a phrase, fourteen in order of source, length and id."""
    docs = read(spark, d, "documents").where(F.lower("text").contains("license"))
    return docs.orderBy("source", F.desc("n_chars"), "doc_id").limit(14).select("doc_id", "source", "n_chars")


def prj_10(spark, d):
    """CSR rows: node, dense index and offset of its first edge."""
    degrees = cut(directed(spark, d).groupBy("src").agg(F.count("*").alias("degree")))
    laid = sums_before(position(degrees, "src"), "first_edge", "degree", ["src"])
    return laid.select("src", F.col("position").cast("int").alias("node_index"), "first_edge", "degree")


def ag_25(spark, d):
    """Display names made unique: plain, with the country, then with the id."""
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("country"))
    same = cut(rows.groupBy("name").agg(F.count("*").alias("n"), F.count("*").alias("same")))
    first = rows.groupBy("name", "country").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("leads"))
    by_country = F.concat(F.col("name"), F.lit(" ("), F.col("country").cast("string"), F.lit(")"))
    met = join_counted(rows, same, "name").join(first, "id", "left")
    return met.select("id", F.when(F.col("same") == 1, F.col("name")).when(F.col("leads"), by_country).otherwise(F.concat(by_country, F.lit(" ["), F.col("id").cast("string"), F.lit("]"))).alias("shown"))


def ag_26(spark, d):
    e = raw_edges(spark, d)
    return e.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("w").alias("w"))


def prj_1(spark, d):
    """Cities with degree-derived interest and population and their least route."""
    routes = ag_26(spark, d).where("a <> b")
    ends = routes.select(F.col("a").alias("id"), "w").union(routes.select(F.col("b").alias("id"), "w"))
    degree = ends.groupBy("id").agg(F.count("*").alias("degree"), F.min("w").alias("nearest"))
    out = cities(spark, d).select("id", "name").join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    interest = F.when(F.col("degree") >= 14, 9).when(F.col("degree") >= 9, 8).when(F.col("degree") >= 6, 7).when(F.col("degree") >= 4, 6).when(F.col("degree") >= 2, 5).when(F.col("degree") >= 1, 4).otherwise(3)
    return out.select("id", "name", "degree", "nearest", interest.alias("interest"))


def st_4(spark, d):
    """Interior cities of a trip's paths."""
    found = graphs.distances(both_ways(spark, d), one(spark, 0))
    return found.where(F.size("path") > 2).select(F.explode(F.slice("path", F.lit(2), F.size("path") - 2)).alias("city")).distinct()


def st_5(spark, d):
    e = raw_edges(spark, d).where("w < 40")
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()


QUERIES = {"gr_1": gr_1, "gr_2": gr_2, "gr_3": gr_3, "gr_4": gr_4, "gr_5": gr_5, "gr_6": gr_6, "gr_7": gr_7, "gr_8": gr_8, "gr_13": gr_13, "gr_15": gr_15, "so_1": so_1, "so_2": so_2, "so_3": so_3, "prj_10": prj_10, "ag_25": ag_25, "ag_26": ag_26, "prj_1": prj_1, "st_4": st_4, "st_5": st_5}
ORACLE_SQL = {
    "gr_1": f"WITH {DIRECTED} SELECT src, count(*) AS degree, min(w) AS nearest FROM e GROUP BY src",
    "gr_2": _walk(DIRECTED, "3") + " SELECT node, cost, array_to_string(path, '>') AS path FROM best JOIN dist USING (node) WHERE node IN (1, 7, 12, 19)",
    "gr_3": _walk(DIRECTED, "3") + " SELECT node, cost FROM dist WHERE cost <= 45",
    "gr_4": f"WITH {RAW} SELECT DISTINCT src || '-' || dst AS edge_key FROM raw WHERE src = dst OR src >= 20 OR dst >= 20",
    "gr_5": _walk(BOTH, "0") + " SELECT node, cost, array_to_string(path, '>') AS path FROM best JOIN dist USING (node)",
    "gr_6": GR_6,
    "gr_13": GR_13,
    "gr_15": f"WITH {DIRECTED} SELECT * FROM e",
    "so_1": f"WITH {CITIES} SELECT id, row_number() OVER (ORDER BY interest DESC, pop DESC, name)::INT AS position FROM cities",
    "so_2": f"WITH {CITIES} SELECT id, name, interest, pop::BIGINT AS pop FROM cities WHERE contains(lower(name), '1') ORDER BY interest DESC, pop DESC, name LIMIT 4",
    "so_3": "SELECT doc_id, source, n_chars FROM documents WHERE contains(lower(text), 'license') ORDER BY source, n_chars DESC, doc_id LIMIT 14",
    "prj_10": f"WITH {DIRECTED}, g AS (SELECT src, count(*) AS degree FROM e GROUP BY src) SELECT src, (row_number() OVER (ORDER BY src) - 1)::INT AS node_index, (sum(degree) OVER (ORDER BY src) - degree)::BIGINT AS first_edge, degree FROM g",
    "ag_25": "SELECT id, CASE WHEN n = 1 THEN name WHEN r = 1 THEN name || ' (' || country || ')' ELSE name || ' (' || country || ') [' || id || ']' END AS shown FROM (SELECT c_custkey AS id, c_mktsegment AS name, c_nationkey AS country, count(*) OVER (PARTITION BY c_mktsegment) AS n, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS r FROM customer)",
    "ag_26": f"WITH {RAW} SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(w) AS w FROM raw GROUP BY 1, 2",
    "prj_1": f"WITH {BOTH}, g AS (SELECT src, count(*) AS degree, min(w) AS nearest FROM e GROUP BY src), {CITIES} SELECT id, name, coalesce(degree, 0) AS degree, nearest, CASE WHEN degree >= 14 THEN 9 WHEN degree >= 9 THEN 8 WHEN degree >= 6 THEN 7 WHEN degree >= 4 THEN 6 WHEN degree >= 2 THEN 5 WHEN degree >= 1 THEN 4 ELSE 3 END AS interest FROM cities LEFT JOIN g ON id = src",
    "st_4": _walk(BOTH, "0") + " SELECT DISTINCT unnest(path[2:-2]) AS city FROM best WHERE len(path) > 2",
    "st_5": f"WITH {RAW} SELECT src AS id FROM raw WHERE w < 40 UNION SELECT dst FROM raw WHERE w < 40",
}
