"""City graphs: shortest paths, reachability, suggestions and components.

Searches step through buckets of rank (delta-stepping). Edges are put down once, dealt by their source, and what is found
is put down round by round, dealt by its node. A round relaxes what the round before improved in the current bucket
and reads no more than the parts that its nodes and their neighbours fall into; what ranks beyond the bucket waits in
the folders of its rounds. Ranks are costs, or costs and a bound of what remains for searches with a goal. Paths are rebuilt
afterwards over the edges of least ways alone, by the same search; equal costs give the lexicographically least path.
Components contract stars. No link or node passes through the driver: it sees counts, least ranks and the numbers of parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from viaduct.operators.tables import Rounds, cut, join_counted
from viaduct.sources.lines import shared_folder

PER_PART, MOST_PARTS, SEGMENTS, WIDE = 2_000_000, 256, 16, 16


def least_parallel(edges: DataFrame) -> DataFrame:
    """The least weight of each (src, dst)."""
    return edges.groupBy("src", "dst").agg(F.min("w").alias("w"))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge but self-loops, least weights."""
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return least_parallel(both.where("src <> dst"))


def invalid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Keys ``src-dst`` of self-loops and of edges with an unknown end."""
    known = lambda c: nodes.select(F.col("id").alias(c))
    good = edges.where("src <> dst").join(known("src"), "src", "left_semi").join(known("dst"), "dst", "left_semi")
    bad = edges.join(good.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    return bad.select(F.concat_ws("-", "src", "dst").alias("edge_key")).distinct()


class Parts:
    """Rows put down in folders by the hash of a column; only named parts are read back."""

    def __init__(self, root: str, number: int):
        self.root, self.number, self.held, self.schema = root, number, {}, None

    def of(self, column: str):
        return F.pmod(F.xxhash64(column), F.lit(self.number)).cast("int")

    def put(self, name: int, rows: DataFrame, by: str) -> tuple[int, float, float]:
        """Puts rows down as a segment; their number and the least and largest rank."""
        self.schema = rows.schema
        rows.withColumn("part", self.of(by)).write.partitionBy("part").parquet(f"{self.root}/{name}")
        back = rows.sparkSession.read.schema(StructType([*rows.schema.fields, StructField("part", IntegerType())])).parquet(f"{self.root}/{name}")
        rank = F.col("rank") if "rank" in back.columns else F.lit(0)
        n, low, high, parts = back.agg(F.count("*"), F.min(rank), F.max(rank), F.collect_set("part")).first()
        self.held[name] = set(parts)
        return n, low, high

    def read(self, spark, parts=None, names=None) -> DataFrame:
        paths = [f"{self.root}/{k}/part={p}" for k, have in self.held.items() if names is None or k in names for p in sorted(have) if parts is None or p in parts]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)


def search(edges: DataFrame, begun: DataFrame, offer, delta: float, keep=None) -> DataFrame:
    """The least ``value`` of each ``(source, node)`` that ``begun(source, node, value, rank)`` leads to.

    ``offer(rows, edges)`` gives what rows offer over edges, whose ends are ``src`` and ``dst``; a rank must not fall
    along a way. ``keep(offers, found)`` may drop offers, ``found`` being all values so far.
    """
    spark = edges.sparkSession
    root, number = shared_folder(spark), max(1, min(MOST_PARTS, edges.count() // PER_PART))
    graph, found = Parts(f"{root}/edges", number), Parts(f"{root}/found", number)
    graph.put(0, edges, "src")
    places = Rounds(spark)
    best = lambda rows: rows.groupBy("source", "node").agg(F.min(F.struct("value", "rank")).alias("b")).select("source", "node", "b.value", "b.rank")
    beaten = lambda rows, known, or_equal: rows.alias("x").join(known.select("source", "node", F.col("value").alias("old")).alias("k"), (F.col("x.source") == F.col("k.source")) & (F.col("x.node") == F.col("k.node")) & ((F.col("old") <= F.col("x.value")) if or_equal else (F.col("old") < F.col("x.value"))), "left_anti")

    def parts_of(rows):
        return None if number == 1 else {r.part for r in rows.select(found.of("node").alias("part")).distinct().collect()}

    k, end = 0, None
    waiting = {0: found.put(0, best(begun), "node")}
    while True:
        waiting = {i: s for i, s in waiting.items() if s[0] and (end is None or s[2] >= end)}
        if not waiting:
            return found.read(spark).groupBy("source", "node").agg(F.min("value").alias("value"))
        if len(found.held) > SEGMENTS:  # segments become one, their stale rows go
            old = [*found.held]
            k += 1
            waiting = {k: found.put(k, best(found.read(spark)), "node")}
            for i in old:
                del found.held[i]
            if not waiting[k][0] or waiting[k][2] < end:
                continue
        open_rows = found.read(spark, names=set(waiting))
        if end is not None:
            open_rows = open_rows.where(F.col("rank") >= end)
        low = open_rows.agg(F.min("rank")).first()[0]
        if low is None:
            waiting = {}
            continue
        end = (low // delta + 1) * delta
        ready = open_rows.where(F.col("rank") < end)
        ready = ready if keep is None else keep(ready, found.read(spark))
        ready = places.cut(beaten(ready, found.read(spark, parts_of(ready)), False)) if k else ready
        while True:
            offers = best(offer(ready, graph.read(spark, parts_of(ready))))
            offers = keep(offers, found.read(spark)) if keep is not None else offers
            if number > 1:
                offers = cut(offers)
            k += 1
            waiting[k] = found.put(k, beaten(offers, found.read(spark, parts_of(offers)), True), "node")
            n, low, _ = waiting[k]
            if not n or low >= end:
                break
            ready = found.read(spark, names={k}).where(F.col("rank") < end)


def distances(edges: DataFrame, sources: DataFrame, limit: int | None = None, paths: bool = True, delta: int | None = None) -> DataFrame:
    """``(source, node, cost)``, and ``path`` unless told otherwise, of all nodes reachable from each of ``sources(id)`` over directed
    least-weight edges, within ``limit`` if given; a source reaches itself at no cost. ``delta`` is the width of a bucket,
    by default ``WIDE`` mean weights: narrower ones relax fewer edges twice, wider ones take fewer rounds."""
    begun = sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).cast("long").alias("value"), F.lit(0.0).alias("rank"))

    def offer(rows, edges):
        step = rows.join(edges, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), (F.col("value") + F.col("w")).alias("value"))
        step = step if limit is None else step.where(F.col("value") <= limit)
        return step.withColumn("rank", F.col("value").cast("double"))

    width = delta or WIDE * (edges.agg(F.avg("w")).first()[0] or 1)
    found = cut(search(edges.select("src", "dst", "w"), begun, offer, width).withColumnRenamed("value", "cost"))
    return with_paths(found, edges) if paths else found


def with_paths(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``found(source, node, cost)`` with the lexicographically least ``path`` of that cost from the source's own node."""
    return paths_from(found, found.where("source = node").select("source", "node"), edges)


def paths_from(found: DataFrame, starts: DataFrame, edges: DataFrame) -> DataFrame:
    """``found(source, node, cost)`` with the ``path`` from ``starts(source, node)``. Nodes are taken in order of their cost,
    so those before one on its ways are done when its turn comes."""
    begin, end = found.select("source", F.col("node").alias("src"), F.col("cost").alias("c0")), found.select("source", F.col("node").alias("dst"), F.col("cost").alias("c1"))
    tight = cut(begin.join(edges, "src").join(end, ["source", "dst"]).where("c0 + w = c1 and src <> dst").select(F.col("source").alias("of"), "src", "dst", "w", F.col("c1").cast("double").alias("c1")))
    begun = starts.select("source", "node", F.array("node").alias("value"), F.lit(0.0).alias("rank"))

    def offer(rows, edges):
        step = rows.join(edges, (F.col("source") == F.col("of")) & (F.col("node") == F.col("src")))
        return step.select("source", F.col("dst").alias("node"), F.concat("value", F.array("dst")).alias("value"), F.col("c1").alias("rank"))

    width = WIDE * (tight.agg(F.avg("w")).first()[0] or 1)
    return found.join(search(tight, begun, offer, width).withColumnRenamed("value", "path"), ["source", "node"])


def goal_routes(edges: DataFrame, places: DataFrame, trips: DataFrame, limit: int, delta: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Routes of trips ``(trip, start, goal)`` of at most ``limit`` as ``(trip, cost, path)``, and the nodes their searches
    settled, ``(source, node, cost)`` with the trip as source.

    A search with a goal (A*): ``places(node, lat, lon)`` give the great-circle distance that remains, and the least weight
    a metre of any edge makes it a bound that no way beats. Nodes rank by cost and bound. Offers that rank beyond the
    limit are dropped, and once a trip's goal is reached those that rank beyond its cost.
    """
    from viaduct.functions.geo import haversine_m

    at = lambda c, p: places.select(F.col("node").alias(c), F.col("lat").alias(f"{p}lat"), F.col("lon").alias(f"{p}lon"))
    metres = lambda p, q: haversine_m(F.col(f"{p}lat"), F.col(f"{p}lon"), F.col(f"{q}lat"), F.col(f"{q}lon"))
    long = edges.join(at("src", "a"), "src").join(at("dst", "b"), "dst").withColumn("m", metres("a", "b"))
    pace, mean = long.where("m > 0").agg(F.min(F.col("w") / F.col("m")), F.avg("w")).first()
    pace = (pace or 0.0) * (1 - 1e-9)  # no more than the sums of rounded terms
    goals = cut(trips.select(F.col("trip").alias("source"), "start", "goal").join(at("goal", "g"), "goal"))

    def ranked(rows):
        return rows.join(at("node", "n"), "node").join(goals.select("source", "glat", "glon"), "source").select("source", "node", "value", (F.col("value") + pace * metres("n", "g")).alias("rank")).where(F.col("rank") <= limit)

    def offer(rows, edges):
        step = rows.join(edges, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node"), (F.col("value") + F.col("w")).alias("value"))
        return ranked(step.where(F.col("value") <= limit))

    def keep(rows, found):
        reached = found.join(goals.select("source", F.col("goal").alias("node")), ["source", "node"]).groupBy("source").agg(F.min("value").alias("most"))
        return rows.join(reached, "source", "left").where("most is null or rank <= most").drop("most")

    begun = ranked(goals.select("source", F.col("start").alias("node"), F.lit(0).cast("long").alias("value")))
    settled = cut(search(edges.select("src", "dst", "w"), begun, offer, delta or WIDE / 4 * (mean or 1), keep).withColumnRenamed("value", "cost"))
    # paths start at a trip's own start: its node stands for the source
    begin = goals.select("source", "start", "goal")
    reached = settled.join(begin.select("source", F.col("goal").alias("node")), ["source", "node"]).select("source", F.col("cost").alias("most"))
    near = settled.join(reached, "source").where("cost <= most").drop("most")
    paths = paths_from(near, begin.select("source", F.col("start").alias("node")), edges)
    routes = paths.join(begin.select("source", F.col("goal").alias("node")), ["source", "node"]).select(F.col("source").alias("trip"), "cost", "path")
    return routes, settled


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, component)``: the least node reachable over edges ``(src, dst)`` taken as undirected."""
    found = star_components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return nodes.select("id").join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def star_components(edges: DataFrame) -> DataFrame:
    """Connected components of ``(u, v)`` longs as ``(node, component)``, component = least node; nodes without
    a link to another have no row.

    Alternates large-star and small-star steps until none changes a pair; every round is a min-aggregate and a
    join. The centre of a large star holds many pairs, so its row is broadcast. The driver sees a count and a checksum
    per round, never links.
    """
    places, lows = Rounds(edges.sparkSession), Rounds(edges.sparkSession)
    pairs = places.cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = lows.cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")))
        large = join_counted(both.where("v > u"), low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # after the large star a node points at smaller ones only, and most at a single one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = places.cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        row = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == before:
            found = pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
            return found.union(found.select(F.col("component").alias("node"), "component").distinct())
        before = tuple(row)


def suggestions(cities: DataFrame, edges: DataFrame, trip: list[int], least_interest: int = 7) -> DataFrame:
    """Stops worth a visit: interior cities of the legs' paths at no detour, then, for legs of more
    than two nodes, cities near a leg's midpoint with a detour of less than three hours. The first
    leg that suggests a city counts; ``cities`` are ``id, lat, lon, interest``.
    """
    from viaduct.functions.geo import haversine_m

    spark = cities.sparkSession
    legs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(trip, trip[1:], strict=False))], "leg int, a long, b long")
    found = distances(edges, spark.createDataFrame([(x,) for x in sorted(set(trip))], "id long"))
    leg = legs.join(found.select(F.col("source").alias("a"), F.col("node").alias("b"), F.col("cost").alias("leg_cost"), "path"), ["a", "b"]).where(F.size("path") > 2)
    liked = cities.where((F.col("interest") >= least_interest) & ~F.col("id").isin(trip))
    inner = leg.select("leg", F.posexplode(F.slice("path", F.lit(2), F.size("path") - 2)).alias("rank", "id")).join(liked.select("id", "interest"), "id")
    inner = inner.select("id", "interest", "leg", F.lit(0).alias("kind"), "rank", F.lit(0).cast("long").alias("detour"))
    ends = leg.join(cities.select(F.col("id").alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")), "a").join(cities.select(F.col("id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "b")
    length = haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) / 1000
    middle = ends.select("leg", "a", "b", "leg_cost", "path", length.alias("length"), ((F.col("lat1") + F.col("lat2")) / 2).alias("mlat"), ((F.col("lon1") + F.col("lon2")) / 2).alias("mlon"))
    # legs are the few of one trip, given by the caller
    near = liked.crossJoin(F.broadcast(middle)).withColumn("off", haversine_m(F.col("lat"), F.col("lon"), F.col("mlat"), F.col("mlon")) / 1000)
    near = near.where((F.col("off") < F.col("length") * 0.4) & (F.col("off") < 120) & ~F.array_contains("path", F.col("id")))
    there = found.select(F.col("source").alias("a"), F.col("node").alias("id"), F.col("cost").alias("to_it"))
    back = found.select(F.col("source").alias("b"), F.col("node").alias("id"), F.col("cost").alias("from_it"))
    near = near.join(there, ["a", "id"]).join(back, ["b", "id"]).withColumn("detour", F.col("to_it") + F.col("from_it") - F.col("leg_cost")).where("detour > 0 and detour < 180")
    near = near.select("id", "interest", "leg", F.lit(1).alias("kind"), F.col("id").cast("int").alias("rank"), "detour")
    first = F.struct("leg", "kind", "rank")
    return inner.union(near).groupBy("id").agg(F.min_by(F.struct("interest", "leg", "detour"), first).alias("s")).select("id", "s.interest", F.col("s.leg").alias("after_stop"), F.col("s.detour").alias("detour"))
