"""Rail networks: nodes and edges from lines, stitches, unions, snapping and routes.

A node's id packs its coordinates in hundred-thousandths of a degree, so equal places are one node
without a number given out. Edges ``(src, dst, w)`` hold both directions with whole metres.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.functions.geo import haversine_m, local_metres
from viaduct.operators.graphs import components, distances, least_parallel, with_paths
from viaduct.operators.polylines import densify
from viaduct.operators.spatial import around, at_places, first_near, local_candidates, segment_cells, stitch_pairs
from viaduct.operators.tables import cut

# Tolerances of stitches, cells and snapping.
MERGE_M, ENDS_M, MICRO_M, COMPONENT_M = 120.0, 25.0, 60.0, 150.0
CELL, SNAP_M, END_M = 0.001, 5_000.0, 350.0
CANDIDATES, SLACK_M, MORE_CANDIDATES, MORE_SLACK_M = 8, 300.0, 24, 1_500.0


def node_id(lat: Column, lon: Column) -> Column:
    e5 = lambda v: F.round(v * 100_000).cast("long")
    return e5(lat) * (1 << 26) + e5(lon) + (1 << 25)


def weight(metres: Column) -> Column:
    return F.greatest(F.round(metres), F.lit(1.0)).cast("long")


def both_ways(pairs: DataFrame) -> DataFrame:
    """Directed edges of pairs ``(u, v, w)``, the least weight of each."""
    there = pairs.select(F.col("u").alias("src"), F.col("v").alias("dst"), "w")
    return least_parallel(there.union(pairs.select("v", "u", "w")).where("src <> dst"))


def track_graph(lines: DataFrame, spacing: float = 500.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes ``(node, lat, lon)``, edges and line ends of lines ``(line, i, lat, lon)`` of two or more points."""
    points = cut(densify(lines, spacing).withColumn("node", node_id(F.col("lat"), F.col("lon"))))
    way = Window.partitionBy("line").orderBy("i", "j")
    step = points.withColumn("b", F.lag(F.struct("node", "lat", "lon")).over(way)).where("b is not null and b.node <> node")
    edges = both_ways(step.select(F.col("b.node").alias("u"), F.col("node").alias("v"), weight(haversine_m(F.col("b.lat"), F.col("b.lon"), F.col("lat"), F.col("lon"))).alias("w")))
    place = F.struct("line", "i", "j")
    per_line = points.groupBy("line").agg(F.count("*").alias("n"), F.min_by("node", F.struct("i", "j")).alias("first"), F.max_by("node", F.struct("i", "j")).alias("last")).where("n > 1")
    nodes = points.join(per_line.select("line"), "line", "left_semi").groupBy("node").agg(F.min_by(F.struct("lat", "lon"), place).alias("p")).select("node", "p.lat", "p.lon")
    ends = per_line.select(F.explode(F.array("first", "last")).alias("node")).distinct()
    return nodes, edges, ends


def endpoint_stitches(nodes: DataFrame, ends: DataFrame, metres: float = MERGE_M) -> DataFrame:
    """Pairs of line ends within ``metres`` in neighbouring cells."""
    met = stitch_pairs(nodes.join(ends, "node", "left_semi"), metres, CELL, 1)
    return met.select("u", "v", weight(F.col("m")).alias("w"))


def labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, component`` by the least node of each component."""
    return components(nodes.select(F.col("node").alias("id")), edges).select(F.col("id").alias("node"), "component")


def relabel(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """Components ``known(node, component)`` after pairs ``(u, v)`` are linked: only the components that they
    join are looked at again."""
    of = lambda end: known.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    links = cut(pairs.join(of("u"), "u").join(of("v"), "v").select(F.col("cu").alias("src"), F.col("cv").alias("dst")).where("src <> dst").distinct())
    if links.isEmpty():
        return known
    ids = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    top = components(ids, links).select(F.col("id").alias("component"), F.col("component").alias("top"))
    return cut(known.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component")))


def segment_stitches(nodes: DataFrame, edges: DataFrame, metres: float = ENDS_M, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New nodes and pairs where a node of degree one lies within ``metres`` of a segment of another
    component: the nearest place on it is linked with the node and both its ends."""
    known = (labels(nodes, edges) if known is None else known).join(nodes, "node")
    lone = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).where("n = 1").join(known, "node")
    end = lambda c, p: known.select(F.col("node").alias(c), F.col("lat").alias(f"{p}lat"), F.col("lon").alias(f"{p}lon"), F.col("component").alias(f"{p}component"))
    segments = edges.where("src < dst").join(end("src", "a"), "src").join(end("dst", "b"), "dst")
    held = segment_cells(segments.select("src", "dst", F.col("acomponent").alias("other"), F.col("alat").alias("lat"), F.col("alon").alias("lon"), F.col("blat").alias("blat"), F.col("blon").alias("blon")), CELL)
    held = held.select("src", "dst", "other", F.col("lat").alias("slat"), F.col("lon").alias("slon"), "blat", "blon", "cy", "cx")
    met = around(lone.select("node", "lat", "lon", "component"), CELL, 1).join(held, ["cy", "cx"]).where("component <> other and node <> src and node <> dst").drop("cy", "cx").distinct()
    ax, ay = local_metres(F.col("slat"), F.col("slon"), F.col("lat"), F.col("lon"))
    bx, by = local_metres(F.col("blat"), F.col("blon"), F.col("lat"), F.col("lon"))
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / square))
    near = met.withColumn("square", square).where("square > 0").withColumn("t", t).withColumn("d", F.sqrt(F.pow(ax + t * dx, F.lit(2.0)) + F.pow(ay + t * dy, F.lit(2.0)))).where(F.col("d") <= metres)
    near = near.withColumn("plat", F.col("slat") + (F.col("blat") - F.col("slat")) * F.col("t")).withColumn("plon", F.col("slon") + (F.col("blon") - F.col("slon")) * F.col("t"))
    near = cut(near.withColumn("at", node_id(F.col("plat"), F.col("plon"))))
    made = near.groupBy(F.col("at").alias("node")).agg(F.min(F.struct("plat", "plon")).alias("p")).select("node", F.col("p.plat").alias("lat"), F.col("p.plon").alias("lon")).join(nodes, "node", "left_anti")
    end = lambda *c: F.struct(*[F.col(x).alias(n) for x, n in zip(c, "nyx", strict=True)])
    legs = near.select("at", "plat", "plon", F.explode(F.array(end("node", "lat", "lon"), end("src", "slat", "slon"), end("dst", "blat", "blon"))).alias("e"))
    pairs = legs.where("e.n <> at").select(F.least("e.n", "at").alias("u"), F.greatest("e.n", "at").alias("v"), weight(haversine_m(F.col("e.y"), F.col("e.x"), F.col("plat"), F.col("plon"))).alias("w"))
    return made, pairs.groupBy("u", "v").agg(F.min("w").alias("w"))


def component_stitches(nodes: DataFrame, edges: DataFrame, ends: DataFrame, micro: float = MICRO_M, wide: float = COMPONENT_M, known: DataFrame | None = None) -> DataFrame:
    """Pairs of different components within ``micro`` metres, or ``wide`` if a line end is one of them, in
    neighbouring cells."""
    known = labels(nodes, edges) if known is None else known
    of = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    end = lambda c: ends.select(F.col("node").alias(c), F.lit(True).alias(f"e{c}"))
    met = stitch_pairs(nodes, wide, CELL, 1).join(of("u"), "u").join(of("v"), "v").where("cu <> cv")
    met = met.join(end("u"), "u", "left").join(end("v"), "v", "left").where((F.col("m") <= micro) | F.coalesce("eu", "ev", F.lit(False)))
    return met.select("u", "v", weight(F.col("m")).alias("w"))


def stitched(nodes: DataFrame, edges: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with their component, and edges, after the three stitches, each over what the one before left."""
    add = lambda edges, pairs: cut(least_parallel(edges.union(both_ways(pairs))))
    edges = add(edges, endpoint_stitches(nodes, ends))
    known = cut(labels(nodes, edges))
    made, pairs = segment_stitches(nodes, edges, known=known)
    made, pairs = cut(made), cut(pairs)
    nodes, edges = cut(nodes.union(made)), add(edges, pairs)
    known = relabel(known.union(made.select("node", F.col("node").alias("component"))), pairs)
    pairs = cut(component_stitches(nodes, edges, ends, known=known))
    return cut(nodes.join(relabel(known, pairs), "node")), add(edges, pairs)


def build_network(lines: DataFrame, spacing: float = 500.0) -> tuple[DataFrame, DataFrame]:
    """Nodes with their component and edges of a network of lines."""
    nodes, edges, ends = track_graph(lines, spacing)
    return stitched(cut(nodes), cut(edges), cut(ends))


def merge_networks(*networks: tuple[DataFrame, DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Networks ``(nodes, edges, ends)`` as one: equal places are one node already, the least weight of an
    edge counts, and what lies close is stitched anew."""
    nodes, edges, ends = networks[0]
    for n, e, x in networks[1:]:
        nodes, edges, ends = nodes.unionByName(n), edges.unionByName(e), ends.unionByName(x)
    one = nodes.groupBy("node").agg(F.min(F.struct("lat", "lon")).alias("p")).select("node", "p.lat", "p.lon")
    return stitched(cut(one), cut(least_parallel(edges)), cut(ends.distinct()))


def snaps(points: DataFrame, nodes: DataFrame, k: int = CANDIDATES, slack: float = SLACK_M, metres: float = SNAP_M) -> DataFrame:
    """``k, node, m``: of the ``k`` nearest nodes within ``metres`` of points ``(k, lat, lon)`` those at most
    ``slack`` beyond the nearest; distances in whole metres."""
    other = nodes.select("node", F.col("lat").alias("nlat"), F.col("lon").alias("nlon"))
    met = first_near(points, other, metres, "node", k=k)
    near = local_candidates(met.select("lat", "lon", "node", F.round("m").cast("long").alias("m")), ["lat", "lon"], slack)
    return at_places(points.select("k", "lat", "lon"), near).select("k", "node", "m")


def per_kind(trips: DataFrame, kind: list[str], found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``found`` of one trip of each ``kind``, which columns of ``trips(trip, …)`` make, given to all trips of that kind."""
    first = cut(trips.groupBy(*kind).agg(F.min("trip").alias("first")))
    names = first.select("first", *[F.col(c).alias(f"_{c}") for c in kind]).hint("merge")
    of = trips.join(names, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in kind])).select("trip", "first")
    return of.join(found(first.withColumnRenamed("first", "trip")).withColumnRenamed("trip", "first").hint("merge"), "first").drop("first")


ENDS = ["lat", "lon", "blat", "blon"]


def best_routes(trips: DataFrame, nodes: DataFrame, edges: DataFrame, most: float, k: int = CANDIDATES, slack: float = SLACK_M, paths: bool = False) -> DataFrame:
    """``trip, score, from_node, to_node, metres`` of trips ``(trip, lat, lon, blat, blon)``: over all pairs of snaps the
    least route and ways to it, at most ``most`` metres in all; pairs of one node only where the ends are close.
    With ``paths`` also the nodes of that route, ``path``."""
    key = lambda a, b: trips.select(F.col("trip").alias("k"), F.col(a).alias("lat"), F.col(b).alias("lon"))
    start = cut(snaps(key("lat", "lon"), nodes, k, slack)).select(F.col("k").alias("trip"), F.col("node").alias("source"), F.col("m").alias("m1"))
    end = cut(snaps(key("blat", "blon"), nodes, k, slack)).select(F.col("k").alias("trip"), F.col("node").alias("node"), F.col("m").alias("m2"))
    wanted = start.join(end, "trip")
    found = distances(edges, wanted.select(F.col("source").alias("id")).distinct(), limit=int(most), paths=False)
    direct = trips.select("trip", F.round(haversine_m(F.col("lat"), F.col("lon"), F.col("blat"), F.col("blon"))).alias("direct"))
    met = wanted.join(found.select("source", "node", "cost"), ["source", "node"]).join(direct, "trip")
    met = met.where((F.col("source") != F.col("node")) | (F.col("direct") <= END_M)).where(F.col("cost") + F.col("m1") + F.col("m2") <= most)
    score = F.col("cost") + F.col("m1") + F.col("m2")
    best = met.groupBy("trip").agg(F.min(F.struct(score.alias("score"), "source", "node", "cost")).alias("x"))
    best = best.select("trip", "x.score", F.col("x.source").alias("from_node"), F.col("x.node").alias("to_node"), F.col("x.cost").alias("metres"))
    if not paths:
        return best
    best = cut(best)
    used = found.join(best.select(F.col("from_node").alias("source")).distinct(), "source", "left_semi")
    way = with_paths(used, edges).select(F.col("source").alias("from_node"), F.col("node").alias("to_node"), "path")
    return best.join(way, ["from_node", "to_node"])


def route_lines(paths: DataFrame, nodes: DataFrame, ends: DataFrame, snap: float = END_M) -> DataFrame:
    """``trip, points``: nodes of paths ``(trip, path)`` as points, the first and last replaced by the trip's
    own ends ``(trip, lat, lon, blat, blon)``, or joined to them where they are further than ``snap`` metres."""
    at = paths.select("trip", F.posexplode("path").alias("i", "node")).join(nodes.select("node", F.struct("lat", "lon").alias("p")), "node")
    line = at.groupBy("trip").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]).alias("p")).where(F.size("p") > 1).join(ends, "trip")
    a, b = F.struct("lat", "lon"), F.struct(F.col("blat").alias("lat"), F.col("blon").alias("lon"))
    first, last = F.get("p", F.lit(0)), F.element_at("p", -1)
    far = lambda x, y: haversine_m(x["lat"], x["lon"], y["lat"], y["lon"]) > snap
    head, tail = F.when(far(first, a), F.array(a, first)).otherwise(F.array(a)), F.when(far(last, b), F.array(last, b)).otherwise(F.array(b))
    return line.select("trip", F.concat(head, F.slice("p", F.lit(2), F.size("p") - 2), tail).alias("points"))


def topology(trips: DataFrame, nodes: DataFrame, k: int = CANDIDATES, slack: float = SLACK_M) -> DataFrame:
    """Why trips route or don't: snap candidates of either end, the nearest, their components, and
    whether one is shared; ``nodes`` have a component."""
    key = lambda a, b: trips.select(F.col("trip").alias("k"), F.col(a).alias("lat"), F.col(b).alias("lon"))

    def side(a, b, p):
        met = snaps(key(a, b), nodes, k, slack).join(nodes.select("node", "component"), "node")
        return met.groupBy(F.col("k").alias("trip")).agg(F.count("*").alias(f"{p}_candidates"), F.min("m").alias(f"{p}_nearest"), F.array_sort(F.collect_set("component")).alias(f"{p}_components"))

    out = trips.select("trip").join(side("lat", "lon", "from"), "trip", "left").join(side("blat", "blon", "to"), "trip", "left")
    return out.withColumn("shared", F.coalesce(F.arrays_overlap("from_components", "to_components"), F.lit(False)))


def path_lines(paths: DataFrame, cities: DataFrame, geometries: DataFrame) -> DataFrame:
    """``trip, points`` of paths ``(trip, path)`` of cities: each edge's geometry ``(src, dst, points)`` or the straight
    line between its cities, one after another without a point repeated."""
    from viaduct.operators.polylines import concat_lines

    hops = paths.select("trip", F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("src"), F.slice("path", F.lit(2), F.size("path") - 1).alias("dst"))).alias("i", "h")).where("h.dst is not null").select("trip", "i", "h.src", "h.dst")
    end = lambda c: cities.select(F.col("id").alias(c), F.struct("lat", "lon").alias(f"p{c}"))
    drawn = hops.join(end("src"), "src").join(end("dst"), "dst").join(geometries, ["src", "dst"], "left")
    piece = F.coalesce("points", F.array("psrc", "pdst"))
    lines = drawn.groupBy("trip").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", piece.alias("p")))), lambda x: x["p"]).alias("parts"))
    return lines.select("trip", concat_lines(F.col("parts")).alias("points"))


def export_edges(edges: DataFrame) -> DataFrame:
    """Each edge once, from its lesser node."""
    return edges.where("src < dst").select("src", "dst", "w")


def load_network(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """Edges of exported segments; one with an unknown end fails the job."""
    known = nodes.select("node", F.lit(True).alias("ok"))
    met = segments.join(known.select(F.col("node").alias("src"), F.col("ok").alias("a")), "src", "left").join(known.select(F.col("node").alias("dst"), F.col("ok").alias("b")), "dst", "left")
    bad = F.raise_error(F.lit("a segment ends at no node")).cast("long")
    good = met.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.when(F.coalesce(F.col("a") & F.col("b"), F.lit(False)), F.col("w")).otherwise(bad).alias("w"))
    return both_ways(good)
