"""Bundles that leave the build: joins, overlays, audits and backlogs over finished tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaduct.operators import graphs
from viaduct.operators.spatial import close_pairs
from viaduct.operators.tables import cut


def aggregate_targets(*edges: DataFrame) -> DataFrame:
    """Edges of several targets as one set, the least weight of each pair."""
    return graphs.least_parallel(reduce(lambda a, b: a.unionByName(b), edges))


def overlay(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Rows with ids of ``column`` replaced by the registry's ``(old_id, new_id)`` where it has one."""
    return rows.join(mapping.withColumnRenamed("old_id", column), column, "left").withColumn(column, F.coalesce("new_id", column)).drop("new_id")


def gates(facts: DataFrame, least: dict[str, int], most: dict[str, int]) -> DataFrame:
    """A row of counts as one row a gate: gate, value, bound, passed."""
    rules = [(c, b, F.col(c) >= b) for c, b in least.items()] + [(c, b, F.col(c) <= b) for c, b in most.items()]
    rows = F.array(*[F.struct(F.lit(c).alias("gate"), F.col(c).cast("long").alias("value"), F.lit(b).cast("long").alias("bound"), ok.alias("passed")) for c, b, ok in rules])
    return facts.select(F.explode(rows).alias("x")).select("x.*")


def service_places(stops: DataFrame, links: DataFrame) -> DataFrame:
    """``place, patterns, city`` of the places in patterns ``(pattern, place)`` with their registry link if they have one."""
    return stops.groupBy("place").agg(F.count_distinct("pattern").alias("patterns")).join(links, "place", "left")


def pair_audit(pairs: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` without an edge between them in that direction: whether they are linked some other way."""
    missing = pairs.join(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")
    part = graphs.components(nodes, edges)
    of = lambda c: part.select(F.col("id").alias(c), F.col("component").alias(f"c{c}"))
    return missing.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).alias("reachable"))


def close_without_edge(nodes: DataFrame, edges: DataFrame, bands: tuple[float, ...] = (10.0, 100.0, 1000.0)) -> DataFrame:
    """Pairs ``u < v`` of ``nodes(node, lat, lon)`` closer than the widest band that no edge joins: their band, and
    whether two or three edges do."""
    from viaduct.functions.geo import haversine_m

    both = cut(edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src"))).distinct())
    at = lambda c, p: nodes.select(F.col("node").alias(c), F.col("lat").alias(f"{p}lat"), F.col("lon").alias(f"{p}lon"))
    # small files may hold many rows: nothing is broadcast
    step = lambda df: df.join(both.select(F.col("src").alias("v"), F.col("dst").alias("w")).hint("merge"), "v").select("u", F.col("w").alias("v")).distinct()
    one = both.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    two = cut(step(one))
    walks = [df.where("u < v").withColumn("hops", F.lit(n)) for n, df in enumerate((one, two, step(two)), 1)]
    least = reduce(DataFrame.union, walks).groupBy("u", "v").agg(F.min("hops").alias("hops"))
    # pairs that one to three edges join are few a node; all others are listed where their places meet
    linked = least.join(at("u", "").hint("merge"), "u").join(at("v", "b").hint("merge"), "v").withColumn("m", haversine_m(F.col("lat"), F.col("lon"), F.col("blat"), F.col("blon")))
    linked = cut(linked.where(F.col("m") <= bands[-1]).select("u", "v", "m", "hops"))
    others = linked.select(F.col("u").alias("node"), "v").union(linked.select("v", "u")).groupBy("node").agg(F.collect_list("v").alias("others"))
    lone = close_pairs(nodes.join(others.hint("merge"), "node", "left"), bands[-1], skip="others")
    band = reduce(lambda out, b: F.when(F.col("m") <= b, int(b)).otherwise(out), reversed(bands), F.lit(None).cast("int"))
    every = lone.withColumn("hops", F.lit(None).cast("int")).unionByName(linked.where("hops > 1"))
    return every.select("u", "v", band.alias("band"), "hops")


def backlog(stations: DataFrame, key: str, open_: Column) -> DataFrame:
    return stations.groupBy(key).agg(F.count("*").alias("stations"), F.count_if(open_).alias("backlog"))


def rail_profile(stations: DataFrame, spread_km: float) -> DataFrame:
    """``city, terminals, spread_km, anchor``: stations of a city ``(city, k, lat, lon)``, the diagonal of their box, and whether a
    main station or their centre stands for it."""
    from viaduct.functions.geo import haversine_m

    box = stations.groupBy("city").agg(F.count("*").alias("terminals"), *[f(c).alias(n) for c, f, n in (("lat", F.min, "s"), ("lat", F.max, "n"), ("lon", F.min, "w"), ("lon", F.max, "e"))])
    far = haversine_m(F.col("s"), F.col("w"), F.col("n"), F.col("e")) / 1000
    return box.select("city", "terminals", F.round(far, 3).alias("spread_km"), F.when((F.col("terminals") > 1) & (far > spread_km), "centroid").otherwise("main_station").alias("anchor"))


def country_label(code: Column, known: Column, fallback: dict[str, str]) -> Column:
    """A country's name, else that of the fallback, else its code; ``Unknown`` for a blank one."""
    table = reduce(lambda out, kv: F.when(F.upper(code) == kv[0], kv[1]).otherwise(out), fallback.items(), F.lit(None).cast("string"))
    return F.when(F.coalesce(F.trim(code), F.lit("")) == "", "Unknown").otherwise(F.coalesce(known, table, code))


def rekey_geometries(geometries: DataFrame, names: DataFrame) -> DataFrame:
    """Geometries ``(a, b, pos)`` under the names of their ends; unknown ends are skipped, the last of a pair wins."""
    of = lambda c: names.select(F.col("id").alias(c), F.col("name").alias(f"n{c}"))
    return geometries.join(of("a"), "a").join(of("b"), "b").groupBy(F.col("na").alias("a"), F.col("nb").alias("b")).agg(F.max("pos").alias("pos"))


def places(raw: DataFrame) -> DataFrame:
    """Places with coordinates in degrees and the defaults of what they leave out."""
    return raw.select("place_id", F.coalesce("role", F.lit("service")).alias("role"), (F.col("lat_e5") / 100_000).alias("lat"), (F.col("lon_e5") / 100_000).alias("lon"), F.coalesce("patterns", F.lit(0)).alias("patterns"))


def bundle_findings(meta: dict[str, int], tables: dict[str, DataFrame], cities: DataFrame, countries: int) -> DataFrame:
    """Counts that differ from the bundle's meta data, and cities of no country."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(f"{name}_count").alias("finding"), F.col("n").alias("value")).where(F.col("value") != meta[name]) for name, t in tables.items()]
    bounds = cities.where((F.col("country") < 0) | (F.col("country") >= countries)).select(F.lit("country_bounds"), F.col("city").cast("long"))
    return reduce(lambda a, b: a.union(b), [*parts, bounds])


def authority(stations: DataFrame) -> DataFrame:
    """``k, refs, evidence, status`` of stations ``(k, qid, uic, raw)``: every identity with its kind and value, what it proves, and
    whether the station is resolved. Fixed values: names and confidences of the evidence."""
    good = F.col("qid").rlike("^Q[0-9]+$")
    ref = lambda kind, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{kind}:"), F.col(c)))
    refs = F.array_compact(F.array(ref("wikidata_qid", "qid"), ref("uic_code", "uic"), ref("source_record", "raw")))
    said = F.array_compact(F.array(F.when(good, "wikidata_qid_accepted:95").when(F.col("qid").isNotNull(), "wikidata_qid_invalid:0"), F.when(F.col("uic").isNotNull(), "identifier_exact:90"), F.when(F.col("qid").isNull() & F.col("uic").isNull(), "source_carry_forward:60")))
    status = F.when(good, "resolved").when(F.col("qid").isNotNull(), "needs_review").when(F.col("uic").isNotNull(), "resolved").otherwise("provisional")
    return stations.select("k", F.array_join(refs, ",").alias("refs"), F.array_join(said, ",").alias("evidence"), status.alias("status"))


def planner_findings(routes: DataFrame) -> DataFrame:
    """Route keys without a dash and times that aren't finite and at least 0."""
    bad = F.when(~F.col("key").contains("-"), "key").when(F.col("minutes").isNull() | F.isnan("minutes") | (F.col("minutes") < 0) | (F.col("minutes") == float("inf")), "minutes")
    return routes.select("key", bad.alias("finding")).where("finding is not null")


def route_edges(pairs: DataFrame | None, keys: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges ``(a, b, minutes)`` of route pairs, else of parsed keys ``(key, minutes)``, and the keys that don't parse."""
    from viaduct.operators.views import route_keys

    if pairs is not None:
        return pairs.select("a", "b", "minutes"), keys.select("key").limit(0)
    parsed = route_keys(keys.select("key"), names)
    return keys.join(parsed, "key").select("a", "b", "minutes"), keys.select("key").join(parsed.select("key"), "key", "left_anti")


def station_id(uic: Column, raw: Column) -> Column:
    """A station's id by its code, else by its source's name for it."""
    from viaduct.functions.text import registry_slug

    return F.coalesce(F.concat(F.lit("station-uic-"), uic), F.concat(F.lit("station-sncf-"), registry_slug(raw)))
