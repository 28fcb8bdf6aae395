"""The national build: a timetable, its reference stations and rail geometry, put together into cities, edges and their lines.

Every part that several outputs read is put down once: stations with their city, consecutive edges, the pairs of stations that
need a line, the network. Outputs are plans over those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.functions import text
from viaduct.functions.geo import haversine_m, impossible_speed, plausible, plausible_limit_m
from viaduct.functions.times import gtfs_seconds
from viaduct.operators import feed, polylines, rails
from viaduct.operators import stations as st
from viaduct.operators.tables import cut
from viaduct.sources import feeds

# How sure a station's city is, by how it was found, and the priority of a reference's segment.
CONFIDENCE = {"manual_override": 100, "reference_uic": 100, "reference_name": 80, "fallback_reference_gap": 50}
SEGMENTS = {"A": 4, "B": 3, "C": 2}


def segment_priority(segment: Column) -> Column:
    """Of a reference's segment, 0 where there is none."""
    letter = F.upper(F.trim(segment))
    known = F.lit(1)
    for name, value in SEGMENTS.items():
        known = F.when(letter == name, value).otherwise(known)
    return F.when(segment.isNull(), 0).otherwise(known)


def assign_cities(stations: DataFrame, references: DataFrame, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stations ``(k, name, lat, lon)`` with their city, how it was found and how sure that is; the ``cities``; their ``aliases``.

    An override of the station or of its reference decides, then the nearest reference that shares a code, then the
    nearest of its name; a station without any makes a city of its own kind, named after its code or place.
    """
    spark = stations.sparkSession
    coded = stations.withColumn("codes", text.digit_runs(F.col("k"), 7)).withColumn("uic", F.get("codes", F.lit(0)))
    refs = references.select(F.col("id").alias("r"), "name", "segment", "insee", "codes", F.col("lat").alias("nlat"), F.col("lon").alias("nlon"))
    one = coded.withColumn("codes", F.when(F.col("uic").isNotNull(), F.array("uic")).otherwise(F.array().cast("array<string>")))
    by_code = st.match_by_code(one, refs.select("r", "codes", "nlat", "nlon")).withColumn("how", F.lit("reference_uic"))
    by_name = st.match_by_name(stations, refs.select("r", "name", "nlat", "nlon"), by_code).withColumn("how", F.lit("reference_name"))
    matched = by_code.select("k", "r", "how").unionByName(by_name.select("k", "r", "how"))
    known = cut(coded.join(matched, "k", "left").join(refs.select("r", F.col("name").alias("reference"), "segment", text.french_commune(F.col("insee")).alias("insee")), "r", "left"))
    given = overrides if overrides is not None else spark.createDataFrame([], "raw_id string, target string")
    asked = known.select(F.col("k").alias("station"), F.explode(F.array_compact(F.array("k", "r"))).alias("raw_id"))
    bound = st.resolve_overrides(asked, st.override_lookup(given, strict=True))
    clash = F.raise_error(F.concat(F.lit("overrides of "), F.col("station"), F.lit(" disagree"))).cast("string")
    target = bound.select(F.col("station").alias("k"), F.when(F.col("conflict"), clash).otherwise(F.col("binding")).alias("target"))
    rows = known.join(target, "k", "left")
    how = F.when(F.col("target").isNotNull(), "manual_override").otherwise(F.coalesce("how", F.lit("fallback_reference_gap")))
    french = F.col("target").isNotNull() | F.col("r").isNotNull()
    key = F.when(F.col("target").isNotNull(), F.concat(F.lit("override-city-"), F.col("target"))).when(F.col("r").isNotNull(), F.concat(F.lit("fr-insee-"), F.coalesce("insee", F.lit("unknown"))))
    sure = F.lit(0)
    for name, value in CONFIDENCE.items():
        sure = F.when(how == name, value).otherwise(sure)
    placed = rows.select("k", "name", "lat", "lon", "uic", "r", "reference", "insee", "target", how.alias("strategy"), sure.alias("confidence"), segment_priority(F.col("segment")).alias("priority"), F.coalesce(key, text.fallback_cluster_key(F.col("name"), F.col("uic"), F.col("lat"), F.col("lon"))).alias("cluster"), F.when(french, "FR").otherwise("ZZ").alias("country"))
    placed = cut(placed)
    figures = placed.groupBy("cluster").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("stations"), F.min_by("country", "k").alias("country"), F.min("insee").alias("insee"), F.min("target").alias("target"))
    votes = st.display_names(placed.select(F.col("cluster").alias("city"), "name"))
    top = placed.join(placed.groupBy("cluster").agg(F.max("priority").alias("most")), "cluster").where("priority = most and most > 0")
    main = st.display_names(top.select(F.col("cluster").alias("city"), "name")).withColumnRenamed("display_name", "main")
    liked = st.preferred_names(placed.where("r is not null").select(F.col("cluster").alias("city"), F.col("reference").alias("name"), "priority", F.col("k").alias("pos")))
    named = votes.join(main, "city", "left").join(liked, "city", "left").select(F.col("city").alias("cluster"), F.coalesce("name", "main", "display_name").alias("display_name"))
    cities = figures.join(named, "cluster").withColumn("slug", text.slugify(F.col("display_name")))
    cities = cut(cities.withColumn("city", F.coalesce("target", text.stable_city_id(F.col("cluster"), F.col("slug"), F.col("country"), F.col("insee")))))
    homes = cut(placed.join(cities.select("cluster", "city"), "cluster"))
    names = homes.select("city", "name").unionByName(cities.select("city", F.col("display_name").alias("name")))
    aliases = names.select(text.normalize_name(F.col("name")).alias("alias"), "city").distinct()
    return homes, cities.select("city", "slug", "display_name", "country", "lat", "lon", "stations"), aliases


def city_hops(times: DataFrame, homes: DataFrame, source_country: str = "FR") -> tuple[DataFrame, DataFrame]:
    """Edges between consecutive stops ``(trip_id, pos, seq, k, arrival, departure)`` in different cities with both stations, and the
    issues: edges faster than a train or within a foreign country."""
    at = homes.select("k", "city", "confidence", "country", "lat", "lon")
    visits = times.join(at, "k").select(F.col("trip_id").alias("trip"), "pos", "seq", "city", "arrival", "departure", F.struct("k", "confidence", "country", "lat", "lon").alias("at"))
    edges = feed.consecutive_edges(visits.where("arrival is not null and departure is not null"), ("at",))
    far = haversine_m(F.col("from_at.lat"), F.col("from_at.lon"), F.col("to_at.lat"), F.col("to_at.lon"))
    foreign = (F.col("from_at.country") == F.col("to_at.country")) & ~F.col("to_at.country").isin("ZZ", source_country)
    kind = F.when(impossible_speed(far, F.col("duration_min")), "impossible_edge").when(foreign, "foreign_domestic_edge")
    judged = cut(edges.withColumn("direct", far).withColumn("issue", kind))
    issues = judged.where("issue is not null").select("issue", F.concat_ws("->", "from_city", "to_city").alias("entity")).distinct()
    good = judged.where("issue is null").withColumn("confidence", F.least("from_at.confidence", "to_at.confidence"))
    return good, issues


def edge_lines(pairs: DataFrame, rail: DataFrame | None, shapes: DataFrame) -> DataFrame:
    """``edge, geometry, metres, points, rejected_m`` of ``pairs(edge, shape_id, lat, lon, blat, blon)``: the way along the rail
    network if its length is plausible, searched from near nodes and then from more; else the trip's shape between the two
    places; else the straight line. ``rejected_m`` is the length of a rail way that was not taken."""
    spark = pairs.sparkSession
    direct = haversine_m(F.col("lat"), F.col("lon"), F.col("blat"), F.col("blon"))
    asked = cut(pairs.withColumn("direct", direct).withColumn("limit", F.ceil(plausible_limit_m(direct))))
    trips = asked.select(F.col("edge").alias("trip"), "lat", "lon", "blat", "blon")
    none = spark.createDataFrame([], f"edge {pairs.schema['edge'].dataType.simpleString()}, i long, j int, lat double, lon double")
    ways, rejected = none, none.select("edge", F.lit(0).cast("long").alias("rejected_m"))
    if rail is not None:
        nodes, edges = rails.build_network(rail)
        most = asked.agg(F.max("limit")).first()[0] or 0
        open_, found = trips, []
        for k, slack in ((rails.CANDIDATES, rails.SLACK_M), (rails.MORE_CANDIDATES, rails.MORE_SLACK_M)):
            best = cut(rails.best_routes(open_, nodes, edges, float(most), k, slack, paths=True))
            lines = rails.route_lines(best.select("trip", "path"), nodes, open_).select(F.col("trip").alias("edge"), F.posexplode("points").alias("i", "p")).select("edge", F.col("i").cast("long").alias("i"), F.lit(0).alias("j"), "p.lat", "p.lon")
            found.append(_judged(lines, asked))
            open_ = cut(open_.join(found[-1].where("ok").select(F.col("edge").alias("trip")).distinct(), "trip", "left_anti"))
        ways = found[0].where("ok").unionByName(found[1].where("ok")).select(none.columns)
        tried = found[0].where("not ok").unionByName(found[1].where("not ok"))
        rejected = tried.groupBy("edge").agg(F.max("metres").alias("rejected_m"))
    left = asked.join(ways.select("edge").distinct(), "edge", "left_anti").where("shape_id is not null")
    along = left.select("edge", "shape_id").join(shapes, "shape_id").select(F.col("edge").alias("line"), "i", "lat", "lon")
    ends = left.select(F.col("edge").alias("line"), F.col("lat").alias("alat"), F.col("lon").alias("alon"), "blat", "blon")
    shaped = _judged(polylines.shape_rows(along, ends).withColumnRenamed("line", "edge").select(*[F.col(c).cast(t) for c, t in none.dtypes]), asked).where("ok").select(none.columns)
    drawn = ways.withColumn("kind", F.lit("rail")).unionByName(shaped.withColumn("kind", F.lit("shape")))
    plain = asked.join(drawn.select("edge").distinct(), "edge", "left_anti")
    straight = plain.select("edge", F.posexplode(F.array(F.struct("lat", "lon"), F.struct(F.col("blat").alias("lat"), F.col("blon").alias("lon")))).alias("i", "p")).select("edge", F.col("i").cast("long").alias("i"), F.lit(0).alias("j"), "p.lat", "p.lon", F.lit("straight").alias("kind"))
    every = cut(drawn.unionByName(straight))
    length = polylines.lengths(every.select(F.col("edge").alias("line"), F.struct("i", "j").alias("i"), "lat", "lon"))
    counts = every.groupBy("edge").agg(F.first("kind").alias("geometry"), F.count("*").alias("points"))
    out = counts.join(length.withColumnRenamed("line", "edge"), "edge").join(rejected, "edge", "left")
    return out.select("edge", "geometry", "metres", "points", F.when(F.col("geometry") == "straight", F.col("rejected_m")).alias("rejected_m"))


def _judged(lines: DataFrame, asked: DataFrame) -> DataFrame:
    """Points of lines with their length and whether it is plausible for their edge."""
    lines = cut(lines)
    length = polylines.lengths(lines.select(F.col("edge").alias("line"), F.struct("i", "j").alias("i"), "lat", "lon")).withColumnRenamed("line", "edge")
    met = length.join(asked.select("edge", "direct"), "edge").withColumn("ok", plausible(F.col("metres"), F.col("direct")))
    return cut(lines.join(met.select("edge", "metres", "ok"), "edge"))


def national_build(spark: SparkSession, timetable: str, references: str, source: str, rail: DataFrame | None = None, overrides: DataFrame | None = None) -> dict[str, DataFrame]:
    """All outputs by name: stations, cities, aliases, mappings, edges, geometries, patterns, duplicates, issues, summary."""
    refs = cut(feeds.station_list(spark, references))
    all_, stop_of = feeds.stations(spark, timetable)
    trips = cut(feeds.trips(spark, timetable, source))
    times = feeds.stop_times(spark, timetable).join(trips.select("trip_id"), "trip_id", "left_semi").join(stop_of, "stop_id")
    times = cut(times.select("trip_id", "pos", "seq", "k", gtfs_seconds(F.col("arrival_time")).alias("arrival"), gtfs_seconds(F.col("departure_time")).alias("departure")))
    used = cut(all_.join(times.select("k").distinct(), "k", "left_semi"))
    homes, cities, aliases = assign_cities(used, refs, overrides)
    hops, odd = city_hops(times, homes)
    first = F.struct("duration_min", "pos")
    edges = cut(hops.groupBy("from_city", "to_city").agg(F.min("duration_min").alias("duration_min"), F.min_by(F.struct("trip", "from_at", "to_at", "confidence"), first).alias("x")).select(F.concat_ws("->", "from_city", "to_city").alias("edge"), "from_city", "to_city", "duration_min", "x.*"))
    shapes = feeds.read_member(spark, timetable, "shapes.txt", ["shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"], optional=True)
    shapes = cut(shapes.select("shape_id", F.expr("try_cast(shape_pt_sequence as bigint)").alias("i"), F.expr("try_cast(shape_pt_lat as double)").alias("lat"), F.expr("try_cast(shape_pt_lon as double)").alias("lon")).where("i is not null and lat is not null and lon is not null"))
    wanted = edges.join(trips.select(F.col("trip_id").alias("trip"), "shape_id"), "trip").select("edge", "shape_id", "from_at.lat", "from_at.lon", F.col("to_at.lat").alias("blat"), F.col("to_at.lon").alias("blon"))
    geometries = cut(edge_lines(wanted, rail, shapes))
    called = feed.drop_adjacent_repeats(times.join(homes.select("k"), "k").select(F.col("trip_id").alias("trip"), "pos", F.col("k").alias("stop")))
    patterns = feed.service_patterns(called, source, F.lit(""), "rail").select("pattern_id", "stops", "trip_count", "sample_trips")
    gaps = homes.where("strategy = 'fallback_reference_gap'").select(F.lit("no_reference").alias("issue"), F.col("k").alias("entity"))
    issues = cut(gaps.unionByName(odd))
    duplicates = st.duplicate_cities(cities.select(F.col("city").alias("k"), F.col("display_name").alias("name"), "lat", "lon"))
    say = lambda name, df: df.agg(F.lit(name).alias("measure"), F.count("*").alias("value"))
    summary = say("references", refs).union(say("stations", homes)).union(say("matched", homes.where("r is not null"))).union(say("cities", cities)).union(say("edges", edges)).union(say("patterns", patterns)).union(say("duplicates", duplicates)).union(say("issues", issues))
    return {
        "stations": homes.select("k", "name", "lat", "lon", "uic", "city", "country"), "mappings": homes.select("k", "city", "strategy", "confidence", "r"), "cities": cities, "aliases": aliases,
        "edges": edges.select("edge", "from_city", "to_city", "duration_min", "confidence"), "geometries": geometries, "patterns": patterns, "duplicates": duplicates, "issues": issues, "summary": summary,
    }
