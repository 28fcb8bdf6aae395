"""Timetable operators: consecutive edges, service patterns, calendars, trip filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def consecutive_edges(visits: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Edges between a visit and the one before it in the trip, in file order.

    Takes trip, pos, seq, city, arrival and departure in seconds. A visit that isn't later in
    sequence or changes no city gives no edge but is still the next one's predecessor; durations
    of nothing or less give none. Columns to ``carry`` come from both visits, as ``from_…`` and ``to_…``.
    """
    before = F.lag(F.struct("city", "departure", "seq", *carry)).over(Window.partitionBy("trip").orderBy("pos"))
    edges = visits.withColumn("before", before).where("before is not null")
    edges = edges.where((F.col("seq") > F.col("before.seq")) & (F.col("city") != F.col("before.city")))
    seconds = F.col("arrival") - F.col("before.departure")
    return edges.where(seconds > 0).select("trip", "pos", F.col("before.city").alias("from_city"), F.col("city").alias("to_city"), F.ceil(seconds / 60).cast("long").alias("duration_min"), *[F.col(f"before.{c}").alias(f"from_{c}") for c in carry], *[F.col(c).alias(f"to_{c}") for c in carry])


def fastest_edges(edges: DataFrame) -> DataFrame:
    """The least duration of each directed pair with the trip of the first edge that has it."""
    first = F.struct("duration_min", "pos")
    return edges.groupBy("from_city", "to_city").agg(F.min("duration_min").alias("duration_min"), F.min_by("trip", first).alias("trip"), F.min_by("pos", first).alias("pos"))


def drop_adjacent_repeats(stops: DataFrame) -> DataFrame:
    """Rows ``trip, pos, stop`` that differ from the row before them in the trip."""
    before = F.lag("stop").over(Window.partitionBy("trip").orderBy("pos"))
    return stops.withColumn("_b", before).where(~F.col("stop").eqNullSafe(F.col("_b"))).drop("_b")


def service_patterns(stops: DataFrame, source: str, route: Column, mode: str) -> DataFrame:
    """Trips with one stop sequence as a pattern: id, key, stops, trip count and five sample trips."""
    trips = stops.groupBy("trip").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "stop"))), lambda x: x["stop"]).alias("stops"))
    key = F.concat_ws("|", F.lit(source), route, F.lit(mode), F.array_join("stops", ">"))
    patterns = trips.withColumn("pattern_key", key).groupBy("pattern_key").agg(F.first("stops").alias("stops"), F.count("*").alias("trip_count"), F.slice(F.array_sort(F.collect_set("trip")), 1, 5).alias("sample_trips"))
    return patterns.withColumn("pattern_id", F.substring(F.md5(F.col("pattern_key").cast("binary")), 1, 8))


def journey_pairs(stops: DataFrame) -> DataFrame:
    """Every pair i < j of a trip's stops in different cities, with the cities between as a run-collapsed list."""
    numbered = stops.withColumn("i", F.row_number().over(Window.partitionBy("trip").orderBy("pos")))
    cities = numbered.groupBy("trip").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "stop"))), lambda x: x["stop"]).alias("all"))
    pairs = cities.select("trip", "all", F.explode(F.sequence(F.lit(1), F.size("all"))).alias("i"))
    pairs = pairs.where(F.col("i") < F.size("all")).select("trip", "all", "i", F.explode(F.sequence(F.col("i") + 1, F.size("all"))).alias("j"))
    get = lambda k: F.element_at("all", k)
    inner = F.slice("all", F.col("i") + 1, F.col("j") - F.col("i") - 1)
    runs = F.aggregate(inner, F.array().cast("array<string>"), lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1) == x), acc).otherwise(F.concat(acc, F.array(x))))
    return pairs.where(get(F.col("i")) != get(F.col("j"))).select("trip", F.col("i").cast("int"), F.col("j").cast("int"), get(F.col("i")).alias("from_city"), get(F.col("j")).alias("to_city"), F.array_join(runs, ">").alias("via"))


def rail_route_type(c: Column) -> Column:
    return (c == 2) | c.between(100, 117)


def rail_route(route_id: Column, route_type: Column, source: str) -> Column:
    """Rail policy of a source. The marks and types of the German feed."""
    if source != "de-delfi-gtfs":
        return rail_route_type(route_type)
    other = route_id.contains("|Bus|") | route_id.contains("|Tram") | route_id.contains("|U-Ba") | route_id.contains("|Faeh")
    return ~other & route_type.isin(2, 101, 102, 103, 105, 107, 109, 116, 117)


def coach_stop(source: Column, stop_id: Column) -> Column:
    return (source == "sncf-fr-gtfs") & F.lower(F.trim(stop_id)).contains("ocecar")


def service_mode(source: Column, route_type: Column, coach: Column) -> Column:
    return F.when((source == "sncf-fr-gtfs") & ((route_type == 3) | coach), "replacement_bus").when(rail_route_type(route_type), "rail")


def station_key(stop_id: Column, location_type: Column, parent: Column) -> Column:
    return F.when(location_type == 1, stop_id).otherwise(F.coalesce(F.nullif(F.trim(parent), F.lit("")), stop_id))


def first_per(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row of each key in file order."""
    return df.groupBy(key).agg(F.min_by(F.struct(*[c for c in df.columns if c != key]), F.col(order)).alias("_r")).select(key, "_r.*")


def last_per(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.col(order)).alias("_r")).select(key, "_r.*")


def calendar_summary(dates: DataFrame) -> DataFrame:
    """Rows, first and last date of each service; dates are strings and exceptions count like others."""
    return dates.groupBy("service_id").agg(F.count("*").alias("n_dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def pattern_calendar(patterns: DataFrame, calendar: DataFrame) -> DataFrame:
    """Counts of a pattern's services added up, least first and greatest last date."""
    services = patterns.select("pattern_id", F.explode("service_ids").alias("service_id")).join(calendar, "service_id", "left")
    return services.groupBy("pattern_id").agg(F.coalesce(F.sum("n_dates"), F.lit(0)).alias("n_dates"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))
