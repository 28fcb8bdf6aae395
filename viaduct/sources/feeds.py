"""Timetable archives, station lists and rail geometry files as DataFrames.

Text files are read by Spark; archives and GeoPackages by data sources that give each task a part of one file.
"""

from __future__ import annotations

import csv
import io
import struct
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.functions import text
from viaduct.operators import feed
from viaduct.sources import splits

# Layer names and classes of railways in GeoPackages.
LAYER, CLASSES = "gis_osm_railways_free", ("rail", "narrow_gauge")


def read_member(spark: SparkSession, path: str, member: str, columns: list[str], optional: bool = False, split: int = 64 << 20) -> DataFrame:
    """Rows of a CSV member of the archives at ``path``: archive, pos (record number) and ``columns`` as strings,
    null where the file has no such column. Headers and values are trimmed, byte order marks dropped. A
    missing member fails unless it is ``optional``. Each ``split`` bytes of a member are a task of their own."""
    splits.register(spark)
    schema = "archive string, pos long, " + ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("archive_member").schema(schema).options(member=member, optional=str(optional).lower(), split=split).load(path)


def stations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stations ``(k, name, lat, lon)``, the first row of each, without placeholder names, and every stop's station
    ``(stop_id, k)``, placeholders' too."""
    rows = read_member(spark, path, "stops.txt", ["stop_id", "stop_name", "stop_lat", "stop_lon", "location_type", "parent_station"])
    keyed = rows.withColumn("k", feed.station_key(F.col("stop_id"), F.expr("try_cast(location_type as int)"), F.col("parent_station")))
    stops = keyed.select("stop_id", "k").distinct()
    at = lambda c: F.expr(f"try_cast({c} as double)")
    first = feed.first_per(keyed.select("k", "pos", F.col("stop_name").alias("name"), at("stop_lat").alias("lat"), at("stop_lon").alias("lon")), "k", "pos")
    return first.where(~text.placeholder_station(F.col("name"))).drop("pos"), stops


def trips(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Rail trips ``(trip_id, route_id, shape_id)``: of supported routes, the last row of each, none that touches a coach stop."""
    routes = read_member(spark, path, "routes.txt", ["route_id", "route_type"])
    rail = routes.where(feed.rail_route(F.col("route_id"), F.expr("try_cast(route_type as int)"), source)).select("route_id").distinct()
    rows = read_member(spark, path, "trips.txt", ["route_id", "trip_id", "service_id", "trip_headsign", "shape_id"]).join(rail, "route_id")
    last = feed.last_per(rows.select("trip_id", "pos", "route_id", F.nullif("shape_id", F.lit("")).alias("shape_id")), "trip_id", "pos").drop("pos")
    coach = stop_times(spark, path).where(feed.coach_stop(F.lit(source), F.col("stop_id"))).select("trip_id").distinct()
    return last.join(coach, "trip_id", "left_anti")


def stop_times(spark: SparkSession, path: str) -> DataFrame:
    rows = read_member(spark, path, "stop_times.txt", ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence"])
    return rows.select("trip_id", "pos", "stop_id", F.expr("try_cast(stop_sequence as int)").alias("seq"), "arrival_time", "departure_time")


def city_edges(spark: SparkSession, path: str, source: str, country: str, metres: float | None = None) -> dict[str, DataFrame]:
    """A timetable without references as ``stations`` with their cluster, ``cities`` with a voted name and mean place, and
    the fastest directed ``edges`` between consecutive stops of rail trips. Trains alone make a station: those
    no rail trip visits are left out."""
    from viaduct.functions.times import gtfs_seconds
    from viaduct.operators import stations as st

    all_, stop_of = stations(spark, path)
    rail = trips(spark, path, source)
    times = stop_times(spark, path).join(rail.select("trip_id"), "trip_id", "left_semi").join(stop_of, "stop_id")
    used = all_.join(times.select("k").distinct(), "k", "left_semi")
    near = {} if metres is None else {"metres": metres}
    stems = used.join(st.stems(used, **near), "k")
    grouped = st.leader_clusters(stems.select("stem", "k", "lat", "lon"), **near)
    slug = F.concat_ws("-", F.lit("gtfs-basic"), F.lit(country.lower()), text.slugify(F.col("stem")), F.col("cluster").cast("string"))
    placed = used.join(grouped.select("k", slug.alias("city")), "k")
    names = st.display_names(placed.select("city", "name"))
    cities = placed.groupBy("city").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("stations")).join(names, "city")
    visits = times.join(placed.select("k", "city"), "k").select(F.col("trip_id").alias("trip"), "pos", "seq", "city", gtfs_seconds(F.col("arrival_time")).alias("arrival"), gtfs_seconds(F.col("departure_time")).alias("departure"))
    return {"stations": placed, "cities": cities, "edges": feed.fastest_edges(feed.consecutive_edges(visits))}


def station_list(spark: SparkSession, path: str, least: int = 7, normalise: bool = False) -> DataFrame:
    """A CSV of reference stations: ``id, name, segment, insee, lat, lon, codes``. Headers may be padded, in capitals or begin
    with a byte order mark; rows without a name or a place are skipped. Codes are digit runs of ``least`` or
    more, sorted once each, or for the registry, with ``least`` 1, in order; ``normalise`` takes districts to their commune."""
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    named = {c.lstrip("﻿").strip().lower(): c for c in raw.columns}
    missing = [c for c in ("nom", "position_geographique", "codeinsee", "codes_uic", "id") if c not in named]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    col = lambda c: text.non_empty(F.col(f"`{named[c]}`")) if c in named else F.lit(None).cast("string")
    rows = raw.select(F.coalesce(col("id"), F.lit("")).alias("id"), col("nom").alias("name"), col("segment_drg").alias("segment"), col("codeinsee").alias("insee"), F.split(col("position_geographique"), ",").alias("p"), F.coalesce(col("codes_uic"), F.lit("")).alias("codes"))
    at = lambda i: F.expr(f"try_cast(trim(get(p, {i})) as double)")
    codes = text.digit_runs(F.col("codes"), least)
    if least > 1:
        codes = F.array_sort(F.array_distinct(codes))
    insee = text.french_commune(F.col("insee")) if normalise else F.col("insee")
    out = rows.select("id", "name", "segment", insee.alias("insee"), at(0).alias("lat"), at(1).alias("lon"), codes.alias("codes"))
    return out.where("name is not null and lat is not null and lon is not null")


def geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``(line, i, lat, lon)`` of the active features of GeoJSON collections, each part of a MultiLineString one."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("f"))
    one, many = "array<array<double>>", "array<array<array<double>>>"
    kind, shape = F.get_json_object("f", "$.geometry.type"), F.get_json_object("f", "$.geometry.coordinates")
    mnemo = F.get_json_object("f", "$.properties.mnemo")
    parts = F.when(kind == "LineString", F.array(F.from_json(shape, one))).when(kind == "MultiLineString", F.from_json(shape, many))
    return _numbered(raw.where(text.in_service(mnemo)).select(F.md5("f").alias("file"), F.posexplode(parts).alias("n", "p")), lambda p: (p[1], p[0]))


def _numbered(parts: DataFrame, of) -> DataFrame:
    points = parts.select(F.concat_ws(":", "file", F.col("n").cast("string")).alias("line"), F.posexplode("p").alias("i", "q"))
    lat, lon = of(F.col("q"))
    return points.select("line", "i", lat.alias("lat"), lon.alias("lon"))


def wkb_lines(data: bytes) -> list[list[tuple[float, float]]]:
    """Lines of a WKB LineString or MultiLineString of either byte order, as (lat, lon)."""

    def geometry(at: int):
        order = "<>"[data[at] == 0] if data[at] in (0, 1) else None
        if order is None:
            raise ValueError("unknown byte order")
        kind, count = struct.unpack_from(f"{order}II", data, at + 1)
        at += 9
        if kind == 2:
            flat = struct.unpack_from(f"{order}{2 * count}d", data, at)
            return [[*zip(flat[1::2], flat[::2], strict=True)]], at + 16 * count
        if kind == 5:
            lines = []
            for _ in range(count):
                more, at = geometry(at)
                lines += more
            return lines, at
        raise ValueError(f"geometry type {kind} isn't a line")

    return geometry(0)[0]


def geopackage_payload(blob: bytes) -> bytes:
    """The WKB after a GeoPackage header and its envelope."""
    envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}.get(blob[3] >> 1 & 7) if len(blob) >= 8 and blob[:2] == b"GP" else None
    if envelope is None or len(blob) < 8 + envelope:
        raise ValueError("not a GeoPackage geometry")
    return blob[8 + envelope :]


def geopackage_lines(spark: SparkSession, path: str, split: int = 100_000) -> DataFrame:
    """Lines ``(line, i, lat, lon)`` of the railways of GeoPackages, ``split`` rows of the layer a task."""
    splits.register(spark)
    found = spark.read.format("geopackage_layer").options(layer=LAYER, kinds=",".join(CLASSES), split=split).load(path)
    return _numbered(found, lambda q: (q["lat"], q["lon"]))


def read_document(spark: SparkSession, path: str, schema) -> DataFrame:
    """Typed records of whole-file JSON; one that doesn't parse fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def write_document(df: DataFrame, path: str, head: str = "[", tail: str = "]") -> None:
    """Records as one JSON list in one file, in order of their text, nulls kept. A file is one task, which writes record
    after record and holds a batch of them."""
    import pyarrow as pa

    def lines(batches):
        before = head + "\n"
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array([before + ",\n".join(texts)])], ["value"])
                before = ","
        yield pa.RecordBatch.from_arrays([pa.array([(before if before != "," else "") + tail])], ["value"])

    record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    ordered = df.select(record.alias("record")).repartition(1).sortWithinPartitions("record")
    ordered.mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def write_archives(df: DataFrame, folder: str, member: str) -> None:
    """Rows as CSV members of archives, one a task, named after its number, so that a task that runs again replaces its own."""
    import pyarrow as pa
    from pyspark import TaskContext

    header = df.columns

    def put(batches):
        number = TaskContext.get().partitionId()
        (store, place, _), *_ = splits.places_for(f"{folder}/part-{number:05d}.zip")
        with store.open_output_stream(place) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z, z.open(member, "w", force_zip64=True) as out:
            text_ = io.TextIOWrapper(out, "utf-8", newline="")
            rows = csv.writer(text_)
            rows.writerow(header)
            for batch in batches:
                rows.writerows(zip(*[c.to_pylist() for c in batch.columns], strict=True))
            text_.flush()
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32())], ["number"])

    df.select(*[F.col(c).cast("string") for c in header]).mapInArrow(put, "number int").count()


def write_geopackages(lines: DataFrame, folder: str) -> None:
    """Lines ``(p array<struct<lat,lon>>, fclass)`` as GeoPackages with the railway layer, one a task."""
    import pyarrow as pa
    from pyspark import TaskContext

    def put(batches):
        import sqlite3

        number = TaskContext.get().partitionId()
        db = sqlite3.connect(":memory:")
        db.execute("CREATE TABLE gpkg_contents (table_name TEXT)")
        db.execute("INSERT INTO gpkg_contents VALUES (?)", (LAYER,))
        db.execute(f'CREATE TABLE "{LAYER}" (geom BLOB, fclass TEXT)')
        for batch in batches:
            for p, kind in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flat = [v for q in p for v in (q["lon"], q["lat"])]
                db.execute(f'INSERT INTO "{LAYER}" VALUES (?, ?)', (b"GP" + bytes(6) + struct.pack(f"<bII{len(flat)}d", 1, 2, len(p), *flat), kind))
        db.commit()
        (store, place, _), *_ = splits.places_for(f"{folder}/part-{number:05d}.gpkg")
        with store.open_output_stream(place) as f:
            f.write(db.serialize())
        db.close()
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32())], ["number"])

    lines.select("p", "fclass").mapInArrow(put, "number int").count()


def registry_folders(root: str) -> dict[str, str]:
    return {n: f"{root.rstrip('/')}/{n}" for n in ("observations", "canonical", "audit")}


def now_rfc3339() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
