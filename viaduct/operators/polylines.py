"""Lines as arrays of points ``struct(lat, lon)`` or, on a map, ``struct(x, y)``, and lines as rows.

Arrays serve lines that fit a row; rows ``(line, i, lat, lon)`` serve the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.functions.geo import haversine_m
from viaduct.operators.ranks import position
from viaduct.operators.tables import cut, join_skewed

# How a timetable shape is cut and snapped, and when a line on the map is suspect.
SNAP_M, CUTOFF_M = 350.0, 25_000.0
LEAST_CHORD, LEAST_RATIO = 0.005, 1.02


def metres(a: Column, b: Column) -> Column:
    return haversine_m(a["lat"], a["lon"], b["lat"], b["lon"])


def steps(points: Column, f) -> Column:
    """``f`` of each point and the next one."""
    n = F.greatest(F.size(points) - 1, F.lit(0))
    return F.zip_with(F.slice(points, F.lit(1), n), F.slice(points, F.lit(2), n), f)


def length_m(points: Column) -> Column:
    """Whole metres: each step is rounded before the sum."""
    return F.aggregate(steps(points, lambda a, b: F.round(metres(a, b)).cast("long")), F.lit(0).cast("long"), lambda t, x: t + x)


def flat_length(points: Column) -> Column:
    far = lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], F.lit(2.0)) + F.pow(b["y"] - a["y"], F.lit(2.0)))
    return F.aggregate(steps(points, far), F.lit(0.0), lambda t, x: t + x)


def midpoint(rows: DataFrame) -> DataFrame:
    """``line, x, y``: the place half way along ``(line, i, x, y)``, between its neighbours as far as the way goes."""
    way = Window.partitionBy("line").orderBy("i")
    step = rows.withColumn("px", F.lag("x").over(way)).withColumn("py", F.lag("y").over(way))
    step = step.withColumn("d", F.coalesce(F.sqrt(F.pow(F.col("x") - F.col("px"), F.lit(2.0)) + F.pow(F.col("y") - F.col("py"), F.lit(2.0))), F.lit(0.0)))
    run = step.withColumn("run", F.sum("d").over(way)).withColumn("half", F.sum("d").over(Window.partitionBy("line")) / 2)
    t = F.when(F.col("d") > 0, (F.col("half") - (F.col("run") - F.col("d"))) / F.col("d")).otherwise(0.0)
    hit = run.where("run >= half").groupBy("line").agg(F.min_by(F.struct(F.coalesce(F.col("px") + (F.col("x") - F.col("px")) * t, "x").alias("x"), F.coalesce(F.col("py") + (F.col("y") - F.col("py")) * t, "y").alias("y")), "i").alias("p"))
    return hit.select("line", "p.x", "p.y")


def decimate(points: Column, gap: float) -> Column:
    """The first and last point and those at least ``gap`` from the last one kept."""
    inner = F.slice(points, F.lit(2), F.greatest(F.size(points) - 2, F.lit(0)))
    start = F.struct(F.array(F.get(points, F.lit(0))).alias("kept"), F.get(points, F.lit(0)).alias("at"))

    def step(acc, p):
        far = F.pow(p["x"] - acc["at"]["x"], F.lit(2.0)) + F.pow(p["y"] - acc["at"]["y"], F.lit(2.0)) >= gap * gap
        return F.struct(F.when(far, F.concat(acc["kept"], F.array(p))).otherwise(acc["kept"]).alias("kept"), F.when(far, p).otherwise(acc["at"]).alias("at"))

    thin = F.aggregate(inner, start, step, lambda acc: F.concat(acc["kept"], F.array(F.element_at(points, -1))))
    return F.when((F.size(points) <= 2) | F.lit(gap <= 0), points).otherwise(thin)


def concat_lines(parts: Column) -> Column:
    """One line of several, without a point equal to the one before it."""
    flat = F.flatten(parts)
    apart = lambda p, i: (i == 0) | (p != F.get(flat, i - 1))
    return F.filter(flat, apart)


def _argmin(points: Column, target: Column, first: Column) -> Column:
    """``struct(d, i)``, distance and place from 0, of the nearest point at or after ``first``."""
    rest = F.slice(points, first + 1, F.size(points) - first)
    return F.array_min(F.transform(rest, lambda p, i: F.struct(metres(p, target).alias("d"), (i + first).alias("i"))))


def nearest_vertices(points: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """The point nearest to ``a``, and the one nearest to ``b`` at or after it."""
    start = _argmin(points, a, F.lit(0))
    return start, _argmin(points, b, start["i"])


def shape_between(points: Column, a: Column, b: Column, snap: float = SNAP_M, cutoff: float = CUTOFF_M) -> Column:
    """The stretch of a shape from ``a`` to ``b``, ends put on them, or before and after where they are
    further than ``snap``; null if the shape runs the other way or either is beyond ``cutoff``."""
    start, end = nearest_vertices(points, a, b)
    cut = F.slice(points, start["i"] + 1, end["i"] - start["i"] + 1)
    inner = F.slice(cut, F.lit(2), F.size(cut) - 2)
    head = F.when(start["d"] > snap, F.array(a, F.get(points, start["i"]))).otherwise(F.array(a))
    tail = F.when(end["d"] > snap, F.array(F.get(points, end["i"]), b)).otherwise(F.array(b))
    good = (F.size(points) >= 2) & (end["i"] > start["i"]) & (start["d"] <= cutoff) & (end["d"] <= cutoff)
    return F.when(good, F.concat(head, inner, tail))


def with_previous(rows: DataFrame, per_task: int = 200_000) -> DataFrame:
    """Points ``(line, i, lat, lon)`` with ``b``, the point before each of its line. Lines are cut in blocks, ranges of line
    and ``i``; a block's first point takes the last one of the block before, so a line of any length is many tasks."""
    parts = max(1, -(-rows.count() // per_task))
    ranged = cut(rows.select("line", "i", "lat", "lon").repartitionByRange(parts, "line", "i").withColumn("_part", F.spark_partition_id()))
    last = ranged.groupBy("line", "_part").agg(F.max_by(F.struct("lat", "lon"), "i").alias("_last"))
    edge = last.select("line", "_part", F.lag("_last").over(Window.partitionBy("line").orderBy("_part")).alias("_edge"))
    inside = F.lag(F.struct("lat", "lon")).over(Window.partitionBy("line", "_part").orderBy("i"))
    out = ranged.withColumn("_b", inside).join(edge, ["line", "_part"])
    return out.select("line", "i", "lat", "lon", F.coalesce("_b", "_edge").alias("b"))


def lengths(rows: DataFrame) -> DataFrame:
    """``line, metres`` of points as rows; each step is rounded before the sum."""
    step = haversine_m(F.col("b.lat"), F.col("b.lon"), F.col("lat"), F.col("lon"))
    return with_previous(rows).groupBy("line").agg(F.sum(F.coalesce(F.round(step).cast("long"), F.lit(0).cast("long"))).alias("metres"))


def nearest_rows(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(line, alat, alon, blat, blon)``, one row a line, with ``start``, ``d1``, ``finish`` and ``d2``: where the point
    nearest to ``a`` stands on the line and how far, and the one nearest to ``b`` at or after it. Points meet the row of
    their line where they are if the line is long, and are added up before they are dealt."""
    off = lambda y, x: haversine_m(F.col("lat"), F.col("lon"), F.col(y), F.col(x))
    points = rows.select("line", "i", "lat", "lon")
    first = cut(join_skewed(points, asked, "line").groupBy("line").agg(F.min(F.struct(off("alat", "alon").alias("d"), "i")).alias("s")))
    known = cut(asked.join(first.select("line", F.col("s.i").alias("start"), F.col("s.d").alias("d1")), "line"))
    last = join_skewed(points, known, "line").where("i >= start").groupBy("line").agg(F.min(F.struct(off("blat", "blon").alias("d"), "i")).alias("e"))
    return cut(known.join(last.select("line", F.col("e.i").alias("finish"), F.col("e.d").alias("d2")), "line"))


def shape_rows(rows: DataFrame, asked: DataFrame, snap: float = SNAP_M, cutoff: float = CUTOFF_M) -> DataFrame:
    """``line, i, j, lat, lon``: the stretches of ``shape_between`` as rows, in order of ``i`` and ``j``."""
    near = nearest_rows(rows, asked).where((F.col("finish") > F.col("start")) & (F.col("d1") <= cutoff) & (F.col("d2") <= cutoff))
    within = join_skewed(rows.select("line", "i", "lat", "lon"), near, "line").where("i between start and finish")
    kept = within.where(((F.col("i") != F.col("start")) | (F.col("d1") > snap)) & ((F.col("i") != F.col("finish")) | (F.col("d2") > snap)))
    end = lambda i, j, p: near.select("line", F.col(i).alias("i"), F.lit(j).alias("j"), F.col(f"{p}lat").alias("lat"), F.col(f"{p}lon").alias("lon"))
    return kept.select("line", "i", F.lit(0).alias("j"), "lat", "lon").unionByName(end("start", -1, "a")).unionByName(end("finish", 1, "b"))


def densify(rows: DataFrame, spacing: float = 500.0) -> DataFrame:
    """Rows ``(line, i, lat, lon)`` as segments cut into equal pieces of at most ``spacing`` metres:
    ``line, i, j, lat, lon`` with ``j`` from 1, and the line's first point as ``i`` 0 and ``j`` 0."""
    seg = position(with_previous(rows), "i", key=["line"]).withColumn("n", F.col("position").cast("int")).drop("position")
    pieces = F.greatest(F.ceil(haversine_m(F.col("b.lat"), F.col("b.lon"), F.col("lat"), F.col("lon")) / spacing), F.lit(1)).cast("int")
    cut = seg.where("b is not null").withColumn("pieces", pieces).withColumn("j", F.explode(F.sequence(F.lit(1), F.col("pieces"))))
    t = F.col("j") / F.col("pieces")
    between = lambda c: F.when(F.col("j") == F.col("pieces"), F.col(c)).otherwise(F.col(f"b.{c}") + (F.col(c) - F.col(f"b.{c}")) * t)
    out = cut.select("line", F.col("n").alias("i"), "j", between("lat").alias("lat"), between("lon").alias("lon"))
    return out.union(seg.where("n = 0").select("line", "n", F.lit(0), "lat", "lon"))


def to_segment(px: Column, py: Column, a: Column, b: Column) -> Column:
    """Distance of a point on the map to a segment."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - a["x"]) * dx + (py - a["y"]) * dy) / square))).otherwise(0.0)
    return F.sqrt(F.pow(px - (a["x"] + t * dx), F.lit(2.0)) + F.pow(py - (a["y"] + t * dy), F.lit(2.0)))


def to_polyline(px: Column, py: Column, points: Column) -> Column:
    """Distance of a point to a line; of a line of one point to that; infinite to none."""
    one = F.get(points, F.lit(0))
    alone = F.sqrt(F.pow(px - one["x"], F.lit(2.0)) + F.pow(py - one["y"], F.lit(2.0)))
    return F.when(F.size(points) == 0, F.lit(float("inf"))).when(F.size(points) == 1, alone).otherwise(F.array_min(steps(points, lambda a, b: to_segment(px, py, a, b))))


def straight_suspect(a: Column, b: Column, points: Column, least: float = LEAST_CHORD, ratio: float = LEAST_RATIO) -> Column:
    """Whether a long edge is drawn nearly as its chord, as one without geometry is."""
    chord = F.sqrt(F.pow(b["x"] - a["x"], F.lit(2.0)) + F.pow(b["y"] - a["y"], F.lit(2.0)))
    line = F.when(F.coalesce(F.size(points), F.lit(0)) >= 2, points).otherwise(F.array(a, b))
    return F.when(chord <= least, False).otherwise(flat_length(line) / chord < ratio)


def meets_view(points: Column, view: tuple[float, float, float, float]) -> Column:
    """Whether a line has a point in the view ``(x0, x1, y0, y1)`` or a step whose box meets it."""
    x0, x1, y0, y1 = view
    inside = lambda p: p["x"].between(x0, x1) & p["y"].between(y0, y1)
    box = lambda a, b: (F.least(a["x"], b["x"]) <= x1) & (F.greatest(a["x"], b["x"]) >= x0) & (F.least(a["y"], b["y"]) <= y1) & (F.greatest(a["y"], b["y"]) >= y0)
    return F.exists(points, inside) | F.exists(steps(points, box), lambda hit: hit)


def line_box(points: Column, *ends: Column) -> Column:
    every = F.concat(F.coalesce(points, F.array().cast("array<struct<x:double,y:double>>")), F.array(*ends)) if ends else points
    of = lambda f, c: f(F.transform(every, lambda p: p[c]))
    return F.struct(of(F.array_min, "x").alias("x0"), of(F.array_max, "x").alias("x1"), of(F.array_min, "y").alias("y0"), of(F.array_max, "y").alias("y1"))


def decode_e5(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["lat_e5"] / 100_000).alias("lat"), (p["lon_e5"] / 100_000).alias("lon")))


def polygons(records: Column) -> Column:
    """Polygons of border records ``{"t": "P" or "M", "c": coordinates}``, their rings of at least three
    points; polygons without such a ring are left out."""
    flat = "array<array<array<double>>>"
    one = F.array(F.from_json(F.get_json_object(records, "$.c"), flat))
    many = F.from_json(F.get_json_object(records, "$.c"), f"array<{flat}>")
    kind = F.get_json_object(records, "$.t")
    every = F.coalesce(F.when(kind == "P", one).when(kind == "M", many), F.array().cast(f"array<{flat}>"))
    rings = F.transform(every, lambda polygon: F.filter(F.coalesce(polygon, F.array().cast(flat)), lambda ring: F.size(ring) >= 3))
    return F.filter(rings, lambda polygon: F.size(polygon) > 0)
