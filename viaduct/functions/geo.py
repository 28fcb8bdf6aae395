"""Points, projections, predicates and curves as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * RADIUS_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    bound = F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat))
    return clamp((lon + 180) / 360), clamp(0.5 - F.ln(F.tan(math.pi / 4 + F.radians(bound) / 2)) / (2 * math.pi))


def unproject(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * y)))), x * 360 - 180


def scale_for_zoom(zoom: Column) -> Column:
    return 256 * F.pow(F.lit(2.0), zoom)


def encode_e5(c: Column) -> Column:
    return F.when(~F.isnan(c), F.round(c * 100_000).cast("int"))


def plausible_limit_m(direct: Column) -> Column:
    return F.when(direct < 1000, direct + 20_000).when(direct < 30_000, F.greatest(direct * 6, direct + 5000)).when(direct < 100_000, direct * 4).when(direct < 300_000, direct * 3).otherwise(direct * 2.5)


def plausible(path: Column, direct: Column) -> Column:
    return F.when(direct < 1, path <= 1000).otherwise(path <= plausible_limit_m(direct))


def impossible_speed(direct_m: Column, minutes: Column) -> Column:
    return F.when(minutes == 0, True).otherwise(direct_m / 1000 / (minutes / 60) > 380)


def smoothstep(t: Column) -> Column:
    c = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return c * c * (3 - 2 * c)


def curve(x: Column, anchors: list[tuple[float, float]]) -> Column:
    """Piecewise linear through the anchors, constant outside."""
    out = F.lit(float(anchors[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(anchors, anchors[1:], strict=False))):
        out = F.when(x < x1, y0 + (x - x0) / (x1 - x0) * (y1 - y0)).otherwise(out)
    return F.when(x <= anchors[0][0], F.lit(float(anchors[0][1]))).otherwise(out)


def bucket(v: Column) -> Column:
    return F.floor(v * 1000).cast("long")


def world_cell(x: Column, y: Column, size: float) -> Column:
    return F.concat_ws(":", F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))


def local_metres(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    return (lon - lon0) * 111_320.0 * F.greatest(F.cos(F.radians(lat0)), F.lit(0.1)), (lat - lat0) * 111_320.0


def boxes_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Closed intervals ``x0, x1, y0, y1`` of two boxes meet."""
    return (a["x0"] <= b["x1"]) & (a["x1"] >= b["x0"]) & (a["y0"] <= b["y1"]) & (a["y1"] >= b["y0"])


def parse_place(c: Column) -> Column:
    """``struct(lat, lon)`` of a text of two numbers with a comma between, what follows a second one left out; null if either
    isn't a number."""
    part = lambda i: F.trim(F.get(F.split(c, ","), F.lit(i))).try_cast("double")
    return F.when(part(0).isNotNull() & part(1).isNotNull(), F.struct(part(0).alias("lat"), part(1).alias("lon")))
