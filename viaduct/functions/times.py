"""Timetable times and durations: integers, never timestamps, as hours may pass 24."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gtfs_seconds(c: Column) -> Column:
    part = lambda i: F.regexp_extract(c, "^([0-9]+):([0-9]+):([0-9]+)(:.*)?$", i).cast("long")
    return F.when(c.rlike("^[0-9]+:[0-9]+:[0-9]+(:.*)?$"), part(1) * 3600 + part(2) * 60 + part(3))


def ceil_minutes(seconds: Column) -> Column:
    return F.ceil(F.greatest(seconds, F.lit(0)) / 60).cast("long")


def format_minutes(c: Column, zero: str = "0min") -> Column:
    hours, rest = F.floor(c / 60).cast("string"), F.pmod(c, F.lit(60))
    text = F.when(c < 60, F.concat(c.cast("string"), F.lit("min"))).when(rest == 0, F.concat(hours, F.lit("h"))).otherwise(F.concat(hours, F.lit("h"), F.lpad(rest.cast("string"), 2, "0")))
    return F.when(c.isNull(), "—").when(c == 0, zero).otherwise(text)


def dataset_version(c: Column) -> Column:
    return F.replace(F.replace(F.regexp_replace(c, "[:-]", ""), F.lit("T"), F.lit("-")), F.lit("Z"), F.lit(""))
