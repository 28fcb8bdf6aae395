"""Planner state in a URL hash, in the strict dialect and in the browser's, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from viaduct.functions.text import encode_component

# Fixed value: the version mark of a state.
VERSION = "v1"


def decode_component(c: Column) -> Column:
    """Percent codes as UTF-8; a plus is a plus. Null where a code isn't one."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def to_hash(trip: Column, interest: Column, population: Column, leg: Column, round_trip: Column, ui: Column) -> Column:
    """``trip`` an array of ids, ``leg`` a struct of min and max or null, ``ui`` a map, written by key."""
    pair = lambda e: F.concat(F.lit("ui."), encode_component(e["key"]), F.lit("="), encode_component(e["value"]))
    head = F.concat_ws(";", F.lit(VERSION), F.concat(F.lit("t="), F.array_join(F.transform(trip, encode_component), ",")), F.concat(F.lit("fi="), interest.cast("string")), F.concat(F.lit("fp="), population.cast("string")))
    legs = F.when(leg.isNotNull(), F.concat(F.lit("ll="), leg["min"].cast("string"), F.lit("-"), leg["max"].cast("string")))
    rest = F.array_join(F.transform(F.array_sort(F.map_entries(ui)), pair), ";")
    return F.concat(F.lit("#"), F.concat_ws(";", head, legs, F.concat(F.lit("rt="), F.when(round_trip, "1").otherwise("0")), F.nullif(rest, F.lit(""))))


def _parts(hash_: Column) -> Column:
    return F.split(F.regexp_replace(hash_, "^#", ""), ";")


def _last(hash_: Column, key: str) -> Column:
    """The value of the last part of that key, null without one."""
    own = F.filter(_parts(hash_), lambda p: p.startswith(f"{key}="))
    return F.when(F.size(own) > 0, F.substring(F.element_at(own, -1), len(key) + 2, 1_000_000))


def _every(hash_: Column, key: str, good) -> Column:
    """Whether all parts of that key have a good value."""
    return F.forall(F.filter(_parts(hash_), lambda p: p.startswith(f"{key}=")), lambda p: F.coalesce(good(F.substring(p, len(key) + 2, 1_000_000)), F.lit(False)))


def _whole(c: Column, most: int) -> Column:
    """A number without a sign of at most ``most``, else null."""
    n = F.try_to_number(F.regexp_extract(c, "^[+]?([0-9]{1,12})$", 1), F.lit("999999999999"))
    return F.when((n <= most), n).cast("long")


def parse_strict(hash_: Column) -> Column:
    """``struct(error, trip, interest, population, leg_min, leg_max, round_trip)``; with an error all else is null."""
    empty = F.regexp_replace(hash_, "^#", "") == ""
    trip = F.coalesce(_last(hash_, "t"), F.lit(""))
    ids = F.when(trip == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(trip, ","), decode_component))
    good_ids = lambda v: (v == "") | F.forall(F.transform(F.split(v, ","), decode_component), lambda x: F.coalesce(x.rlike("^[a-z0-9-]+$"), F.lit(False)))
    leg = lambda v: F.split(v, "-", 2)
    good_leg = lambda v: v.contains("-") & _whole(F.get(leg(v), F.lit(0)), 65_535).isNotNull() & _whole(F.get(leg(v), F.lit(1)), 65_535).isNotNull() & (_whole(F.get(leg(v), F.lit(0)), 65_535) <= _whole(F.get(leg(v), F.lit(1)), 65_535))
    error = (
        F.when(empty, F.lit(None).cast("string"))
        .when(F.get(_parts(hash_), F.lit(0)) != VERSION, "version")
        .when(~_every(hash_, "t", good_ids), "t")
        .when(~_every(hash_, "fi", lambda v: _whole(v, 255).isNotNull()), "fi")
        .when(~_every(hash_, "fp", lambda v: _whole(v, 2**32 - 1).isNotNull()), "fp")
        .when(~_every(hash_, "ll", good_leg), "ll")
    )
    ll = _last(hash_, "ll")
    value = lambda c: F.when(error.isNull(), c)
    return F.struct(
        error.alias("error"), value(F.array_join(ids, ",")).alias("trip"),
        value(F.coalesce(_whole(_last(hash_, "fi"), 255), F.lit(1).cast("long"))).alias("interest"), value(F.coalesce(_whole(_last(hash_, "fp"), 2**32 - 1), F.lit(0).cast("long"))).alias("population"),
        value(_whole(F.get(leg(ll), F.lit(0)), 65_535)).alias("leg_min"), value(_whole(F.get(leg(ll), F.lit(1)), 65_535)).alias("leg_max"), value(F.coalesce(_last(hash_, "rt").isin("1", "true", "yes"), F.lit(False))).alias("round_trip"),
    )


def parse_lossy(hash_: Column) -> Column:
    """As ``parse_strict``, the default state where it has an error."""
    found = parse_strict(hash_)
    bad = found["error"].isNotNull()
    none = F.lit(None).cast("long")
    default = {"trip": F.lit(""), "interest": F.lit(1).cast("long"), "population": F.lit(0).cast("long"), "leg_min": none, "leg_max": none, "round_trip": F.lit(False)}
    return F.struct(*[F.when(bad, v).otherwise(found[k]).alias(k) for k, v in default.items()])


def leading_int(c: Column) -> Column:
    """The whole number a text begins with, as browsers read it."""
    return F.nullif(F.regexp_extract(c, r"^\s*([+-]?[0-9]{1,15})", 1), F.lit("")).cast("long")


def parse_browser(hash_: Column) -> Column:
    """The browser's dialect, which never fails: ``struct(trip, interest, population, manual, leg_min, leg_max, query,
    zoom, lat, lon)``, null for an empty hash or another version."""
    simple = lambda key: F.split(_last(hash_, key), "=")[0]
    trip = F.filter(F.transform(F.split(F.coalesce(simple("t"), F.lit("")), ","), lambda x: F.coalesce(decode_component(x), x)), lambda x: x != "")
    ll = F.split(F.coalesce(simple("ll"), F.lit("")), "-")
    number = lambda c, fallback: F.coalesce(leading_int(c), F.lit(fallback).cast("long"))
    view = parse_view(F.coalesce(decode_component(simple("ui.map")), F.lit("")))
    state = F.struct(
        F.array_join(trip, ",").alias("trip"), number(simple("fi"), 5).alias("interest"), number(simple("fp"), 100).alias("population"), F.coalesce(simple("fpm") == "1", F.lit(False)).alias("manual"),
        number(F.get(ll, F.lit(0)), 0).alias("leg_min"), number(F.get(ll, F.lit(1)), 1440).alias("leg_max"), F.coalesce(decode_component(simple("ui.q")), F.lit("")).alias("query"), view["zoom"].alias("zoom"), view["lat"].alias("lat"), view["lon"].alias("lon"),
    )
    return F.when(F.get(_parts(hash_), F.lit(0)) == VERSION, state)


def parse_view(c: Column) -> Column:
    """``zoom/lat/lon`` as numbers, all null unless each begins with one."""
    part = lambda i: F.nullif(F.regexp_extract(F.get(F.split(c, "/"), F.lit(i)), r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1), F.lit("")).cast("double")
    every = part(0).isNotNull() & part(1).isNotNull() & part(2).isNotNull()
    return F.struct(*[F.when(every, part(i)).alias(n) for i, n in enumerate(("zoom", "lat", "lon"))])
