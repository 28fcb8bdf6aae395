"""Scalar functions over names, points and numbers derived from the tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.functions import geo, text, times

PREFIXES = ["", "Bus ", "S U ", "St ", "u ", "bus12 ", "La ", "Gare "]
SUFFIXES = ["", " Hbf", " Gare Centrale", " 12 Rue", " S U", " Busbahnhof", " U Tram", " Platz", " Saint de", " Bf", " ZOB", " Straße", " station nord", " Hauptbahnhof hbf", " (Élan) & \"Cø\"", "  É-1 Bourg"]


def names(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda words, i: F.element_at(F.array(*[F.lit(w) for w in words]), (i % len(words) + 1).cast("int"))
    return spark.read.parquet(f"{d}/part.parquet").select(k.alias("k"), F.concat(pick(PREFIXES, k), "p_name", pick(SUFFIXES, F.floor(k / 8))).alias("name"))


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


NAMES_SQL = f"(SELECT p_partkey AS k, {_list(PREFIXES)}[1 + p_partkey % 8] || p_name || {_list(SUFFIXES)}[1 + (p_partkey // 8) % 16] AS name FROM part)"


def points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    lat, lon = lambda a: 36.0 + (k * a) % 250 / 10.0, lambda a: -9.0 + (k * a) % 340 / 10.0
    return spark.read.parquet(f"{d}/customer.parquet").select(k.alias("k"), lat(37).alias("lat"), lon(53).alias("lon"), lat(91).alias("lat2"), lon(17).alias("lon2"), lat(13).alias("lat3"), lon(29).alias("lon3"), (k % 900).alias("mins"), (k * 7919 % 3_000_000).alias("pop"), (k % 130 / 10.0).alias("zoom"), F.col("c_acctbal").alias("bal"))


POINTS_SQL = "(SELECT c_custkey AS k, 36.0::DOUBLE + ((c_custkey*37)%250)/10.0::DOUBLE AS lat, -9.0::DOUBLE + ((c_custkey*53)%340)/10.0::DOUBLE AS lon, 36.0::DOUBLE + ((c_custkey*91)%250)/10.0::DOUBLE AS lat2, -9.0::DOUBLE + ((c_custkey*17)%340)/10.0::DOUBLE AS lon2, 36.0::DOUBLE + ((c_custkey*13)%250)/10.0::DOUBLE AS lat3, -9.0::DOUBLE + ((c_custkey*29)%340)/10.0::DOUBLE AS lon3, c_custkey % 900 AS mins, c_custkey * 7919 % 3000000 AS pop, (c_custkey % 130)/10.0::DOUBLE AS zoom, c_acctbal AS bal FROM customer)"


# --- SQL twins of the text functions -------------------------------------------------------


def q_norm(x: str) -> str:
    out = f"lower({x})"
    for a, b in text.FOLD_PAIRS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace(translate({out}, '{text.FOLD_FROM}', '{text.FOLD_TO}'), '[^a-z0-9]+', ' ', 'g'))"


def q_title(x: str) -> str:
    return f"array_to_string(list_transform(string_split(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' '), lambda w: upper(w[1:1]) || w[2:]), ' ')"


def q_strip(x: str, words: list[str]) -> str:
    return f"trim(regexp_replace(' ' || {x}, '( {text.any_of(words)})+$', ''))"


def q_usable(x: str) -> str:
    return f"({x} <> '' AND {x} <> 's u' AND {x} NOT IN ({', '.join(repr(w) for w in text.LONE_WORDS)}))"


def q_clean(x: str) -> str:
    return f"regexp_replace({q_norm(x)}, '( {text.any_of(text.STATION_PAIRS + text.STATION_WORDS)})+$', '')"


def q_comparable(x: str) -> str:
    tokens = f"list_transform(string_split({q_norm(x)}, ' '), lambda t: CASE t WHEN 'st' THEN 'saint' WHEN 'ste' THEN 'sainte' ELSE t END)"
    kept = q_strip(f"array_to_string({tokens}, ' ')", text.STATION_TAIL)
    return f"array_to_string(list_filter(string_split({kept}, ' '), lambda t: t <> '' AND t NOT IN ({', '.join(repr(w) for w in text.STOP_WORDS)})), ' ')"


def q_route(x: str) -> str:
    head = f"trim(regexp_replace(' ' || {q_norm(x)}, ' ([a-z]*[0-9][a-z0-9]*|{'|'.join(text.STREET_WORDS)})( .*)?$', ''))"
    head = q_strip(q_strip(head, text.ROUTE_NOISE), text.ROUTE_PLACES)
    return f"CASE WHEN {head} <> '' THEN {q_comparable(head)} END"


def q_urban(x: str) -> str:
    name = f"trim(regexp_replace({q_norm(x)}, '^(s u|u)( |$)', ''))"
    name = q_strip(q_strip(name, text.URBAN_TAIL), ["s"])
    return f"CASE WHEN {name} <> '' THEN coalesce(nullif({q_comparable(name)}, ''), {name}) END"


def q_interchange(n: str) -> str:
    return f"regexp_matches({n}, '( u| zob)$|^s u( |$)| s u| busbahnhof')"


def q_eligible(x: str) -> str:
    n = q_norm(x)
    return f"CASE WHEN regexp_matches({n}, '^bus([0-9]+)?( .*)?$|^busbahnhof$|^bussteige ') OR (regexp_matches({n}, '^[a-z0-9]+$') AND regexp_matches({n}, '[0-9]')) THEN 'station_only_label' WHEN {q_interchange(n)} THEN 'urban_interchange' WHEN regexp_matches({n}, '[0-9]') THEN 'route_like' ELSE 'eligible' END"


def q_stem(x: str) -> str:
    n, w = q_norm(x), text.any_of(text.IDENTITY_WORDS)
    cut = f"regexp_replace({n}, '^([a-z0-9]+( [a-z0-9]+)*?) {w}( .*)?$', '\\1')"
    return f"CASE WHEN {cut} <> {n} THEN {cut} ELSE trim(regexp_replace({n}, '{text.any_of(text.STATION_PAIRS)}$', '')) END"


def q_qualified(x: str) -> str:
    return f"regexp_matches({q_norm(x)}, ' {text.any_of(text.IDENTITY_WORDS)}( |$)|{text.any_of(text.STATION_PAIRS)}$')"


def q_hash(x: str) -> str:
    return f"substr(md5({x}), 1, 8)"


def q_escape(x: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def q_hav(a: str, b: str, c: str, d: str) -> str:
    h = f"(pow(sin((radians({c})-radians({a}))/2), 2) + cos(radians({a}))*cos(radians({c}))*pow(sin((radians({d})-radians({b}))/2), 2))"
    return f"(2*6371000.0*atan2(sqrt({h}), sqrt(1-{h})))"


def q_curve(x: str, anchors) -> str:
    out = f"{float(anchors[-1][1])}"
    for (x0, y0), (x1, y1) in reversed(list(zip(anchors, anchors[1:], strict=False))):
        out = f"CASE WHEN {x} < {x1} THEN {y0} + ({x} - {x0}) / ({x1} - {x0})::DOUBLE * ({y1} - {y0}) ELSE {out} END"
    return f"(CASE WHEN {x} <= {anchors[0][0]} THEN {float(anchors[0][1])} ELSE {out} END)::DOUBLE"


def q_minutes(x: str, zero: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '—' WHEN {x} = 0 THEN '{zero}' WHEN {x} < 60 THEN {x} || 'min' WHEN {x} % 60 = 0 THEN ({x} // 60) || 'h' ELSE ({x} // 60) || 'h' || lpad(({x} % 60)::VARCHAR, 2, '0') END"


# Columns are built when a query runs, as they need a session; SQL is plain text.
C, R = F.col, F.round


def _column(name: str):
    return lambda: C(name)


N, LAT, LON, LAT2, LON2, LAT3, LON3 = map(_column, ("name", "lat", "lon", "lat2", "lon2", "lat3", "lon3"))
HAV, Q_HAV = lambda: geo.haversine_m(LAT(), LON(), LAT2(), LON2()), q_hav("lat", "lon", "lat2", "lon2")
MX, MY = lambda: geo.mercator(LAT(), LON())[0], lambda: geo.mercator(LAT(), LON())[1]
Q_MX, Q_MY = "((lon + 180) / 360)", "(0.5 - ln(tan(pi()/4 + radians(lat)/2)) / (2*pi()))"
MX2, MY2 = lambda: geo.mercator(LAT2(), LON2())[0], lambda: geo.mercator(LAT2(), LON2())[1]
Q_MX2, Q_MY2 = Q_MX.replace("lon", "lon2"), Q_MY.replace("lat", "lat2")
UX, UY = lambda: geo.unproject(MX(), MY())[0], lambda: geo.unproject(MX(), MY())[1]
LX, LY = lambda: geo.local_metres(LAT2(), LON2(), LAT(), LON())[0], lambda: geo.local_metres(LAT2(), LON2(), LAT(), LON())[1]
Q_LX, Q_LY = "((lon2 - lon) * 111320.0 * greatest(cos(radians(lat)), 0.1))", "((lat2 - lat) * 111320.0)"
PX, PY = lambda: geo.local_metres(LAT3(), LON3(), LAT(), LON())[0], lambda: geo.local_metres(LAT3(), LON3(), LAT(), LON())[1]
Q_PX, Q_PY = Q_LX.replace("lon2", "lon3"), Q_LY.replace("lat2", "lat3")
T = lambda: F.when(LX() * LX() + LY() * LY() > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (PX() * LX() + PY() * LY()) / (LX() * LX() + LY() * LY())))).otherwise(0.0)
Q_T = f"(CASE WHEN {Q_LX}*{Q_LX} + {Q_LY}*{Q_LY} > 0 THEN greatest(0.0, least(1.0, ({Q_PX}*{Q_LX} + {Q_PY}*{Q_LY}) / ({Q_LX}*{Q_LX} + {Q_LY}*{Q_LY}))) ELSE 0.0 END)::DOUBLE"
# Zoom and population threshold in thousands.
POP_ANCHORS = [(4, 500), (5, 300), (6, 150), (7, 70), (8, 30), (9, 12), (9.5, 8), (10.5, 0)]
LIMIT = lambda: geo.plausible_limit_m(HAV())
Q_LIMIT = f"(CASE WHEN {Q_HAV} < 1000 THEN {Q_HAV} + 20000 WHEN {Q_HAV} < 30000 THEN greatest({Q_HAV}*6, {Q_HAV}+5000) WHEN {Q_HAV} < 100000 THEN {Q_HAV}*4 WHEN {Q_HAV} < 300000 THEN {Q_HAV}*3 ELSE {Q_HAV}*2.5 END)"
PATH = lambda: geo.haversine_m(LAT(), LON(), LAT3(), LON3()) + geo.haversine_m(LAT3(), LON3(), LAT2(), LON2())
Q_PATH = f"({q_hav('lat', 'lon', 'lat3', 'lon3')} + {q_hav('lat3', 'lon3', 'lat2', 'lon2')})"
RAMP = lambda: (F.ln("pop") - F.ln(F.lit(40_000.0))) / (F.ln(F.lit(62_500.0)) - F.ln(F.lit(40_000.0)))
Q_RAMP = "((ln(pop) - ln(40000.0::DOUBLE)) / (ln(62500.0::DOUBLE) - ln(40000.0::DOUBLE)))"
BOX_A = lambda: {"x0": F.least("lon", "lon2"), "x1": F.greatest("lon", "lon2"), "y0": F.least("lat", "lat2"), "y1": F.greatest("lat", "lat2")}
VIEW = lambda: {"x0": F.lit(0.0), "x1": F.lit(8.0), "y0": F.lit(45.0), "y1": F.lit(50.0)}

#: key: (base, {column: (Column, SQL)})
SCALARS = {
    "fn_s1": ("names", {"v": (lambda: text.normalize_name(N()), q_norm("name"))}),
    "fn_s2": ("names", {"v": (lambda: text.normalize_query(N()), "trim(translate(lower(name), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'))")}),
    "fn_s3": ("names", {"v": (lambda: text.slugify(N()), f"replace({q_norm('name')}, ' ', '-')")}),
    "fn_s4": ("names", {"v": (lambda: text.registry_slug(N()), f"replace({q_norm('name')}, ' ', '-')")}),
    "fn_s5": ("names", {"v": (lambda: text.title_case(N()), q_title("name"))}),
    "fn_s8": ("names", {"v": (lambda: text.cleaned_city_name(N()), f"CASE WHEN {q_clean('name')} = '' THEN 'Unknown' ELSE {q_title(q_clean('name'))} END")}),
    "fn_s9": ("names", {"usable": (lambda: text.name_quality(N())["usable"], f"{q_usable(q_norm('name'))}::INT"), "tokens": (lambda: text.name_quality(N())["tokens"], f"len(string_split({q_norm('name')}, ' '))::INT"), "bytes": (lambda: text.name_quality(N())["bytes"], f"strlen({q_norm('name')})::INT")}),
    "fn_s10": ("names", {"v": (lambda: text.route_parent_key(N()), q_route("name"))}),
    "fn_s11": ("names", {"v": (lambda: text.urban_parent_key(N()), q_urban("name"))}),
    "fn_s12": ("names", {"v": (lambda: text.comparable_key(N()), q_comparable("name"))}),
    "fn_s13": ("names", {"v": (lambda: text.fallback_urban_name(N()), f"CASE WHEN {q_usable(q_norm('name'))} AND NOT regexp_matches({q_norm('name')}, '^[^ ]*{text.any_of(text.STOP_ENDINGS)}$') THEN {q_title(q_norm('name'))} END")}),
    "fn_s14": ("names", {"v": (lambda: text.parent_display_name(N()), f"CASE WHEN {q_usable(q_norm('name'))} THEN {q_title(q_norm('name'))} END")}),
    "fn_s19": ("names", {"v": (lambda: text.encode_component(N()), "replace(url_encode(name), '%3A', ':')")}),
    "fn_s20": ("names", {"v": (lambda: text.identity_key(N(), F.lit(" FR ")), f"{q_stem('name')} || '|fr'")}),
    "fn_s23": ("points", {"v": (lambda: text.french_commune((75_090 + C("k") % 40).cast("string")), "CASE WHEN 75090 + k % 40 BETWEEN 75101 AND 75120 THEN '75056' ELSE (75090 + k % 40)::VARCHAR END"), "w": (lambda: text.french_commune((69_378 + C("k") % 15).cast("string")), "CASE WHEN 69378 + k % 15 BETWEEN 69381 AND 69389 THEN '69123' ELSE (69378 + k % 15)::VARCHAR END"), "x": (lambda: text.french_commune((13_195 + C("k") % 25).cast("string")), "CASE WHEN 13195 + k % 25 BETWEEN 13201 AND 13216 THEN '13055' ELSE (13195 + k % 25)::VARCHAR END")}),
    "fn_s24": ("names", {"v": (lambda: text.slugify(N()).rlike("^[a-z0-9-]+$"), "true"), "raw": (lambda: N().rlike("^[a-z0-9-]+$"), "regexp_full_match(name, '[a-z0-9-]+')")}),
    "fn_s25": ("names", {"v": (lambda: text.stable_hash(N()), q_hash("name"))}),
    "fn_s26": ("names", {"v": (lambda: text.stable_city_id(N(), text.slugify(N()), F.when(C("k") % 2 == 0, "FR").otherwise("DE"), F.when(C("k") % 3 == 0, "75056")), f"CASE WHEN k % 2 <> 0 THEN replace({q_norm('name')}, ' ', '-') || '-de-' || {q_hash('name')} WHEN k % 3 = 0 THEN replace({q_norm('name')}, ' ', '-') || '-fr-75056' ELSE replace({q_norm('name')}, ' ', '-') || '-zz-' || {q_hash('name')} END")}),
    "fn_s27": ("names", {"v": (lambda: text.fallback_cluster_key(N(), F.when(C("k") % 3 == 0, C("k").cast("string")), C("k") / 8.0, C("k") / 16.0), f"'fallback-' || replace({q_norm('name')}, ' ', '-') || '-' || CASE WHEN k % 3 = 0 THEN k::VARCHAR ELSE round(k / 8.0::DOUBLE * 1000)::INT || '-' || round(k / 16.0::DOUBLE * 1000)::INT END")}),
    "fn_s30": ("names", {"v": (lambda: text.escape_html(N()), q_escape("name"))}),
    "fn_s32": ("names", {"pair": (lambda: text.classify_pair(N(), F.lit("FR"), F.regexp_replace(N(), "(?i)bus |hbf", ""), F.when(C("k") % 5 == 0, "DE").otherwise("FR")), f"CASE WHEN k % 5 <> 0 AND {q_stem('name')} = {q_stem('other')} AND ({q_qualified('name')} OR {q_qualified('other')}) THEN 'station_variant' WHEN k % 5 <> 0 AND {q_stem('name')} = {q_stem('other')} THEN 'true_duplicate' WHEN lower(name) = lower(other) AND k % 5 = 0 THEN 'homonym' ELSE 'unresolved_city' END".replace("other", "regexp_replace(name, '(?i)bus |hbf', '', 'g')"))}),
    "flt_4": ("names", {"v": (lambda: text.placeholder_station(N()), f"regexp_matches({q_norm('name')}, '^(bus[0-9]*|bahn|(bus|bahn) [^ ]+)$')")}),
    "flt_5": ("names", {"v": (lambda: text.city_eligibility(N()), q_eligible("name"))}),
    "flt_6": ("names", {"v": (lambda: text.urban_interchange(text.normalize_name(N())), q_interchange(q_norm("name")))}),
    "flt_7": ("names", {"v": (lambda: text.usable_prefix(text.normalize_name(N())), q_usable(q_norm("name")))}),
    "flt_23": ("names", {"v": (lambda: text.station_qualified(N()), q_qualified("name"))}),
    "val_9": ("names", {"v": (lambda: text.classify_name_issue(F.when(C("k") % 4 == 0, F.substring(N(), 1, 3)).otherwise(N())), "CASE WHEN lower(trim(nm)) IN ('bus', 'bahn') OR lower(trim(nm)) LIKE 'bus %' THEN 'placeholder_stop' WHEN strlen(trim(nm)) <= 3 AND regexp_matches(trim(nm), '[A-Z]') THEN 'feed_abbreviation' END".replace("nm", "CASE WHEN k % 4 = 0 THEN name[1:3] ELSE name END"))}),
    "var_7": ("names", {"v": (lambda: text.normalize_name(N()), q_norm("name"))}),
    "fn_c2": ("names", {"v": (lambda: text.non_empty(F.when(C("k") % 3 == 0, F.lit("  ")).otherwise(N())), "CASE WHEN k % 3 = 0 THEN NULL ELSE trim(name) END")}),
    "fn_d1": ("points", {"v": (lambda: times.gtfs_seconds(F.when(C("k") % 11 == 0, F.lit("8:xx:00")).otherwise(F.concat_ws(":", (C("k") % 31).cast("string"), F.lpad((C("k") % 60).cast("string"), 2, "0"), F.lit("07")))), "CASE WHEN k % 11 <> 0 THEN (k % 31) * 3600 + (k % 60) * 60 + 7 END")}),
    "fn_d2": ("points", {"v": (lambda: times.ceil_minutes(C("mins") * 37 - 900), "ceil(greatest(mins * 37 - 900, 0) / 60.0)::BIGINT")}),
    "fn_d3": ("points", {"v": (lambda: times.format_minutes(F.when(C("k") % 13 != 0, C("mins"))), q_minutes("(CASE WHEN k % 13 <> 0 THEN mins END)", "0min"))}),
    "fn_d4": ("points", {"v": (lambda: times.format_minutes(C("mins"), "0h"), q_minutes("mins", "0h"))}),
    "fn_d5": ("points", {"v": (lambda: times.dataset_version(F.concat(F.lit("2026-05-25T16:32:"), F.lpad((C("k") % 60).cast("string"), 2, "0"), F.lit("Z"))), "'20260525-1632' || lpad((k % 60)::VARCHAR, 2, '0')")}),
    "fn_m1": ("points", {"v": (lambda: R(HAV(), 3), f"round({Q_HAV}, 3)")}),
    "fn_m2": ("points", {"v": (lambda: R(HAV() / 1000, 6), f"round({Q_HAV} / 1000, 6)")}),
    "fn_m3": ("points", {"x": (lambda: R(MX(), 9), f"round({Q_MX}, 9)"), "y": (lambda: R(MY(), 9), f"round({Q_MY}, 9)")}),
    "fn_m4": ("points", {"lat_back": (lambda: R(UX(), 6), "round(lat, 6)"), "lon_back": (lambda: R(UY(), 6), "round(lon, 6)")}),
    "fn_m5": ("points", {"v": (lambda: R(geo.scale_for_zoom(C("zoom")), 6), "round(256 * pow(2.0::DOUBLE, zoom), 6)")}),
    "fn_m6": ("points", {"x": (lambda: R((MX() - 0.5) * geo.scale_for_zoom(C("zoom")) + 400, 4), f"round(({Q_MX} - 0.5) * (256 * pow(2.0::DOUBLE, zoom)) + 400, 4)"), "y": (lambda: R((MY() - 0.35) * geo.scale_for_zoom(C("zoom")) + 300, 4), f"round(({Q_MY} - 0.35) * (256 * pow(2.0::DOUBLE, zoom)) + 300, 4)")}),
    "fn_m7": ("points", {"v": (lambda: R(F.log2(F.least(800 / F.greatest(F.lit(0.000001), F.abs(MX2() - MX())), 600 / F.greatest(F.lit(0.000001), F.abs(MY2() - MY()))) / 256), 6), f"round(log2(least(800 / greatest(0.000001::DOUBLE, abs({Q_MX2} - {Q_MX})), 600 / greatest(0.000001::DOUBLE, abs({Q_MY2} - {Q_MY}))) / 256), 6)")}),
    "fn_m9": ("points", {"lat_mid": (lambda: R(geo.unproject((MX() + MX2()) / 2, (MY() + MY2()) / 2)[0], 6), f"round(degrees(atan(sinh(pi() * (1 - 2 * (({Q_MY} + {Q_MY2}) / 2))))), 6)"), "lon_mid": (lambda: R(geo.unproject((MX() + MX2()) / 2, (MY() + MY2()) / 2)[1], 6), f"round((({Q_MX} + {Q_MX2}) / 2) * 360 - 180, 6)")}),
    "fn_m11": ("points", {"v": (lambda: R(geo.curve(C("zoom"), POP_ANCHORS), 6), f"round({q_curve('zoom', POP_ANCHORS)}, 6)")}),
    "fn_m13": ("points", {"v": (lambda: R(geo.smoothstep(C("zoom") / 10 - 0.1), 9), "round(pow(greatest(0.0::DOUBLE, least(1.0::DOUBLE, zoom / 10 - 0.1)), 2) * (3 - 2 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, zoom / 10 - 0.1))), 9)")}),
    "fn_m14": ("points", {"v": (lambda: R(F.when(C("pop") >= 62_500, 1.0).when(C("pop") <= 40_000, 0.0).otherwise(geo.smoothstep(RAMP())), 9), f"round(CASE WHEN pop >= 62500 THEN 1.0::DOUBLE WHEN pop <= 40000 THEN 0.0::DOUBLE ELSE pow({Q_RAMP}, 2) * (3 - 2 * {Q_RAMP}) END, 9)")}),
    "fn_m16": ("points", {"t": (lambda: R(T(), 9), f"round({Q_T}, 9)"), "dist": (lambda: R(F.sqrt(F.pow(PX() - T() * LX(), F.lit(2.0)) + F.pow(PY() - T() * LY(), F.lit(2.0))), 3), f"round(sqrt(pow({Q_PX} - {Q_T} * {Q_LX}, 2) + pow({Q_PY} - {Q_T} * {Q_LY}, 2)), 3)")}),
    "fn_m17": ("points", {"x": (lambda: R(LX(), 3), f"round({Q_LX}, 3)"), "y": (lambda: R(LY(), 3), f"round({Q_LY}, 3)")}),
    "fn_m18": ("points", {"lat_i": (lambda: R(LAT() + (LAT2() - LAT()) * 0.25, 6), "round(lat + (lat2 - lat) * 0.25, 6)"), "lon_i": (lambda: R(LON() + (LON2() - LON()) * 0.25, 6), "round(lon + (lon2 - lon) * 0.25, 6)")}),
    "fn_m19": ("points", {"key": (lambda: R(LAT() * 100_000).cast("long"), "round(lat * 100000)::BIGINT"), "cell": (lambda: geo.bucket(LON()), "floor(lon * 1000)::BIGINT")}),
    "fn_m20": ("points", {"rows": (lambda: (F.ceil(C("mins") / (111_320.0 * 0.001)) + 1).cast("long"), "(ceil(mins / (111320.0::DOUBLE * 0.001)) + 1)::BIGINT"), "cols": (lambda: (F.ceil(C("mins") / (111_320.0 * 0.001 * F.greatest(F.cos(F.radians(LAT())), F.lit(0.1)))) + 1).cast("long"), "(ceil(mins / (111320.0::DOUBLE * 0.001 * greatest(cos(radians(lat)), 0.1))) + 1)::BIGINT")}),
    "fn_m22": ("points", {"v": (lambda: F.least(F.lit(500), F.greatest(F.lit(20), F.coalesce(F.regexp_extract(F.concat(C("mins").cast("string"), F.lit("px")), "^-?[0-9]+", 0).try_cast("int"), F.lit(20)))), "least(500, greatest(20, mins))::INT")}),
    "fn_m23": ("points", {"v": (lambda: F.when(C("pop") >= 1_000_000, F.concat(R(C("pop") / 1_000_000, 1).cast("decimal(10,1)").cast("string"), F.lit("M"))).otherwise(F.concat(F.floor(C("pop") / 1000 + 0.5).cast("string"), F.lit("k"))), "CASE WHEN pop >= 1000000 THEN round(pop / 1000000::DOUBLE, 1)::DECIMAL(10,1) || 'M' ELSE floor(pop / 1000.0::DOUBLE + 0.5)::BIGINT || 'k' END")}),
    "fn_m25": ("points", {"v": (lambda: geo.world_cell(MX(), MY(), 0.001), f"floor({Q_MX} / 0.001)::BIGINT || ':' || floor({Q_MY} / 0.001)::BIGINT")}),
    "prj_2": ("points", {"v": (lambda: F.when(C("mins") >= 14, 9).when(C("mins") >= 9, 8).when(C("mins") >= 6, 7).when(C("mins") >= 4, 6).when(C("mins") >= 2, 5).when(C("mins") >= 1, 4).otherwise(3), "(CASE WHEN mins >= 14 THEN 9 WHEN mins >= 9 THEN 8 WHEN mins >= 6 THEN 7 WHEN mins >= 4 THEN 6 WHEN mins >= 2 THEN 5 WHEN mins >= 1 THEN 4 ELSE 3 END)::INT")}),
    "prj_3": ("points", {"v": (lambda: F.when(C("mins") >= 14, 600_000).when(C("mins") >= 9, 350_000).when(C("mins") >= 6, 220_000).when(C("mins") >= 4, 160_000).when(C("mins") >= 2, 110_000).otherwise(F.greatest(F.lit(50_000), C("k") % 5 * 25_000)).cast("long"), "(CASE WHEN mins >= 14 THEN 600000 WHEN mins >= 9 THEN 350000 WHEN mins >= 6 THEN 220000 WHEN mins >= 4 THEN 160000 WHEN mins >= 2 THEN 110000 ELSE greatest(50000, k % 5 * 25000) END)::BIGINT")}),
    "prj_8": ("points", {"v": (lambda: geo.encode_e5(LAT() / 7), "round(lat / 7 * 100000)::INT")}),
    "flt_8": ("points", {"v": (lambda: geo.impossible_speed(HAV(), C("mins")), f"CASE WHEN mins = 0 THEN true ELSE {Q_HAV} / 1000 / (mins / 60.0::DOUBLE) > 380 END")}),
    "flt_10": ("points", {"v": (lambda: geo.plausible(PATH(), HAV()), f"CASE WHEN {Q_HAV} < 1 THEN {Q_PATH} <= 1000 ELSE {Q_PATH} <= {Q_LIMIT} END")}),
    "var_4": ("points", {"v": (lambda: R(LIMIT(), 3), f"round({Q_LIMIT}, 3)")}),
    "gr_17": ("points", {"detour": (lambda: F.when(HAV() > 0, R(PATH() / HAV() * 100).cast("long")), f"CASE WHEN {Q_HAV} > 0 THEN round({Q_PATH} / {Q_HAV} * 100)::BIGINT END"), "kmh": (lambda: F.when((C("mins") > 0) & (PATH() > 0), R(PATH() / 1000 / (C("mins") / 60)).cast("long")), f"CASE WHEN mins > 0 AND {Q_PATH} > 0 THEN round({Q_PATH} / 1000 / (mins / 60.0::DOUBLE))::BIGINT END")}),
    "var_5": ("points", {"v": (lambda: F.concat(F.lit("geometry_km="), R(PATH() / 1000).cast("long").cast("string"), F.lit(";direct_km="), R(HAV() / 1000).cast("long").cast("string")), f"'geometry_km=' || round({Q_PATH} / 1000)::BIGINT || ';direct_km=' || round({Q_HAV} / 1000)::BIGINT")}),
    "flt_9": ("points", {"v": (lambda: (C("k") % 4 == C("k") % 6) & (C("k") % 4 != 3) & (C("k") % 4 != 1), "k % 4 = k % 6 AND k % 4 <> 3 AND k % 4 <> 1")}),
    "flt_13": ("points", {"v": (lambda: geo.boxes_overlap(BOX_A(), VIEW()), "least(lon, lon2) <= 8 AND greatest(lon, lon2) >= 0 AND least(lat, lat2) <= 50 AND greatest(lat, lat2) >= 45")}),
    "flt_15": ("points", {"v": (lambda: LON().between(-1.0, 9.0) & LAT().between(44.0, 51.0), "lon BETWEEN -1.0 AND 9.0 AND lat BETWEEN 44.0 AND 51.0")}),
    "flt_16": ("points", {"v": (lambda: geo.boxes_overlap(BOX_A(), {"x0": F.lit(-1.0), "x1": F.lit(9.0), "y0": F.lit(44.0), "y1": F.lit(51.0)}), "least(lon, lon2) <= 9 AND greatest(lon, lon2) >= -1 AND least(lat, lat2) <= 51 AND greatest(lat, lat2) >= 44")}),
    "fn_c3": ("points", {"v": (lambda: F.when(C("pop") >= 20_000, C("pop")), "CASE WHEN pop >= 20000 THEN pop END")}),
    "so_7": ("points", {"v": (lambda: F.when(C("k") % 10 == 0, 100_000 - C("mins")).when(C("k") % 10 == 1, 90_000).otherwise(C("mins") % 10 * 10_000 + F.floor(C("pop") / 1000)).cast("long"), "(CASE WHEN k % 10 = 0 THEN 100000 - mins WHEN k % 10 = 1 THEN 90000 ELSE mins % 10 * 10000 + pop // 1000 END)::BIGINT")}),
    "flt_11": ("points", {"shown": (lambda: (C("k") % 10 == 0) | (C("k") % 17 == 0) | ((C("k") % 2 == 0) & (C("mins") % 10 >= 5) & (C("pop") >= 80_000)), "k % 10 = 0 OR k % 17 = 0 OR (k % 2 = 0 AND mins % 10 >= 5 AND pop >= 80000)")}),
}


def _query(base: str, outputs: dict):
    source = {"names": names, "points": points}[base]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return source(spark, d).select("k", *[v[0]().alias(c) for c, v in outputs.items()])

    return run


def _sql(base: str, outputs: dict) -> str:
    source = {"names": NAMES_SQL, "points": POINTS_SQL}[base]
    return "SELECT k, " + ", ".join(f"{v[1]} AS {c}" for c, v in outputs.items()) + f" FROM {source} AS t"


QUERIES = {k: _query(*v) for k, v in SCALARS.items()}
ORACLE_SQL = {k: _sql(*v) for k, v in SCALARS.items()}
