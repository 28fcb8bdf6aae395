"""Names, identifiers and keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters folded one to one, and those that become two letters.
FOLD_FROM = "àáâãäåāăąçćčďđèéêëēęěğìíîïīıłñńňòóôõöøōőřśšşťùúûüūůűýÿźżž"
FOLD_TO = "aaaaaaaaacccddeeeeeeegiiiiiilnnnoooooooorssstuuuuuuuyyzzz"
FOLD_PAIRS = [("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th")]

# Words that name a station rather than a place.
STATION_WORDS = ["bahnhof", "bahnhst", "bhf", "hbf", "hb", "hauptbahnhof", "station", "gare"]
STATION_TAIL = ["bahnhof", "bahnhst", "bhf", "hbf", "hauptbahnhof", "station", "gare"]
STATION_PAIRS = ["gare centrale", "gare central", "central station"]
IDENTITY_WORDS = ["gare", "station", "hauptbahnhof", "bahnhof", "hbf", "bhf", "hb"]
LONE_WORDS = ["a", "o", "l", "la", "le", "les", "el", "los", "las", "de", "des", "du", "saint", "st", "san", "sant", "santa", "santo", "bad", "bus"]
STREET_WORDS = ["allee", "avenue", "chaussee", "road", "route", "rue", "strasse"]
ROUTE_NOISE = ["a", "b", "d", "k", "l", "rd", "rn", "bahnhof", "bahnhst", "bhf", "hbf"]
ROUTE_PLACES = ["abri", "bourg", "carrefour", "centre", "cte", "inter"]
URBAN_TAIL = ["u", "tram", "zob", "bahn", "bf", "bhf", "hbf", "bahnhof"]
STOP_WORDS = ["a", "b", "d", "de", "des", "du", "en", "k", "l", "la", "le", "les", "pres", "sur", "sous"]
STOP_ENDINGS = ["str", "strasse", "platz", "tor", "campus", "brucke", "bruecke"]


def fold(c: Column) -> Column:
    """Lower case with Latin letters folded to ASCII."""
    out = F.lower(c)
    for a, b in FOLD_PAIRS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, FOLD_FROM, FOLD_TO)


def normalize_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " "))


def normalize_query(c: Column) -> Column:
    """Lower case without marks on letters; punctuation stays."""
    return F.trim(F.translate(F.lower(c), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"))


def slugify(c: Column) -> Column:
    return F.replace(normalize_name(c), F.lit(" "), F.lit("-"))


def registry_slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_case(c: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))), " ")


def digit_runs(c: Column, least: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(f"([0-9]{{{least},}})"), F.lit(1))


def long_digit_runs(c: Column) -> Column:
    return F.array_sort(F.array_distinct(digit_runs(c, 7)))


def any_of(words: list[str]) -> str:
    return "(" + "|".join(words) + ")"


def strip_tail(c: Column, words: list[str]) -> Column:
    """Drop trailing words of the list while there are any."""
    return F.trim(F.regexp_replace(F.concat(F.lit(" "), c), f"( {any_of(words)})+$", ""))


def usable_prefix(c: Column) -> Column:
    return (c != "") & (c != "s u") & ~c.isin(LONE_WORDS)


def cleaned_city_name(c: Column) -> Column:
    name = F.regexp_replace(normalize_name(c), f"( {any_of(STATION_PAIRS + STATION_WORDS)})+$", "")
    return F.when(name == "", F.lit("Unknown")).otherwise(title_case(name))


def name_quality(c: Column) -> Column:
    name = normalize_name(c)
    tokens = F.when(name == "", 0).otherwise(F.size(F.split(name, " ")))
    return F.struct(usable_prefix(name).cast("int").alias("usable"), tokens.alias("tokens"), F.octet_length(name).alias("bytes"))


def comparable_key(c: Column) -> Column:
    tokens = F.transform(F.split(normalize_name(c), " "), lambda t: F.when(t == "st", "saint").when(t == "ste", "sainte").otherwise(t))
    kept = strip_tail(F.array_join(tokens, " "), STATION_TAIL)
    return F.array_join(F.filter(F.split(kept, " "), lambda t: ~t.isin(STOP_WORDS) & (t != "")), " ")


def route_parent_key(c: Column) -> Column:
    """Place before the first number or street word; null if nothing is left."""
    name = F.concat(F.lit(" "), normalize_name(c))
    head = F.trim(F.regexp_replace(name, f" ([a-z]*[0-9][a-z0-9]*|{'|'.join(STREET_WORDS)})( .*)?$", ""))
    head = strip_tail(strip_tail(head, ROUTE_NOISE), ROUTE_PLACES)
    return F.when(head != "", comparable_key(head))


def urban_parent_key(c: Column) -> Column:
    name = F.trim(F.regexp_replace(normalize_name(c), "^(s u|u)( |$)", ""))
    name = strip_tail(strip_tail(name, URBAN_TAIL), ["s"])
    return F.when(name != "", F.coalesce(F.nullif(comparable_key(name), F.lit("")), name))


def parent_display_name(c: Column) -> Column:
    name = normalize_name(c)
    return F.when(usable_prefix(name), title_case(name))


def fallback_urban_name(c: Column) -> Column:
    name = normalize_name(c)
    return F.when(usable_prefix(name) & ~name.rlike(f"^[^ ]*{any_of(STOP_ENDINGS)}$"), title_case(name))


def urban_interchange(name: Column) -> Column:
    return name.rlike("( u| zob)$|^s u( |$)| s u| busbahnhof")


def city_eligibility(c: Column) -> Column:
    n = normalize_name(c)
    bus = n.rlike("^bus([0-9]+)?( .*)?$|^busbahnhof$|^bussteige ")
    return (
        F.when(bus | (n.rlike("^[a-z0-9]+$") & n.rlike("[0-9]")), "station_only_label")
        .when(urban_interchange(n), "urban_interchange")
        .when(n.rlike("[0-9]"), "route_like")
        .otherwise("eligible")
    )


def placeholder_station(c: Column) -> Column:
    return normalize_name(c).rlike("^(bus[0-9]*|bahn|(bus|bahn) [^ ]+)$")


def non_empty(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def stable_hash(c: Column) -> Column:
    return F.substring(F.md5(c.cast("binary")), 1, 8)


def stable_city_id(key: Column, slug: Column, cc: Column, insee: Column) -> Column:
    french = F.when(F.coalesce(insee, F.lit("")).isin("", "unknown"), F.concat(slug, F.lit("-zz-"), stable_hash(key))).otherwise(F.concat(slug, F.lit("-fr-"), insee))
    return F.when(F.upper(cc) == "FR", french).otherwise(F.concat(slug, F.lit("-"), F.lower(cc), F.lit("-"), stable_hash(key)))


def fallback_cluster_key(name: Column, uic: Column, lat: Column, lon: Column) -> Column:
    at = F.concat_ws("-", F.round(lat * 1000).cast("int"), F.round(lon * 1000).cast("int"))
    return F.concat(F.lit("fallback-"), slugify(name), F.lit("-"), F.coalesce(uic, at))


def french_commune(c: Column) -> Column:
    """Municipal districts of Paris, Lyon and Marseille to their commune."""
    return F.when(c.rlike("^751(0[1-9]|1[0-9]|20)$"), "75056").when(c.rlike("^6938[1-9]$"), "69123").when(c.rlike("^132(0[1-9]|1[0-6])$"), "13055").otherwise(c)


def wikidata_id(c: Column) -> Column:
    """Whether a text is an item's id, as it stands."""
    return F.coalesce(c.rlike("^Q[0-9]+$"), F.lit(False))


def in_service(mnemo: Column) -> Column:
    """Whether a line of the infrastructure is in use; one that says nothing is."""
    return F.coalesce(F.upper(F.trim(mnemo)) == "EXPLOITE", F.lit(True))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def file_name_of_url(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, r"([^/?]*)(\?.*)?$", 1), F.lit("")), F.lit("source.bin"))


def identity_stem(c: Column) -> Column:
    """Name before a station word that isn't first, else without a station phrase at its end."""
    name = normalize_name(c)
    cut = F.regexp_replace(name, f"^([a-z0-9]+( [a-z0-9]+)*?) {any_of(IDENTITY_WORDS)}( .*)?$", "$1")
    return F.when(cut != name, cut).otherwise(F.trim(F.regexp_replace(name, f"{any_of(STATION_PAIRS)}$", "")))


def identity_key(name: Column, cc: Column) -> Column:
    return F.concat(identity_stem(name), F.lit("|"), F.lower(F.trim(cc)))


def station_qualified(c: Column) -> Column:
    return normalize_name(c).rlike(f" {any_of(IDENTITY_WORDS)}( |$)|{any_of(STATION_PAIRS)}$")


def classify_pair(a: Column, a_cc: Column, b: Column, b_cc: Column) -> Column:
    same = identity_key(a, a_cc) == identity_key(b, b_cc)
    return (
        F.when(same & (station_qualified(a) | station_qualified(b)), "station_variant")
        .when(same, "true_duplicate")
        .when((F.lower(a) == F.lower(b)) & (F.lower(a_cc) != F.lower(b_cc)), "homonym")
        .otherwise("unresolved_city")
    )


def classify_name_issue(c: Column) -> Column:
    name = F.trim(c)
    low = F.lower(name)
    return F.when(low.isin("bus", "bahn") | low.startswith("bus "), "placeholder_stop").when((F.octet_length(name) <= 3) & name.rlike("[A-Z]"), "feed_abbreviation")


def encode_component(c: Column) -> Column:
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")), F.lit("%3A"), F.lit(":"))
