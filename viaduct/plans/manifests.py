"""Manifest queries: sources of the documents table as a manifest, pages as listings, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from viaduct.operators import manifests as m
from viaduct.plans.feed import read

C = F.col
PROVIDERS = ["national_statistical_office", "wikidata", "osm", "eurostat_gisco", "national_transport_authority"]
KINDS = ["city_registry", "city_station_membership", "city_enrichment", "municipality_registry", "station_registry", "city_station_membership", "city_registry"]
STRATEGIES = ["recent_changes", "replication_diff", "annual_release"]


def _pick(words, i):
    return F.get(F.array(*[F.lit(w) for w in words]), (i % len(words)).cast("int"))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def sources(spark, d):
    """Sources by the number in their name, some with a role, a tier, an address and countries of their own."""
    rows = read(spark, d, "documents").select(C("source").alias("id")).distinct().withColumn("n", F.regexp_extract("id", "([0-9]+)$", 1).cast("int"))
    n = C("n")
    return rows.select("id", "n", _pick(PROVIDERS, n).alias("provider"), _pick(KINDS, n).alias("kind"), F.when(n % 4 == 3, "city_identity").alias("role"), F.when(n % 6 == 5, "derived").alias("tier"), F.when(n % 2 == 0, F.array(F.lit("FR"), F.lit("BE"))).otherwise(F.array().cast("array<string>")).alias("countries"), (n % 3 > 0).alias("seed_once"), _pick(STRATEGIES, n).alias("strategy"), (n % 5 != 4).alias("active"), F.when(n % 3 == 0, F.concat(F.lit("https://x/"), "id")).alias("url"))


_N = "regexp_extract(source, '([0-9]+)$', 1)::INT"
_CASES = lambda table, key: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"
SOURCES = f"""s0 AS (SELECT DISTINCT source AS id, {_N} AS n FROM documents), s1 AS (SELECT id, n, {_list(PROVIDERS)}[1 + n % 5] AS provider, {_list(KINDS)}[1 + n % 7] AS kind, CASE WHEN n % 2 = 0 THEN ['BE', 'FR'] ELSE [] END AS countries, n % 3 > 0 AS seed_once, {_list(STRATEGIES)}[1 + n % 3] AS strategy, n % 5 <> 4 AS active, CASE WHEN n % 3 = 0 THEN 'https://x/' || id END AS url FROM s0),
s AS (SELECT *, CASE WHEN n % 4 = 3 THEN 'city_identity' ELSE {_CASES(m.ROLES, 'kind')} END AS role, CASE WHEN n % 6 = 5 THEN 'derived' ELSE {_CASES(m.TIERS, 'provider')} END AS tier FROM s1)"""


def targets(spark, d):
    """Nations as targets: sources by number, one in three built from others, one in four not active."""
    k = C("n_nationkey")
    name = lambda c: F.concat(F.lit("t"), c.cast("string"))
    return read(spark, d, "nation").select(name(k).alias("target"), F.transform(F.array(k % 10, (k * 3 + 1) % 14), lambda x: F.concat(F.lit("src"), x.cast("string"))).alias("source_ids"), F.when((k % 3 == 2) & (k > 4), F.array(name(F.floor(k / 2)), name(k - 1))).otherwise(F.array().cast("array<string>")).alias("inputs"), (k % 4 != 3).alias("active"), _pick(["draft", "production_ready", None], k).alias("status"))


TARGETS = "t AS (SELECT n_nationkey AS k, 't' || n_nationkey AS target, ['src' || (n_nationkey % 10), 'src' || ((n_nationkey * 3 + 1) % 14)] AS source_ids, CASE WHEN n_nationkey % 3 = 2 AND n_nationkey > 4 THEN ['t' || (n_nationkey // 2), 't' || (n_nationkey - 1)] ELSE [] END AS inputs, n_nationkey % 4 <> 3 AS active, ['draft', 'production_ready', NULL][1 + n_nationkey % 3] AS status FROM nation)"
_USED = "u AS (SELECT k, target, active, inputs, unnest(source_ids) AS id, generate_subscripts(source_ids, 1) AS pos FROM t)"


def fn_c4(spark, d):
    return m.effective(sources(spark, d)).select("id", "role", "tier")


def var_15(spark, d):
    """Tiers of sources that name none."""
    return m.effective(sources(spark, d).withColumn("tier", F.lit(None).cast("string"))).select("id", "tier")


def var_18(spark, d):
    return m.coverage_records(sources(spark, d))


def ag_16(spark, d):
    return m.coverage_counts(sources(spark, d))


def ag_17(spark, d):
    """Documents as cities; the references are their own source and one more by number."""
    docs = read(spark, d, "documents").select(C("doc_id").alias("city"), "source")
    s = m.effective(sources(spark, d)).select(C("id").alias("source"), "role", "tier").where("role is not null")
    more = docs.where("city % 3 = 0").select("city", F.concat(F.lit("src"), (C("city") % 10).cast("string")).alias("source"))
    refs = docs.where("city % 5 > 0").union(more).join(F.broadcast(s), "source")
    return m.city_strength(refs, docs.select("city", F.when(C("city") % 7 == 0, "Q1").alias("qid")))


AG_17 = f"""WITH {SOURCES}, r AS (SELECT doc_id AS city, source FROM documents WHERE doc_id % 5 > 0 UNION ALL SELECT doc_id, 'src' || (doc_id % 10) FROM documents WHERE doc_id % 3 = 0),
b AS (SELECT city, min(CASE WHEN role IN ('municipality_identity', 'city_identity') THEN CASE tier WHEN 'official' THEN 0 WHEN 'linked_open_data' THEN 1 WHEN 'community' THEN 2 END WHEN role = 'enrichment' THEN 3 END) AS rank FROM r JOIN s ON source = id GROUP BY city)
SELECT doc_id AS city, CASE coalesce(rank, CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 4 END) WHEN 0 THEN 'official_identity' WHEN 1 THEN 'linked_open_data_identity' WHEN 2 THEN 'community_identity' WHEN 3 THEN 'enriched_only' ELSE 'unverified' END AS strength FROM documents LEFT JOIN b ON city = doc_id"""


def var_16(spark, d):
    return m.target_findings(targets(spark, d), sources(spark, d))


_TARGET_FINDINGS = "SELECT DISTINCT u.id, 'error' AS severity, 'unknown source of ' || target AS finding FROM u LEFT JOIN s USING (id) WHERE active AND s.id IS NULL UNION ALL SELECT target, 'error', 'no identity source for ' || target FROM u LEFT JOIN s USING (id) WHERE u.active GROUP BY target HAVING count(*) FILTER (WHERE role IN ('municipality_identity', 'city_identity')) = 0"
_TARGET_FINDINGS = _TARGET_FINDINGS.replace("WHERE active AND", "WHERE u.active AND").replace("SELECT DISTINCT u.id", "SELECT u.id")
_SOURCE_FINDINGS = "SELECT id, 'warning' AS severity, 'no source url' AS finding FROM s WHERE active AND tier = 'official' AND url IS NULL AND provider <> 'eurostat_gisco' UNION ALL SELECT id, 'error', 'no countries' FROM s WHERE active AND provider LIKE 'national%' AND len(countries) = 0 UNION ALL SELECT id, 'warning', 'community membership' FROM s WHERE active AND role = 'station_city_membership' AND tier = 'community'"


def var_17(spark, d):
    return m.source_findings(sources(spark, d))


def val_8(spark, d):
    return m.contract_findings(targets(spark, d), sources(spark, d))


def val_13(spark, d):
    return m.seed_plan(targets(spark, d), sources(spark, d))


VAL_13 = f"WITH {SOURCES}, {TARGETS}, {_USED} SELECT target, string_agg(u.id, ',' ORDER BY pos) AS sources, CASE WHEN max(len(inputs)) > 0 THEN 'aggregate target' WHEN count(*) FILTER (WHERE s.id IS NULL) > 0 THEN 'missing source' WHEN count(*) FILTER (WHERE NOT seed_once) > 0 THEN 'not seeded once' END AS fault FROM u LEFT JOIN s USING (id) GROUP BY target"


def str_8(spark, d):
    cursors = sources(spark, d).where("n % 7 <> 6").select("id", F.when(C("n") % 9 == 1, "seed").otherwise("incremental").alias("mode"), F.when(C("n") % 11 > 0, F.concat(F.lit("snap"), C("n").cast("string"))).alias("snapshot"))
    return m.refresh_plan(targets(spark, d), sources(spark, d), cursors)


STR_8 = f"WITH {SOURCES}, {TARGETS}, {_USED} SELECT target, u.id, CASE WHEN s.id IS NULL THEN 'missing source' WHEN strategy = 'annual_release' THEN 'no incremental refresh' WHEN n % 7 = 6 THEN 'missing cursor' WHEN n % 9 = 1 THEN 'cursor not incremental' WHEN n % 11 = 0 THEN 'no seed snapshot' END AS fault FROM u LEFT JOIN s USING (id)"


def var_13(spark, d):
    return m.resolve_targets(targets(spark, d), ["t4", "t9", "t20"]).select("target").union(m.resolve_targets(targets(spark, d)).select("target"))


def so_10(spark, d):
    """Targets in an order that builds dependencies first: the deepest, then by name."""
    return m.target_closure(targets(spark, d), m.resolve_targets(targets(spark, d), ["t20", "t17", "t5"]))


_CLOSURE = f"WITH RECURSIVE {TARGETS}, n AS (SELECT target, unnest(inputs) AS input FROM t), c(target, depth) AS (SELECT target, 0 FROM t WHERE {{roots}} UNION SELECT input, depth + 1 FROM c JOIN n USING (target))"


def var_14(spark, d):
    """The closure of all active targets, as registries ask for it."""
    t = targets(spark, d)
    return m.target_closure(t, m.resolve_targets(t))


def flt_26(spark, d):
    t = targets(spark, d)
    return m.scoped_sources(t, sources(spark, d), m.target_closure(t, m.resolve_targets(t, ["t20"]))).select("id", "provider")


def src_19(spark, d):
    states = sources(spark, d).select("id", F.concat("id", F.lit(".zip")).alias("file")).where("n <> 2")
    return m.cached_sources(sources(spark, d).where("n <> 2"), states)


def _remote(spark, d):
    """Pages as sources: the stored state and what the server says, differing by number."""
    k = C("page_id")
    put = lambda test, x: F.when(test, F.concat(F.lit(x), (k % 3).cast("string")))
    state = F.struct(C("url").alias("configured_url"), C("url").alias("resolved_url"), F.lit("a.zip").alias("file"), put(k % 4 > 0, "v").alias("version"), put(k % 5 > 1, "e").alias("etag"), put(k % 2 > 0, "d").alias("modified"), F.length("html").cast("long").alias("length"))
    remote = F.struct(F.when(k % 13 == 0, "moved").otherwise(C("url")).alias("configured_url"), C("url").alias("resolved_url"), F.when(k % 17 == 0, "b.zip").otherwise("a.zip").alias("file"), F.when(k % 3 == 0, F.concat(F.lit("v"), (k % 6 % 3).cast("string"))).alias("version"), put(k % 7 > 3, "e").alias("etag"), put(k % 11 > 0, "d").alias("modified"), (F.length("html") + (k % 8 == 0).cast("int")).cast("long").alias("length"))
    return read(spark, d, "pages").select(k.alias("page_id"), state.alias("s"), remote.alias("r"))


def src_21(spark, d):
    return _remote(spark, d).select("page_id", m.up_to_date().alias("up_to_date"))


SRC_21 = """WITH p AS (SELECT page_id AS k, CASE WHEN page_id % 4 > 0 THEN 'v' || (page_id % 3) END AS sv, CASE WHEN page_id % 5 > 1 THEN 'e' || (page_id % 3) END AS se, CASE WHEN page_id % 2 > 0 THEN 'd' || (page_id % 3) END AS sd,
CASE WHEN page_id % 3 = 0 THEN 'v' || (page_id % 6 % 3) END AS rv, CASE WHEN page_id % 7 > 3 THEN 'e' || (page_id % 3) END AS re, CASE WHEN page_id % 11 > 0 THEN 'd' || (page_id % 3) END AS rd FROM pages)
SELECT k AS page_id, k % 13 <> 0 AND k % 17 <> 0 AND CASE WHEN rv IS NOT NULL THEN sv IS NOT DISTINCT FROM rv WHEN re IS NOT NULL THEN se IS NOT DISTINCT FROM re ELSE coalesce(sd = rd, false) AND k % 8 <> 0 END AS up_to_date FROM p"""


def _listings(spark, d):
    return read(spark, d, "pages").select("page_id", "url", "html")


def src_22(spark, d):
    return m.latest_href(_listings(spark, d), "^/[A-Za-z]+$")


_HREF = "(SELECT url, list_max(list_filter(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1), lambda h: regexp_matches(h, '{p}'))) AS href FROM {t})"
SRC_22 = "SELECT url, href, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || href AS target FROM " + _HREF.format(p="^/[A-Za-z]+$", t="pages") + " WHERE href IS NOT NULL"


def src_23(spark, d):
    """From an index to the latest year, its latest month, and the latest file in it."""
    k = C("o_orderkey")
    rows = read(spark, d, "orders").select(F.year("o_orderdate").cast("string").alias("y"), F.date_format("o_orderdate", "MM").alias("mo"), F.concat(F.lit("feed-"), k.cast("string"), F.lit(".zip")).alias("f"), (C("o_custkey") % 5).cast("string").alias("site"))
    link = lambda c: F.concat(F.lit('<a href="'), c, F.lit('">x</a>'))
    page = lambda keys, url, to: rows.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_set(link(to))), "").alias("html")).select(F.concat(F.lit("http://h/"), *url).alias("url"), "html")
    slash = F.lit("/")
    pages = page(["site"], ["site", slash], F.concat("y", slash)).union(page(["site", "y"], ["site", slash, "y", slash], F.concat(F.lit("/"), "site", slash, "y", slash, "mo", slash))).union(page(["site", "y", "mo"], ["site", slash, "y", slash, "mo", slash], C("f")))
    index = rows.select(F.concat(F.lit("http://h/"), "site", slash).alias("url")).distinct()
    return m.cascade(index, pages, ["^[0-9]{4}/$", "/[0-9]{2}/$", "zip$"])


SRC_23 = "WITH r AS (SELECT strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%m') AS mo, 'feed-' || o_orderkey || '.zip' AS f, o_custkey % 5 AS site FROM orders), a AS (SELECT *, max(y) OVER (PARTITION BY site) AS ly FROM r), b AS (SELECT *, max(mo) OVER (PARTITION BY site) AS lm FROM a WHERE y = ly) SELECT 'http://h/' || site || '/' AS start, 'http://h/' || site || '/' || ly || '/' || lm || '/' || max(f) AS url, max(f) AS href FROM b WHERE mo = lm GROUP BY site, ly, lm"


def _resources(spark, d, title, created):
    k = C("page_id")
    return read(spark, d, "pages").select((k % 25).alias("dataset"), "url", F.when(k % 6 > 0, F.concat(F.lit("Feed "), (k % 9).cast("string"))).alias(title), _pick(["zip", "ZIP", "csv", None], k).alias("format"), F.when(k % 4 > 0, F.concat(F.lit("2024-0"), (k % 7 + 1).cast("string"))).alias("last_modified"), F.when(k % 5 > 0, F.concat(F.lit("2023-0"), (k % 8 + 1).cast("string"))).alias(created))


def src_24(spark, d):
    return m.select_resource(_resources(spark, d, "title", "created_at"), "dataset", "title", "created_at", "Zip", "^Feed", "^https?://")


def src_25(spark, d):
    return m.select_resource(_resources(spark, d, "name", "created"), "dataset", "name", "created", None, None, "example")


def q_resource(title: str, where: str) -> str:
    return f"WITH p AS (SELECT page_id % 25 AS dataset, url, CASE WHEN page_id % 6 > 0 THEN 'Feed ' || (page_id % 9) END AS {title}, ['zip', 'ZIP', 'csv', NULL][1 + page_id % 4] AS format, CASE WHEN page_id % 4 > 0 THEN '2024-0' || (page_id % 7 + 1) END AS last_modified, CASE WHEN page_id % 5 > 0 THEN '2023-0' || (page_id % 8 + 1) END AS cr FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY last_modified DESC NULLS LAST, cr DESC NULLS LAST, {title} DESC NULLS LAST, url DESC) AS n FROM p WHERE {where}) SELECT dataset, url, {title}, last_modified FROM r WHERE n = 1"


def src_26(spark, d):
    k, u = C("event_id"), C("props")
    spot = lambda i, path: F.when(k % 8 == i, F.format_string(path, u))
    forms = ['{"modified": 7, "data_processed": "p"}', '{"metas": {"data_processed": "x", "default": {"modified": "y"}}}', '{"metas": {"metadata_processed": "m"}}', '{"metas": {"default": {"modified": "d"}}}', '{"metas": {"default": {"data_processed": "e"}}}', '{"metas": {"default": {"metadata_processed": "f"}}}', '{"modified": "2024", "metas": {}}', "{}"]
    return read(spark, d, "events").select("event_id", m.probe_version(_pick(forms, k)).alias("version"))


def src_27(spark, d):
    marks = F.array(*[F.unhex(F.lit(x)) for x in ("504B030414", "504B0506", "504B0708", "504B0102", "3C21")])
    body = F.concat(F.get(marks, (C("page_id") % 5).cast("int")), F.encode("html", "UTF-8"))
    return read(spark, d, "pages").select("page_id", m.is_zip(body).alias("zip"), m.is_zip(F.encode("html", "UTF-8")).alias("page_is_zip"))


def snk_5(spark, d):
    o = read(spark, d, "orders")
    old = o.groupBy(C("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("pos"), F.min_by("o_orderstatus", "o_orderkey").alias("state"))
    new = o.where("o_orderpriority = '1-URGENT'").select(C("o_custkey").alias("id"), C("o_orderkey").alias("pos"), C("o_orderstatus").alias("state"))
    return m.upsert_states(old, new)


SNK_5 = "SELECT o_custkey AS id, coalesce(max(o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT'), min(o_orderkey)) AS pos, coalesce(arg_max(o_orderstatus, o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT'), arg_min(o_orderstatus, o_orderkey)) AS state FROM orders GROUP BY o_custkey"


def st_7(spark, d):
    b = read(spark, d, "benchmark")
    words = F.size(F.split("text", " "))
    return m.override_files(b.where(words % 2 == 0).select(C("item_id").alias("id"), "text"), b.where(words % 2 == 1).select(C("item_id").alias("id"), "text"))


def fn_c1(spark, d):
    k = C("c_custkey")
    put = lambda n, x: F.when(k % n == 0, x)
    cc, reason = m.infer_country(put(2, "FR"), put(3, "DE"), put(5, "IT"), put(7, "ES"))
    return read(spark, d, "customer").select("c_custkey", cc.alias("cc"), reason.alias("reason"))


def var_9(spark, d):
    rows = read(spark, d, "supplier").select("s_suppkey", F.when(C("s_suppkey") % 2 == 0, F.concat(F.lit("n"), C("s_nationkey").cast("string"))).otherwise(F.concat(F.lit("N"), C("s_nationkey").cast("string"))).alias("cc"))
    known = read(spark, d, "nation").where("n_regionkey > 1").select(F.concat(F.lit("N"), C("n_nationkey").cast("string")).alias("cc"), C("n_name").alias("authority"))
    return m.country_authority(rows, known)


def var_10(spark, d):
    cc = lambda c: F.concat(F.lit("N"), c.cast("string"))
    known = read(spark, d, "nation").select(cc(C("n_nationkey")).alias("a"), F.lower(cc(C("n_regionkey"))).alias("b"), C("n_name").alias("corridor"), C("n_nationkey").alias("pos"))
    return m.corridor_of(read(spark, d, "supplier").select("s_suppkey", cc(C("s_suppkey") % 5).alias("a"), cc(C("s_nationkey")).alias("b")), known).select("s_suppkey", "corridor")


VAR_10 = "WITH c AS (SELECT least(n_nationkey, n_regionkey) AS a, greatest(n_nationkey, n_regionkey) AS b, n_nationkey AS pos, n_name FROM nation), f AS (SELECT least('N' || a, 'N' || b) AS a, greatest('N' || a, 'N' || b) AS b, arg_min(n_name, pos) AS corridor FROM c GROUP BY 1, 2) SELECT s_suppkey, corridor FROM supplier LEFT JOIN f ON least('N' || (s_suppkey % 5), 'N' || s_nationkey) = a AND greatest('N' || (s_suppkey % 5), 'N' || s_nationkey) = b"


def var_11(spark, d):
    known = read(spark, d, "customer").select((C("c_custkey") % 4).alias("source"), C("c_nationkey").alias("a"), (C("c_custkey") % 25).cast("int").alias("b"), C("c_mktsegment").alias("policy"), C("c_custkey").alias("pos"))
    rows = read(spark, d, "supplier").select("s_suppkey", (C("s_suppkey") % 4).alias("source"), (C("s_suppkey") % 25).cast("int").alias("a"), C("s_nationkey").alias("b"))
    return m.policy_of(rows, known).select("s_suppkey", "policy")


VAR_11 = "WITH f AS (SELECT c_custkey % 4 AS source, least(c_nationkey, c_custkey % 25) AS a, greatest(c_nationkey, c_custkey % 25) AS b, arg_min(c_mktsegment, c_custkey) AS policy FROM customer GROUP BY ALL) SELECT s_suppkey, policy FROM supplier LEFT JOIN f ON s_suppkey % 4 = source AND least(s_suppkey % 25, s_nationkey) = a AND greatest(s_suppkey % 25, s_nationkey) = b"


def var_12(spark, d):
    return targets(spark, d).select("target", m.promoted(C("status")).alias("promoted"))


def _chunks(spark, d):
    k = C("s_suppkey")
    edge = lambda c: F.when(k % 4 > 0, c)
    return read(spark, d, "supplier").select(F.concat(F.lit("chunk-"), k.cast("string")).alias("file"), k, edge(k * 17 % 340 / 10.0).alias("west"), edge(k * 17 % 340 / 10.0 + 3).alias("east"), edge(k * 37 % 250 / 10.0).alias("south"), edge(k * 37 % 250 / 10.0 + 2).alias("north"))


def _seen(spark, d):
    return read(spark, d, "supplier").where("s_nationkey < 6").select(F.concat(F.lit("chunk-"), C("s_suppkey").cast("string")).alias("file"))


def flt_27(spark, d):
    return m.pending_chunks(_chunks(spark, d), _seen(spark, d)).select("file")


def flt_28(spark, d):
    return m.visible_chunks(_chunks(spark, d), _seen(spark, d), {"west": 10.0, "east": 20.0, "south": 5.0, "north": 15.0}).select("file")


_PENDING = "SELECT 'chunk-' || s_suppkey AS file FROM supplier WHERE s_nationkey >= 6"

QUERIES = {n: globals()[n] for n in ("fn_c4", "var_15", "var_18", "ag_16", "ag_17", "var_16", "var_17", "val_8", "val_13", "str_8", "var_13", "so_10", "var_14", "flt_26", "src_19", "src_21", "src_22", "src_23", "src_24", "src_25", "src_26", "src_27", "snk_5", "st_7", "fn_c1", "var_9", "var_10", "var_11", "var_12", "flt_27", "flt_28")} | {"var_51": flt_27}
ORACLE_SQL = {
    "ag_17": AG_17, "val_13": VAL_13, "str_8": STR_8, "src_21": SRC_21, "src_22": SRC_22, "src_23": SRC_23, "snk_5": SNK_5, "var_10": VAR_10, "var_11": VAR_11,
    "fn_c4": f"WITH {SOURCES} SELECT id, role, tier FROM s",
    "var_15": f"WITH {SOURCES} SELECT id, {_CASES(m.TIERS, 'provider')} AS tier FROM s",
    "var_18": f"WITH {SOURCES} SELECT id, provider, kind, role, tier, seed_once, active, array_to_string(countries, ',') AS countries FROM s",
    "ag_16": f"WITH {SOURCES} SELECT count(*) AS total, count_if(active) AS active, count_if(tier = 'official') AS official, count_if(tier = 'linked_open_data') AS linked_open_data, count_if(tier = 'community') AS community FROM s",
    "var_16": f"WITH {SOURCES}, {TARGETS}, {_USED} {_TARGET_FINDINGS}",
    "var_17": f"WITH {SOURCES} {_SOURCE_FINDINGS}",
    "val_8": f"WITH {SOURCES}, {TARGETS}, {_USED} {_TARGET_FINDINGS} UNION ALL {_SOURCE_FINDINGS}",
    "var_13": "SELECT unnest(['t4', 't9', 't20']) AS target UNION ALL SELECT 't' || n_nationkey FROM nation WHERE n_nationkey % 4 <> 3",
    "so_10": _CLOSURE.format(roots="k IN (20, 17, 5)") + " SELECT target, max(depth) AS depth FROM c GROUP BY target",
    "var_14": _CLOSURE.format(roots="active") + " SELECT target, max(depth) AS depth FROM c GROUP BY target",
    "flt_26": _CLOSURE.format(roots="k = 20").replace("WITH RECURSIVE", f"WITH RECURSIVE {SOURCES},") + " SELECT id, provider FROM s WHERE id IN (SELECT unnest(source_ids) FROM t WHERE target IN (SELECT target FROM c))",
    "src_19": f"WITH {SOURCES} SELECT id, id || '.zip' AS file FROM s WHERE active AND n <> 2",
    "src_24": q_resource("title", "lower(format) = 'zip' AND title LIKE 'Feed%' AND regexp_matches(url, '^https?://')"),
    "src_25": q_resource("name", "url LIKE '%example%'"),
    "src_26": "SELECT event_id, ['p', 'x', 'm', 'd', 'e', 'f', '2024', NULL][1 + event_id % 8] AS version FROM events",
    "src_27": "SELECT page_id, page_id % 5 < 3 AS zip, false AS page_is_zip FROM pages",
    "st_7": "SELECT item_id AS id, text FROM benchmark",
    "fn_c1": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'FR' WHEN c_custkey % 3 = 0 THEN 'DE' WHEN c_custkey % 5 = 0 THEN 'IT' WHEN c_custkey % 7 = 0 THEN 'ES' END AS cc, CASE WHEN c_custkey % 2 = 0 THEN 'explicit_authoritative' WHEN c_custkey % 3 = 0 THEN 'registry_match' WHEN c_custkey % 5 = 0 THEN 'coordinate_match' WHEN c_custkey % 7 = 0 THEN 'source_fallback' ELSE 'unresolved' END AS reason FROM customer",
    "var_9": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'n' ELSE 'N' END || s_nationkey AS cc, CASE WHEN n_regionkey > 1 THEN n_name END AS authority FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
    "var_12": f"WITH {TARGETS} SELECT target, coalesce(status = 'production_ready', false) AS promoted FROM t",
    "flt_27": _PENDING,
    "flt_28": f"{_PENDING} AND (s_suppkey % 4 = 0 OR (s_suppkey * 17 % 340 / 10.0 <= 20 AND s_suppkey * 17 % 340 / 10.0 + 3 >= 10 AND s_suppkey * 37 % 250 / 10.0 <= 15 AND s_suppkey * 37 % 250 / 10.0 + 2 >= 5))",
    "var_51": _PENDING,
}
