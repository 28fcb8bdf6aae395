"""Source manifests as tables: state, selection, closures, defaults, coverage and audits.

Manifests are small control tables. Sources are ``id, provider, kind, role, tier, countries, seed_once,
strategy, active, url``; targets ``target, source_ids, inputs, active, status``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viaduct.operators.tables import Rounds, cut

# Roles by kind of entity and tiers by provider, where a source names none.
ROLES = {"municipality_registry": "municipality_identity", "city_registry": "city_identity", "station_registry": "station_identity", "city_station_membership": "station_city_membership", "city_enrichment": "enrichment"}
TIERS = {"eurostat_gisco": "official", "national_geographic_authority": "official", "national_statistical_office": "official", "national_transport_authority": "official", "wikidata": "linked_open_data", "osm": "community"}
IDENTITY = ["municipality_identity", "city_identity"]
NATIONAL = ["national_geographic_authority", "national_statistical_office", "national_transport_authority"]
INCREMENTAL = ["recent_changes", "replication_diff"]


def _lookup(table: dict[str, str], key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def effective(sources: DataFrame) -> DataFrame:
    """Sources with their role and tier filled in from kind and provider."""
    return sources.withColumn("role", F.coalesce("role", _lookup(ROLES, F.col("kind")))).withColumn("tier", F.coalesce("tier", _lookup(TIERS, F.col("provider"))))


def coverage_records(sources: DataFrame) -> DataFrame:
    return effective(sources).select("id", "provider", "kind", "role", "tier", "seed_once", "active", F.array_join(F.array_sort("countries"), ",").alias("countries"))


def coverage_counts(sources: DataFrame) -> DataFrame:
    known = effective(sources)
    of = lambda tier: F.count_if(F.col("tier") == tier).alias(tier)
    return known.agg(F.count("*").alias("total"), F.count_if("active").alias("active"), of("official"), of("linked_open_data"), of("community"))


def city_strength(refs: DataFrame, cities: DataFrame) -> DataFrame:
    """``city, strength`` from ``refs(city, role, tier)`` and ``cities(city, qid)``: the best identity tier, else
    enrichment or a qid, else nothing."""
    identity = F.col("role").isin(IDENTITY)
    rank = F.when(identity & (F.col("tier") == "official"), 0).when(identity & (F.col("tier") == "linked_open_data"), 1).when(identity & (F.col("tier") == "community"), 2).when(~identity & (F.col("role") == "enrichment"), 3)
    best = refs.groupBy("city").agg(F.min(rank).alias("rank"))
    found = cities.join(best, "city", "left").withColumn("rank", F.coalesce("rank", F.when(F.col("qid").isNotNull(), 3), F.lit(4)))
    names = F.array(*[F.lit(x) for x in ("official_identity", "linked_open_data_identity", "community_identity", "enriched_only", "unverified")])
    return found.select("city", F.get(names, F.col("rank")).alias("strength"))


def target_findings(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Unknown sources of active targets, and active targets without an identity source."""
    listed = targets.where("active").select("target", F.explode_outer("source_ids").alias("id"))
    met = listed.join(effective(sources).select("id", "role"), "id", "left")
    unknown = met.where("role is null and id is not null").select(F.col("id"), F.lit("error").alias("severity"), F.concat(F.lit("unknown source of "), "target").alias("finding"))
    plain = met.groupBy("target").agg(F.bool_or(F.coalesce(F.col("role").isin(IDENTITY), F.lit(False))).alias("identity")).where("not identity")
    return unknown.union(plain.select(F.col("target"), F.lit("error"), F.concat(F.lit("no identity source for "), "target")))


def source_findings(sources: DataFrame) -> DataFrame:
    """Official sources without an address, national authorities without countries, community memberships."""
    s = effective(sources.where("active"))
    rule = lambda test, severity, finding: F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(finding).alias("finding")))
    found = F.array_compact(F.array(
        rule((F.col("tier") == "official") & F.col("url").isNull() & (F.col("provider") != "eurostat_gisco"), "warning", "no source url"),
        rule(F.col("provider").isin(NATIONAL) & (F.size("countries") == 0), "error", "no countries"),
        rule((F.col("role") == "station_city_membership") & (F.col("tier") == "community"), "warning", "community membership"),
    ))
    return s.select("id", F.explode(found).alias("x")).select("id", "x.severity", "x.finding")


def contract_findings(targets: DataFrame, sources: DataFrame) -> DataFrame:
    return target_findings(targets, sources).union(source_findings(sources))


def seed_plan(targets: DataFrame, sources: DataFrame, strict: bool = False) -> DataFrame:
    """``target, sources, fault``: targets of their own sources, all seeded once; ``strict`` fails on a fault."""
    met = targets.select("target", "inputs", F.posexplode_outer("source_ids").alias("pos", "id")).join(sources.select("id", "seed_once"), "id", "left")
    plan = met.groupBy("target").agg(F.max(F.size("inputs")).alias("inputs"), F.count_if(F.col("id").isNotNull() & F.col("seed_once").isNull()).alias("missing"), F.count_if(~F.col("seed_once")).alias("again"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id")))), lambda x: x["id"]), ",").alias("sources"))
    fault = F.when(F.col("inputs") > 0, "aggregate target").when(F.col("missing") > 0, "missing source").when(F.col("again") > 0, "not seeded once")
    if strict:
        fault = F.when(fault.isNotNull(), F.raise_error(F.concat("target", F.lit(": "), fault)).cast("string"))
    return plan.select("target", "sources", fault.alias("fault"))


def refresh_plan(targets: DataFrame, sources: DataFrame, cursors: DataFrame) -> DataFrame:
    """``target, id, fault`` of an incremental refresh: the strategy must allow it, and the cursor
    ``(id, mode, snapshot)`` exist, be incremental and name a seed snapshot."""
    met = targets.select("target", F.explode("source_ids").alias("id")).join(sources.select("id", "strategy"), "id", "left").join(cursors, "id", "left")
    fault = (
        F.when(F.col("strategy").isNull(), "missing source")
        .when(~F.col("strategy").isin(INCREMENTAL), "no incremental refresh")
        .when(F.col("mode").isNull(), "missing cursor")
        .when(F.col("mode") != "incremental", "cursor not incremental")
        .when(F.col("snapshot").isNull(), "no seed snapshot")
    )
    return met.select("target", "id", fault.alias("fault"))


def resolve_targets(targets: DataFrame, requested: list[str] | None = None, default: str | None = None) -> DataFrame:
    """The requested targets, else the default one, else all active ones; one that is unknown or not active fails."""
    wanted = requested or ([default] if default else None)
    if wanted is None:
        return targets.where("active")
    asked = targets.sparkSession.createDataFrame([(t,) for t in wanted], "target string").join(targets, "target", "left")
    bad = F.raise_error(F.concat("target", F.when(F.col("active").isNull(), F.lit(" is unknown")).otherwise(F.lit(" isn't active")))).cast("string")
    return asked.withColumn("target", F.when(F.coalesce("active", F.lit(False)), F.col("target")).otherwise(bad))


def target_closure(targets: DataFrame, roots: DataFrame) -> DataFrame:
    """``target, depth`` of the roots and all they depend on, a dependency deeper than what needs it, so
    descending depth builds dependencies first. Where targets are reached at a depth that is no less than the number of targets
    found so far, some depend on each other in a circle, and the job fails."""
    needs = cut(targets.select("target", F.explode("inputs").alias("input")))
    levels = Rounds(targets.sparkSession)
    level, depth = levels.cut(roots.select("target").distinct()), 0
    found = [cut(level.withColumn("depth", F.lit(0)))]
    while not level.isEmpty():
        level, depth = levels.cut(level.join(needs, "target").select(F.col("input").alias("target")).distinct()), depth + 1
        found.append(cut(level.withColumn("depth", F.lit(depth))))
        if len(found) > 16:
            found = [cut(_deepest(found))]
        if depth >= _deepest(found).count() and not level.isEmpty():
            raise ValueError("targets depend on each other in a circle")
    return _deepest(found)


def _deepest(levels: list[DataFrame]) -> DataFrame:
    every = levels[0]
    for more in levels[1:]:
        every = every.unionByName(more)
    return every.groupBy("target").agg(F.max("depth").alias("depth"))


def scoped_sources(targets: DataFrame, sources: DataFrame, closure: DataFrame) -> DataFrame:
    """Sources that the targets of a closure list."""
    used = targets.join(closure.select("target"), "target", "left_semi").select(F.explode("source_ids").alias("id")).distinct()
    return sources.join(used, "id", "left_semi")


def cached_sources(sources: DataFrame, states: DataFrame, strict: bool = True) -> DataFrame:
    """Active sources with their stored state; without one a source fails, or keeps a null file."""
    out = sources.where("active").join(states.select("id", "file"), "id", "left")
    missing = F.raise_error(F.concat(F.lit("no cached file of "), "id")).cast("string")
    return out.select("id", F.coalesce("file", missing if strict else F.lit(None).cast("string")).alias("file"))


def up_to_date(state: str = "s", remote: str = "r") -> Column:
    """Whether a stored state still holds: equal configuration, then the probed version, then the
    etag, then date and length."""
    s, r = (lambda c: F.col(f"{state}.{c}")), (lambda c: F.col(f"{remote}.{c}"))
    same = (s("configured_url") == r("configured_url")) & (s("resolved_url") == r("resolved_url")) & (s("file") == r("file"))
    dated = (s("modified") == r("modified")) & (s("length") == r("length"))
    by = F.when(r("version").isNotNull(), s("version").eqNullSafe(r("version"))).when(r("etag").isNotNull(), s("etag").eqNullSafe(r("etag"))).otherwise(F.coalesce(dated, F.lit(False)))
    return F.coalesce(same, F.lit(False)) & by


def hrefs(html: Column, pattern: str) -> Column:
    return F.filter(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1)), lambda h: h.rlike(pattern))


def resolve_href(base: Column, href: Column) -> Column:
    """An address as seen from a page: whole addresses, ones from the host, and ones beside the page."""
    host, folder = F.regexp_extract(base, "^([a-z]+://[^/?#]*)", 1), F.regexp_extract(base, "^([a-z]+://[^/?#]*(?:/[^?#/]*)*/)", 1)
    folder = F.when(folder == "", F.concat(host, F.lit("/"))).otherwise(folder)
    return F.when(href.rlike("^[a-z]+:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^([a-z]+:)", 1), href)).when(href.startswith("/"), F.concat(host, href)).otherwise(F.concat(folder, href))


def latest_href(pages: DataFrame, pattern: str) -> DataFrame:
    """``url, href, target``: of the links of a page that match, the last in order of letters, resolved
    against the page; pages without one are left out."""
    found = pages.withColumn("href", F.array_max(hrefs(F.col("html"), pattern))).where("href is not null")
    return found.select("url", "href", resolve_href(F.col("url"), F.col("href")).alias("target"))


def cascade(index: DataFrame, pages: DataFrame, patterns: list[str]) -> DataFrame:
    """``start, url, href`` after following the latest link step by step through stored ``pages(url, html)``."""
    at = index.select(F.col("url").alias("start"), "url", F.lit(None).cast("string").alias("href"))
    for pattern in patterns:
        step = latest_href(pages, pattern)
        at = at.select("start", "url").join(step, "url").select("start", F.col("target").alias("url"), "href")
    return at


def select_resource(resources: DataFrame, key: str, title: str, created: str, format: str | None = None, title_pattern: str | None = None, url_pattern: str | None = None) -> DataFrame:
    """The newest resource of each ``key`` that fits: the greatest of (last_modified, created, title, url),
    nulls least. Catalogues differ only in how they name ``title`` and ``created``."""
    fit = resources
    if format is not None:
        fit = fit.where(F.lower(F.coalesce("format", F.lit(""))) == format.lower())
    if title_pattern is not None:
        fit = fit.where(F.coalesce(title, F.lit("")).rlike(title_pattern))
    if url_pattern is not None:
        fit = fit.where(F.col("url").rlike(url_pattern))
    known = lambda c: F.struct(F.col(c).isNotNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return fit.groupBy(key).agg(F.max_by(F.struct("url", title, "last_modified"), F.struct(known("last_modified"), known(created), known(title), "url")).alias("x")).select(key, "x.*")


def probe_version(payload: Column) -> Column:
    """The first of seven places in a probe's JSON that holds a text."""
    at = ["$.modified", "$.data_processed", "$.metas.data_processed", "$.metas.metadata_processed", "$.metas.default.modified", "$.metas.default.data_processed", "$.metas.default.metadata_processed"]
    parsed = F.try_parse_json(payload)
    said = lambda p: F.when(F.schema_of_variant(F.try_variant_get(parsed, p, "variant")) == "STRING", F.try_variant_get(parsed, p, "string"))
    return F.coalesce(*[said(p) for p in at])


def is_zip(content: Column) -> Column:
    """The marks of a zip archive that holds files, is empty or is spanned."""
    return F.hex(F.substring(content, 1, 4)).isin("504B0304", "504B0506", "504B0708")


def upsert_states(states: DataFrame, updates: DataFrame, key: str = "id", order: str = "pos") -> DataFrame:
    """States with those of the same key replaced by the last update."""
    rows = states.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    rest = [c for c in states.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct("_new", order)).alias("x")).select(key, "x.*")


def unordered(a: str, b: str) -> Column:
    return F.struct(F.least(F.upper(a), F.upper(b)), F.greatest(F.upper(a), F.upper(b)))


def country_authority(rows: DataFrame, countries: DataFrame) -> DataFrame:
    """Rows with the authority of their country ``cc``, whatever its case."""
    return rows.withColumn("_cc", F.upper("cc")).join(countries.select(F.upper("cc").alias("_cc"), "authority"), "_cc", "left").drop("_cc")


def corridor_of(rows: DataFrame, corridors: DataFrame) -> DataFrame:
    """Rows ``(a, b)`` of countries with the first corridor ``(a, b, corridor, pos)`` between them, in either order."""
    first = corridors.groupBy(unordered("a", "b").alias("_p")).agg(F.min_by("corridor", "pos").alias("corridor"))
    return rows.withColumn("_p", unordered("a", "b")).join(first, "_p", "left").drop("_p")


def policy_of(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """Rows ``(source, a, b)`` with the first policy of their source and pair of cities, in either order."""
    pair = F.struct(F.least("a", "b"), F.greatest("a", "b"))
    first = policies.groupBy("source", pair.alias("_p")).agg(F.min_by("policy", "pos").alias("policy"))
    return rows.withColumn("_p", pair).join(first, ["source", "_p"], "left").drop("_p")


def promoted(status: Column) -> Column:
    return F.coalesce(status == "production_ready", F.lit(False))


def infer_country(explicit: Column, registry: Column, coordinate: Column, source: Column) -> tuple[Column, Column]:
    """The first known country and the reason for it."""
    ways = [("explicit_authoritative", explicit), ("registry_match", registry), ("coordinate_match", coordinate), ("source_fallback", source)]
    reason = F.lit("unresolved")
    for name, value in reversed(ways):
        reason = F.when(value.isNotNull(), name).otherwise(reason)
    return F.coalesce(*[v for _, v in ways]), reason


def pending_chunks(chunks: DataFrame, seen: DataFrame) -> DataFrame:
    return chunks.join(seen.select("file"), "file", "left_anti")


def visible_chunks(chunks: DataFrame, seen: DataFrame, view: dict[str, float] | None = None) -> DataFrame:
    """Chunks not seen whose box meets the view; without a view or a box all of them."""
    rest = pending_chunks(chunks, seen)
    if view is None:
        return rest
    apart = (F.col("east") < view["west"]) | (F.col("west") > view["east"]) | (F.col("north") < view["south"]) | (F.col("south") > view["north"])
    return rest.where(F.coalesce(~apart, F.lit(True)))


def override_files(*tables: DataFrame) -> DataFrame:
    """The overrides of several lists, one after another."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def running_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key, as a stale result would be discarded."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def last_rows(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The ``most`` newest rows of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_r") <= most).drop("_r")
