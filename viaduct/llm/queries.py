"""The numbered queries of this subpackage and their SQL, for the entry module.

What SQL can say of an operator whose method it can't is a query of its own: the ``…_base`` queries
take those columns from the same operator.
"""

from pyspark.sql import functions as F

from viaduct.llm import divergence, fim, licenses, pii, quality, secrets
from viaduct.llm.chat import op6_chat
from viaduct.llm.common import table
from viaduct.llm.decontamination import op7_decontamination
from viaduct.llm.divergence import op12_divergence
from viaduct.llm.fim import op13_fim
from viaduct.llm.language import op10_language
from viaduct.llm.licenses import op11_licenses
from viaduct.llm.neardup import op9_ngram_join
from viaduct.llm.packing import op2_packing
from viaduct.llm.pii import op4_pii
from viaduct.llm.quality import op1_quality
from viaduct.llm.secrets import op8_secrets
from viaduct.llm.sharding import op5_sharding
from viaduct.llm.warc import op3_warc


def quality_base(spark, sf_dir):
    """The statistics and the base rule of op1."""
    found = quality.score_frame(table(spark, sf_dir, "documents"), None, ["doc_id"])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def _digest(base, kinds):
    names = F.array(*[F.lit(k) for k in kinds])
    said = F.array_join(F.transform(base, lambda x: F.concat_ws(":", F.get(names, x["ord"]), x["start"], x["end"])), ",")
    count = lambda i: F.size(F.filter(base, lambda x: x["ord"] == i)).cast("long")
    return [*[count(i).alias(f"n_{k}") for i, k in enumerate(kinds)], F.sha2(said, 256).alias("base_sha256")]


def pii_base(spark, sf_dir):
    """The base spans of op4."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *_digest("base", pii.KINDS[:4]))


def secrets_base(spark, sf_dir):
    """The base spans of op8."""
    found = secrets.candidates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *_digest("base", secrets.KINDS[:3]))


def license_base(spark, sf_dir):
    """The fixed phrases of op11."""
    return op11_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_packing": op2_packing,
    "op3_warc": op3_warc,
    "op4_pii": op4_pii,
    "op5_sharding": op5_sharding,
    "op6_chat": op6_chat,
    "op7_decontamination": op7_decontamination,
    "op8_secrets": op8_secrets,
    "op9_ngram_join": op9_ngram_join,
    "op10_language": op10_language,
    "op11_licenses": op11_licenses,
    "op12_divergence": op12_divergence,
    "op13_fim": op13_fim,
    "quality_base": quality_base,
    "pii_base": pii_base,
    "secrets_base": secrets_base,
    "license_base": license_base,
}

_ROWS = "d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents)"
QUALITY_BASE = rf"""WITH {_ROWS}, w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, len(regexp_extract_all(t, '[#*$%&|<>]')) AS symbols FROM d),
l AS (SELECT r, count(*) FILTER (WHERE n > 1) AS dup FROM (SELECT r, row_number() OVER (PARTITION BY r, x) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')) GROUP BY r),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS x FROM (SELECT *, unnest(generate_series(1, len(w) - 2)) AS i FROM w)),
m AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, x) AS n FROM g) WHERE n > 1), c AS (SELECT r, count(DISTINCT i + k) AS rep FROM m, (VALUES (0), (1), (2)) AS v(k) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, symbols AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(rep, 0) > 50 * len(w) AS base_failed FROM d JOIN w USING (r) LEFT JOIN l USING (r) LEFT JOIN c USING (r)"""


def _spans(order: int, kind: str, pattern: str, keep: str, groups: int = 0) -> str:
    """Matches of a pattern that pass ``keep`` (over ``m``, and ``g`` for a group), with places from the lengths of what
    lies between them."""
    part = lambda i: f"regexp_extract_all(t, '(?s)(.*?)({pattern})', {i})"
    group = f"unnest({part(groups)}) AS g" if groups else "'' AS g"
    return f"SELECT r, {order} AS o, '{kind}' AS kind, e - length(m) AS a, e AS b FROM (SELECT *, sum(length(f)) OVER (PARTITION BY r ORDER BY i) AS e FROM (SELECT r, unnest({part(0)}) AS f, unnest({part(2)}) AS m, {group}, generate_subscripts({part(0)}, 1) AS i FROM d)) WHERE {keep}"


def _digests(spans: list[str], kinds: list[str]) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in kinds)
    return f"WITH {_ROWS}, s AS ({' UNION ALL '.join(spans)}) SELECT doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || a::BIGINT || ':' || b::BIGINT, ',' ORDER BY a, o), '')) AS base_sha256 FROM d LEFT JOIN s USING (r) GROUP BY r, doc_id"


_OCTETS = "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(nullif(ltrim(p, '0'), '') AS INT), 0) <= 255))"
_PLAIN = "regexp_replace(m, '[ -]', '', 'g')"
_LUHN = f"list_sum(list_transform(generate_series(1, length({_PLAIN})), lambda i: CASE WHEN (length({_PLAIN}) - i) % 2 = 0 THEN {_PLAIN}[i:i]::INT WHEN {_PLAIN}[i:i]::INT > 4 THEN {_PLAIN}[i:i]::INT * 2 - 9 ELSE {_PLAIN}[i:i]::INT * 2 END)) % 10 = 0"
_ANY_CASE = lambda word: "".join(f"[{c}{c.upper()}]" for c in word)
_NAMES = "|".join([*map(_ANY_CASE, ("password", "passwd", "secret", "token")), f"{_ANY_CASE('api')}_?{_ANY_CASE('key')}"])

_TURNS = r"""turns AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM turns),
sizes AS (SELECT *, length(replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\', '\\'), chr(10), '\n')) AS r, length(text) + CASE WHEN regexp_matches(text, '<\|[A-Za-z0-9_]+\|>') OR regexp_matches(text, '<\\+\|') THEN len(regexp_extract_all(text, '<\\*\|')) ELSE 0 END AS t FROM said)"""
_ORDER = "ORDER BY turn NULLS FIRST, role, text"

ORACLE_SQL: dict[str, str] = {
    "op3_warc": "WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages), k AS (SELECT h, max(page_id) AS keeper FROM p WHERE n >= 1000 GROUP BY h), r AS (SELECT *, keeper IS NOT NULL AND NOT (page_id = keeper AND row_number() OVER (PARTITION BY h, page_id ORDER BY url) = 1) AS again FROM p LEFT JOIN k USING (h)) SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN keeper END AS refers_to FROM r",
    "op6_chat": f"WITH {_TURNS} SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(12 + r + 1 + t + 10 + 1)::BIGINT AS formatted_chars FROM sizes GROUP BY conv_id",
    "op12_divergence": divergence.SQL,
    "op13_fim": fim.SQL,
    "license_base": licenses.BASE_SQL,
    "quality_base": QUALITY_BASE,
    "pii_base": _digests([
        _spans(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
        _spans(1, "ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", _OCTETS),
        _spans(2, "card", r"[0-9]([\x20-]?[0-9])+", f"length({_PLAIN}) BETWEEN 12 AND 19 AND {_LUHN}"),
        _spans(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15"),
    ], pii.KINDS[:4]),
    "secrets_base": _digests([
        _spans(0, "assign", rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "length(g) >= 12", 4),
        _spans(1, "access", "AKIA[A-Z0-9]+", "length(m) >= 18"),
        _spans(2, "hex", "[0-9a-f]+", "length(m) >= 16"),
    ], secrets.KINDS[:3]),
}
