"""Personal data: fixed patterns and information-theoretic sanitisation.

Pattern matches are the protected entities. Words of three characters or more outside the matches are terms, and
co-occurrence in whole documents estimates what a term reveals. With n(t) documents holding a term and n(t, c) of them an entity
too, a reader of the term has the entity right in ``n(t,c) / n(t)`` of cases, which leaves ``log2(n(t) / n(t,c))`` bits
open. A term discloses an entity if its true share lies above a level: one half, so that less than one bit is
open, for generalising, and 0.8, a third of a bit, for removal. Few sightings estimate little, and many pairs are looked at; so for
each pair the chance of as many joint sightings at a share of just the level is bounded (Chernoff:
``exp(-n(t) KL(n(t,c)/n(t), level))``), and the false-discovery rate over all pairs is held at ``q`` (Benjamini and Hochberg).
Pairs that could not be told at any number of joint sightings their entity has are no part of the family: a term or an
entity of three documents or fewer is never told of at q = 0.1. The pair must also tell a bit more than the entity's own frequency
does (pointwise mutual information of one bit), so an entity that stands everywhere isn't told by each word.
Counts are over documents, copies included. Apart from that bit none hangs on the number of documents: documents that hold neither
the terms nor the entities change no verdict. A term is judged by the entity it tells most of, and holds wherever it stands
in any document, whether or not that writes the entity out.

Defined results: null and empty texts have no span; texts of any length are read whole; repeated
rows count as documents each and get the same spans; ties are kept, as thresholds are inclusive;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.llm.arrays import cut_out
from viaduct.llm.common import WORD, cut, join_counted, join_skewed, join_small, row_key, table

KINDS = ["email", "ip", "card", "phone", "term"]
#: the characters of an email's local part, and what follows its @
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: a whole chain of numbers, which holds an address in every four
CHAIN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str):
    """``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, looked for around each @ so that long runs cost their length."""
    at, begin = text.find("@"), 0
    while at >= 0:
        before = text[begin:at]
        start = begin + len(before.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        begin = domain.end() if domain else at + 1
        if domain:
            yield start, begin
        at = text.find("@", begin)


def addresses(text: str):
    """``[0-9]+(\\.[0-9]+){3}``: each four numbers of a chain, from its beginning."""
    for chain in CHAIN.finditer(text):
        at, parts = chain.start(), chain[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            yield at, end, four
            at = end + 1


def octet(part: str) -> bool:
    number = part.lstrip("0")
    return len(number) <= 3 and int(number or 0) <= 255


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) sorted; a match that fails its check is consumed, not tried again."""
    if not text:
        return []
    found = [(a, 0, b) for a, b in emails(text)]
    found += [(a, 1, b) for a, b, four in addresses(text) if all(map(octet, four))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(found)


SPANS = "array<struct<start:bigint,ord:int,end:bigint>>"


def outside(text: str, spans: list[tuple[int, int, int]]):
    """Matches of the terms of a whole text: words of three characters or more that touch no base span."""
    at, reached = 0, 0  # spans before ``at`` start before the word's end; the furthest of their ends
    for m in WORD.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reached = max(reached, spans[at][2])
            at += 1
        if m.end() - m.start() >= 3 and reached <= m.start():
            yield m


def find(docs: DataFrame) -> DataFrame:
    """doc_id, rid, base spans, entities, and the distinct terms of documents with an entity."""
    import pyarrow as pa
    import xxhash

    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.list_(pa.struct([("start", pa.int64()), ("ord", pa.int32()), ("end", pa.int64())]))

    def look(batches):
        for batch in batches:
            base, entities, terms = [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                spans = base_spans(text)
                base.append([{"start": a, "ord": k, "end": b} for a, k, b in spans])
                entities.append(sorted({xxhash.xxh3_64_intdigest(f"{k}:{text[a:b].lower()}") - (1 << 63) for a, k, b in spans}))
                terms.append(sorted({m[0].lower() for m in outside(text, spans)}) if spans else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("rid"), pa.array(base, span), pa.array(entities, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.string()))], ["doc_id", "rid", "base", "entities", "terms"])

    rows = docs.select("doc_id", row_key("doc_id", "text").alias("rid"), "text")
    return rows.mapInArrow(look, f"doc_id {kind}, rid binary, base {SPANS}, entities array<bigint>, terms array<string>")


def document_frequency(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """(term, n_t): documents holding each word; tasks add up what they see before the shuffle,
    in tables of at most ``most`` words."""
    import pyarrow as pa

    def count(batches):
        from collections import Counter

        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_pydict({"term": list(seen), "n": list(seen.values())}, pa.schema([("term", pa.string()), ("n", pa.int64())]))
        for batch in batches:
            for text in batch.column("text"):
                seen.update({w.lower() for w in set(WORD.findall(text.as_py() or "")) if len(w) >= 3})
                if len(seen) >= most:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))


def least_documents(level: float, q: float) -> int:
    """Documents below which even sightings that are all joint could not be told from the level."""
    return math.ceil(math.log(q) / math.log(level))


def pair_counts(found: DataFrame, docs: DataFrame, least: int, level: float) -> DataFrame:
    """``entity, term, n, n_t, n_c, n_tc`` of the pairs in whose family tests are: terms and entities of ``least`` documents or
    more that stand together, the term in few enough documents for the entity to reach the level in them."""
    n = found.count()
    rows = found.where(F.size("entities") > 0)
    entities = cut(rows.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("n") < n)))
    held = join_counted(rows.select("rid", F.explode("entities").alias("entity")), entities, "entity").select("rid", "entity")
    held = cut(held.distinct().join(entities.select("entity", F.col("n").alias("n_c")), "entity"))
    # only terms beside these entities are asked for, and none of more documents than the level lets an entity tell
    most = (held.agg(F.max("n_c")).first()[0] or 0) / level
    terms = cut(rows.join(held.select("rid").distinct(), "rid", "left_semi").select("rid", F.explode("terms").alias("term")))
    rare = document_frequency(docs).where(F.col("n_t").between(least, most))
    # equal rows share a rid: each counts by its terms, with the entities once
    met = join_skewed(terms, cut(rare), "term").join(held, "rid").where(F.col("n_t") * level <= F.col("n_c"))
    return met.groupBy("entity", "term").agg(F.lit(float(n)).alias("n"), F.count("*").alias("n_tc"), F.first("n_t").alias("n_t"), F.first("n_c").alias("n_c"))


def chance(level: float):
    """log10 of a bound of the probability of ``n_tc`` joint sightings in ``n_t`` or more, at a share of ``level``."""
    share = F.col("n_tc") / F.col("n_t")
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - level))).otherwise(0.0)
    return F.when(share > level, -F.col("n_t") * (share * F.log(share / level) + rest) / math.log(10)).otherwise(0.0)


def told(pairs: DataFrame, level: float, q: float) -> float | None:
    """The log10 probability up to which pairs are told: the largest at which those expected by chance are at most ``q`` of
    those that reach it. Probabilities are rounded up to hundredths of a decade, the driver sees their counts."""
    bins = pairs.groupBy(F.greatest(F.ceil(chance(level) * 100), F.lit(-30_000)).alias("bin")).agg(F.count("*").alias("n")).collect()
    total, above, limit = sum(r.n for r in bins), 0, None
    for r in sorted(bins, key=lambda r: r.bin):
        above += r.n
        if 10 ** (r.bin / 100) * total <= q * above:
            limit = r.bin / 100
    return limit


def disclosing(found: DataFrame, docs: DataFrame, levels: tuple[float, float] = (0.5, 0.8), q: float = 0.1) -> DataFrame:
    """``entity, term, share, removed`` of the pairs told at the first level; removed are those told at the second."""
    pairs = cut(pair_counts(found, docs, least_documents(levels[0], q), levels[0]))
    limits = [told(pairs, x, q) for x in levels]
    reaches = [F.lit(False) if limit is None else chance(x) <= limit for x, limit in zip(levels, limits, strict=True)]
    bit = F.col("n") * F.col("n_tc") >= 2.0 * F.col("n_t") * F.col("n_c")
    return pairs.where(reaches[0] & bit).select("entity", "term", (F.col("n_tc") / F.col("n_t")).alias("share"), reaches[1].alias("removed"))


def sieve(terms: DataFrame) -> bytes:
    """Sorted 64-bit hashes of the ``term`` column, eight bytes each; the caller bounds their number."""
    found = terms.select(F.xxhash64("term").alias("h")).toArrow()["h"].to_numpy()
    return np.unique(found.astype("<i8")).tobytes()


def passes(table: bytes, term: str) -> bool:
    import xxhash

    held = np.frombuffer(table, "<i8")
    h = np.uint64(xxhash.xxh64_intdigest(term, 42)).astype(np.int64)
    at = int(np.searchsorted(held, h))
    return at < len(held) and held[at] == h


def places(text: str, words: set[str], spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Where ``words`` stand in a text as whole words that touch no base span; a few words are looked up one by one."""
    if len(words) > 16:
        return [m.span() for m in outside(text, spans) if m[0] in words]
    out = []
    in_word = lambda c: c.isalnum() or c == "_"
    for w in words:
        a = text.find(w)
        while a >= 0:
            b = a + len(w)
            whole = not (a and in_word(text[a - 1]) or b < len(text) and in_word(text[b]))
            if whole and not any(x < b and a < y for x, _, y in spans):
                out.append((a, b))
            a = text.find(w, b if whole else a + 1)
    return out


def candidates(docs: DataFrame, shared) -> DataFrame:
    """(rid, term, start, end) of the terms of whole texts that the broadcast sieve lets through."""
    import pyarrow as pa

    def look(batches):
        table = shared.value
        known: dict[str, bool] = {}
        for batch in batches:
            out = []
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                words = {*WORD.findall(text)}
                if len(known) > 200_000:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = len(w) >= 3 and passes(table, w.lower())
                hit = {w for w in words if known[w]}
                if hit:
                    out += [(rid, text[a:b].lower(), a, b) for a, b in places(text, hit, base_spans(text))]
            columns = zip(*out, strict=True) if out else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["rid", "term", "start", "end"])

    return docs.select(row_key("doc_id", "text").alias("rid"), "text").mapInArrow(look, "rid binary, term string, start long, end long")


def sought(docs: DataFrame, risky: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``rid, term, start, end`` of all ``risky`` terms in whole texts. The hashes of at most ``most`` terms, eight megabytes, are
    broadcast; more terms are dealt by hash, and texts are read once for each deal, whose sieve goes before the next."""
    deals = max(1, -(-risky.count() // most))
    if deals == 1:
        return candidates(docs, docs.sparkSession.sparkContext.broadcast(sieve(risky)))
    hits = []
    for i in range(deals):
        shared = docs.sparkSession.sparkContext.broadcast(sieve(risky.where(F.pmod(F.xxhash64("term", F.lit(1)), F.lit(deals)) == i)))
        hits.append(cut(candidates(docs, shared)))
        shared.destroy()
    return functools.reduce(DataFrame.union, hits).distinct()


def spans(docs: DataFrame, levels: tuple[float, float] = (0.5, 0.8), q: float = 0.1, most: int = 1_000_000) -> DataFrame:
    """doc_id, rid, ``base`` and ``terms``: term spans with the share of their documents that they tell and whether they are removed."""
    found = cut(find(docs))
    risky = cut(disclosing(found, docs, levels, q).groupBy("term").agg(F.max("share").alias("share"), F.max("removed").alias("removed")))
    hit = join_small(sought(docs, risky, most), risky, ["term"]).groupBy("rid", "start", "end").agg(F.max("share").alias("share"), F.max("removed").alias("removed"), F.max(F.col("term").rlike("^[0-9]+$")).alias("number"))
    per_doc = hit.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(4).alias("ord"), "end", "share", "removed", "number"))).alias("terms"))
    empty = F.array().cast("array<struct<start:bigint,ord:int,end:bigint,share:double,removed:boolean,number:boolean>>")
    return found.drop("terms", "entities").join(per_doc, "rid", "left").withColumn("terms", F.coalesce("terms", empty))


def sanitise(docs: DataFrame, **kw) -> DataFrame:
    """The columns of ``docs`` with entities replaced by their kind and disclosing terms removed or
    generalised to ``[NUMBER]`` or ``[WORD]``."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]])
    found = spans(docs, **kw)
    base = F.transform("base", lambda x: F.struct(x["start"], x["end"], F.get(marks, x["ord"]).alias("mark")))
    terms = F.transform("terms", lambda x: F.struct(x["start"], x["end"], F.when(x["removed"], F.lit("")).when(x["number"], F.lit("[NUMBER]")).otherwise(F.lit("[WORD]")).alias("mark")))
    plan = found.select("rid", F.array_sort(F.concat(base, terms)).alias("_plan")).where(F.size("_plan") > 0).dropDuplicates(["rid"])
    carried = docs.select(row_key("doc_id", "text").alias("rid"), "text", F.struct(*[F.col(c) for c in docs.columns]).alias("carried")).join(plan, "rid", "left")
    text = F.when(F.col("_plan").isNotNull(), cut_out(F.col("text"), F.col("_plan"))).otherwise(F.col("text"))
    return carried.select(*[text.alias(c) if c == "text" else F.col("carried")[c].alias(c) for c in docs.columns])


def op4_pii(spark, sf_dir):
    found = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(kinds, x["ord"]), x["start"], x["end"])), ",")
    count = lambda i: F.size(F.filter("base", lambda x: x["ord"] == i)).cast("long")
    plain = F.transform("terms", lambda x: F.struct(x["start"], x["ord"], x["end"]))
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(said("base"), 256).alias("base_sha256"), said(F.array_sort(F.concat("base", plain))).alias("spans"), F.size("terms").cast("long").alias("n_term"))
