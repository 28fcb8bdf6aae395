"""Source divergence audit: how far the sources of a language are apart, and by which terms.

Each language keeps the terms that enough of its documents hold. A source's share of a term is smoothed
by one occurrence and scaled to whole numbers, and the divergence of a source from another is the sum of
``floor((p - q)^2 / q)`` over all kept terms. Terms are grouped by their sparse vector of counts by
source: a vector that many terms share is looked at once and its values are multiplied by their number.
In a vector only pairs of sources that both hold the term are evaluated; what a source that holds it adds
against one that doesn't depends on the count alone, so it is taken from the source's histogram of counts, and
pairs where neither holds it add one constant each. The parts are put together exactly, in whole numbers.

Terms are ranked as they stand: a value only depends on a term's counts in source and language, so each pair of
counts is evaluated once, the value that the ``most``-th term reaches is read off the numbers of terms, and
terms below it are dropped before any are sorted.

Defined results: null text, language and source count as empty ones; a row is a document, so rows that
repeat count each; texts are read whole, in pieces of bounded size; a group without terms has the least shares
throughout; a language without kept terms has pairs of value 0 and no terms; ties go by item; an empty table
gives no rows; other columns, clashing names included, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viaduct.llm.common import cut, join_small, table

SCALE, LEAST_DOCS, MOST_TERMS = 1_000_000_000, 3, 200
TERM = re.compile(rb"[a-z\x80-\xff]+")  # on lower-cased UTF-8; bytes from 0x80 on are those of other characters


def pieces_of(data: bytes, size: int = 1 << 22):
    """Lists of the terms of a text, of about ``size`` bytes each, none cut in two."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and TERM.match(data, end, end + 1):
            end += 1
        yield TERM.findall(data, at, end)
        at = end


def count_terms(docs: DataFrame, held: int = 400_000) -> DataFrame:
    """Partial sums ``lang, source, term, n, docs`` of occurrences and documents; a task holds about
    ``held`` of them and gives them out when there are more."""
    import pyarrow as pa

    def counted(batches):
        tally: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held_now = 0

        def out():
            cols: tuple[list, ...] = ([], [], [], [], [])
            for (lang, source), (n, d) in tally.items():
                cols[0].extend([lang] * len(n)), cols[1].extend([source] * len(n))
                cols[2].extend(n), cols[3].extend(n.values()), cols[4].extend(map(d.__getitem__, n))
            tally.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["lang", "source", "term", "n", "docs"])

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                n, d = tally.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for words in pieces_of(text.as_py().lower()):
                    n.update(words)
                    fresh = set(words) - seen
                    d.update(fresh)
                    seen |= fresh
                held_now += len(n) - before
                if held_now > held:
                    yield out()
                    held_now = 0
        if tally:
            yield out()

    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = plain.mapInArrow(counted, "lang string, source string, term binary, n long, docs long")
    return found.withColumn("term", F.col("term").cast("string"))


def term_vectors(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, vec``: the kept terms with their counts ``(source, n)`` by source."""
    # the partial sums of a term meet once, for its sources and for itself; a task sends one row a source at most
    by_source = count_terms(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    vectors = by_source.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vec"))
    return cut(vectors.where(F.col("docs") >= least).select("lang", "term", "vec"))


def group_sizes(docs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``lang, source, size, terms, lang_size`` of every group: occurrences of kept terms, in the group and in
    the language, and the language's kept terms."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")])
    held = vectors.select("lang", F.explode("vec").alias("x")).groupBy("lang", "x.source").agg(F.sum("x.n").alias("size"))
    whole = held.groupBy("lang").agg(F.sum("size").alias("lang_size")).join(vectors.groupBy("lang").agg(F.count("*").alias("terms")), "lang")
    out = plain.distinct().join(held, ["lang", "source"], "left").join(whole, "lang", "left")
    return cut(out.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("size", "terms", "lang_size")]))


def share(n, size, terms):
    """1 + floor(SCALE * (n + 1) / (size + terms)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(n + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(size + terms)) + 1


def apart(p, q):
    """floor((p - q)^2 / q) of shares, which are at most SCALE + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def pair_values(vectors: DataFrame, sizes: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of every two sources of a language."""
    some = sizes.where("terms > 0").withColumn("p0", share(F.lit(0), F.col("size"), F.col("terms")))
    side = lambda p: some.select("lang", *[F.col(c).alias(f"{p}_{c}") for c in ("source", "size", "p0", "terms")])
    distinct = cut(vectors.groupBy("lang", "vec").agg(F.count("*").alias("m")))
    exact = lambda n, v: n.cast("decimal(19,0)") * v.cast("decimal(19,0)")
    say = lambda a, b, v: F.struct(F.col(f"{a}_source").alias("source"), F.col(f"{b}_source").alias("item"), v.alias("v"))

    # both hold the term: what it adds beyond what the two histograms and the constant say
    met = distinct.select("lang", "m", "vec", F.explode("vec").alias("a")).select("lang", "m", "a", F.explode("vec").alias("b")).where("a.source < b.source")
    met = met.groupBy("lang", F.col("a.source").alias("a_source"), F.col("a.n").alias("a_n"), F.col("b.source").alias("b_source"), F.col("b.n").alias("b_n")).agg(F.sum("m").alias("m"))
    met = join_small(join_small(met, side("a").drop("a_terms"), ["lang", "a_source"]), side("b"), ["lang", "b_source"])
    met = met.withColumn("p", share(F.col("a_n"), F.col("a_size"), F.col("b_terms"))).withColumn("q", share(F.col("b_n"), F.col("b_size"), F.col("b_terms")))
    beyond = lambda p, p0, q, q0: apart(p, q) - apart(p, q0) - apart(p0, q) + apart(p0, q0)
    p, q, p0, q0 = F.col("p"), F.col("q"), F.col("a_p0"), F.col("b_p0")
    both = met.select("lang", F.explode(F.array(say("a", "b", exact(F.col("m"), beyond(p, p0, q, q0))), say("b", "a", exact(F.col("m"), beyond(q, q0, p, p0))))).alias("x"))

    # one holds it: its histogram of counts against every other source
    hist = distinct.select("lang", "m", F.explode("vec").alias("a")).groupBy("lang", F.col("a.source").alias("a_source"), F.col("a.n").alias("a_n")).agg(F.sum("m").alias("m"))
    hist = join_small(join_small(hist, side("a").drop("a_terms"), ["lang", "a_source"]).withColumnRenamed("m", "k"), side("b"), ["lang"]).where("a_source <> b_source")
    hist = hist.withColumn("p", share(F.col("a_n"), F.col("a_size"), F.col("b_terms")))
    one = hist.select("lang", F.explode(F.array(say("a", "b", exact(F.col("k"), apart(p, q0) - apart(p0, q0))), say("b", "a", exact(F.col("k"), apart(q0, p) - apart(q0, p0))))).alias("x"))

    # neither does: a constant a term
    pairs = join_small(side("a").drop("a_terms"), side("b"), ["lang"]).where("a_source <> b_source")
    none = pairs.select("lang", say("a", "b", exact(F.col("b_terms"), apart(p0, q0))).alias("x"))
    bare = sizes.where("terms = 0")
    zero = bare.select("lang", F.col("source").alias("a_source")).join(bare.select("lang", F.col("source").alias("b_source")), "lang").where("a_source <> b_source")
    none = none.union(zero.select("lang", say("a", "b", exact(F.lit(0), F.lit(0)))))
    parts = [x.groupBy("lang", "x.source", "x.item").agg(F.sum("x.v").alias("v")) for x in (both, one, none)]
    whole = parts[0].union(parts[1]).union(parts[2])
    return whole.groupBy("lang", "source", "item").agg(F.sum("v").cast("long").alias("value"))


def marking_terms(vectors: DataFrame, sizes: DataFrame, most: int = MOST_TERMS) -> DataFrame:
    """``lang, source, item, value``, at least the first ``most`` of each group."""
    held = vectors.select("lang", "term", F.aggregate("vec", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("whole"), F.explode("vec").alias("x")).select("lang", "x.source", "x.n", "whole", "term")
    met = join_small(held.groupBy("lang", "source", "n", "whole").agg(F.count("*").alias("m")), sizes, ["lang", "source"])
    p, q = share(F.col("n"), F.col("size"), F.col("terms")), share(F.col("whole"), F.col("lang_size"), F.col("terms"))
    met = met.withColumn("p", p).withColumn("q", q).where("p > q").withColumn("value", apart(F.col("p"), F.col("q")))
    levels = met.groupBy("lang", "source", "value").agg(F.sum("m").alias("m"))
    above = Window.partitionBy("lang", "source").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    needed = levels.withColumn("above", F.coalesce(F.sum("m").over(above), F.lit(0))).where(F.col("above") < most)
    floor = cut(needed.groupBy("lang", "source").agg(F.min("value").alias("floor")))
    chosen = join_small(met.select("lang", "source", "n", "whole", "value"), floor, ["lang", "source"]).where("value >= floor").drop("floor")
    return join_small(held, cut(chosen), ["lang", "source", "n", "whole"]).select("lang", "source", F.col("term").alias("item"), "value")


def audit(docs: DataFrame, least: int = LEAST_DOCS, most: int = MOST_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: the divergence of each source from every other one of its
    language (``pair``) and the ``most`` terms by which it differs from the language (``term``)."""
    vectors = term_vectors(docs, least)
    sizes = group_sizes(docs, vectors)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(vectors, sizes).withColumn("part", F.lit("pair")).withColumn("rank", F.row_number().over(order))
    terms = marking_terms(vectors, sizes, most).withColumn("part", F.lit("term")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op12_divergence(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))


_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
_APART = "((a.p - b.p) * (a.p - b.p) // b.p)"
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents),
w AS (SELECT r, lang, source, unnest(w) AS term FROM d), kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d), c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + ({SCALE}::HUGEINT * (n + 1)) // (sum(n) OVER s + count(*) OVER s) AS p FROM dense WINDOW s AS (PARTITION BY lang, source)),
q AS (SELECT lang, term, 1 + ({SCALE}::HUGEINT * (n + 1)) // (sum(n) OVER s + count(*) OVER s) AS p FROM kept WINDOW s AS (PARTITION BY lang)),
v AS (SELECT a.lang, a.source, b.source AS item, sum{_APART} AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
UNION ALL SELECT a.lang, a.source, 'term', a.term, {_APART}::BIGINT FROM p a JOIN q b ON a.lang = b.lang AND a.term = b.term WHERE a.n > 0 AND a.p > b.p),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM x)
SELECT * FROM r WHERE part = 'pair' OR rank <= {MOST_TERMS}"""
