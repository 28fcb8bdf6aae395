"""Secret scan: fixed patterns and a randomness test battery, in Spark SQL functions only.

Tokens of at least 20 characters whose encoding can be inferred (decimal, hex, base 32, lower
alphanumeric, base 64) are tested for randomness: chi-squared uniformity over the alphabet of the
encoding (upper case, lower case and the rest, each cut into as many equal cells as leave five
characters a cell), a runs test about the middle
of the alphabet and lag-1 serial correlation, combined by Cauchy's method, which one small p-value
decides. A random token's p-value is uniform, one that isn't random has a small one. So in each
length class, over all tokens of the corpus, the number of random tokens is read off the upper part
of the p-values (Storey's estimator, here of all above 0.302), and what exceeds it above a limit is an estimate of the tokens
that aren't random. The limit is the least at which those are at most ``q`` of the tokens above it;
tokens from there on are reported as kind ``random``, unless they overlap a span of the fixed
patterns, and where no limit does none is. P-values are rounded up to hundredths of a decade.

Defined results: null and empty texts have no span; texts of any length are scanned whole; tokens
with equal p-values share a decision; repeated rows are scanned each and each counts; an empty
table gives no rows; clashing column names of the input aren't carried on.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viaduct.llm.arrays import cut_out, let, running
from viaduct.llm.common import cut, table

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LONG = ASSIGN.removesuffix("+)") + "{12,})"
ACCESS = r"AKIA[A-Z0-9]{14,}"  # a shorter run has no longer match in it
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
SPAN = "array<struct<start:bigint,ord:int,end:bigint,m:string>>"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"
#: encoding: test, alphabet in order, its runs of letters and digits
ENCODINGS = [
    ("decimal", r"^[0-9]+$", "0123456789", [10]),
    ("hex", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", "0123456789ABCDEF", [10, 6]),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", [26, 6]),
    ("alnum", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789", [26, 10]),
    ("base64", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+$", BASE64, [26, 26, 12]),
]
LENGTHS = [24, 32, 48, 64, 96, 128]  # upper ends of the length classes


def spans(text, order: int, pattern: str, guard, keep=None):
    """``start, ord, end, m`` of the non-overlapping matches, leftmost first; places are code points,
    the end exclusive. Each match is taken with the gap before it, so lengths add up to places.
    """
    whole = F.lit(r"\G([\s\S]*?)(" + pattern + ")")
    part = lambda i: F.regexp_extract_all(text, whole, F.lit(i))
    pieces = F.arrays_zip(part(0).alias("f"), part(2).alias("m"), part(4 if keep else 2).alias("g"))
    none = F.array().cast(SPAN)
    length = lambda x: F.length(x["f"]).cast("bigint")

    def placed(pieces):
        ends = running(F.transform(pieces, length))
        kept = F.filter(F.arrays_zip(pieces.alias("x"), ends.alias("end")), (lambda z: keep(z["x"]["g"])) if keep else (lambda z: F.lit(True)))
        return F.transform(kept, lambda z: F.struct((z["end"] - F.length(z["x"]["m"])).cast("bigint").alias("start"), F.lit(order).alias("ord"), z["end"].alias("end"), z["x"]["m"].alias("m")))

    return F.when(guard, let(pieces, placed)).otherwise(none)


def tail(z):
    """Upper tail of the normal distribution, Abramowitz and Stegun 26.2.17."""

    def upper(z):
        series = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        p = F.exp(-z * z / 2) * 0.3989422804014327 * let(1 / (1 + 0.2316419 * F.abs(z)), series)
        return let(p, lambda p: F.when(z >= 0, p).otherwise(1 - p))

    return let(z, upper)


def with_p(tokens):
    """Tokens ``start, ord, end, m`` that have an encoding as ``start, ord, end, cls, bin``.

    The steps are lambdas one after another, so each value is computed once.
    """
    keep = lambda x, **more: F.struct(x["start"], x["ord"], x["end"], *[v.alias(k) for k, v in more.items()])
    encoding = lambda body: functools.reduce(lambda rest, i: F.when(body.rlike(ENCODINGS[i][1]), i).otherwise(rest), reversed(range(len(ENCODINGS))), F.lit(-1))
    alphabets, sizes = F.array(*[F.lit(e[2]) for e in ENCODINGS]), F.array(*[F.lit(float(min(64, len(e[2])))) for e in ENCODINGS])
    starts = lambda runs: [sum(runs[:i]) for i in range(len(runs))]
    run = lambda at, width: F.struct(F.lit(float(at)).alias("at"), F.lit(float(width)).alias("width"), F.array(*[F.lit(float(d)) for d in range(1, width + 1) if width % d == 0]).alias("cuts"))
    runs = F.array(*[F.array(*map(run, starts(e[3]), e[3])) for e in ENCODINGS])
    t = F.transform(tokens, lambda x: keep(x, body=F.regexp_replace(x["m"], "=+$", "")))
    t = F.transform(t, lambda x: keep(x, body=x["body"], e=encoding(x["body"])))
    t = F.filter(t, lambda x: x["e"] >= 0)
    t = F.transform(t, lambda x: keep(x, body=x["body"], n=F.length(x["body"]).cast("double"), k=F.get(sizes, x["e"]), runs=F.get(runs, x["e"]), alphabet=F.get(alphabets, x["e"]), chars=F.regexp_extract_all(x["body"], F.lit("(.)"), F.lit(1))))

    def place(x, c):
        return let(F.position(c, x["alphabet"]) - 1, lambda at: F.when(at > 63, at - 2).otherwise(at).cast("double"))

    def cells(x):
        enough = lambda r: F.array_max(F.filter(r["cuts"], lambda d: (d == 1) | (x["n"] * r["width"] >= 5 * d * x["k"])))
        return F.transform(x["runs"], lambda r: F.struct(r["at"], r["width"], enough(r).alias("n")))

    def chi(x):
        """Squared counts over expected ones, less the number of characters."""
        count = lambda r, c: F.size(F.filter(x["v"], lambda v: (v >= r["at"]) & (F.floor((v - r["at"]) * r["n"] / r["width"]) == c))).cast("double")
        squares = lambda r: F.aggregate(F.sequence(F.lit(0), r["n"].cast("int") - 1), F.lit(0.0), lambda a, c: a + F.pow(count(r, c), F.lit(2.0)))
        return F.aggregate(x["cells"], F.lit(0.0), lambda a, r: a + squares(r) * r["n"] / r["width"]) * x["k"] / x["n"] - x["n"]

    t = F.transform(t, lambda x: keep(x, n=x["n"], k=x["k"], cells=cells(x), v=F.transform(x["chars"], lambda c: place(x, c))))
    t = F.transform(t, lambda x: keep(x, n=x["n"], k=x["k"], df=F.aggregate(x["cells"], F.lit(-1.0), lambda a, r: a + r["n"]), chi=chi(x), v=x["v"]))
    pair = lambda v: F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    t = F.transform(t, lambda x: keep(x, n=x["n"], k=x["k"], df=x["df"], chi=x["chi"], pairs=pair(x["v"])))

    def z_chi(x):
        return (F.pow(x["chi"] / x["df"], F.lit(1 / 3)) - (1 - 2 / (9 * x["df"]))) / F.sqrt(2 / (9 * x["df"]))

    def z_runs(x):
        changes = F.size(F.filter(x["pairs"], lambda p: (p["a"] >= x["k"] / 2) != (p["b"] >= x["k"] / 2)))
        return F.abs(changes - (x["n"] - 1) / 2) / F.sqrt((x["n"] - 1) / 4)

    def z_serial(x):
        lagged = F.aggregate(x["pairs"], F.lit(0.0), lambda a, p: a + (p["a"] - (x["k"] - 1) / 2) * (p["b"] - (x["k"] - 1) / 2))
        return F.abs(lagged) * 12 / ((x["k"] * x["k"] - 1) * F.sqrt(x["n"] - 1))

    # p-values near one are held at 0.95: they shouldn't make up for a small one
    part = lambda p: F.tan((0.5 - F.greatest(F.least(p, F.lit(0.95)), F.lit(1e-15))) * math.pi)
    t = F.transform(t, lambda x: keep(x, n=x["n"], c=(part(tail(z_chi(x))) + part(2 * tail(z_runs(x))) + part(2 * tail(z_serial(x)))) / 3))
    # 1 / (pi c) in place of the difference of two near equals
    t = F.transform(t, lambda x: keep(x, n=x["n"], p=F.when(x["c"] > 1e6, 1 / (math.pi * x["c"])).otherwise(0.5 - F.atan(x["c"]) / math.pi)))
    return F.transform(t, lambda x: keep(x, cls=length_class(x["n"]), bin=F.floor(-100 * F.log10(F.greatest(x["p"], F.lit(1e-15)))).cast("int")))


def length_class(length):
    return functools.reduce(lambda rest, i: F.when(length <= LENGTHS[i], i).otherwise(rest), reversed(range(len(LENGTHS))), F.lit(len(LENGTHS)))


def candidates(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with ``base`` spans and tested ``tokens`` (start, ord, end, cls, bin)."""
    text = F.coalesce("text", F.lit(""))
    base = F.concat(
        spans(text, 0, ASSIGN, text.rlike(ASSIGN_LONG), lambda g: F.length(g) >= 12),
        spans(text, 1, ACCESS, text.rlike(ACCESS)),
        spans(text, 2, HEX, text.rlike(HEX)),
    )
    plain = F.transform(base, lambda x: F.struct(x["start"], x["ord"], x["end"]))
    out = docs.withColumn("base", F.array_sort(plain)).withColumn("found", spans(text, 3, TOKEN, text.rlike(TOKEN)))
    free = F.filter("found", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return out.withColumn("tokens", with_p(free)).drop("found")


def limits_of(found: DataFrame, q: float) -> dict[int, int]:
    """The largest reported bin of each length class that has one, from counts per class and bin."""
    counts = found.select(F.explode("tokens").alias("t")).groupBy(F.col("t.cls").alias("cls"), F.col("t.bin").alias("bin")).agg(F.count("*").alias("n"))
    up = Window.partitionBy("cls").orderBy("bin")
    # random tokens' p-values lie above 0.302, in bins 0 to 51, in 698 cases of a thousand
    upper = F.sum(F.when(F.col("bin") <= 51, F.col("n")).otherwise(0)).over(Window.partitionBy("cls"))
    ranked = counts.withColumn("above", F.sum("n").over(up)).withColumn("random", upper / (1 - 10**-0.52))
    false = F.col("above") - F.col("random") * (1 - F.pow(F.lit(10.0), -(F.col("bin") + 1) / 100))
    good = ranked.where(false <= q * F.col("above"))
    return {r.cls: r.bin for r in good.groupBy("cls").agg(F.max("bin").alias("bin")).collect()}


def scan(docs: DataFrame, q: float = 0.05) -> DataFrame:
    """The columns of ``docs`` with ``base`` and ``secret_spans``, all spans by start and kind."""
    return report(candidates(docs.drop("base", "tokens", "secret_spans", "found")), q)


def report(found: DataFrame, q: float) -> DataFrame:
    """Spans of tested ``candidates``, which are read twice: for the limits and for the result."""
    limits = limits_of(found.select("tokens"), q)
    kept = F.filter("tokens", lambda x: functools.reduce(lambda rest, c: F.when(x["cls"] == c, x["bin"] <= limits[c]).otherwise(rest), limits, F.lit(False)))
    more = F.transform(kept, lambda x: F.struct(x["start"], x["ord"], x["end"]))
    return found.withColumn("secret_spans", F.array_sort(F.concat("base", more))).drop("tokens")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The columns of ``docs`` with every span, overlapping ones as one, replaced in the text."""
    done = cut_out(F.col("text"), F.transform("secret_spans", lambda x: F.struct(x["start"], x["end"], F.lit(mark).alias("mark"))))
    text = F.when(F.size("secret_spans") > 0, done).otherwise(F.col("text"))
    carried = docs.select("text", F.struct(*[F.col(c) for c in docs.columns]).alias("carried"))
    return scan(carried).select(*[text.alias(c) if c == "text" else F.col("carried")[c].alias(c) for c in docs.columns])


def op8_secrets(spark, sf_dir):
    # the places are written down, so no text is scanned twice
    out = report(cut(candidates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")), 0.05)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(kinds, x["ord"]), x["start"], x["end"])), ",")
    count = lambda i: F.size(F.filter("secret_spans", lambda x: x["ord"] == i)).cast("long")
    return out.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], F.sha2(said("base"), 256).alias("base_sha256"), said("secret_spans").alias("spans"), count(3).alias("n_random"))
