"""Scans along arrays in Spark SQL functions.

An aggregate that appends to an array copies it at every step. Here arrays are cut into blocks: the state before
each block comes from one aggregate a block, and only within a block is a result appended to.
"""

from __future__ import annotations

from pyspark.sql import functions as F

BLOCK = 128


def let(value, body):
    """``body(value)`` with the value computed once: a lambda over an array of one."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items, zero, step, merge, emit, kind: str, block: int = BLOCK):
    """``emit(state, x)`` of each item, the state being what ``step(state, x)`` made of the items before it, from ``zero``;
    ``merge`` joins two states that came from ``zero`` each. Results are of the type ``kind``."""
    none = F.array().cast(f"array<{kind}>")

    def within(blocks):
        after = F.transform(blocks, lambda b: F.aggregate(b, zero, step))
        return let(after, lambda a: F.flatten(F.transform(blocks, lambda b, i: emitted(b, F.aggregate(F.slice(a, F.lit(1), i), zero, merge)))))

    def emitted(b, state):
        begin = F.struct(state.alias("s"), none.alias("out"))
        one = lambda acc, x: F.struct(step(acc["s"], x).alias("s"), F.concat(acc["out"], F.array(emit(acc["s"], x))).alias("out"))
        return F.aggregate(b, begin, one, lambda acc: acc["out"])

    numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int"))
    cut = F.transform(numbers, lambda i: F.slice(items, i * block + 1, F.lit(block)))
    return F.when(F.size(items) > 0, let(cut, within)).otherwise(none)


def running(numbers):
    """The sums of longs up to and with each."""
    zero = F.lit(0).cast("long")
    add = lambda s, x: s + x
    return scan(numbers, zero, add, add, add, "bigint")


def cut_out(text, spans, piece: int = 1024):
    """``text`` with ``spans(start, end, mark)``, sorted, replaced by their marks; one that begins within those before it goes
    with them. The text is cut in pieces once, so a gap costs its own length wherever it stands."""
    zero = F.lit(0).cast("long")
    furthest = lambda s, x: F.greatest(s, x["end"])
    other = lambda s, t: F.greatest(s, t)

    def between(pieces, a, b):
        """The code points from ``a`` up to ``b``."""
        i, j = F.floor(a / piece).cast("int"), F.floor(b / piece).cast("int")
        at = lambda n: F.coalesce(F.get(pieces, n), F.lit(""))
        head = lambda x, n: F.substring(x, F.lit(1), n.cast("int"))
        tail = F.substring(at(i), (a % piece + 1).cast("int"), F.lit(piece))
        within = F.substring(at(i), (a % piece + 1).cast("int"), (b - a).cast("int"))
        return F.when(i == j, within).otherwise(F.concat(tail, F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), head(at(j), b % piece)))

    def joined(pieces):
        before = scan(spans, zero, furthest, other, lambda s, x: s, "bigint")
        kept = F.filter(F.arrays_zip(spans.alias("x"), before.alias("at")), lambda z: z["x"]["start"] >= z["at"])
        parts = F.transform(kept, lambda z: F.concat(between(pieces, z["at"], z["x"]["start"]), z["x"]["mark"]))
        return F.concat(F.array_join(parts, ""), between(pieces, F.array_max(F.transform(spans, lambda x: x["end"])), F.length(text).cast("long")))

    return let(F.regexp_extract_all(text, F.lit(rf"([\s\S]{{1,{piece}}})"), F.lit(1)), joined)
