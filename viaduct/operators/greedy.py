"""First come, first served among rows that conflict, in rounds.

Taking rows in order, each that conflicts with none taken, looks like a fold, but a row can be settled as soon as it precedes
all open rows that it conflicts with. Each round takes such rows and drops what conflicts with them. Rows that hold a
cell together conflict, so only the first of each cell is looked at, against the open rows within its reach: no round
lists pairs of rows, and what is settled is left behind. The result is the fold's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaduct.operators.tables import Rounds, cut


def first_come(rows: DataFrame, claims: Callable[[DataFrame], DataFrame], reaches: Callable[[DataFrame], DataFrame], holds: Callable[[DataFrame], DataFrame], conflict: Callable[[Callable, Callable], Column]) -> DataFrame:
    """The rows taken, of ``rows(k, ord, …)`` with unique ``k`` and ``ord``.

    ``claims`` adds ``claim`` cells, such that rows with a cell in common conflict; ``reaches`` adds the ``cell`` values in which
    conflicting rows are found by those that ``holds`` gives them; ``conflict(a, b)`` is the condition on columns of two rows.
    """
    spark = rows.sparkSession
    left, won = Rounds(spark), []
    open_ = left.cut(rows)

    def met(some: DataFrame) -> DataFrame:
        """Conflicting pairs of a few rows (``a_…``) and open ones (``b_…``)."""
        a = reaches(some).select(*[F.col(c).alias(f"a_{c}") for c in rows.columns], "cell")
        b = holds(open_).select(*[F.col(c).alias(f"b_{c}") for c in rows.columns], "cell")
        return a.join(b, "cell").where(conflict(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")))

    while not open_.isEmpty():
        claimed = claims(open_)
        firsts = claimed.groupBy("claim").agg(F.min("ord").alias("first"))
        behind = claimed.join(firsts, "claim").where("ord > first").select("k").distinct()
        fore = cut(open_.join(behind, "k", "left_anti"))
        late = met(fore).where("b_ord < a_ord").select(F.col("a_k").alias("k")).distinct()
        taken = cut(fore.join(late, "k", "left_anti"))
        won.append(taken)
        gone = met(taken).select(F.col("b_k").alias("k")).union(taken.select("k")).distinct()
        open_ = left.cut(open_.join(gone, "k", "left_anti"))
        if len(won) > 16:
            won = [cut(_union(won))]
    return _union(won) if won else rows.limit(0)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
