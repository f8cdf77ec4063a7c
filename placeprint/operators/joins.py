"""Joins and order statistics in which no key's rows meet in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that more than one row in so many has is looked up in a broadcast (of fewer than so many keys).
HOT_SHARE = 1000
#: Numbers that may reach the driver to be sorted there, and marks by which more of them are narrowed down.
SORTED = 100_000
MARKS = 512


def split_join(left: DataFrame, right: DataFrame, key: str | list[str], rows: str, total: int) -> DataFrame:
    """left joined with right on key (distinct there) so that no key's rows meet in one task: right says in ``rows`` how
    many of the ``total`` rows on the left a key has; the frequent ones are broadcast, the others shuffled."""
    hot = F.col(rows) * HOT_SHARE > total
    met = left.join(F.broadcast(right.where(hot).withColumn("__hot", F.lit(True))), key, "left")
    rest = met.where("__hot is null").select(left.columns).join(right.where(~hot), key)
    return met.where("__hot").select(rest.columns).unionAll(rest)


def order_statistics(df: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """The numbers of a column at ranks (from 0) of their order; nulls are no numbers, ranks have to be below their count.

    Up to SORTED numbers are sorted on the driver. More are counted between MARKS approximate quantiles; only the ranges
    that hold a rank are looked at again, each narrowed down in the same way.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    return _at_ranks(x, ranks)


def _at_ranks(x: DataFrame, ranks: list[int]) -> dict[int, float]:
    if x.limit(SORTED + 1).count() <= SORTED:
        values = sorted(r[0] for r in x.collect())
        return {k: values[k] for k in ranks}
    marks = x.agg(F.percentile_approx("x", F.array(*[F.lit(i / MARKS) for i in range(1, MARKS)]), F.lit(20 * MARKS))).first()[0]
    marks = sorted(set(marks))
    # Range 2i is what lies below mark i, range 2i + 1 the mark itself: a number that very many rows share is a range of its own.
    below, upto = (F.size(F.filter(F.lit(marks), f)) for f in (lambda m: m < F.col("x"), lambda m: m <= F.col("x")))
    at = x.withColumn("r", below + upto)
    counts, out, before = {r[0]: r[1] for r in at.groupBy("r").count().collect()}, {}, 0
    for r in sorted(counts):
        own = [k for k in ranks if before <= k < before + counts[r]]
        if own and r % 2:
            out |= dict.fromkeys(own, marks[r // 2])
        elif own:
            out |= {k + before: v for k, v in _at_ranks(at.where(F.col("r") == r).select("x"), [k - before for k in own]).items()}
        before += counts[r]
    return out


def percentiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles with linear interpolation between neighbours; nulls without any number."""
    n = df.where(F.col(column).isNotNull()).count()
    if not n:
        return [None] * len(shares)
    place = [s * (n - 1) for s in shares]
    at = order_statistics(df, column, sorted({f(p) for p in place for f in (math.floor, math.ceil)}))
    return [at[math.floor(p)] if p == math.floor(p) else (math.ceil(p) - p) * at[math.floor(p)] + (p - math.floor(p)) * at[math.ceil(p)] for p in place]
