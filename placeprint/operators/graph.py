"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeprint.operators import joins
from placeprint.sources.shared import drop_written, written

#: Edges of a round whose nodes may be looked up in a plain join.
SPLIT_EDGES = 1_000_000


def _with_least(edges: DataFrame, least: DataFrame, many: int) -> DataFrame:
    """edges joined with what was found by node a. A round of many edges looks hubs up in a broadcast, as a hub's edges
    would meet in one task; a round of fewer is bounded anyway."""
    return joins.split_join(edges, least, "a", "n", many) if many > SPLIT_EDGES else edges.join(least.drop("n"), "a")


def _large_star(edges: DataFrame, many: int) -> DataFrame:
    """Every node hands the least node of its neighbourhood to its larger neighbours."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = edges.unionAll(back).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
    return _with_least(back, least, 2 * many).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, many: int) -> DataFrame:
    """Every node and its smaller neighbours point to the least of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    moved = _with_least(edges, least, many).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the least node that it reaches.

    Rounds grow with the logarithm of the longest path; each ends in a table in the shared folder. Self-loops and null
    ends are left out; no edges, no rows.
    """
    state = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if not now[0] or now == before:
            break
        following = written(_small_star(_large_star(state, now[0]), now[0]), "stars")
        drop_written(state)
        before, state = now, following
    else:
        raise RuntimeError(f"components haven't settled after {rounds} rounds")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def groups_of(memberships: DataFrame, member: str, container: str) -> DataFrame:
    """(member, group): members that share a container, directly or over others, have the same group (the least member)."""
    first = memberships.groupBy(container).agg(F.min(member).alias("__first"))
    edges = memberships.join(first, container).select(F.col(member).alias("a"), F.col("__first").alias("b"))
    reached = components(edges)
    every = memberships.select(member).where(F.col(member).isNotNull()).distinct()
    return every.join(reached, F.col(member) == F.col("node"), "left").select(member, F.coalesce("root", F.col(member)).alias("group"))
