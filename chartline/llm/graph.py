"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored

ROUNDS = 100


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (large: the greater ones, small: the others and itself) to the least of them and it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("_m"))
    on = both.join(least, "a")
    if large:
        out = on.where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b"))
    else:
        out = on.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(least.select("a", F.col("_m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) of comparable ids -> (node, root) for every node that is not the least of its component."""
    state = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "graph")
    mark = None
    for _ in range(ROUNDS):
        got = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if mark == tuple(got) or not got[0]:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(got)
        state = stored(_star(_star(state, True), False), "graph")
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
