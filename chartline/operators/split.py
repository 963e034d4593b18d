"""Reproducible splits, folds, weights and the checks on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import scalar as x
from ..skew import hash_rank


def split(spine: DataFrame, fracs: dict[str, float], seed: int = 42, by: Sequence[str] = ("label",), id_col: str = "entity") -> DataFrame:
    """Stratified assignment by hash order: the first share of ranks of every
    stratum goes to the first name, and so on. The same ids always land in
    the same split, on any cluster and partitioning."""
    ranked = hash_rank(spine.select(id_col, *by), by, [id_col], str(seed))
    out, cum, names = None, 0.0, list(fracs)
    for name in names[:-1]:
        cum += fracs[name]
        here = F.col("rank") <= F.floor(F.lit(cum) * F.col("rank_all") + 0.5)
        out = F.when(here, name) if out is None else out.when(here, name)
    return ranked.withColumn("split", out.otherwise(names[-1])).drop("rank", "rank_all")


def folds(spine: DataFrame, k: int, seed: int = 42, by: Sequence[str] = ("label",), id_col: str = "entity") -> DataFrame:
    """Stratified fold number 0..k-1 by hash order."""
    ranked = hash_rank(spine.select(id_col, *by), by, [id_col], str(seed))
    return ranked.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "rank_all")


def verify_split(mat: DataFrame, assigned: DataFrame) -> DataFrame:
    """Counts of everything that must not happen: all zero when sound."""
    per = assigned.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min("split").alias("lo"), F.max("split").alias("hi"))
    both = mat.select("entity", F.lit(1).alias("m")).distinct().join(per, "entity", "full_outer")
    return both.agg(
        x.count_where(F.col("lo") != F.col("hi")).alias("n_in_two_splits"),
        x.count_where(F.col("n") > 1).alias("n_repeated"),
        x.count_where(F.col("n").isNull()).alias("n_uncovered"),
        x.count_where(F.col("m").isNull()).alias("n_unknown"),
    )


def class_weights(spine: DataFrame, by: str | None = None) -> DataFrame:
    """Balanced class weight; with ``by`` times P(band) / P(band | class), mean 1.

    All counts come from one small table (classes x bands)."""
    keys = ["label"] + ([by] if by else [])
    cells = spine.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))

    def over(*part):  # the windows run over classes x bands rows
        return F.sum("n").over(W.partitionBy(*part) if part else W.partitionBy(F.lit(0)))

    w = cells.withColumns({"_all": over(), "_class": over("label")})
    classes = F.size(F.collect_set("label").over(W.partitionBy(F.lit(0))))
    weight = F.col("_all") / (classes * F.col("_class"))
    if by:
        weight = weight * (over(by) / F.col("_all")) / (F.col("n") / F.col("_class"))
    w = w.withColumn("weight", weight)
    mean = F.sum(F.col("weight") * F.col("n")).over(W.partitionBy(F.lit(0))) / F.col("_all")
    w = w.withColumn("weight", F.col("weight") / mean)
    # a join by shuffle would gather each class in one task
    return spine.join(F.broadcast(w.select(*keys, "weight")), keys)
