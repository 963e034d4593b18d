"""Correlated pairs among very many sparse columns, exactly, from the stored rows alone.

Columns are features of a long table (entity, feature, value); an entity without a row has 0. Nothing of the size features x
features or entities x features is made. Instead every column is a vector of length 1, and columns whose correlation is
beyond the limit need a dot product that can be bounded from below: so they must share an entity early in any fixed order
of the entities, where neither vector's rest is too short. Only these first rows of every column ("prefixes": a few hundredths
of its mass at a limit of 0.98) are joined, and the pairs that meet are computed whole.

Columns stored for at most ``SPARSE`` of the entities are taken as they are: their mean moves them little, and the bound
pays for it. The others ("dense"; at most 1 / SPARSE times an average entity's number of features) are centred first, absent rows
included. Dense columns are correlated with each other by sums of products of the entities' stored rows, block by block of columns in every
task; what a dense and a sparse column share is bounded by the sparse one's first row. Entities with few features come first in the order, so
that long rows are seldom in a prefix.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .. import skew
from ..session import cut_lineage, literal_table

SPARSE = 0.05


def moments(long: DataFrame, n: int) -> DataFrame:
    """(feature, stored, mean, ss, length): stored rows, mean, sum of squares around the mean and length of each column, absent
    rows as 0; from each column's own mean and variance, so that nothing cancels."""
    t = long.groupBy("feature").agg(F.count(F.lit(1)).alias("stored"), F.avg("value").alias("a"), F.var_pop("value").alias("v"))
    c = F.col("stored").cast("double")
    mean = c * F.col("a") / float(n)
    ss = c * F.col("v") + c * (F.col("a") - mean) * (F.col("a") - mean) + (float(n) - c) * mean * mean
    return t.select("feature", "stored", mean.alias("mean"), ss.alias("ss"), F.sqrt(ss + float(n) * mean * mean).alias("length"))


def label_correlation(long: DataFrame, spine: DataFrame) -> DataFrame:
    """(feature, corr) with the label over all entities of the spine; NULL for a constant column or label."""
    y = spine.select("entity", "label")
    r = y.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("m"), F.var_pop("label").alias("v")).first()
    n, mean, var = r["n"], r["m"] or 0.0, r["v"] or 0.0
    own = long.join(y, "entity").withColumn("value", F.col("value").cast("double"))
    cov = own.groupBy("feature").agg(F.sum(F.col("value") * (F.col("label") - mean)).alias("cov"))
    den = F.sqrt(F.col("ss") * float(n * var))
    return moments(own, n).join(cov, "feature").select("feature", F.try_divide(F.col("cov"), F.when(den > 1e-12 * F.col("length"), den)).alias("corr"))


def _placed(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, at): the order of the entities, those with few features first."""
    size = rows.where("value <> 0").groupBy("entity").agg(F.count(F.lit(1)).alias("size"))
    return entities.join(size, "entity", "left").select("entity", (F.shiftleft(F.least(F.coalesce("size", F.lit(0).cast("long")), F.lit(1 << 22)), 40) + F.shiftrightunsigned(F.xxhash64("entity"), 24)).alias("at"))


def _prefixes(rows: DataFrame, stats: DataFrame, at: DataFrame, n: int, limit: float) -> DataFrame:
    """(feature, at): the places, in the order of entities, where a sparse column can first meet a partner."""
    cos_max, sin_max = sqrt(1 - SPARSE), sqrt(SPARSE)
    cos, sin = F.sqrt("ss") / F.col("length"), F.abs("mean") * sqrt(n) / F.col("length")
    need = F.greatest(limit * cos * cos_max - sin * sin_max, F.lit(0.0)) ** 2
    s = stats.where("NOT dense").select("feature", "length", need.alias("need"))
    mass = F.col("value") * F.col("value") / (F.col("length") * F.col("length"))
    unit = rows.join(s, "feature").join(at, "entity").groupBy("feature", "at").agg(F.sum(mass).alias("mass"), F.max("need").alias("need"))
    run = skew.running_total(unit, ["feature"], "at", ["mass"], [F.shiftright("at", 40), F.shiftright("at", 30)])
    return run.where(1.0 - F.col("mass_before") >= F.col("need") - 1e-9).select("feature", "at")


def _mixed(rows: DataFrame, stats: DataFrame, at: DataFrame, first: DataFrame, limit: float) -> DataFrame:
    """(feature, other): a sparse and a dense column, in the order of their names, whose prefixes meet. A dense column's prefix takes in all
    places up to its end, so it meets a sparse one's first row or none. Ends are found in stretches of the order, never too early."""
    stretch, end = F.shiftright("at", 33), (1 << 62)
    need = limit * limit * (1 - SPARSE)
    facts = stats.where("dense").select("feature", "mean", "ss")
    base, own = F.col("mean") * F.col("mean") / F.col("ss"), F.col("value") - F.col("mean")
    cells = rows.join(facts, "feature").join(at, "entity").groupBy("feature", stretch.alias("s")).agg(F.sum(own * own / F.col("ss") - base).alias("mass"), F.max(base).alias("base"))
    before = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("s").rowsBetween(W.unboundedPreceding, -1))  # a row for each stretch
    sizes = at.groupBy(stretch.alias("s")).agg(F.count(F.lit(1)).alias("n")).select("s", F.coalesce(before, F.lit(0)).alias("n_before"))
    by = W.partitionBy("feature").orderBy("s")
    cells = cells.join(sizes, "s").select("feature", "s", (F.coalesce(F.sum("mass").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)) + F.col("n_before") * F.col("base")).alias("mass_before"), F.lead("s").over(by).alias("next"))
    ends = cells.groupBy("feature").agg(F.coalesce(F.max(F.when(1.0 - F.col("mass_before") >= need - 1e-9, F.coalesce("next", F.lit(end)))), F.min("s")).alias("last"))
    start = first.groupBy("feature").agg(F.min(stretch).alias("s"))
    met = start.join(F.broadcast(ends.select(F.col("feature").alias("other"), "last")), F.col("s") <= F.col("last"))
    return met.select(F.least("feature", "other").alias("feature"), F.greatest("feature", "other").alias("other"))


def _dense_pairs(rows: DataFrame, dense: list, entities: DataFrame, limit: float) -> DataFrame:
    """(a, b, corr) of dense columns. dense: their (feature, mean, ss) in the order of names."""
    from .hygiene import block_pairs  # which imports this module

    names, k = [r["feature"] for r in dense], len(dense)
    mean, scale = (np.array([f(r) for r in dense], float) for f in (lambda r: r["mean"], lambda r: sqrt(r["ss"])))
    index = literal_table(rows.sparkSession, [{"feature": f, "idx": i} for i, f in enumerate(names)], "feature string, idx int")
    # every entity has a row, so that the ones without a dense feature count as zeros
    long = rows.join(F.broadcast(index), "feature").select("entity", "idx", "value").unionByName(entities.select("entity", F.lit(-1).alias("idx"), F.lit(0.0).alias("value")))
    laid = long.select(F.xxhash64("entity").alias("h"), "entity", "idx", "value").repartition("h", "entity").sortWithinPartitions("h", "entity", "idx")
    laid = laid.select((F.col("idx") < 0).alias("head"), "idx", "value")  # an entity's rows follow its head

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        def matrix(row: np.ndarray, idx: np.ndarray, value: np.ndarray) -> np.ndarray:
            z = np.tile(-mean / scale, (int(row[-1]) + 1, 1))
            own = idx >= 0
            z[row[own], idx[own]] += value[own] / scale[idx[own]]
            return z

        kept = None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("head", "idx", "value")]
            if kept is not None:
                cols = [np.concatenate(c) for c in zip(kept, cols)]
            heads = np.flatnonzero(cols[0])
            if len(heads) > 1:
                cut = heads[-1]
                yield matrix(np.cumsum(cols[0][:cut]) - 1, cols[1][:cut], cols[2][:cut])
                cols = [c[cut:] for c in cols]
            kept = cols
        if kept is not None and len(kept[0]):
            yield matrix(np.cumsum(kept[0]) - 1, kept[1], kept[2])

    found = block_pairs(laid, matrices, k, limit)
    name = lambda c, at: F.broadcast(index.select(F.col("feature").alias(c), F.col("idx").cast("long").alias(at)))
    return found.join(name("a", "i"), "i").join(name("b", "j"), "j").select("a", "b", "corr")


def correlated_pairs(long: DataFrame, entities: DataFrame, limit: float) -> DataFrame:
    """(a, b, corr) of features a < b with absolute correlation above ``limit`` (above 0.3, so that bounds hold) over the
    entities. Values that are NULL or 0 count as absent, several rows of one entity and feature are added up, constant
    columns correlate with nothing."""
    if not 0.3 <= limit < 1:
        raise ValueError("limit must lie between 0.3 and 1")
    who = entities.select("entity").distinct()
    rows = long.where(F.col("value").isNotNull()).groupBy("entity", "feature").agg(F.sum(F.col("value").cast("double")).alias("value")).where("value <> 0")
    rows = cut_lineage(rows.join(who, "entity"))
    n = who.count()
    stats = moments(rows, n).where(F.col("ss") > 1e-12 * F.col("length") * F.col("length"))
    stats = cut_lineage(stats.withColumn("dense", F.col("stored") > SPARSE * n))
    dense = stats.where("dense").select("feature", "mean", "ss").orderBy("feature").collect()  # at most 1 / SPARSE features an entity
    own = rows.join(stats.select("feature"), "feature")
    at = _placed(own, who)
    first = _prefixes(own, stats, at, n, limit)
    meet = first.join(first.select(F.col("feature").alias("other"), "at"), "at").where("feature < other").select("feature", "other").distinct()
    if dense:
        meet = meet.unionByName(_mixed(own, stats, at, first, limit))
    facts = stats.select("feature", "stored", "mean", "ss")
    pair = meet.join(facts, "feature").join(facts.select(*[F.col(c).alias("other" if c == "feature" else f"{c}_2") for c in facts.columns]), "other")
    # the column with fewer rows is read through, the other looked up
    flip = F.col("stored") > F.col("stored_2")
    pair = pair.select(F.when(flip, F.col("other")).otherwise(F.col("feature")).alias("feature"), F.when(flip, F.col("feature")).otherwise(F.col("other")).alias("other"),
                       *[F.when(flip, F.col(y)).otherwise(F.col(x)).alias(z) for c in ("stored", "mean", "ss") for x, y, z in ((c, f"{c}_2", c), (f"{c}_2", c, f"{c}_2"))])
    pair = cut_lineage(pair)
    shared = pair.select("feature", "other", "mean", "mean_2").join(own, "feature").join(own.select(F.col("feature").alias("other"), "entity", F.col("value").alias("v2")), ["other", "entity"])
    d1, d2 = F.col("value") - F.col("mean"), F.col("v2") - F.col("mean_2")
    sums = shared.groupBy("feature", "other").agg(F.sum(d1 * d2).alias("xy"), F.sum(d1).alias("x"), F.sum(d2).alias("y"), F.count(F.lit(1)).alias("both"))
    m1, m2 = F.col("mean"), F.col("mean_2")
    at0 = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    # rows of one column alone, and of neither, in centred values
    x_only, y_only = m1 * (float(n) - F.col("stored")) - at0("x"), m2 * (float(n) - F.col("stored_2")) - at0("y")
    none = float(n) - F.col("stored") - F.col("stored_2") + at0("both")
    cov = at0("xy") - m2 * x_only - m1 * y_only + none * m1 * m2
    corr = pair.join(sums, ["feature", "other"], "left").withColumn("corr", cov / F.sqrt(F.col("ss") * F.col("ss_2")))
    out = corr.where(F.abs("corr") > limit).select(F.least("feature", "other").alias("a"), F.greatest("feature", "other").alias("b"), "corr")
    return out.unionByName(_dense_pairs(own, dense, who, limit)) if len(dense) > 1 else out


def correlated_drops(long: DataFrame, spine: DataFrame, limit: float = 0.98) -> DataFrame:
    """(feature, same_as, corr): features that go, each with the kept one that it repeats. Of a pair the feature less
    correlated with the label goes (equal: the later name); a feature goes only for one that stays. Rounds over the pairs that
    are left: a feature stays when it beats all its partners, and its partners go."""
    own = label_correlation(long, spine).select("feature", F.round(F.abs("corr"), 12).alias("own"))
    p = correlated_pairs(long, spine, limit)
    both = p.unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    rank = lambda c: own.select(F.col("feature").alias(c), F.col("own").alias(f"own_{c}"))
    left = cut_lineage(both.join(rank("a"), "a").join(rank("b"), "b").withColumn("wins", (F.coalesce("own_a", F.lit(0.0)) > F.coalesce("own_b", F.lit(0.0))) | ((F.coalesce("own_a", F.lit(0.0)) == F.coalesce("own_b", F.lit(0.0))) & (F.col("a") < F.col("b")))))
    gone = None
    while not left.isEmpty():
        stay = left.groupBy("a").agg(F.min("wins").alias("w")).where("w").select("a")
        out = left.join(stay, "a").groupBy(F.col("b").alias("feature")).agg(F.min_by(F.struct(F.col("a").alias("same_as"), "corr"), F.struct(-F.round("own_a", 12), F.col("a"))).alias("s")).select("feature", "s.same_as", "s.corr")
        out = cut_lineage(out)
        gone = out if gone is None else gone.unionByName(out)
        done = stay.select(F.col("a").alias("f")).unionByName(out.select(F.col("feature").alias("f"))).distinct()
        left = cut_lineage(left.join(done.withColumnRenamed("f", "a"), "a", "left_anti").join(done.withColumnRenamed("f", "b"), "b", "left_anti"))
    return gone if gone is not None else p.limit(0).select(F.col("a").alias("feature"), F.col("b").alias("same_as"), "corr")
