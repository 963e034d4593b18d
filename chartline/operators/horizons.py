"""Logistic regression by Newton steps, and two horizons' scores combined by one.

A step is one aggregation over distinct points (features and label, with their count): the gradient and the upper triangle
of the Hessian, (k + 1)(k + 4) / 2 numbers for k features, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as x
from . import evaluate
from .learn import held

NEAR_FLAT = 1e-9  # penalty of a fit that should have none: keeps the steps finite on separable classes


@dataclass
class Logit:
    """A fitted model: log odds are the intercept and the weighted features."""

    features: list[str]
    intercept: float
    weights: list[float]

    def score(self) -> Column:
        return x.sigmoid(x.total([F.lit(self.intercept), *[F.col(f) * w for f, w in zip(self.features, self.weights)]]))

    def table(self, spark) -> DataFrame:
        rows = [("intercept", self.intercept), *zip(self.features, self.weights)]
        return spark.createDataFrame([(n, float(w)) for n, w in rows], "name string, weight double")


def fit_logit(rows: DataFrame, features: Sequence[str], label: str = "label", penalty: float = 1.0, steps: int = 50, tolerance: float = 1e-12) -> Logit:
    """Weights that minimise the log loss plus penalty / 2 times their squares (the intercept goes free). Rows with a missing
    feature or label are left out; without rows all weights are 0. A step that would raise the loss is halved."""
    k = len(features)
    pts = rows.select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y")).dropna()
    pts = pts.groupBy(*[f"x{i}" for i in range(k)], "y").agg(F.count(F.lit(1)).cast("double").alias("w"))
    ridge = np.array([0.0] + [penalty] * k)
    cols = [F.lit(1.0), *[F.col(f"x{i}") for i in range(k)]]

    with held(pts) as pts:
        def sums(b: np.ndarray):
            z = x.total([c * float(v) for c, v in zip(cols, b)])
            p, w = x.sigmoid(z), F.col("w")
            loss = w * (F.log1p(F.exp(-F.abs(z))) + F.greatest(z, F.lit(0.0)) - F.col("y") * z)
            g = [F.sum(w * (F.col("y") - p) * c).alias(f"g{i}") for i, c in enumerate(cols)]
            h = [F.sum(w * p * (1.0 - p) * cols[i] * cols[j]).alias(f"h{i}_{j}") for i in range(k + 1) for j in range(i, k + 1)]
            r = pts.agg(F.sum(loss).alias("loss"), *g, *h).first()
            if r["loss"] is None:
                return None
            hess = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
            return r["loss"] + (ridge * b * b).sum() / 2, np.array([r[f"g{i}"] for i in range(k + 1)]) - ridge * b, hess + np.diag(ridge)

        b = np.zeros(k + 1)
        now = sums(b)
        for _ in range(steps if now else 0):
            loss, grad, hess = now
            step = np.linalg.lstsq(hess, grad, rcond=None)[0]
            now = sums(b + step)
            while now[0] > loss + 1e-12 * abs(loss) and np.abs(step).max() > tolerance:
                step = step / 2
                now = sums(b + step)
            b = b + step
            if np.abs(step).max() < tolerance:
                break
    return Logit(list(features), float(b[0]), [float(v) for v in b[1:]])


def out_of_fold(rows: DataFrame, features: Sequence[str], fold: str = "fold", label: str = "label", penalty: float = 1.0) -> DataFrame:
    """The rows with ``score``: every row is scored once, by the model fitted on the other folds. A handful of folds is assumed;
    rows without a fold get no score."""
    score = F.lit(None).cast("double")
    for (f,) in rows.select(fold).where(F.col(fold).isNotNull()).distinct().orderBy(fold).collect():
        score = F.when(F.col(fold) == f, fit_logit(rows.where(F.col(fold) != f), features, label, penalty).score()).otherwise(score)
    return rows.withColumn("score", score)


COMBINED = ("near", "far", "max", "mean", "stack")


def stacked(pred: DataFrame, calib: Column, penalty: float = 1.0) -> tuple[DataFrame, Logit]:
    """Rows outside the calibration part with near and far calibrated one by one, their max and mean, and the stack: a
    logistic regression on both raw scores. All three fits see the calibration part alone. pred: entity, label, near, far;
    only rows with both scores are combined."""
    both = pred.where(F.col("near").isNotNull() & F.col("far").isNotNull())
    cal = both.where(calib)
    near, far = (fit_logit(cal, [c], penalty=NEAR_FLAT) for c in ("near", "far"))
    stack = fit_logit(cal, ["near", "far"], penalty=penalty)
    t = both.where(~calib).select("entity", "label", near.score().alias("n"), far.score().alias("f"), stack.score().alias("stack"))
    return t.select("entity", "label", F.col("n").alias("near"), F.col("f").alias("far"), F.greatest("n", "f").alias("max"), ((F.col("n") + F.col("f")) / 2.0).alias("mean"), "stack"), stack


def report(scored: DataFrame) -> DataFrame:
    """(combine, threshold, auroc, auprc, sensitivity, specificity, ppv, npv) of each combination at its Youden point, and of
    'or': near or far above its own threshold."""
    pair = F.array(*[F.struct(F.lit(n).alias("combine"), F.col(n).alias("score")) for n in COMBINED])
    long = scored.select("entity", "label", F.explode(pair).alias("s")).select("entity", "label", "s.combine", "s.score")
    points = evaluate.operating_points(long, ["combine"]).where("rule = 'youden'").select("combine", "threshold")
    at = evaluate.confusion(long.join(points, "combine"), F.col("threshold"), ["combine"])
    names = ("sensitivity", "specificity", "ppv", "npv")
    table = evaluate.auroc_auprc(long, ["combine"]).select("combine", "auroc", "auprc").join(points, "combine").join(at.select("combine", *names), "combine")
    cut = {r["combine"]: r["threshold"] for r in points.where(F.col("combine").isin("near", "far")).collect()}
    if cut:
        hit = (F.col("near") >= cut["near"]) | (F.col("far") >= cut["far"])
        either = evaluate.confusion(scored.withColumn("score", x.flag(hit).cast("double")), 0.5).select(F.lit("or").alias("combine"), *names)
        table = table.unionByName(either, allowMissingColumns=True)
    return table.select("combine", "threshold", "auroc", "auprc", *names)
