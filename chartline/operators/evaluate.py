"""Evaluation and audit of scores: confusion, ROC, thresholds, calibration, subgroups, rules.

Input rows: entity, label (0/1), score and any group columns. Ranking
metrics start from distinct scores with class counts and use segment totals
for the cumulative sums, so they are exact and no group is sorted whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import skew
from ..functions import scalar as x
from .hygiene import auc_table

# Sensitivity points and the floors (sensitivity, specificity) of the tiers.
SENS_POINTS = (0.80, 0.85, 0.90, 0.95)
TIERS = (("tier0", 0.80, 0.70), ("tier1", 0.75, 0.65), ("tier2", 0.70, 0.65), ("tier2b", 0.70, 0.60))


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), F.nullif(b, F.lit(0)))


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    """Rates of the four cells as named columns."""
    sens, ppv = _div(tp, tp + fn), _div(tp, tp + fp)
    return [sens.alias("sensitivity"), _div(tn, tn + fp).alias("specificity"), ppv.alias("ppv"), _div(tn, tn + fn).alias("npv"),
            _div(tp + fn, tp + fp + fn + tn).alias("prevalence"), _div(2 * tp, 2 * tp + fp + fn).alias("f1"), _div(5 * tp, 5 * tp + 4 * fn + fp).alias("f2")]


def cells(pred: Column) -> list[Column]:
    """Aggregates counting TP, FP, FN, TN of a 0/1 decision."""
    y = F.col("label") == 1
    return [x.count_where(pred & y).alias("tp"), x.count_where(pred & ~y).alias("fp"), x.count_where(~pred & y).alias("fn"), x.count_where(~pred & ~y).alias("tn")]


def confusion(pred: DataFrame, threshold: float | Column, by: Sequence[str] = ()) -> DataFrame:
    t = pred.groupBy(*by).agg(*cells(F.col("score") >= threshold))
    return t.select("*", *rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def score_cells(pred: DataFrame, by: Sequence[str] = (), score: str = "score") -> DataFrame:
    """Distinct scores with cumulative counts tp, fp (at or above the score) and class totals p_all, q_all."""
    c = pred.where(F.col(score).isNotNull()).groupBy(*by, score).agg(x.count_where(F.col("label") == 1).alias("p"), x.count_where(F.col("label") == 0).alias("q"))
    r = skew.running_total(c, list(by), score, ["p", "q"], skew.number_buckets(F.col(score)))
    return r.select(*by, score, "p", "q", (F.col("p_all") - F.col("p_before")).alias("tp"), (F.col("q_all") - F.col("q_before")).alias("fp"),
                    "p_all", "q_all")


def auroc_auprc(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AUROC (ties half) and average precision per group; NULL with one class."""
    r = score_cells(pred, by)
    neg_below = F.col("q_all") - F.col("fp")
    u = F.sum(F.col("p") * (neg_below + F.col("q") / 2.0))
    ap = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    t = r.groupBy(*by).agg(F.max("p_all").alias("n_pos"), F.max("q_all").alias("n_neg"), u.alias("_u"), ap.alias("_a"))
    return t.select(*by, "n_pos", "n_neg", _div(F.col("_u"), F.col("n_pos") * F.col("n_neg")).alias("auroc"), _div(F.col("_a"), F.col("n_pos")).alias("auprc"))


# --- thresholds -------------------------------------------------------------
def operating_points(pred: DataFrame, by: Sequence[str] = (), min_sens: float | None = None, min_spec: float | None = None) -> DataFrame:
    """Youden, tier ladder, balanced and high-sensitivity operating points per group, and the tier chosen.

    All rules are conditional maxima over the table of distinct scores; equal
    objectives take the higher threshold.
    """
    r = score_cells(pred, by)
    sens, spec = _div(F.col("tp"), F.col("p_all")), 1.0 - _div(F.col("fp"), F.col("q_all"))
    r = r.withColumn("sens", sens).withColumn("spec", spec)
    s, c = F.col("sens"), F.col("spec")

    def best(objective, cond=None):
        o = F.struct(F.round(objective, 12).alias("o"), F.col("score").alias("threshold"), s.alias("sensitivity"), c.alias("specificity"))
        return F.max(o if cond is None else F.when(cond, o))

    floor = x.all_of([F.lit(True)] + ([s >= min_sens] if min_sens else []) + ([c >= min_spec] if min_spec else []))
    rules = [("youden", s + c, None), *[(n, s + c, (s >= a) & (c >= b)) for n, a, b in TIERS], ("tier3", F.least(s, c), None),
             ("tier90", c, s >= 0.90), ("floors", s + c, floor)]
    t = r.groupBy(*by).agg(*[best(o, cond).alias(n) for n, o, cond in rules])
    chosen = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in ("tier0", "tier1", "tier2", "tier2b", "tier3")])
    t = t.withColumn("_c", chosen)
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"{n}.threshold").alias("threshold"), F.col(f"{n}.sensitivity").alias("sensitivity"),
                              F.col(f"{n}.specificity").alias("specificity"), x.flag(F.col("_c") == n).alias("chosen")) for n, _, _ in rules])
    return t.select(*by, F.explode(rows).alias("r")).select(*by, "r.*").where(F.col("threshold").isNotNull())


def sens_threshold(pred: DataFrame, target: float = 0.90, by: Sequence[str] = ()) -> DataFrame:
    """Positive score at 0-based position floor((1 - target) * n): the highest cut that keeps the target sensitivity."""
    v = skew.value_ranks(pred.where(F.col("label") == 1), list(by), "score", skew.number_buckets(F.col("score")))
    idx = F.least(F.greatest(F.floor((1.0 - target) * F.col("n_all")), F.lit(0)), F.col("n_all") - 1)
    at = (F.col("n_before") <= idx) & (idx < F.col("n_before") + F.col("n"))
    return v.groupBy(*by).agg(F.max(F.when(at, F.col("score"))).alias("threshold"), F.max("n_all").alias("n_pos"))


def threshold_by(calib: DataFrame, group: str, target: float = 0.90, min_pos: int = 20) -> DataFrame:
    """Target-sensitivity cut per group; groups with few positives take the global cut."""
    g = sens_threshold(calib, target).first()["threshold"]
    per = sens_threshold(calib, target, [group])
    groups = calib.select(group).distinct()
    out = groups.join(per, group, "left").na.fill(0, ["n_pos"])
    ok = F.col("n_pos") >= min_pos
    return out.select(group, "n_pos", F.when(ok, F.col("threshold")).otherwise(F.lit(g)).alias("threshold"), x.flag(~ok).alias("is_global"))


def fit_quartiles(calib: DataFrame, c: str) -> list[float]:
    """Three quartile edges of a column: three numbers, to be stored and reused."""
    r = skew.quantiles(calib, [], c, {"a": 0.25, "b": 0.5, "c": 0.75}).first()
    return [r["a"], r["b"], r["c"]]


def quartile(c: str, edges: Sequence[float]) -> Column:
    v = F.col(c)
    return F.when(v < edges[0], "Q1").when(v < edges[1], "Q2").when(v < edges[2], "Q3").otherwise("Q4")


# --- groups and calibration -------------------------------------------------
def within(pred: DataFrame, edges: Sequence[float], labels: Sequence[str], age: str = "age", min_pos: int = 10) -> DataFrame:
    """AUROC and AUPRC inside each age band, the macro mean over bands, and the global value."""
    b = pred.withColumn("band", x.band(age, edges, labels)).where(F.col("band").isNotNull())
    per = auroc_auprc(b, ["band"]).where((F.col("n_pos") >= min_pos) & (F.col("n_neg") > 0))
    macro = per.agg(F.lit("MACRO").alias("band"), F.sum("n_pos").alias("n_pos"), F.sum("n_neg").alias("n_neg"), F.avg("auroc").alias("auroc"), F.avg("auprc").alias("auprc"))
    return per.unionByName(macro).unionByName(auroc_auprc(pred).withColumn("band", F.lit("GLOBAL")))


def reliability(pred: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """Equal-width bins: rows, mean score, observed rate."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return pred.withColumn("bin", b).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg("label").alias("rate"))


def calibration(pred: DataFrame, by: Sequence[str] = (), bins: int = 10) -> DataFrame:
    """ECE, Brier, Brier skill, slope and intercept of the label on the logit of the score."""
    rel = reliability(pred, by, bins)
    ece = rel.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n")).alias("ece"))
    y, p = F.col("label").cast("double"), F.col("score")
    lg = x.logit(p)
    m = pred.withColumn("_lg", lg).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((p - y) * (p - y)).alias("brier"), F.avg(y).alias("base"),
        F.regr_slope(y, F.col("_lg")).alias("slope"), F.regr_intercept(y, F.col("_lg")).alias("intercept"))
    m = m.withColumn("brier_skill", 1.0 - F.try_divide(F.col("brier"), F.nullif(F.col("base") * (1 - F.col("base")), F.lit(0.0))))
    return skew.join_null_safe(m, ece, list(by)) if by else skew.one_row(m, ece)


def audit(pred: DataFrame, strata: dict[str, Column | str], threshold: float, min_n: int = 30, points: float = 0.05) -> DataFrame:
    """Metrics per stratum and group, with the spread of sensitivity over a stratum's groups and a disparity flag.

    Each row is counted once per stratum; everything after the first grouping
    is on distinct (stratum, group, score).
    """
    pairs = F.array(*[F.struct(F.lit(k).alias("stratum"), F.coalesce(x.col(c).cast("string"), F.lit("Unknown")).alias("group")) for k, c in strata.items()])
    e = pred.select("label", "score", F.explode(pairs).alias("s")).select("label", "score", "s.*")
    by = ["stratum", "group"]
    t = confusion(e, threshold, by).where(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") >= min_n)
    t = t.join(auroc_auprc(e, by).drop("n_pos", "n_neg"), by).join(calibration(e, by).select(*by, "brier", "ece"), by)
    spread = t.groupBy("stratum").agg((F.max("sensitivity") - F.min("sensitivity")).alias("sens_spread"), F.count("sensitivity").alias("_k"))
    return t.join(spread, "stratum").withColumn("disparity", x.flag((F.col("_k") >= 2) & (F.col("sens_spread") > points))).drop("_k")


def iso_sensitivity(test: DataFrame, holdout: DataFrame, prevalence: float = 0.0015, points: Sequence[float] = SENS_POINTS) -> DataFrame:
    """At fixed sensitivities: threshold from the test positives, specificity on test and on an all-negative hold-out, PPV and alerts per 1000."""
    names = {f"s{int(s * 100)}": 1.0 - s for s in points}
    thr = skew.quantiles(test.where(F.col("label") == 1), [], "score", names, skew.number_buckets(F.col("score"))).first()
    def below(df):
        return df.agg(*[F.avg(x.flag(F.col("score") < thr[n])).alias(n) for n in names]).first()
    neg, hold = below(test.where(F.col("label") == 0)), below(holdout)
    rows = []
    for s, n in zip(points, names):
        denom = s * prevalence + (1.0 - hold[n]) * (1.0 - prevalence)
        rows.append((float(s), float(thr[n]), float(neg[n]), float(hold[n]), s * prevalence / denom if denom > 0 else 0.0, denom * 1000.0))
    return test.sparkSession.createDataFrame(rows, "sens double, threshold double, spec_test double, spec_holdout double, ppv double, alerts_per_1k double")


def iso_winner(models: dict[str, tuple[DataFrame, DataFrame]], prevalence: float = 0.0015, points: Sequence[float] = SENS_POINTS) -> DataFrame:
    """Hold-out specificity of several models (test, hold-out) at equal sensitivities, one row per point, and the winner: the
    highest, the first named on ties."""
    parts = [iso_sensitivity(a, b, prevalence, points).select("sens", F.lit(i).alias("i"), F.lit(n).alias("model"), "spec_holdout") for i, (n, (a, b)) in enumerate(models.items())]
    every = reduce(DataFrame.unionByName, parts)
    best = F.max(F.struct("spec_holdout", (-F.col("i")).alias("first"), "model"))["model"]
    return every.groupBy("sens").agg(*[F.max(F.when(F.col("model") == n, F.col("spec_holdout"))).alias(n) for n in models], best.alias("winner"))


def combined(test: DataFrame, holdout: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Internal test and an all-negative hold-out as one set, at named thresholds and at a fresh Youden point."""
    both = test.select("entity", "label", "score").unionByName(holdout.select("entity", F.lit(0).alias("label"), "score"))
    fresh = operating_points(both).where(F.col("rule") == "youden").first()["threshold"]
    t = sweep(both, [*thresholds.values(), fresh])
    names = x.lookup(F.col("i"), dict(enumerate([*thresholds, "fresh"])))
    auc = auroc_auprc(both).first()["auroc"]
    return t.withColumn("run", names).withColumn("auroc", F.lit(auc)).drop("i")


def sweep(pred: DataFrame, grid: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Confusion and rates at every threshold of a grid, in one pass without multiplying rows."""
    y, s = F.col("label") == 1, F.col("score")
    aggs = [F.struct(F.lit(float(t)).alias("threshold"), F.lit(i).alias("i"), x.count_where((s >= t) & y).alias("tp"), x.count_where((s >= t) & ~y).alias("fp"),
                     x.count_where((s < t) & y).alias("fn"), x.count_where((s < t) & ~y).alias("tn")).alias(f"g{i}") for i, t in enumerate(grid)]
    g = pred.groupBy(*by).agg(*aggs).select(*by, F.explode(F.array(*[F.col(f"g{i}") for i in range(len(grid))])).alias("g")).select(*by, "g.*")
    return g.select("*", *rates(*[F.col(c) for c in ("tp", "fp", "fn", "tn")]))


def best_points(sw: DataFrame) -> DataFrame:
    """Best Youden, best specificity with sensitivity >= .9, best sensitivity with specificity >= .9 of a sweep (lower threshold on ties)."""
    s, c = F.col("sensitivity"), F.col("specificity")
    def best(o, cond=None):
        v = F.struct(F.round(o, 12).alias("o"), (-F.col("threshold")).alias("m"), s.alias("s"), c.alias("c"))
        return F.max(v if cond is None else F.when(cond, v))
    t = sw.agg(best(s + c).alias("youden"), best(c, s >= 0.9).alias("sens90"), best(s, c >= 0.9).alias("spec90"))
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), (-F.col(f"{n}.m")).alias("threshold"), F.col(f"{n}.s").alias("sensitivity"), F.col(f"{n}.c").alias("specificity"))
                     for n in ("youden", "sens90", "spec90")])
    return t.select(F.explode(rows).alias("r")).select("r.*").where(F.col("threshold").isNotNull())


# --- errors -----------------------------------------------------------------
def error_group(threshold: float) -> Column:
    p, y = F.col("score") >= threshold, F.col("label") == 1
    return F.when(p & y, "TP").when(p, "FP").when(y, "FN").otherwise("TN")


def error_profile(pred: DataFrame, long: DataFrame, threshold: float) -> DataFrame:
    """Mean of each feature in missed and caught cases with the rank-sum z (tie- and continuity-corrected) and stars."""
    g = pred.select("entity", error_group(threshold).alias("grp")).where(F.col("grp").isin("FN", "TP"))
    j = long.join(g, "entity")
    m = j.groupBy("feature").agg(F.avg(F.when(F.col("grp") == "FN", F.col("value"))).alias("fn_mean"), F.avg(F.when(F.col("grp") == "TP", F.col("value"))).alias("tp_mean"))
    c = j.groupBy("feature", "value").agg(x.count_where(F.col("grp") == "FN").alias("p"), x.count_where(F.col("grp") == "TP").alias("q"))
    r = skew.running_total(c, ["feature"], "value", ["p", "q"], skew.number_buckets(F.col("value")))
    t3 = (F.col("p") + F.col("q")).cast("double")
    u = r.groupBy("feature").agg(F.sum("p").alias("n1"), F.sum("q").alias("n2"), F.sum(F.col("p") * (F.col("q_before") + F.col("q") / 2.0)).alias("u"), F.sum(t3 * t3 * t3 - t3).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12.0 * (n + 1.0 - F.try_divide(F.col("ties"), F.nullif(n * (n - 1.0), F.lit(0.0)))))
    d = F.col("u") - n1 * n2 / 2.0
    z = F.try_divide(F.signum(d) * F.greatest(F.abs(d) - 0.5, F.lit(0.0)), F.nullif(sd, F.lit(0.0)))
    s = F.abs("z")
    return m.join(u.withColumn("z", z), "feature").select(
        "feature", "fn_mean", "tp_mean", (F.col("fn_mean") - F.col("tp_mean")).alias("difference"), "z",
        F.when(s > 3.290527, "***").when(s > 2.575829, "**").when(s > 1.959964, "*").otherwise("").alias("significance"))


def fn_rates(pred: DataFrame, strata: dict[str, Column | str], threshold: float) -> DataFrame:
    """Share of missed cases per group, with near misses (score >= 0.8 x threshold) and very low scores (< 0.1)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("stratum"), x.col(c).cast("string").alias("group")) for k, c in strata.items()])
    e = pred.where(F.col("label") == 1).select("score", F.explode(pairs).alias("s")).select("score", "s.*")
    miss = F.col("score") < threshold
    return e.groupBy("stratum", "group").agg(
        F.count(F.lit(1)).alias("cases"), x.count_where(miss).alias("missed"), F.avg(x.flag(miss)).alias("fn_rate"),
        x.count_where(miss & (F.col("score") >= 0.8 * threshold)).alias("near_miss"), x.count_where(F.col("score") < 0.1).alias("very_low"))


def archetypes(pred: DataFrame, rows: DataFrame, threshold: float, kinds: dict[str, Column], age: str = "age", sex: str = "sex") -> DataFrame:
    """Missed cases that fit each archetype (a condition over ``rows``' columns): number, share of all missed, mean age, share
    of men, mean score. Archetypes may overlap; one grouping, no rows multiplied."""
    missed = pred.select("entity", "label", "score").where((F.col("label") == 1) & (F.col("score") < threshold)).join(rows.drop("label", "score"), "entity")
    hit = {n: F.coalesce(c, F.lit(False)) for n, c in kinds.items()}
    one = [F.struct(F.lit(n).alias("archetype"), x.count_where(h).alias("missed"), F.avg(x.flag(h)).alias("share"), F.avg(F.when(h, F.col(age))).alias("mean_age"),
                    F.avg(F.when(h, x.flag(F.col(sex) == "M"))).alias("male_share"), F.avg(F.when(h, F.col("score"))).alias("mean_score")) for n, h in hit.items()]
    return missed.agg(F.array(*one).alias("a")).select(F.explode("a").alias("r")).select("r.*")


# --- rules and points -------------------------------------------------------
def rules(long: DataFrame, spine: DataFrame, pcts: Sequence[float] = (0.25, 0.5, 0.75, 0.90), min_side: int = 50) -> DataFrame:
    """Best single-feature cut by lift: percentiles of the positive values, both directions, absent rows as 0.

    Runs on distinct (feature, value) cells with class counts.
    """
    y = spine.select("entity", "label")
    tot = y.agg(x.count_where(F.col("label") == 1).alias("p"), x.count_where(F.col("label") == 0).alias("q")).first()
    cells_ = long.join(y, "entity").groupBy("feature", "value").agg(x.count_where(F.col("label") == 1).alias("p"), x.count_where(F.col("label") == 0).alias("q"))
    pos = long.where(F.col("value") > 0)
    q = skew.quantiles(pos, ["feature"], "value", {f"c{int(p * 100)}": p for p in pcts})
    cuts = q.select("feature", F.explode(F.array(*[F.col(f"c{int(p * 100)}") for p in pcts])).alias("cut")).distinct()
    j = cells_.join(cuts, "feature")
    above = F.col("value") > F.col("cut")
    a = j.groupBy("feature", "cut").agg(F.sum(F.when(above, F.col("p")).otherwise(0)).alias("pa"), F.sum(F.when(above, F.col("q")).otherwise(0)).alias("qa"))
    P, Q = float(tot["p"]), float(tot["q"])
    two = a.select("feature", "cut", F.explode(F.array(
        F.struct(F.lit(">").alias("direction"), F.col("pa").cast("double").alias("p"), F.col("qa").cast("double").alias("q")),
        F.struct(F.lit("<=").alias("direction"), (P - F.col("pa")).alias("p"), (Q - F.col("qa")).alias("q")))).alias("d")).select("feature", "cut", "d.*")
    p_, q_ = F.col("p"), F.col("q")
    n_in, n_out = p_ + q_, F.lit(P + Q) - p_ - q_
    lift = (p_ / n_in) / F.greatest((P - p_) / n_out, F.lit(0.001))
    ok = two.where((n_in >= min_side) & (n_out >= min_side)).select(
        "feature", F.col("cut").alias("threshold"), "direction", (p_ / P * 100).alias("pct_pos"), (q_ / Q * 100).alias("pct_neg"), lift.alias("lift"))
    return skew.top_by(ok, ["feature"], [F.desc(F.round("lift", 9)), F.col("threshold"), F.col("direction")], 1)


def combo(mat: DataFrame, named: dict[str, Column], min_n: int = 10) -> DataFrame:
    """Named AND rules: rows, cases, rate, lift over the base rate, sensitivity. One pass."""
    y = F.col("label") == 1
    aggs = [F.struct(F.lit(n).alias("rule"), x.count_where(c).alias("n"), x.count_where(c & y).alias("n_pos")).alias(f"r{i}") for i, (n, c) in enumerate(named.items())]
    t = mat.agg(*aggs, F.count(F.lit(1)).alias("_n"), x.count_where(y).alias("_p"))
    r = t.select("_n", "_p", F.explode(F.array(*[F.col(f"r{i}") for i in range(len(named))])).alias("r")).select("_n", "_p", "r.*").where(F.col("n") >= min_n)
    rate = F.col("n_pos") / F.col("n")
    return r.select("rule", "n", "n_pos", rate.alias("rate"), (rate / (F.col("_p") / F.col("_n"))).alias("lift"), _div(F.col("n_pos"), F.col("_p")).alias("sensitivity"))


def points(mat: DataFrame, spec: Sequence[tuple[str, str, float, int]]) -> DataFrame:
    """Integer points score: (column, '>' or '>=', cut, points) per criterion; columns not there are skipped."""
    parts = [F.when(F.coalesce((F.col(c) > cut) if op == ">" else (F.col(c) >= cut), F.lit(False)), pts).otherwise(0) for c, op, cut, pts in spec if c in mat.columns]
    return mat.withColumn("points", x.total(parts))


def points_table(scored: DataFrame, cuts: Sequence[int] = tuple(range(16))) -> DataFrame:
    t = sweep(scored.withColumn("score", F.col("points").cast("double")), [float(c) for c in cuts])
    return t.select(F.col("threshold").cast("int").alias("cut"), (F.col("tp") + F.col("fp")).alias("n"), "tp", "sensitivity", "specificity", "ppv").where(F.col("n") > 0)


# --- contributions ----------------------------------------------------------
def top_factors(contrib: DataFrame, k: int = 10) -> DataFrame:
    """The k largest contributions of each row (one row per feature to choose from)."""
    return skew.top_by(contrib, ["entity"], [F.desc(F.abs("contribution")), F.col("feature")], k, "rank")


def mean_abs(contrib: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return contrib.groupBy(*by, "feature").agg(F.avg(F.abs("contribution")).alias("mean_abs"), F.avg("contribution").alias("mean_signed"))


def band_stability(contrib: DataFrame, ks: Sequence[int] = (5, 10, 20), band: str = "band", min_n: int = 50) -> DataFrame:
    """Overlap (Jaccard) of the top-k features between bands; bands with few rows are left out."""
    big = contrib.groupBy(band).agg(F.count_distinct("entity").alias("n")).where(F.col("n") >= min_n).select(band)
    m = mean_abs(contrib.join(big, band, "left_semi"), [band])
    w = W.partitionBy(band).orderBy(F.desc(F.round("mean_abs", 12)), "feature")  # one row per feature and band
    m = m.withColumn("r", F.row_number().over(w))
    m = m.withColumn("k", F.explode(F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: F.col("r") <= k)))
    a = m.select("k", "feature", F.col(band).alias("band_a"))
    b = m.select("k", "feature", F.col(band).alias("band_b"))
    size = m.groupBy("k", band).agg(F.count(F.lit(1)).alias("n"))
    inter = a.join(b, ["k", "feature"]).where(F.col("band_a") < F.col("band_b")).groupBy("k", "band_a", "band_b").agg(F.count(F.lit(1)).alias("inter"))
    sa, sb = size.select("k", F.col(band).alias("band_a"), F.col("n").alias("na")), size.select("k", F.col(band).alias("band_b"), F.col("n").alias("nb"))
    pairs = sa.join(sb, "k").where(F.col("band_a") < F.col("band_b")).join(inter, ["k", "band_a", "band_b"], "left").na.fill(0, ["inter"])
    union = F.col("na") + F.col("nb") - F.col("inter")
    return pairs.select(F.col("k").alias("top_k"), "band_a", "band_b", F.col("inter").alias("intersection"), union.alias("union_size"), _div(F.col("inter"), union).alias("jaccard"))


def segment_drivers(contrib: DataFrame, segment: str, k: int = 10) -> DataFrame:
    """Strongest features per segment with the direction of their mean effect."""
    m = mean_abs(contrib, [segment]).withColumn("direction", F.when(F.col("mean_signed") >= 0, "+").otherwise("-"))
    return skew.top_by(m, [segment], [F.desc(F.round("mean_abs", 12)), F.col("feature")], k, "rank")


def parity(a: DataFrame, b: DataFrame, tol: float = 1e-3) -> DataFrame:
    """Re-scored against saved predictions: rows, largest and mean difference, correlation, verdict."""
    j = a.select("entity", F.col("score").alias("sa")).join(b.select("entity", F.col("score").alias("sb")), "entity")
    d = F.abs(F.col("sa") - F.col("sb"))
    return j.agg(F.count(F.lit(1)).alias("n"), F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"), x.correlation("sa", "sb").alias("corr"),
                 F.max(x.flag(d >= tol)).alias("differs"))


# --- predictions ------------------------------------------------------------
def combine_horizons(near: DataFrame, far: DataFrame, cut_near: float, cut_far: float) -> DataFrame:
    """Two horizons per entity: max, mean, OR decision, verdict and who fired.

    Inputs: entity, score, insufficient (0/1). An entity scored by one
    horizon only counts as having insufficient data in the other.
    """
    j = near.select("entity", F.col("score").alias("p_near"), F.col("insufficient").alias("i_near")).join(
        far.select("entity", F.col("score").alias("p_far"), F.col("insufficient").alias("i_far")), "entity", "full_outer")
    fn, ff = F.coalesce(F.col("p_near") >= cut_near, F.lit(False)), F.coalesce(F.col("p_far") >= cut_far, F.lit(False))
    none = (F.coalesce("i_near", F.lit(1)) == 1) & (F.coalesce("i_far", F.lit(1)) == 1)
    mean = F.coalesce((F.col("p_near") + F.col("p_far")) / 2.0, "p_near", "p_far")
    return j.select("entity", F.greatest("p_near", "p_far").alias("p_max"), mean.alias("p_mean"), x.flag(fn | ff).alias("flag_or"),
                    F.when(fn | ff, "Cancer").when(none, "Not enough data").otherwise("No Cancer").alias("verdict"),
                    F.concat_ws(",", F.when(fn, F.lit("1mo")), F.when(ff, F.lit("12mo"))).alias("fired_by"))


PRED_COLUMNS = ("entity", "split", "proba_1", "proba_0", "model_name", "model_version", "abstained")


def validate_preds(df: DataFrame, splits: Sequence[str] = ("valid", "test")) -> DataFrame:
    """(problem, rows) for every broken rule of the predictions contract; no rows when all is well."""
    missing = [c for c in PRED_COLUMNS if c not in df.columns]
    if missing:
        return df.sparkSession.createDataFrame([(f"missing column {c}", 1) for c in missing], "problem string, rows bigint")
    ab = F.coalesce(F.col("abstained"), F.lit(False))
    p1, p0 = F.col("proba_1"), F.col("proba_0")
    per_id = df.groupBy("entity").agg(F.count(F.lit(1)).alias("c")).agg(F.sum(F.when(F.col("c") > 1, F.col("c") - 1).otherwise(0)).alias("n"))
    checks = {
        "null id": x.count_where(F.col("entity").isNull()), "bad split": x.count_where(~F.coalesce(F.col("split").isin(*splits), F.lit(False))),
        "abstained with score": x.count_where(ab & p1.isNotNull()), "missing score": x.count_where(~ab & p1.isNull()),
        "score out of range": x.count_where(~ab & ((p1 < 0) | (p1 > 1))), "scores do not sum to 1": x.count_where(~ab & (F.abs(p1 + p0 - 1) > 1e-3)),
        "several models": F.greatest(F.count_distinct("model_name") - 1, F.lit(0)), "several versions": F.greatest(F.count_distinct("model_version") - 1, F.lit(0)),
        "empty version": x.count_where(F.coalesce(F.trim("model_version"), F.lit("")) == ""),
    }
    t = df.agg(*[c.cast("bigint").alias(n) for n, c in checks.items()])
    rows = t.select(F.explode(F.array(*[F.struct(F.lit(n).alias("problem"), F.col(f"`{n}`").alias("rows")) for n in checks])).alias("r")).select("r.*")
    dup = per_id.select(F.lit("repeated id").alias("problem"), F.col("n").cast("bigint").alias("rows"))
    return rows.unionByName(dup).where(F.col("rows") > 0)
