"""Pattern features: term subtypes, weighted scores, orderings, bursts, gaps, residuals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import skew
from ..functions import scalar as x
from . import counts, timeline as tl


def term_counts(ev: DataFrame, specs: dict[str, tuple[str, str]]) -> DataFrame:
    """Count and flag of events whose category and term pattern match; spec is name -> (category, regex)."""
    aggs = []
    for name, (cat, rx) in specs.items():
        hit = (F.col("category") == cat) & F.col("term").rlike("(?i)" + rx)
        aggs.append(x.count_where(F.coalesce(hit, F.lit(False))).alias(f"{name}_count"))
    out = ev.groupBy("entity").agg(*aggs)
    return out.select("*", *[x.flag(F.col(f"{n}_count") > 0).alias(f"{n}_flag") for n in specs])


def subtype_block(ev: DataFrame, cat: str, patterns: dict[str, str]) -> DataFrame:
    """One category in depth: counts, halves, distinct terms and days, first/last month, term subtypes, recurrence."""
    c = ev.where(F.col("category") == cat)
    a, b = F.col("time_window") == "A", F.col("time_window") == "B"
    subs = [x.count_where(F.coalesce(F.col("term").rlike("(?i)" + rx), F.lit(False))).alias(f"{n}_count") for n, rx in patterns.items()]
    t = c.groupBy("entity").agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("term").alias("unique_terms"), F.count_distinct("event_date").alias("unique_dates"),
        x.count_where(a).alias("count_A"), x.count_where(b).alias("count_B"), F.max("months_before").alias("first_months"),
        F.min("months_before").alias("last_months"), F.avg("months_before").alias("mean_months"), *subs)
    return t.select("*", (F.col("first_months") - F.col("last_months")).alias("span_months"), x.flag(F.col("total") > 1).alias("recurrent"),
                    x.flag(F.col("total") >= 3).alias("frequent"), x.ratio("count_B", "count_A", "only_b").alias("acceleration"))


def score(ev: DataFrame, weights: dict[str, float], cut: float = 5.0, by: str = "category") -> DataFrame:
    """Sum of weights over the categories an entity has, high flag, times age."""
    per = ev.groupBy("entity", by).agg(F.max("age").alias("age"))
    w = F.coalesce(x.lookup(F.col(by), weights), F.lit(0.0))
    t = per.groupBy("entity").agg(F.sum(w).alias("score"), F.max("age").alias("age"))
    return t.select("entity", "score", x.flag(F.col("score") >= cut).alias("score_high"), (F.col("score") * F.col("age")).alias("score_x_age"))


def systems(ev: DataFrame, defs: dict[str, Sequence[str]]) -> DataFrame:
    """Symptom systems active in the recent half; pair and trifecta flags."""
    b = ev.where(F.col("time_window") == "B")
    t = b.groupBy("entity").agg(*[F.max(x.flag(F.col("category").isin(*c))).alias(n) for n, c in defs.items()])
    n = x.total([F.col(k) for k in defs])
    return t.select("*", n.alias("n_systems"), x.flag(n >= 2).alias("pair"), x.flag(n >= 3).alias("trifecta"))


def velocity_counts(tall: DataFrame) -> DataFrame:
    """Rise of the count from A to B (not below 0) and capped activity ratio."""
    a, b = F.col("count_A"), F.col("count_B")
    return tall.select("*", F.greatest(b - a, F.lit(0)).alias("velocity"),
                       F.least(b / F.when(a == 0, 1).otherwise(a), F.lit(10.0)).alias("activity_ratio"))


def deciles(mat: DataFrame, c: str, q: int = 10, id_col: str = "entity", name: str = "decile") -> DataFrame:
    """Quantile bucket 0..q-1 of the first-come rank; equal values are ordered by md5 of the id.

    Rank = rows with smaller values (distinct-value totals) + position among
    equals (hash parts): no window over the whole table.
    """
    before = skew.value_ranks(mat, [], c).select(c, "n_before", "n_all")
    pos = skew.hash_rank(mat.where(F.col(c).isNotNull()).select(id_col, c), [c], [id_col], "qcut").select(id_col, c, "rank")
    r = pos.join(before, c)
    i = F.col("n_before") + F.col("rank") - 1
    bucket = F.greatest(F.ceil(i * F.lit(float(q)) / F.greatest(F.col("n_all") - 1, F.lit(1))) - 1, F.lit(0)).cast("int")
    return mat.join(r.select(id_col, bucket.alias(name)), id_col, "left")


def since_first(ev: DataFrame, groups: dict[str, Sequence[str]], recent: float = 12.0) -> DataFrame:
    """Months from the first event of each group to the anchor (-1 without one) and recent-onset flags."""
    aggs = []
    for name, cats in groups.items():
        first = F.min(F.when(F.col("category").isin(*cats), F.col("event_date")))
        aggs.append(F.coalesce(F.date_diff(F.max("anchor_date"), first) / 30.44, F.lit(-1.0)).alias(f"{name}_months"))
    out = ev.groupBy("entity").agg(*aggs)
    return out.select("*", *[x.flag((F.col(f"{n}_months") >= 0) & (F.col(f"{n}_months") < recent)).alias(f"{n}_recent") for n in groups])


def _member(spec: Sequence[str] | tuple[str, Sequence[str]]) -> Column:
    """Categories, optionally limited to one event type: ['X'] or ('med', ['X'])."""
    if isinstance(spec, tuple) and len(spec) == 2 and not isinstance(spec[1], str):
        return (F.col("event_type") == spec[0]) & F.col("category").isin(*spec[1])
    return F.col("category").isin(*spec)


def then_within(ev: DataFrame, specs: dict[str, tuple[Sequence, Sequence, int]]) -> DataFrame:
    """First X, then first Y within z days: all pairs from one pass over the events."""
    firsts = {}
    for name, (xs, ys, _) in specs.items():
        firsts |= {f"{name}_x": _member(xs), f"{name}_y": _member(ys)}
    d = counts.first_dates(ev, firsts)
    return d.select("entity", *[
        x.flag(F.date_diff(f"{n}_y", f"{n}_x").between(0, z)).alias(n) for n, (_, _, z) in specs.items()])


def time_between(ev: DataFrame, pairs: dict[str, tuple[Sequence, Sequence]]) -> DataFrame:
    """Days from first X to first Y, and whether Y came first, within 30 or 90 days, or later."""
    firsts = {}
    for name, (xs, ys) in pairs.items():
        firsts |= {f"{name}_x": _member(xs), f"{name}_y": _member(ys)}
    d = counts.first_dates(ev, firsts)
    out = []
    for n in pairs:
        g = F.date_diff(f"{n}_y", f"{n}_x")
        out += [g.alias(f"{n}_days"), x.flag(g < 0).alias(f"{n}_y_first"), x.flag(g.between(0, 30)).alias(f"{n}_within_30"),
                x.flag(g.between(0, 90)).alias(f"{n}_within_90"), x.flag(g > 90).alias(f"{n}_delayed")]
    return d.select("entity", *out)


def burst(ev: DataFrame, days: int = 30, by: str = "category") -> DataFrame:
    """Most distinct categories in any window of ``days`` days, with 3+ and 4+ flags.

    Reduced to distinct (entity, day, category) first: the window frame holds
    at most days x categories rows.
    """
    d = ev.where(F.col("event_date").isNotNull()).select("entity", F.unix_date("event_date").alias("d"), by).distinct()
    w = W.partitionBy("entity").orderBy("d").rangeBetween(-days, 0)
    k = d.select("entity", F.size(F.collect_set(by).over(w)).alias("k"))
    t = k.groupBy("entity").agg(F.max("k").alias("max_in_window"))
    return t.select("*", x.flag(F.col("max_in_window") >= 3).alias("burst_3"), x.flag(F.col("max_in_window") >= 4).alias("burst_4"))


def weekly(ev: DataFrame, with_cat: str | None = None) -> DataFrame:
    """Weeks with three events or more, with two categories or more, busiest week, weeks where a category meets others."""
    key = [F.year("event_date").alias("y"), F.weekofyear("event_date").alias("w")]
    days_with = ev.where(F.col("category") == with_cat).select("entity", "event_date").distinct().withColumn("_m", F.lit(1)) if with_cat else None
    e = ev if days_with is None else ev.join(days_with, ["entity", "event_date"], "left")
    marked = F.max(F.coalesce(F.col("_m"), F.lit(0))) if with_cat else F.lit(0)
    weeks = e.groupBy("entity", *key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("category").alias("k"), marked.alias("m"))
    return weeks.groupBy("entity").agg(
        x.count_where(F.col("n") >= 3).alias("burst_weeks"), x.count_where(F.col("k") >= 2).alias("diverse_weeks"), F.max("n").alias("max_per_week"),
        x.count_where((F.col("m") == 1) & (F.col("n") > 1)).alias("together_weeks"))


def gaps(ev: DataFrame) -> DataFrame:
    """Largest, mean and median gap in days between consecutive events of an entity."""
    t = tl.interval_rows(tl.steps(tl.daily(ev, ["entity"]), ["entity"]), ["entity"]).groupBy("entity").agg(*tl.interval_aggs())
    return t.select("entity", F.col("interval_max").alias("max_gap"), F.col("interval_mean").alias("mean_gap"), F.col("interval_median").alias("median_gap"))


def per_day(ev: DataFrame) -> DataFrame:
    return tl.daily(ev, ["entity"]).groupBy("entity").agg(
        F.max("n").alias("max_per_day"), F.avg("n").alias("mean_per_day"), x.count_where(F.col("n") > 1).alias("multi_days"))


def burstiness(ev: DataFrame, windows: dict[str, tuple[int, int]]) -> DataFrame:
    """Spread and maximum of monthly counts, active months, counts per window and their successive differences."""
    m = ev.groupBy("entity", "months_before").agg(F.count(F.lit(1)).alias("n"))
    names = list(windows)
    aggs = [F.sum(F.when(F.col("months_before").between(lo, hi), F.col("n")).otherwise(0)).alias(k) for k, (lo, hi) in windows.items()]
    t = m.groupBy("entity").agg(F.stddev_samp("n").alias("monthly_std"), F.max("n").alias("monthly_max"), F.count(F.lit(1)).alias("active_months"), *aggs)
    steps = [(F.col(b) - F.col(a)).alias(f"{b}_minus_{a}") for a, b in zip(names, names[1:])]
    return t.select("*", *steps, (F.col(names[0]) - F.col(names[-1])).alias("slope"))


def products(mat: DataFrame, specs: dict[str, Sequence[str]], elderly: dict[str, str] | None = None, age: str = "age", limit: int = 70) -> DataFrame:
    """Products of several columns (age x symptom x marker) and elderly-with flags."""
    prods = []
    for name, cols in specs.items():
        p = F.lit(1.0)
        for c in cols:
            p = p * F.coalesce(F.col(c), F.lit(0))
        prods.append(p.alias(name))
    flags = [x.flag((F.col(age) >= limit) & (F.col(c) > 0)).alias(n) for n, c in (elderly or {}).items()]
    return mat.select("*", *prods, *flags)


def risk_composites(mat: DataFrame, any_of: dict[str, Sequence[str]], scores: dict[str, dict[str, float]],
                    unexplained: dict[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """Any-of flags, weighted sums of flags, and signs without any of their usual explanations."""
    out = [x.flag(x.any_of([F.col(c) > 0 for c in cols])).alias(n) for n, cols in any_of.items()]
    out += [x.total([F.col(c) * w for c, w in ws.items()]).alias(n) for n, ws in scores.items()]
    out += [x.flag((F.col(s) > 0) & x.all_of([F.coalesce(F.col(c), F.lit(0)) == 0 for c in why])).alias(n) for n, (s, why) in unexplained.items()]
    return mat.select("*", *out)


def residual(mat: DataFrame, score_col: str, bin_col: Column) -> DataFrame:
    """Score minus the mean score of entities in the same bin; above-expected flag.

    Means come from a combining aggregate (a handful of rows), joined back.
    """
    m = mat.withColumn("_bin", bin_col)
    means = m.groupBy("_bin").agg(F.avg(score_col).alias("_mean"))
    out = skew.join_null_safe(m, means, ["_bin"], "left").withColumn("residual", F.col(score_col) - F.col("_mean"))
    return out.withColumn("above_expected", x.flag(F.col("residual") > 0)).drop("_bin", "_mean")
