"""Measurement features: levels, trends, jumps, thresholds, percentiles, z-scores.

Rows carry a numeric ``value``. First and last readings are taken by
(event_date, value), so equal dates do not make results depend on row order.
Slopes use the built-in regression aggregates, which combine map-side;
orderings and exact quantiles go through the segment-wise helpers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import skew
from ..functions import scalar as x

KEYS = ("entity", "category")


def measured(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("value").isNotNull())


def first_value(cond: Column | None = None) -> Column:
    v = F.struct("event_date", "value")
    return F.min(v if cond is None else F.when(cond, v))["value"]


def last_value(cond: Column | None = None) -> Column:
    v = F.struct("event_date", "value")
    return F.max(v if cond is None else F.when(cond, v))["value"]


def steps(ev: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct (day, value) readings with their count ``n`` and the reading before each (``prev_value``).

    A key's days are worked on apart, so however many readings a key has on however few months, no task holds
    more than the different values of one of its days. Equal readings of a day follow each other: steps of 0.
    """
    cells = measured(ev).groupBy(*keys, "event_date", "value").agg(F.count(F.lit(1)).alias("n"))
    return skew.previous(cells, keys, ["event_date", "value"], ["value"], F.col("event_date"))


def day_axis(c: str = "days_before") -> Column:
    """Time axis that grows towards the anchor."""
    return (-F.col(c)).cast("double")


def slope(y: str | Column, axis: Column) -> Column:
    """OLS slope; NULL below two points or without spread in x."""
    return x.slope(y, axis)


def value_stats(ev: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Level, spread, first/last, half means, change and relative change."""
    a, b = F.col("time_window") == "A", F.col("time_window") == "B"
    t = measured(ev).groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.stddev_samp("value").alias("std"),
        F.count("value").alias("count"), first_value().alias("first"), last_value().alias("last"),
        F.avg(F.when(a, F.col("value"))).alias("mean_A"), F.avg(F.when(b, F.col("value"))).alias("mean_B"),
    )
    delta = F.col("mean_B") - F.col("mean_A")
    return t.select("*", delta.alias("delta"), F.try_divide(delta, F.abs("mean_A")).alias("pct_change"))


def ols(ev: DataFrame, keys: Sequence[str] = KEYS, y: str = "value", axis: Column | None = None, r2: bool = False) -> DataFrame:
    """Slope and correlation per group (and R squared with the direction of the slope)."""
    axis = day_axis() if axis is None else axis
    ev = ev.where(F.col(y).isNotNull()).withColumn("_x", axis)
    yy = F.col(y).cast("double")
    cols = [x.slope(yy, "_x").alias("slope"), x.correlation(yy, F.col("_x")).alias("corr"), F.count(F.lit(1)).alias("n")]
    out = ev.groupBy(*keys).agg(*cols)
    if r2:
        out = out.withColumn("r2", F.when(F.col("slope").isNotNull(), F.coalesce(F.col("corr") * F.col("corr"), F.lit(1.0))))
    return out.withColumn("direction", F.signum("slope")) if r2 else out


def volatility(ev: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Coefficient of variation, range, inter-quartile range, largest step, last minus first."""
    m = measured(ev)
    base = m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), x.ratio(F.stddev_samp("value"), F.avg("value"), "null").alias("cv"),
        (F.max("value") - F.min("value")).alias("range"), (last_value() - first_value()).alias("first_last_diff"))
    q = skew.quantiles(m, keys, "value", {"q1": 0.25, "q3": 0.75})
    size = F.greatest(F.abs(F.col("value") - F.col("prev_value")), F.when(F.col("n") > 1, 0.0))
    step = steps(ev, keys).groupBy(*keys).agg(F.max(size).alias("max_step"))
    out = base.join(q, list(keys)).join(step, list(keys))
    return out.select(*keys, "n", "cv", "range", (F.col("q3") - F.col("q1")).alias("iqr"), "max_step", "first_last_diff")


def value_accel(ev: DataFrame, keys: Sequence[str] = KEYS, min_n: int = 4) -> DataFrame:
    """Slope of the newer half of the readings minus slope of the older half.

    Readings collapse to (date, value) cells with counts; each cell carries
    its share of both halves as weights, and the slopes come from weighted sums.
    """
    m = measured(ev).withColumn("_o", F.struct("event_date", "value"))
    cells = m.groupBy(*keys, "_o").agg(F.count(F.lit(1)).alias("n"), F.max("days_before").alias("days_before"))
    r = skew.running_total(cells, keys, "_o", ["n"], F.col("_o.event_date"))
    w1 = F.greatest(F.least(F.ceil(F.col("n_all") / 2) - F.col("n_before"), F.col("n")), F.lit(0)).cast("double")
    r = r.where(F.col("n_all") >= min_n).select(*keys, w1.alias("w1"), (F.col("n") - w1).alias("w2"), F.col("_o.value").cast("double").alias("y"),
                                               (-F.col("days_before")).cast("double").alias("t"))

    def wslope(w):
        w, t, y = F.col(w), F.col("t"), F.col("y")
        n, st, sy, stt, sty = (F.sum(c) for c in (w, w * t, w * y, w * t * t, w * t * y))
        return F.try_divide(n * sty - st * sy, F.nullif(n * stt - st * st, F.lit(0.0)))

    return r.groupBy(*keys).agg((wslope("w2") - wslope("w1")).alias("value_accel"))


def missing_flags(roster: DataFrame, ev: DataFrame, cats: Sequence[str]) -> DataFrame:
    """Per roster entity and category: ever measured / never measured."""
    got = measured(ev).groupBy("entity").agg(*[F.max(x.flag(F.col("category") == c)).alias(f"{c}_measured") for c in cats])
    out = roster.select("entity").join(got, "entity", "left").na.fill(0, [f"{c}_measured" for c in cats])
    return out.select("*", *[(1 - F.col(f"{c}_measured")).alias(f"{c}_missing") for c in cats])


Rule = Callable[[dict[str, Column]], Column]


def worsening(stats: DataFrame, rules: dict[str, str | Rule], by: str = "category") -> DataFrame:
    """Worsening flag per category: 'up', 'down' or a function of the stat columns
    (slope, first, last, mean, max, count) returning a condition."""
    cols = {c: F.col(c) for c in ("slope", "first", "last", "mean", "max", "count")}
    out = None
    for cat, rule in rules.items():
        cond = cols["slope"] > 0 if rule == "up" else cols["slope"] < 0 if rule == "down" else rule(cols)
        here, val = F.col(by) == cat, x.flag(cond)
        out = F.when(here, val) if out is None else out.when(here, val)
    return stats.withColumn("worsening", out)


def per_term(ev: DataFrame, k: int = 30, min_rows: int = 20, slope_rows: int = 50) -> DataFrame:
    """Count, mean, last per (entity, term) for the k most frequent terms with enough rows; slope for the larger ones."""
    m = measured(ev)
    sizes = m.where(F.col("term").isNotNull()).groupBy("term").agg(F.count(F.lit(1)).alias("rows"))
    top = sizes.orderBy(F.desc("rows"), "term").limit(k).where(F.col("rows") >= min_rows)
    t = m.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean"), last_value().alias("last"),
                                       slope("value", day_axis()).alias("slope"))
    return t.join(top, "term").withColumn("slope", F.when(F.col("rows") >= slope_rows, F.coalesce("slope", F.lit(0.0)))).drop("rows")


def velocity(ev: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Annualised change over the whole record and over window B, and their capped quotient."""
    b = F.col("time_window") == "B"
    date_b = F.when(b, F.col("event_date"))
    t = measured(ev).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), x.count_where(b).alias("n_b"),
        F.date_diff(F.max("event_date"), F.min("event_date")).alias("days"), F.date_diff(F.max(date_b), F.min(date_b)).alias("days_b"),
        (last_value() - first_value()).alias("diff"), (last_value(b) - first_value(b)).alias("diff_b"),
    )
    life = F.when((F.col("n") >= 2) & (F.col("days") > 30), F.try_divide(F.col("diff"), F.col("days")) * 365.25)
    rec = F.when((F.col("n_b") >= 2) & (F.col("days_b") > 14), F.try_divide(F.col("diff_b"), F.col("days_b")) * 365.25)
    t = t.select(*keys, life.alias("life_velocity"), rec.alias("recent_velocity"))
    q = F.col("recent_velocity") / F.greatest(F.abs("life_velocity"), F.lit(0.05))
    return t.select(
        "*", F.least(F.greatest(F.when(F.col("life_velocity").isNotNull(), q), F.lit(-50.0)), F.lit(50.0)).alias("velocity_accel"),
        x.flag(F.col("recent_velocity") > 0.75).alias("velocity_high"), x.flag(F.col("recent_velocity") > 2.0).alias("velocity_very_high"))


def doubling_time(ev: DataFrame, keys: Sequence[str] = KEYS, days_per_month: float = 30.44) -> DataFrame:
    """Months to double from the slope of the logarithm; only for rising, positive series."""
    m = measured(ev).withColumn("_x", day_axis() / days_per_month).withColumn("_y", F.log(F.col("value") + 0.01))
    t = m.groupBy(*keys).agg(x.slope("_y", "_x").alias("log_slope"), first_value().alias("f"), last_value().alias("l"))
    ok = (F.col("log_slope") > 0) & (F.col("f") > 0) & (F.col("l") > 0)
    t = t.select(*keys, F.when(ok, F.try_divide(F.log(F.lit(2.0)), F.col("log_slope"))).alias("doubling_months"))
    return t.select("*", x.flag(F.col("doubling_months") < 24).alias("fast"), x.flag(F.col("doubling_months") < 12).alias("very_fast"))


def own_z(ev: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Latest reading against the entity's own mean and deviation, clipped to +-10."""
    t = measured(ev).groupBy(*keys).agg(F.count("value").alias("n_reads"), F.try_divide(
        last_value() - F.avg("value"), F.nullif(x.deviation("value"), F.lit(0.0))).alias("z"))
    z = F.least(F.greatest(F.coalesce("z", F.lit(0.0)), F.lit(-10.0)), F.lit(10.0))
    t, s = t.withColumn("z", z), x.settled("z")
    return t.select("*", x.flag(s > 1.5).alias("high"), x.flag(s > 3).alias("extreme"), x.flag(s < -1.5).alias("low"))


def max_jump(ev: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Largest rise between consecutive readings, absolute and relative; 0 with one reading."""
    diff, same = F.col("value") - F.col("prev_value"), F.when(F.col("n") > 1, 0.0)
    t = steps(ev, keys).groupBy(*keys).agg(
        F.coalesce(F.max(F.greatest(diff, same)), F.lit(0.0)).alias("max_jump"),
        F.coalesce(F.max(F.greatest(diff / F.greatest(F.col("prev_value"), F.lit(0.1)), same)), F.lit(0.0)).alias("rel"))
    rel = F.least(F.greatest("rel", F.lit(0.0)), F.lit(50.0))
    return t.select(*keys, "max_jump", rel.alias("max_rel_jump"), x.flag(F.col("max_jump") > 2).alias("over_2"),
                    x.flag(F.col("max_jump") > 5).alias("over_5"), x.flag(rel > 0.5).alias("rel_half"))


def thresholds(ev: DataFrame, bounds: dict[str, tuple[str, str, float]]) -> DataFrame:
    """Per entity and named bound (category, 'above'|'below', limit): ever, latest, count, extreme."""
    aggs = []
    for name, (cat, side, lim) in bounds.items():
        here = (F.col("category") == cat) & F.col("value").isNotNull()
        hit = here & ((F.col("value") > lim) if side == "above" else (F.col("value") < lim))
        v = F.when(here, F.col("value"))
        last = last_value(here)
        aggs += [
            F.max(x.flag(hit)).alias(f"{name}_ever"), x.flag((last > lim) if side == "above" else (last < lim)).alias(f"{name}_latest"),
            x.count_where(hit).alias(f"{name}_count"), (F.max(v) if side == "above" else F.min(v)).alias(f"{name}_extreme"),
        ]
    return ev.groupBy("entity").agg(*aggs)


def value_ratio(ev: DataFrame, pairs: dict[str, tuple[Sequence[str], Sequence[str]]]) -> DataFrame:
    """Quotient of the latest values of two category groups and the slope of the same-day quotient.

    Both come from one table of daily means with one column pair per ratio:
    no self-join, and one row per (entity, day).
    """
    wanted = sorted({c for n, d in pairs.values() for c in (*n, *d)})
    m = measured(ev).where(F.col("category").isin(*wanted))
    aggs, latest = [], []
    for name, (num, den) in pairs.items():
        in_n, in_d = F.col("category").isin(*num), F.col("category").isin(*den)
        aggs += [F.avg(F.when(in_n, F.col("value"))).alias(f"_n_{name}"), F.avg(F.when(in_d, F.col("value"))).alias(f"_d_{name}"),
                 F.max(F.when(in_n, F.col("value"))).alias(f"_ln_{name}"), F.max(F.when(in_d, F.col("value"))).alias(f"_ld_{name}")]
    days = m.groupBy("entity", "event_date").agg(F.max("days_before").alias("days_before"), *aggs)
    for name in pairs:
        def newest(c):
            return F.max(F.when(F.col(c).isNotNull(), F.struct("event_date", F.col(c).alias("v"))))["v"]
        q = F.try_divide(F.col(f"_n_{name}"), F.nullif(F.col(f"_d_{name}"), F.lit(0.0)))
        latest += [F.try_divide(newest(f"_ln_{name}"), F.nullif(newest(f"_ld_{name}"), F.lit(0.0))).alias(name),
                   slope(q, day_axis()).alias(f"{name}_trend")]
    return days.groupBy("entity").agg(*latest)


Trend = Callable[[Column, Column, Column, Column], Column]


def higher_is_better(slope_: Column, first: Column, last: Column, corr: Column) -> Column:
    return F.when(slope_ > 0.0001, "Improving").when(slope_ < -0.0001, "Declining").otherwise("Stable")


def lower_is_better(slope_: Column, first: Column, last: Column, corr: Column) -> Column:
    return F.when(slope_ > 0.0001, "Declining").when(slope_ < -0.0001, "Improving").otherwise("Stable")


def value_profile(ev: DataFrame, sets: DataFrame, logic: dict[str, Trend] | None = None, on: str = "code") -> DataFrame:
    """Full trend profile per (entity, code set), all sets in one job.

    ``sets`` is a (code, set) table; the direction of a trend comes from the
    set's own function of (slope, first, last, correlation).
    """
    keys = ["entity", "set"]
    m = measured(ev).join(sets.select(on, "set"), on)
    t = m.withColumn("_x", day_axis()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_records"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"),
        first_value().alias("first"), last_value().alias("last"), F.avg("value").alias("mean"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.stddev_pop("value").alias("std_pop"), x.slope("value", "_x").alias("slope"),
        x.correlation("value", "_x").alias("corr"), F.min(F.struct("event_date", "event_age"))["event_age"].alias("first_age"),
        F.max(F.struct("event_date", "event_age"))["event_age"].alias("last_age"),
        F.array_join(F.sort_array(F.collect_set(F.col(on).cast("string"))), ", ").alias("codes"),
        F.array_join(F.slice(F.sort_array(F.collect_set("term")), 1, 5), " | ").alias("terms"),
    )
    med = skew.quantiles(m, keys, "value", {"median": 0.5})
    out = t.join(med, keys)
    args = [F.col(c) for c in ("slope", "first", "last", "corr")]
    trend = higher_is_better(*args)
    for name, fn in (logic or {}).items():
        trend = F.when(F.col("set") == name, fn(*args)).otherwise(trend)
    one_day = F.col("first_date") == F.col("last_date")
    direction = F.when(F.col("n_records") < 2, None).when(
        one_day, F.when(F.col("min") < F.col("max"), "Multiple measurements on same date").otherwise("Stable")).otherwise(trend)
    change = F.col("last") - F.col("first")
    return out.select(
        "*", change.alias("abs_change"), (F.try_divide(change, F.col("first")) * 100).alias("pct_change"),
        (F.date_diff("last_date", "first_date") / 365.25).alias("span_years"), direction.alias("direction"))


def dose_max(ev: DataFrame, sets: dict[str, Sequence], on: str = "code") -> DataFrame:
    """Largest recorded value per named code list."""
    return ev.groupBy("entity").agg(*[F.max(F.when(F.col(on).isin(*codes), F.col("value"))).alias(n) for n, codes in sets.items()])


def latest_values(ev: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return measured(ev).groupBy(*keys).agg(last_value().alias("latest"))


def apply_pctl(query_df: DataFrame, ref: DataFrame, value: str = "latest", band: str = "band", by: Sequence[str] = ("category",), min_band: int = 20) -> DataFrame:
    """Share of training values below each value, in the whole cohort and in the age band.

    Reference and queried values are counted together per distinct value
    (queried ones with weight 0) and summed in order: no range join, and no
    sorted array on any one machine. Bands with too few training values fall
    back to the cohort.
    """
    by = list(by)

    def below(keys, name):
        both = ref.select(*keys, F.col(value).alias("_v"), F.lit(1).cast("bigint").alias("c")).unionByName(
            query_df.select(*keys, F.col(value).alias("_v"), F.lit(0).cast("bigint").alias("c")))
        cells = both.where(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.sum("c").alias("c"))
        r = skew.running_total(cells, keys, "_v", ["c"], skew.number_buckets(F.col("_v")))
        return r.select(*keys, "_v", F.try_divide(F.col("c_before"), F.col("c_all")).alias(name), F.col("c_all").alias(f"{name}_n"))

    q = query_df.withColumn("_v", F.col(value))
    out = skew.join_null_safe(q, below(by, "pctl"), [*by, "_v"], "left")
    out = skew.join_null_safe(out, below([*by, band], "band_pctl"), [*by, band, "_v"], "left")
    return out.withColumn("band_pctl", F.when(F.col("band_pctl_n") >= min_band, F.col("band_pctl")).otherwise(F.col("pctl"))).drop(
        "_v", "pctl_n", "band_pctl_n")


def pctl_rank(df: DataFrame, value: str = "latest", by: Sequence[str] = ("category",), name: str = "pctl") -> DataFrame:
    """Average rank over n within a group, with the top 5, 10 and 25 percent flags."""
    r = skew.value_ranks(df, list(by), value)
    pct = (F.col("n_before") + (F.col("n") + 1) / 2) / F.col("n_all")
    out = skew.join_null_safe(df, r.select(*by, value, pct.alias(name)), [*by, value], "left")
    return out.select("*", *[x.flag(F.col(name) >= 1 - p / 100).alias(f"{name}_top{p}") for p in (5, 10, 25)])


def fit_code_z(train: DataFrame, on: str = "code") -> DataFrame:
    """Training mean and deviation per code."""
    return measured(train).groupBy(on).agg(F.avg("value").alias("mean"), x.deviation("value").alias("std"))


def apply_code_z(ev: DataFrame, fitted: DataFrame, on: str = "code") -> DataFrame:
    """Values as deviations from their code's training distribution; unknown or constant codes give NULL."""
    z = F.try_divide(F.col("value") - F.col("mean"), F.nullif(F.col("std"), F.lit(0.0)))
    return ev.join(fitted, on, "left").withColumn("value", z).drop("mean", "std")


def value_codes(ev: DataFrame, frac: float = 0.10, on: str = "code") -> DataFrame:
    """Codes of which at least ``frac`` of the events carry a number."""
    t = ev.groupBy(on).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_value"))
    return t.where((F.col("n_value") > 0) & (F.col("n_value") >= frac * F.col("n"))).select(on, "n", "n_value")


def derangement(ev: DataFrame, keys: Sequence[str] = KEYS, extreme: float = 2.0, axis: Column | None = None) -> DataFrame:
    """Burden over an entity's codes: extreme, rising, accelerating and worsening ones, mean |z|."""
    from . import occurrence as occ

    z = measured(ev).withColumn("_x", day_axis()).groupBy(*keys).agg(F.try_divide(last_value() - F.avg("value"), F.nullif(x.deviation("value"), F.lit(0.0))).alias("z"),
                                    x.slope("value", "_x").alias("slope"))
    o = occ.occurrence(ev, keys).select(*keys, "accel", "is_worsening")
    t = o.join(z, list(keys), "left")
    return t.groupBy("entity").agg(
        x.count_where(x.settled(F.abs("z")) >= extreme).alias("n_extreme"), F.avg(F.abs("z")).alias("mean_abs_z"), x.count_where(F.col("slope") > 0).alias("n_rising"),
        x.count_where(F.col("accel") > 0).alias("n_accelerating"), x.count_where(F.col("is_worsening") == 1).alias("n_worsening"))


def activity_bands(ev: DataFrame, bands: Sequence[tuple[int, int]], recent: Sequence[int] = (6, 12), code: str = "code") -> DataFrame:
    """Events and encounter days per band of months since the own last event; recent distinct codes."""
    first = ev.groupBy("entity").agg(F.min("days_before").alias("_d0"))
    mo = (F.col("days_before") - F.col("_d0")) / 30.44
    cells = ev.groupBy("entity", code, "days_before").agg(F.count(F.lit(1)).alias("n")).join(first, "entity").withColumn("mo", mo)
    in_band = {f"w{lo}_{hi}": (F.col("mo") >= lo) & (F.col("mo") < hi) for lo, hi in bands}
    days = cells.groupBy("entity", "days_before").agg(F.sum("n").alias("n"), F.max("mo").alias("mo"))
    d = days.groupBy("entity").agg(
        *[F.sum(F.when(c, F.col("n")).otherwise(0)).alias(f"events_{k}") for k, c in in_band.items()],
        *[x.count_where(c).alias(f"consults_{k}") for k, c in in_band.items()])
    codes = cells.groupBy("entity", code).agg(F.min("mo").alias("mo")).groupBy("entity").agg(
        *[x.count_where(F.col("mo") < n).alias(f"distinct_last{n}") for n in recent])
    return d.join(codes, "entity")


def co_elevation(flags: DataFrame, pairs: dict[str, Sequence[str]], score: Sequence[str]) -> DataFrame:
    """ANDs of threshold flags and the number of flags set."""
    ands = [x.flag(x.all_of([F.col(c) == 1 for c in cols])).alias(n) for n, cols in pairs.items()]
    return flags.select("*", *ands, x.total([F.col(c) for c in score]).alias("flag_score"))
