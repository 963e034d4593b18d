"""Occurrence dynamics per (entity, category): recency, decay, acceleration, intervals, bands.

Time is months since a zero point: either the entity's own last event or a
constant fitted on training data and stored with the model.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalar as x
from . import timeline as tl
from .values import day_axis, last_value, measured

KEYS = ("entity", "category")
DAYS_PER_MONTH = 30.44
# --- fixed values: months since the zero point
RECENT, MID, OLD = (0, 6), (6, 18), (18, 42)
RECENT_RATIO_MONTHS = 24
DECAY_MONTHS = 12.0
NEW_ONSET, TENURE, ACTIVE = 18, 36, 12
# ----------------------------------------------------------------------------


def fit_zero(train: DataFrame) -> float:
    """Zero point of training data in months before the anchor: one number, to be stored."""
    return float(train.agg(F.min("days_before").alias("d")).first()["d"]) / DAYS_PER_MONTH


def with_zero(ev: DataFrame, zero: float | None = None) -> DataFrame:
    """Adds ``mo``, months since the stored zero point or (None) since the entity's own last event."""
    months = F.col("days_before") / DAYS_PER_MONTH
    if zero is not None:
        return ev.withColumn("mo", months - zero)
    own = ev.groupBy("entity").agg((F.min("days_before") / DAYS_PER_MONTH).alias("_z"))
    return ev.join(own, "entity").withColumn("mo", months - F.col("_z")).drop("_z")


def within(c: str, r: tuple[float, float], right: bool = False) -> Column:
    m = F.col(c)
    return (m > r[0]) & (m <= r[1]) if right else (m >= r[0]) & (m < r[1])


def second_difference(n: Column, right: bool = False, c: str = "mo") -> Column:
    """Aggregate: events in the recent bin, minus twice the middle one, plus the old one."""
    def s(r):
        return F.sum(F.when(within(c, r, right), n).otherwise(0))
    recent = (-1e-9, RECENT[1]) if right else RECENT
    return s(recent) - 2 * s(MID) + s(OLD)


def occurrence(ev: DataFrame, keys: Sequence[str] = KEYS, zero: float | None = None) -> DataFrame:
    """All occurrence dynamics per key from one table of (key, day) counts."""
    st = tl.steps(tl.daily(with_zero(ev, zero), keys, mo=F.min("mo")), keys)
    n = F.col("n")
    extra = [
        F.min("mo").alias("recency"), F.max("mo").alias("onset"), F.sum(n * F.exp(-F.col("mo") / DECAY_MONTHS)).alias("decay"),
        second_difference(n).alias("accel"), (F.sum(F.when(F.col("mo") <= RECENT_RATIO_MONTHS, n).otherwise(0)) / F.sum(n)).alias("recent_ratio"),
    ]
    t = tl.profile(st, keys, extra, recent_first=True)
    span = F.col("span_days") / 365.25
    return t.select(
        *keys, F.col("n").alias("count"), "recency", "onset", "decay", "accel", "recent_ratio", span.alias("span_years"),
        F.try_divide(F.col("n"), F.nullif(span, F.lit(0.0))).alias("freq_per_year"), "interval_median", "interval_min", "interval_max",
        "interval_slope", "first_half_freq", "second_half_freq", "is_worsening")


def chronicity(occ: DataFrame) -> DataFrame:
    """New onset, chronic but quiet, chronic with a recent flare."""
    chronic, active = F.col("onset") >= TENURE, F.col("recency") <= ACTIVE
    return occ.select(
        "*", x.flag(F.col("onset") <= NEW_ONSET).alias("new_onset"), x.flag(chronic & ~active).alias("chronic_stable"),
        x.flag(chronic & active & (F.col("accel") > 0)).alias("escalating_chronic"))


def halves(ev: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    t = tl.profile(tl.steps(tl.daily(ev, keys), keys), keys).where(F.col("n") >= 2)
    return t.select(*keys, "first_half_freq", "second_half_freq", "is_worsening")


def interval_stats(ev: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean interval (-1 if none) and slope of interval length against its index (0 if undefined)."""
    t = tl.interval_rows(tl.steps(tl.daily(ev, keys), keys), keys).groupBy(*keys).agg(*tl.interval_aggs())
    return t.select(*keys, "n", "span_days", F.coalesce("interval_mean", F.lit(-1.0)).alias("interval_mean"),
                    F.when(F.col("n") >= 3, F.coalesce("interval_slope", F.lit(0.0))).otherwise(0.0).alias("interval_slope"))


def half_window(ev: DataFrame, by: str = "category") -> DataFrame:
    """Events in the older and newer half of the longest look-back seen for the category."""
    cells = ev.groupBy("entity", by, "months_before").agg(F.count(F.lit(1)).alias("n"))
    top = ev.groupBy(by).agg((F.max("months_before") / 2.0).alias("_half"))
    t = cells.join(top, by).groupBy("entity", by).agg(
        F.sum(F.when(F.col("months_before") > F.col("_half"), F.col("n")).otherwise(0)).alias("h1"),
        F.sum(F.when(F.col("months_before") <= F.col("_half"), F.col("n")).otherwise(0)).alias("h2"))
    return t.select("*", x.ratio("h2", "h1").alias("h2_over_h1"), (F.col("h2") - F.col("h1")).alias("h2_minus_h1"),
                    x.flag(F.col("h2") > F.col("h1")).alias("is_worsening"))


def dynamics(ev: DataFrame, groups: dict[str, Sequence[str]], on: str = "category") -> DataFrame:
    """Per named group: recency, first occurrence, span, decay, acceleration, recent ratio, presence (tall)."""
    members = F.array(*[F.when(F.col(on).isin(*cats), F.lit(g)) for g, cats in groups.items()])
    e = with_zero(ev).withColumn("group", F.explode(F.array_compact(members)))
    raw = F.col("days_before") / DAYS_PER_MONTH
    t = e.withColumn("_raw", raw).groupBy("entity", "group").agg(
        F.count(F.lit(1)).alias("n"), F.min("_raw").alias("recency_months"), F.max("_raw").alias("first_months"),
        F.sum(F.exp(-F.col("mo") / DECAY_MONTHS)).alias("decay"), second_difference(F.lit(1), right=True).alias("accel"),
        F.avg(F.when(F.col("mo") <= RECENT_RATIO_MONTHS, 1.0).otherwise(0.0)).alias("recent_ratio"), F.min("mo").alias("own_recency"),
    )
    return t.withColumn("span_months", F.col("first_months") - F.col("recency_months")).withColumn("present", F.lit(1))


def symptom_burden(dyn: DataFrame, windows: Sequence[int] = (6, 12)) -> DataFrame:
    """Groups ever present and present in the last N months of the own record."""
    return dyn.groupBy("entity").agg(F.count(F.lit(1)).alias("burden"), *[x.count_where(F.col("own_recency") <= w).alias(f"burden_{w}") for w in windows])


TREND_LABELS = ("Increasing frequency (worsening)", "Decreasing frequency (improving)", "Stable frequency", "Single occurrence")


def _profile(st: DataFrame, keys: Sequence[str]) -> DataFrame:
    t = tl.profile(st, keys, first_half="floor", both=True)
    span = F.col("span_days") / 365.25
    s = F.col("interval_slope")
    inc, dec, same, single = TREND_LABELS
    trend = F.when(F.col("n") <= 1, single).when(F.col("n") < 3, None).when(s < -1, inc).when(s > 1, dec).otherwise(same)
    worse = F.coalesce(trend == inc, F.lit(False)) | F.coalesce(F.col("second_half_freq") > 1.1 * F.col("first_half_freq"), F.lit(False))
    return t.select(
        *keys, "n", "first_date", "last_date", "span_days", F.when(F.col("span_days") > 0, F.try_divide(F.col("n"), span)).alias("freq_per_year"),
        "interval_mean", "interval_median", "interval_min", "interval_max", F.when(F.col("n") >= 3, s).alias("interval_slope"),
        trend.alias("trend"), "first_half_freq", "second_half_freq", x.flag(worse).alias("is_worsening"))


def occ_profile(ev: DataFrame, sets: DataFrame, on: str = "code") -> DataFrame:
    """Occurrence profile per (entity, code set), all sets in one job; ages, codes and up to five terms."""
    keys = ["entity", "set"]
    e = ev.join(sets.select(on, "set"), on)
    prof = _profile(tl.steps(tl.daily(e, keys), keys), keys)
    ages = e.groupBy(*keys).agg(
        F.min(F.struct("event_date", "event_age"))["event_age"].alias("first_age"), F.max(F.struct("event_date", "event_age"))["event_age"].alias("last_age"),
        F.array_join(F.sort_array(F.collect_set(F.col(on).cast("string"))), ", ").alias("codes"),
        F.array_join(F.slice(F.sort_array(F.collect_set("term")), 1, 5), " | ").alias("terms"))
    return prof.join(ages, keys)


def visit_profile(ev: DataFrame) -> DataFrame:
    """The same profile on distinct event days of the entity."""
    days = ev.select("entity", "event_date").distinct().withColumn("n", F.lit(1).cast("bigint"))
    return _profile(tl.steps(days, ["entity"]), ["entity"])


def suffix_merge(life: DataFrame, win: DataFrame, n: int, key: Sequence[str] = ("entity",)) -> DataFrame:
    """Lifetime columns with the last-N-months columns beside them under a suffix."""
    return life.join(win.select(*key, *[F.col(c).alias(f"{c}_last_{n}m") for c in win.columns if c not in key]), list(key), "left")


def bands(ev: DataFrame, edges: Sequence[tuple[int, int]], keys: Sequence[str] = KEYS, zero: float | None = None) -> DataFrame:
    """Disjoint month bands: count, mean, latest value and slope per (key, band) (tall)."""
    e = with_zero(ev, zero)
    label = x.band("mo", [lo for lo, _ in edges] + [edges[-1][1]], [f"w{lo}_{hi}" for lo, hi in edges])
    e = e.withColumn("band", label).where(F.col("band").isNotNull())
    return e.withColumn("_x", F.when(F.col("value").isNotNull(), day_axis())).groupBy(*keys, "band").agg(
        F.count(F.lit(1)).alias("count"), F.avg("value").alias("value_mean"), last_value(F.col("value").isNotNull()).alias("value_latest"),
        x.slope("value", "_x").alias("value_slope"))


def cumulative(ev: DataFrame, ns: Sequence[int], keys: Sequence[str] = KEYS, zero: float | None = None) -> DataFrame:
    """Overlapping last-N-months windows: count, mean and latest value."""
    aggs = []
    for n in ns:
        c = F.col("mo") < n
        aggs += [x.count_where(c).alias(f"count_last{n}"), F.avg(F.when(c, F.col("value"))).alias(f"mean_last{n}"),
                 last_value(c & F.col("value").isNotNull()).alias(f"latest_last{n}")]
    return with_zero(ev, zero).groupBy(*keys).agg(*aggs)


def med_dynamics(med: DataFrame, groups: dict[str, Sequence[str]], edges: Sequence[tuple[int, int]], ns: Sequence[int], on: str = "category") -> DataFrame:
    """Per medication group: count, recency, recent ratio, bands and cumulative windows."""
    members = F.array(*[F.when(F.col(on).isin(*cats), F.lit(g)) for g, cats in groups.items()])
    e = with_zero(med).withColumn("group", F.explode(F.array_compact(members)))
    return e.groupBy("entity", "group").agg(
        F.count(F.lit(1)).alias("count"), (F.min("days_before") / DAYS_PER_MONTH).alias("recency_months"),
        F.avg(F.when(F.col("mo") <= RECENT_RATIO_MONTHS, 1.0).otherwise(0.0)).alias("recent_ratio"),
        *[x.count_where(within("mo", b)).alias(f"w{b[0]}_{b[1]}") for b in edges], *[x.count_where(F.col("mo") < n).alias(f"last{n}") for n in ns])


def consultations(ev: DataFrame) -> DataFrame:
    """Encounter days: total, recency, acceleration, recent rate."""
    days = with_zero(ev.select("entity", "event_date", "days_before").distinct())
    return days.groupBy("entity").agg(
        F.count(F.lit(1)).alias("consults"), (F.min("days_before") / DAYS_PER_MONTH).alias("recency_months"),
        second_difference(F.lit(1), right=True).alias("accel"), F.avg(F.when(F.col("mo") <= RECENT_RATIO_MONTHS, 1.0).otherwise(0.0)).alias("recent_rate"))


def problem_flags(ev: DataFrame, cats: Sequence[str], active: str = "active problem", significant: str = "significant problem") -> DataFrame:
    """Ever active / significant per category, number of rows that are both, number of significant categories."""
    act = F.lower(F.trim("status")) == active
    sig = F.lower(F.trim("significance")) == significant
    aggs = []
    for c in cats:
        here = F.col("category") == c
        aggs += [F.max(x.flag(here & act)).alias(f"{c}_active"), F.max(x.flag(here & sig)).alias(f"{c}_significant")]
    out = ev.groupBy("entity").agg(*aggs, x.count_where(act & sig & F.col("category").isin(*cats)).alias("n_active_significant"))
    return out.withColumn("significant_burden", x.total([F.col(f"{c}_significant") for c in cats]))


def event_ages(ev: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Age at first, last and median event, smallest, largest, mean and span.

    The median runs over (age, count) pairs: at most one pair per year of age.
    """
    cells = ev.where(F.col("event_age").isNotNull()).groupBy(*keys, "event_age").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_date").alias("d0"), F.max("event_date").alias("d1"))
    a = F.col("event_age")
    return cells.groupBy(*keys).agg(
        F.min(F.struct("d0", "event_age"))["event_age"].alias("age_first"), F.max(F.struct("d1", "event_age"))["event_age"].alias("age_last"),
        F.percentile(a, F.lit(0.5), F.col("n")).alias("age_median"), F.min(a).alias("age_min"), F.max(a).alias("age_max"),
        (F.sum(a * F.col("n")) / F.sum("n")).alias("age_mean"), (F.max(a) - F.min(a)).alias("age_span"))


def burden(ev: DataFrame, cats: Sequence[str], zero: float | None = None, by: str = "category") -> DataFrame:
    """Red-flag burden over a category list: distinct, events, recent distinct, decay, acceleration."""
    e = with_zero(ev.where(F.col(by).isin(*cats)), zero)
    cells = e.groupBy("entity", by).agg(
        F.count(F.lit(1)).alias("n"), F.min("mo").alias("lo"), F.sum(F.exp(-F.col("mo") / DECAY_MONTHS)).alias("d"), second_difference(F.lit(1)).alias("a"))
    return cells.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_distinct"), F.sum("n").alias("n_events"), x.count_where(F.col("lo") <= 6).alias("recent6"),
        x.count_where(F.col("lo") <= 12).alias("recent12"), F.sum("d").alias("decay"), F.sum("a").alias("accel")).withColumn("present", F.lit(1))


def structure(ev: DataFrame, extreme: float = 2.0) -> DataFrame:
    """Per (entity, category): distinct codes and ratio, share of the entity's events, first months, extreme values.

    ``value`` is expected as a z-score (see values.apply_code_z).
    """
    az = F.abs("value")
    t = ev.groupBy("entity", "category").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("code").alias("n_codes"), F.max(F.col("days_before") / DAYS_PER_MONTH).alias("first_months"),
        x.count_where(x.settled(az) >= extreme).alias("n_extreme"), F.max(az).alias("max_abs_z"))
    own = t.groupBy("entity").agg(F.sum("n").alias("_all"), F.count(F.lit(1)).alias("n_categories"))
    return t.join(own, "entity").select(
        "entity", "category", "n_codes", (F.col("n_codes") / F.col("n")).alias("code_ratio"), (F.col("n") / F.col("_all")).alias("share"),
        "first_months", "n_extreme", "max_abs_z", "n_categories")


def cross(ev: DataFrame, cats: Sequence[str], by: str = "category") -> DataFrame:
    """For each pair of the listed categories: co-occurrence, strength, and which came first."""
    aggs = []
    for i, c in enumerate(cats):
        here = F.col(by) == c
        aggs += [x.count_where(here).alias(f"n{i}"), F.min(F.when(here, F.col("event_date"))).alias(f"d{i}")]
    w = ev.where(F.col(by).isin(*cats)).groupBy("entity").agg(*aggs)
    out = []
    for i, a in enumerate(cats):
        for j, b in list(enumerate(cats))[i + 1:]:
            both = (F.col(f"n{i}") > 0) & (F.col(f"n{j}") > 0)
            out += [x.flag(both).alias(f"cooc_{a}__{b}"), F.least(f"n{i}", f"n{j}").alias(f"strength_{a}__{b}"),
                    x.flag(both & (F.col(f"d{i}") < F.col(f"d{j}"))).alias(f"seq_{a}__{b}"), x.flag(both & (F.col(f"d{j}") < F.col(f"d{i}"))).alias(f"seq_{b}__{a}")]
    return w.select("entity", *out)


def category_x_age(ev: DataFrame, spine: DataFrame, cats: Sequence[str]) -> DataFrame:
    t = ev.where(F.col("category").isin(*cats)).groupBy("entity").agg(*[x.count_where(F.col("category") == c).alias(c) for c in cats])
    return t.join(spine.select("entity", "age"), "entity").select("entity", *[(F.col(c) * F.col("age")).alias(f"{c}_x_age") for c in cats])


def category_temporal(ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recency rank of each category (tall), and per entity last months, span, categories in the last 6/12 months.

    The rank window holds one row per (entity, category).
    """
    rec = ev.groupBy("entity", "category").agg(F.min(F.col("days_before") / DAYS_PER_MONTH).alias("months"))
    tall = rec.withColumn("recency_rank", F.rank().over(W.partitionBy("entity").orderBy("months")))
    per = rec.groupBy("entity").agg(F.min("months").alias("last_months"), (F.max("months") - F.min("months")).alias("span_months"),
                                    x.count_where(F.col("months") <= 6).alias("n_6"), x.count_where(F.col("months") <= 12).alias("n_12"))
    return tall, per


def assertions(ev: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Absent and family mentions apart from findings; duration and frequency of findings."""
    a = F.coalesce(F.col("assertion"), F.lit(""))
    pos = a.isin("present", "historical", "")
    def stat(c):
        v = F.when(pos, F.col(c))
        last = F.max(F.when(pos & F.col(c).isNotNull(), F.struct("event_date", F.col(c).alias("v"))))["v"]
        return [F.avg(v).alias(f"{c}_mean"), F.max(v).alias(f"{c}_max"), last.alias(f"{c}_last")]
    out = ev.groupBy(*keys).agg(x.count_where(a == "absent").alias("absent_count"), x.count_where(a == "family").alias("family_count"), *stat("duration"), *stat("frequency"))
    return out.select("*", x.flag(F.col("absent_count") > 0).alias("absent_present"), x.flag(F.col("family_count") > 0).alias("family_present"))
