"""Counts, spans, shares and co-occurrence per entity (and per category).

Inputs are anchored events: entity, event_date, category, code, value,
months_before, time_window. Results are tall, one row per (entity, category),
or one row per entity; ``assemble`` turns them into matrices. All sums and
counts combine before the shuffle; per-entity lists hold at most one item
per category.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as x


def half(h: str) -> Column:
    """Event in the earlier (A) or recent (B) half of the window."""
    return F.col("time_window") == h


def windowed(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("time_window").isNotNull())


def top_values(df: DataFrame, c: str, k: int) -> list:
    """The k most frequent values, ties by value; k items reach the driver."""
    n = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    return [row[c] for row in n.orderBy(F.desc("n"), c).limit(k).collect()]


# --- per category -----------------------------------------------------------
def category_counts(ev: DataFrame, by: str = "category") -> DataFrame:
    """count_A, count_B, count_total and has_ever per (entity, category)."""
    return ev.groupBy("entity", by).agg(
        x.count_where(half("A")).alias("count_A"), x.count_where(half("B")).alias("count_B"),
        x.count_where(half("A") | half("B")).alias("count_total"),
    ).withColumn("has_ever", x.flag(F.col("count_total") > 0))


def accel_flags(tall: DataFrame) -> DataFrame:
    """More events in the recent half; events only in the recent half."""
    a, b = F.col("count_A"), F.col("count_B")
    return tall.withColumn("acceleration", x.flag(b > a)).withColumn("new_in_B", x.flag((b > 0) & (a == 0)))


def span_freq(ev: DataFrame, by: str = "category", cap: float = 10000.0) -> DataFrame:
    """Span in years and events per year of it (at least one day, capped)."""
    span = F.greatest(F.date_diff(F.max("event_date"), F.min("event_date")), F.lit(0)) / 365.25
    t = ev.groupBy("entity", by).agg(F.count(F.lit(1)).alias("n"), span.alias("span_years"))
    return t.withColumn("freq_per_year", F.least(F.col("n") / F.greatest(F.col("span_years"), F.lit(1 / 365.25)), F.lit(cap)))


def group_counts(ev: DataFrame, cats: Sequence[str]) -> DataFrame:
    """A/B/total, distinct types, acceleration and the first-listed subtype of a category group."""
    first = F.col("category") == cats[0]
    t = ev.where(F.col("category").isin(*cats)).groupBy("entity").agg(
        x.count_where(half("A")).alias("count_A"), x.count_where(half("B")).alias("count_B"), x.count_where(half("A") | half("B")).alias("count_total"),
        F.count_distinct(F.when(half("A") | half("B"), F.col("category"))).alias("unique_types"),
        x.count_where(first & half("A")).alias("first_A"), x.count_where(first & half("B")).alias("first_B"),
        x.count_where(first & (half("A") | half("B"))).alias("first_total"),
    )
    return t.withColumn("acceleration", x.flag(F.col("count_B") > F.col("count_A")))


def totals(ev: DataFrame) -> DataFrame:
    """Distinct categories and codes, all events, A and B events per entity."""
    return windowed(ev).groupBy("entity").agg(
        F.count_distinct("category").alias("unique_categories"), F.count_distinct("code").alias("unique_codes"),
        F.count(F.lit(1)).alias("total_events"), x.count_where(half("A")).alias("events_A"), x.count_where(half("B")).alias("events_B"),
    )


def new_cats(ev: DataFrame, onset: int = 2) -> DataFrame:
    """Categories seen in B and not in A; acute onset when there are at least ``onset``."""
    t = category_counts(windowed(ev))
    n = x.count_where((F.col("count_B") > 0) & (F.col("count_A") == 0)).alias("new_categories")
    return t.groupBy("entity").agg(n).withColumn("acute_onset", x.flag(F.col("new_categories") >= onset))


def recency(ev: DataFrame) -> DataFrame:
    """Event span in days and days from the last event to the anchor."""
    return windowed(ev).groupBy("entity").agg(
        F.date_diff(F.max("event_date"), F.min("event_date")).alias("span_days"),
        F.date_diff(F.max("anchor_date"), F.max("event_date")).alias("days_last_to_anchor"),
    )


def quantity(ev: DataFrame) -> DataFrame:
    """Total and mean quantity and distinct drugs per (entity, category)."""
    return ev.groupBy("entity", "category").agg(
        F.sum("value").alias("total_qty"), F.avg("value").alias("mean_qty"), F.count_distinct("code").alias("unique_drugs"),
    )


# --- combinations of finished columns ---------------------------------------
def interactions(mat: DataFrame, pairs: Sequence[tuple[str, str, str]], burden: Sequence[tuple[str, Column]] = ()) -> DataFrame:
    """Products of configured column pairs plus threshold flags.

    A pair with a missing parent is skipped; the product of two 0/1 columns is their AND.
    """
    have = set(mat.columns)
    prods = [(F.coalesce(F.col(a), F.lit(0)) * F.coalesce(F.col(b), F.lit(0))).alias(n) for n, a, b in pairs if {a, b} <= have]
    return mat.select("*", *prods, *[x.flag(c).alias(n) for n, c in burden])


def clusters(ev: DataFrame, defs: dict[str, Sequence[str]], n_pairs: int = 6) -> DataFrame:
    """Per cluster any, count, breadth, count_B; systems touched; pairwise ANDs of the first clusters."""
    cells = ev.groupBy("entity", "category").agg(F.count(F.lit(1)).alias("n"), x.count_where(half("B")).alias("n_B"))
    aggs = []
    for name, cats in defs.items():
        inside = F.col("category").isin(*cats)
        aggs += [
            F.max(x.flag(inside)).alias(f"{name}_any"), F.sum(F.when(inside, F.col("n")).otherwise(0)).alias(f"{name}_count"),
            x.count_where(inside).alias(f"{name}_breadth"), F.sum(F.when(inside, F.col("n_B")).otherwise(0)).alias(f"{name}_count_B"),
        ]
    out = cells.groupBy("entity").agg(*aggs)
    out = out.withColumn("multi_system_count", x.total([F.col(f"{n}_any") for n in defs]))
    both = [(F.col(f"{a}_any") * F.col(f"{b}_any")).alias(f"{a}_AND_{b}") for a, b in combinations(list(defs)[:n_pairs], 2)]
    return out.select("*", x.flag(F.col("multi_system_count") >= 3).alias("systems_3plus"), *both)


def visits(ev: DataFrame) -> DataFrame:
    """Distinct event dates in all, A and B, their ratio, events per visit.

    Reduced to one row per (entity, day) first; the half is a function of the day.
    """
    days = windowed(ev).groupBy("entity", "event_date", "time_window").agg(F.count(F.lit(1)).alias("n"))
    out = days.groupBy("entity").agg(
        F.count(F.lit(1)).alias("visits"), x.count_where(half("A")).alias("visits_A"), x.count_where(half("B")).alias("visits_B"),
        F.sum("n").alias("_n"),
    )
    a, b = F.col("visits_A"), F.col("visits_B")
    return out.select(
        "entity", "visits", "visits_A", "visits_B", x.flag(b > a).alias("acceleration"),
        F.when(a > 0, F.try_divide(b, a)).otherwise(b.cast("double")).alias("ratio_B_A"), (F.col("_n") / F.col("visits")).alias("events_per_visit"),
    )


def in_bin(c: str, lo: float, hi: float, right: bool) -> Column:
    m = F.col(c)
    return (m > lo) & (m <= hi) if right else (m >= lo) & (m < hi)


def binned(ev: DataFrame, edges: Sequence[float], right: bool = True, distinct: bool = False, c: str = "months_before", prefix: str = "bin") -> DataFrame:
    """Events (and distinct categories) per month bin."""
    aggs = []
    for lo, hi in zip(edges, edges[1:]):
        aggs.append(x.count_where(in_bin(c, lo, hi, right)).alias(f"{prefix}_{lo}_{hi}"))
    if not distinct:
        return ev.groupBy("entity").agg(*aggs)
    # one row per (entity, category) first: distinct counts become plain counts
    cells = ev.groupBy("entity", "category").agg(*aggs)
    out = []
    for lo, hi in zip(edges, edges[1:]):
        n = f"{prefix}_{lo}_{hi}"
        out += [F.sum(n).alias(n), x.count_where(F.col(n) > 0).alias(f"{prefix}_cats_{lo}_{hi}")]
    return cells.groupBy("entity").agg(*out)


def quarter_trajectory(ev: DataFrame, edges: Sequence[int] = (0, 6, 12, 18, 24, 30, 36)) -> DataFrame:
    """Right-closed bins, newest against oldest."""
    out = binned(windowed(ev), edges, right=True, prefix="q")
    first, last = F.col(f"q_{edges[0]}_{edges[1]}"), F.col(f"q_{edges[-2]}_{edges[-1]}")
    return out.withColumn("increasing_trend", x.flag(first > last)).withColumn(
        "trend_ratio", F.when(last > 0, F.try_divide(first, last)).otherwise(first.cast("double")))


def escalation(med: DataFrame, cats: Sequence[str], repeat_cat: str, single_cat: str, repeat: int = 3) -> DataFrame:
    """Groups of one drug class used, A/B counts, repeats, polypharmacy per half."""
    cells = windowed(med).groupBy("entity", "category").agg(x.count_where(half("A")).alias("a"), x.count_where(half("B")).alias("b"))
    ins, rep = F.col("category").isin(*cats), F.col("category") == repeat_cat
    n = F.col("a") + F.col("b")
    out = cells.groupBy("entity").agg(
        x.count_where(ins).alias("group_categories"), F.sum(F.when(ins, F.col("a")).otherwise(0)).alias("group_A"),
        F.sum(F.when(ins, F.col("b")).otherwise(0)).alias("group_B"), F.sum(F.when(rep, n).otherwise(0)).alias("repeats"),
        F.max(x.flag(F.col("category") == single_cat)).alias("has_single"),
        x.count_where(F.col("a") > 0).alias("poly_A"), x.count_where(F.col("b") > 0).alias("poly_B"),
    )
    return out.select(
        "*", x.flag(F.col("group_B") > F.col("group_A")).alias("group_acceleration"), x.flag(F.col("repeats") >= repeat).alias("repeat_flag"),
        x.flag(F.col("poly_B") > F.col("poly_A")).alias("poly_increase"),
    )


def first_dates(ev: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """First event date of each group per entity, in one pass."""
    return ev.groupBy("entity").agg(*[F.min(F.when(c, F.col("event_date"))).alias(n) for n, c in groups.items()])


def gap(ev: DataFrame, x_cats: Sequence[str], y_cats: Sequence[str]) -> DataFrame:
    """Days from the first X to the first Y, -1 if either is missing."""
    d = first_dates(ev, {"_x": F.col("category").isin(*x_cats), "_y": F.col("category").isin(*y_cats)})
    days = F.coalesce(F.date_diff("_y", "_x"), F.lit(-1))
    return d.select("entity", days.alias("gap_days"), x.flag(days >= 0).alias("y_after_x"))


def odyssey(mat: DataFrame, visits_col: str = "visits", systems_col: str = "multi_system_count") -> DataFrame:
    return mat.withColumn("odyssey", x.flag((F.col(visits_col) >= 5) & (F.col(systems_col) >= 2)))


def decay(ev: DataFrame, k: float = 0.1, groups: dict[str, Sequence[str]] | None = None, months: str = "months_before") -> DataFrame:
    """Sum of exp(-k * months), in all and per category group."""
    w = F.exp(-k * F.greatest(F.col(months), F.lit(0)))
    aggs = [F.sum(w).alias("decay_total")]
    for name, cats in (groups or {}).items():
        aggs.append(F.sum(F.when(F.col("category").isin(*cats), w).otherwise(0.0)).alias(f"decay_{name}"))
    return ev.groupBy("entity").agg(*aggs)


def granular(ev: DataFrame, min_rows: int = 20, by: str = "category") -> DataFrame:
    """Total and distinct codes per (entity, category), for categories with enough rows."""
    ev = windowed(ev)
    cells = ev.groupBy("entity", by).agg(F.count(F.lit(1)).alias("total"), F.count_distinct("code").alias("unique_codes"))
    big = cells.groupBy(by).agg(F.sum("total").alias("_n")).where(F.col("_n") >= min_rows)
    return cells.join(big.select(by), by, "left_semi")


def rates(ev: DataFrame) -> DataFrame:
    t = totals(ev)
    return t.select("entity", F.try_divide(F.col("total_events"), F.col("unique_categories")).alias("events_per_category"))


def pairs(ev: DataFrame, cats: Sequence[str], other: Sequence[str] = (), other_col: str = "category") -> DataFrame:
    """0/1 for each pair of the listed categories (and each list x other pair)."""
    flags = {f"c{i}": F.col("category") == c for i, c in enumerate(cats)}
    flags |= {f"o{i}": F.col(other_col) == c for i, c in enumerate(other)}
    p = ev.groupBy("entity").agg(*[F.max(x.flag(c)).alias(n) for n, c in flags.items()])
    both = [(F.col(f"c{i}") * F.col(f"c{j}")).alias(f"{cats[i]}_x_{cats[j]}") for i, j in combinations(range(len(cats)), 2)]
    both += [(F.col(f"c{i}") * F.col(f"o{j}")).alias(f"{a}_x_{b}") for i, a in enumerate(cats) for j, b in enumerate(other)]
    return p.select("entity", *both)


def age_flags(mat: DataFrame, systems: Sequence[str] = (), age: str = "age") -> DataFrame:
    a = F.col(age)
    flags = [x.flag(a >= n).alias(f"age_over_{n}") for n in (50, 65, 75)]
    return mat.select("*", *flags, *[x.flag((a >= 65) & (F.col(s) == 1)).alias(f"{s}_over65") for s in systems])


def category_list(ev: DataFrame) -> DataFrame:
    """Ascending category counts of each entity as an array (one item per category)."""
    cells = ev.groupBy("entity", "category").agg(F.count(F.lit(1)).alias("n"))
    return cells.groupBy("entity").agg(F.sort_array(F.collect_list("n")).alias("counts"), F.sum("n").alias("n_all"))


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)


def entropy(ev: DataFrame, base: str = "log2") -> DataFrame:
    """Category entropy: log2 with a 1e-10 guard, or natural log."""
    t = category_list(ev)
    log = (lambda p: F.log2(p + 1e-10)) if base == "log2" else F.log
    return t.select("entity", (-_sum(F.transform("counts", lambda n: n / F.col("n_all") * log(n / F.col("n_all"))))).alias("entropy"))


def gini(ev: DataFrame) -> DataFrame:
    """Gini coefficient of the category counts, 0 with one category."""
    t = category_list(ev)
    k = F.size("counts")
    ranked = _sum(F.transform("counts", lambda n, i: n * (i + 1.0)))
    return t.select("entity", F.when(k <= 1, 0.0).otherwise(2 * ranked / (k * F.col("n_all")) - (k + 1) / k).alias("gini"))


def recency_by(ev: DataFrame, by: str = "category") -> DataFrame:
    """Days from the last event of each category to the anchor (absent: -1 when spread)."""
    return ev.groupBy("entity", by).agg(F.date_diff(F.max("anchor_date"), F.max("event_date")).alias("days_since_last"))


def recent_within(ev: DataFrame, days: Sequence[int], by: str = "category") -> DataFrame:
    t = recency_by(ev, by)
    return t.select("*", *[x.flag(F.col("days_since_last") <= d).alias(f"within_{d}") for d in days])


def visits_by(ev: DataFrame, by: str = "category") -> DataFrame:
    return ev.groupBy("entity", by).agg(F.count_distinct("event_date").alias("visits"))


def acceleration(ev: DataFrame) -> DataFrame:
    """B over A and B minus A for events, categories and visits; accelerating categories."""
    ev = windowed(ev)
    c = category_counts(ev).groupBy("entity").agg(
        F.sum("count_A").alias("ea"), F.sum("count_B").alias("eb"), x.count_where(F.col("count_A") > 0).alias("ca"),
        x.count_where(F.col("count_B") > 0).alias("cb"), x.count_where(F.col("count_B") > F.col("count_A")).alias("n_accelerating"),
        x.count_where((F.col("count_B") > 0) & (F.col("count_A") == 0)).alias("new_in_B"),
    )
    v = visits(ev).select("entity", "visits_A", "visits_B")
    return c.join(v, "entity").select(
        "entity", x.ratio("eb", "ea").alias("events_ratio"), (F.col("eb") - F.col("ea")).alias("events_diff"),
        x.ratio("cb", "ca").alias("cats_ratio"), (F.col("cb") - F.col("ca")).alias("cats_diff"),
        x.ratio("visits_B", "visits_A").alias("visits_ratio"), "n_accelerating", "new_in_B",
        x.flag(F.col("new_in_B") >= 2).alias("acute_onset"),
    )


def recurrence_flags(tall: DataFrame, cuts: Sequence[int] = (2, 3, 4), c: str = "count_total") -> DataFrame:
    return tall.select("*", *[x.flag(F.col(c) >= k).alias(f"ge_{k}") for k in cuts])


def near_far(ev: DataFrame, near: tuple[int, int], far: tuple[int, int], by: str = "category") -> DataFrame:
    """(near + 1) / (far + 1) and the difference, over two half-open month ranges."""
    t = ev.groupBy("entity", by).agg(
        x.count_where(in_bin("months_before", *near, right=False)).alias("near"),
        x.count_where(in_bin("months_before", *far, right=False)).alias("far"))
    return t.select("*", x.ratio("near", "far", "plus_one").alias("near_far_ratio"), (F.col("near") - F.col("far")).alias("near_far_diff"))


def distinct_months(ev: DataFrame, by: str = "category", recurring: int = 3) -> DataFrame:
    t = ev.groupBy("entity", by).agg(F.count_distinct(F.trunc("event_date", "MM")).alias("months"))
    return t.withColumn("recurring", x.flag(F.col("months") >= recurring))


def same_month(ev: DataFrame, cats: Sequence[str]) -> DataFrame:
    """Months with any of the categories, span in months, two categories in one month."""
    m = ev.where(F.col("category").isin(*cats)).groupBy("entity", "months_before").agg(F.count_distinct("category").alias("k"))
    return m.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_months"), x.flag(F.count(F.lit(1)) >= 3).alias("sustained"),
        (F.max("months_before") - F.min("months_before")).alias("span_months"), F.max(x.flag(F.col("k") >= 2)).alias("multi_same_month"),
    )


def engagement(ev: DataFrame) -> DataFrame:
    """How long and how densely an entity is on record."""
    n = F.col("n")
    m = ev.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.min("months_before").alias("lo"), F.max("months_before").alias("hi"),
        x.count_where(F.col("months_before") <= 12).alias("last12"), x.count_where(F.col("months_before") <= 6).alias("last6"),
        F.greatest(F.date_diff(F.max("event_date"), F.min("event_date")), F.lit(1)).alias("active_days"),
        F.coalesce(F.min("days_before"), F.lit(9999)).alias("recency_days"), x.count_where(F.col("value").isNull()).alias("orders_without_value"),
        F.count_distinct("event_type").alias("n_vocabularies"),
    )
    span = F.col("hi") - F.col("lo")
    return m.select(
        "entity", span.alias("record_span_months"), (span / 12.0).alias("record_span_years"), x.flag(span >= 60).alias("long_record"),
        (n / F.greatest(span, F.lit(1)) * 12.0).alias("events_per_year"), (F.col("last12") / n).alias("recent_density"),
        F.col("last6").alias("recent_6"), x.flag(F.col("last6") >= 5).alias("active_recent"),
        (n / (F.col("active_days") / 30.4375)).alias("density"), "recency_days", "orders_without_value", "n_vocabularies",
    )


def normalise(tall: DataFrame, totals_df: DataFrame, num: str = "count_total", den: str = "total_events") -> DataFrame:
    """A category's share of all events of the entity."""
    return tall.join(totals_df.select("entity", den), "entity", "left").withColumn(
        f"{num}_share", F.col(num) / F.greatest(F.coalesce(F.col(den), F.lit(0)), F.lit(1)))


def shares(mat: DataFrame, specs: dict[str, tuple[str, str]], default: float = 0.0) -> DataFrame:
    """X / (X + Y) columns, ``default`` where both are empty."""
    def one(a, b):
        s = F.col(a) + F.col(b)
        return F.when(s > 0, F.try_divide(F.col(a), s)).otherwise(default)
    return mat.select("*", *[one(a, b).alias(n) for n, (a, b) in specs.items()])


def cross_window(tall: DataFrame) -> DataFrame:
    """B over A+1, B minus A, and growth of B over A where A is not empty."""
    a, b = F.col("count_A"), F.col("count_B")
    return tall.select("*", x.ratio(b, a, "denom_one").alias("b_over_a1"), (b - a).alias("b_minus_a"),
                       F.when(a > 0, F.try_divide(b - a, a)).otherwise(b.cast("double")).alias("growth"))


def code_aggs(ev: DataFrame) -> DataFrame:
    """Per (entity, code): count, halves around the entity's own midpoint, value mean and last, duration, first and last.

    The bounds come from a combining aggregate joined back, so a hot
    entity's rows are never windowed in one task.
    """
    ends = ev.groupBy("entity").agg(F.min("event_date").alias("_f"), F.max("event_date").alias("_l"))
    mid = F.date_add("_f", F.floor(F.date_diff("_l", "_f") / 2).cast("int"))
    e = ev.join(ends.select("entity", mid.alias("_mid")), "entity")
    recent = F.col("event_date") >= F.col("_mid")
    return e.groupBy("entity", "code").agg(
        F.min("category").alias("category"), F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("count"),
        x.count_where(~recent).alias("count_h1"), x.count_where(recent).alias("count_h2"), F.avg("value").alias("value_mean"),
        F.max(F.when(F.col("value").isNotNull(), F.struct("event_date", "value")))["value"].alias("value_last"),
        F.sum(F.coalesce(F.col("duration"), F.lit(0.0))).alias("duration_sum"),
        F.min("event_date").alias("first_event"), F.max("event_date").alias("last_event"),
    )


def category_aggs(codes: DataFrame, spine: DataFrame) -> DataFrame:
    """Code aggregates rolled up per (entity, category) with recency and density."""
    t = codes.groupBy("entity", "category").agg(
        F.sum("count").alias("count"), F.avg("value_mean").alias("value_mean"), F.sum("duration_sum").alias("duration_sum"),
        F.min("first_event").alias("first_event"), F.max("last_event").alias("last_event"),
        F.sum("count_h1").alias("count_h1"), F.sum("count_h2").alias("count_h2"),
    ).join(spine.select("entity", "anchor_date"), "entity")
    active = F.greatest(F.date_diff("last_event", "first_event"), F.lit(1)) / 30.4375
    return t.select("*", x.flag(F.col("count") > 0).alias("present"), F.date_diff("anchor_date", "last_event").alias("recency_days"),
                    (F.col("count") / active).alias("event_density")).drop("anchor_date")


def declared(mat: DataFrame, specs: Sequence[tuple[str, str, str, float]]) -> DataFrame:
    """Declarative features: (name, kind, column, number); kind is years, ge or lt."""
    kinds = {"years": lambda c, v: F.coalesce(F.col(c), F.lit(0.0)) / v, "ge": lambda c, v: x.flag(F.col(c) >= v),
             "lt": lambda c, v: x.flag(F.col(c) < v)}
    return mat.select("*", *[kinds[k](c, v).alias(n) for n, k, c, v in specs if c in mat.columns])


def half_trend(tall: DataFrame) -> DataFrame:
    """Recent against older half, neutral where there is no older half to compare with."""
    h1, h2 = F.col("count_h1").cast("double"), F.col("count_h2").cast("double")
    base = h1 > 0
    return tall.select("*", F.when(base, h2 / (h1 + 1.0)).otherwise(0.0).alias("trend_h2_over_h1"), x.flag(base & (h2 > h1)).alias("is_worsening"),
                       F.when(base, F.try_divide(h2, h1 + h2)).otherwise(0.0).alias("recent_frac"))


def volume(ev: DataFrame) -> DataFrame:
    """Overall record volume per entity."""
    obs, med = F.col("event_type") == "obs", F.col("event_type") == "med"
    return ev.groupBy("entity").agg(
        F.count(F.lit(1)).alias("total_events"), F.count_distinct(F.when(obs, F.col("code"))).alias("distinct_obs_codes"),
        F.count_distinct(F.when(med, F.col("code"))).alias("distinct_med_codes"), x.count_where(F.col("value").isNotNull()).alias("measured"),
        F.count_distinct("event_date").alias("consultation_days"),
    )


def demographics(spine: DataFrame, edges: Sequence[int], labels: Sequence[str], groups: Sequence[str], group_col: str) -> DataFrame:
    """Age, fixed age-band and group indicators, sex flag."""
    b = spine.withColumn("_band", x.band("age", edges, labels))
    return b.select("entity", "age", x.flag(F.col("sex") == "M").alias("male"), *x.one_hot("_band", labels, "band_"),
                    *x.one_hot(group_col, groups, "group_"))


def top_code_flags(ev: DataFrame, spine: DataFrame, k: int = 50, min_entities: int = 20, by: str = "code") -> DataFrame:
    """(entity, code) presence for the k codes whose class rates differ most.

    Presence pairs are reduced first; the k winners join back as a small table.
    """
    has = windowed(ev).where(F.col(by).isNotNull()).select("entity", by).distinct()
    y = spine.select("entity", "label")
    n = y.groupBy().agg(x.count_where(F.col("label") == 1).alias("P"), x.count_where(F.col("label") == 0).alias("N")).first()
    score = has.join(y, "entity").groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), x.count_where(F.col("label") == 1).alias("p"), x.count_where(F.col("label") == 0).alias("q"))
    diff = F.abs(F.col("p") / float(max(n["P"], 1)) - F.col("q") / float(max(n["N"], 1)))
    top = score.where(F.col("n") >= min_entities).withColumn("abs_diff", diff).orderBy(F.desc(F.round("abs_diff", 12)), by).limit(k)
    return has.join(top.select(by, "abs_diff"), by)
