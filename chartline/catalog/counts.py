"""A: counts, spans, shares and co-occurrence on the anchored history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as x
from ..operators import assemble, counts as a
from .base import ANCH, SPINE, TYPES, query, r, rounded, with_

AN = with_(ANCH)
CELLS = "cells AS (SELECT entity, category, count(*) FILTER (WHERE time_window = 'A') AS ca, count(*) FILTER (WHERE time_window = 'B') AS cb, count(*) FILTER (WHERE time_window IS NOT NULL) AS ct FROM anch GROUP BY 1, 2)"
SYMPTOMS, INVEST = ["SMALL", "LARGE", "MEDIUM"], ["PROMO", "ECONOMY"]
IN_S, IN_I = "('SMALL', 'LARGE', 'MEDIUM')", "('PROMO', 'ECONOMY')"


@query("a01_category_counts", f"""{with_(ANCH, CELLS)} SELECT entity, """ + ", ".join(
    f"coalesce(max(CASE WHEN category = '{c}' THEN {v} END), 0) AS {c}_{n}" for c in TYPES
    for v, n in (("ca", "count_A"), ("cb", "count_B"), ("ct", "count_total"), ("CAST(ct > 0 AS INTEGER)", "has_ever"))) + " FROM cells GROUP BY 1")
def _(t):
    tall = a.category_counts(t.anch)
    cols = ["count_A", "count_B", "count_total", "has_ever"]
    return assemble.spread(tall, "category", TYPES, cols).na.fill(0)


@query("a02_accel_new_flags", f"""{with_(ANCH, CELLS)} SELECT entity, category, CAST(cb > ca AS INTEGER) AS acceleration,
  CAST(cb > 0 AND ca = 0 AS INTEGER) AS new_in_B FROM cells""")
def _(t):
    return a.accel_flags(a.category_counts(t.anch)).select("entity", "category", "acceleration", "new_in_B")


@query("a03_span_frequency", f"""{AN} SELECT entity, category, count(*) AS n, round(s, 6) AS span_years,
  round(least(count(*) / greatest(s, 1 / 365.25::DOUBLE), 10000), 6) AS freq_per_year
FROM (SELECT entity, category, (max(event_date) OVER w - min(event_date) OVER w) / 365.25::DOUBLE AS s FROM anch WINDOW w AS (PARTITION BY entity, category)) GROUP BY entity, category, s""")
def _(t):
    return rounded(a.span_freq(t.anch))


@query("a04_investigation_counts", f"""{AN} SELECT entity, count(*) FILTER (WHERE time_window = 'A') AS count_A, count(*) FILTER (WHERE time_window = 'B') AS count_B,
  count(*) FILTER (WHERE time_window IS NOT NULL) AS count_total, count(DISTINCT category) FILTER (WHERE time_window IS NOT NULL) AS unique_types,
  count(*) FILTER (WHERE category = 'PROMO' AND time_window = 'A') AS first_A, count(*) FILTER (WHERE category = 'PROMO' AND time_window = 'B') AS first_B,
  count(*) FILTER (WHERE category = 'PROMO' AND time_window IS NOT NULL) AS first_total,
  CAST(count(*) FILTER (WHERE time_window = 'B') > count(*) FILTER (WHERE time_window = 'A') AS INTEGER) AS acceleration
FROM anch WHERE category IN {IN_I} GROUP BY 1""")
def _(t):
    return a.group_counts(t.anch, INVEST)


@query("a05_entity_totals", f"""{AN} SELECT entity, count(DISTINCT category) AS unique_categories, count(DISTINCT code) AS unique_codes, count(*) AS total_events,
  count(*) FILTER (WHERE time_window = 'A') AS events_A, count(*) FILTER (WHERE time_window = 'B') AS events_B FROM anch WHERE time_window IS NOT NULL GROUP BY 1""")
def _(t):
    return a.totals(t.anch)


@query("a06_new_categories", f"""{with_(ANCH, CELLS)} SELECT entity, count(*) FILTER (WHERE cb > 0 AND ca = 0) AS new_categories,
  CAST(count(*) FILTER (WHERE cb > 0 AND ca = 0) >= 2 AS INTEGER) AS acute_onset FROM cells WHERE ct > 0 GROUP BY 1""")
def _(t):
    return a.new_cats(t.anch)


@query("a07_span_and_recency", f"""{AN} SELECT entity, CAST(max(event_date) - min(event_date) AS INTEGER) AS span_days,
  CAST(max(anchor_date) - max(event_date) AS INTEGER) AS days_last_to_anchor FROM anch WHERE time_window IS NOT NULL GROUP BY 1""")
def _(t):
    return a.recency(t.anch)


@query("a08_quantity", f"""{AN} SELECT entity, category, round(sum(value), 6) AS total_qty, round(avg(value), 6) AS mean_qty, count(DISTINCT code) AS unique_drugs
FROM anch WHERE event_type = 'med' GROUP BY 1, 2""")
def _(t):
    return rounded(a.quantity(t.anch.where("event_type = 'med'")))


_WIDE = "wide AS (SELECT entity, max(age) AS age, " + ", ".join(
    f"count(*) FILTER (WHERE category = '{c}' AND time_window = 'B') AS {c}_B, count(*) FILTER (WHERE category = '{c}' AND time_window = 'A') AS {c}_A" for c in TYPES
) + ", count(DISTINCT event_date) AS visits FROM anch GROUP BY 1)"


def wide(t):
    cat, w = F.col("category"), F.col("time_window")
    return t.anch.groupBy("entity").agg(
        F.max("age").alias("age"), *[F.count_if((cat == c) & (w == h)).alias(f"{c}_{h}") for c in TYPES for h in "BA"],
        F.count_distinct("event_date").alias("visits"))


@query("a09_product_interactions", f"""{with_(ANCH, _WIDE)} SELECT entity, SMALL_B * LARGE_B AS small_x_large, age * PROMO_B AS age_x_promo,
  CAST(SMALL_B + LARGE_B >= 3 AS INTEGER) AS burden FROM wide""")
def _(t):
    out = a.interactions(wide(t), [("small_x_large", "SMALL_B", "LARGE_B"), ("age_x_promo", "age", "PROMO_B"), ("none", "SMALL_B", "absent")],
                         [("burden", F.col("SMALL_B") + F.col("LARGE_B") >= 3)])
    return out.select("entity", "small_x_large", "age_x_promo", "burden")


_CL = {"size": ["SMALL", "LARGE", "MEDIUM"], "price": ["PROMO", "ECONOMY"], "plain": ["STANDARD"], "mixed": ["SMALL", "PROMO"]}


def _clsql():
    parts, anys = [], []
    for n, cats in _CL.items():
        i = "category IN (" + ", ".join(f"'{c}'" for c in cats) + ")"
        parts += [f"CAST(count(*) FILTER (WHERE {i}) > 0 AS INTEGER) AS {n}_any", f"count(*) FILTER (WHERE {i}) AS {n}_count",
                  f"count(DISTINCT category) FILTER (WHERE {i}) AS {n}_breadth", f"count(*) FILTER (WHERE {i} AND time_window = 'B') AS {n}_count_B"]
        anys.append(f"{n}_any")
    names = list(_CL)
    ands = [f"{p}_any * {q}_any AS {p}_AND_{q}" for k, p in enumerate(names) for q in names[k + 1:]]
    tot = " + ".join(anys)
    return f"{AN}, c AS (SELECT entity, {', '.join(parts)} FROM anch GROUP BY 1) SELECT *, {tot} AS multi_system_count, CAST({tot} >= 3 AS INTEGER) AS systems_3plus, {', '.join(ands)} FROM c"


@query("a10_clusters", _clsql())
def _(t):
    return a.clusters(t.anch, _CL)


_VIS = "vis AS (SELECT entity, count(DISTINCT event_date) AS visits, count(DISTINCT event_date) FILTER (WHERE time_window = 'A') AS visits_A, count(DISTINCT event_date) FILTER (WHERE time_window = 'B') AS visits_B, count(*) AS n FROM anch WHERE time_window IS NOT NULL GROUP BY 1)"


@query("a11_visits", f"""{with_(ANCH, _VIS)} SELECT entity, visits, visits_A, visits_B, CAST(visits_B > visits_A AS INTEGER) AS acceleration,
  round(CASE WHEN visits_A > 0 THEN visits_B / visits_A::DOUBLE ELSE visits_B END, 6) AS ratio_B_A, round(n / visits::DOUBLE, 6) AS events_per_visit FROM vis""")
def _(t):
    return rounded(a.visits(t.anch))


_Q = ", ".join(f"count(*) FILTER (WHERE months_before > {m} AND months_before <= {m + 6}) AS q_{m}_{m + 6}" for m in range(0, 36, 6))


@query("a12_quarter_trajectory", f"""{AN}, q AS (SELECT entity, {_Q} FROM anch WHERE time_window IS NOT NULL GROUP BY 1) SELECT *, CAST(q_0_6 > q_30_36 AS INTEGER) AS increasing_trend,
  round(CASE WHEN q_30_36 > 0 THEN q_0_6 / q_30_36::DOUBLE ELSE q_0_6 END, 6) AS trend_ratio FROM q""")
def _(t):
    return rounded(a.quarter_trajectory(t.anch))


@query("a13_med_escalation", f"""{AN}, e AS (SELECT entity, count(DISTINCT category) FILTER (WHERE category IN {IN_S}) AS group_categories,
  count(*) FILTER (WHERE category IN {IN_S} AND time_window = 'A') AS group_A, count(*) FILTER (WHERE category IN {IN_S} AND time_window = 'B') AS group_B,
  count(*) FILTER (WHERE category = 'PROMO') AS repeats, CAST(count(*) FILTER (WHERE category = 'STANDARD') > 0 AS INTEGER) AS has_single,
  count(DISTINCT category) FILTER (WHERE time_window = 'A') AS poly_A, count(DISTINCT category) FILTER (WHERE time_window = 'B') AS poly_B
  FROM anch WHERE event_type = 'med' AND time_window IS NOT NULL GROUP BY 1)
SELECT *, CAST(group_B > group_A AS INTEGER) AS group_acceleration, CAST(repeats >= 3 AS INTEGER) AS repeat_flag, CAST(poly_B > poly_A AS INTEGER) AS poly_increase FROM e""")
def _(t):
    return a.escalation(t.anch.where("event_type = 'med'"), SYMPTOMS, "PROMO", "STANDARD")


@query("a14_gap_first_to_first", f"""{AN}, d AS (SELECT entity, CAST(min(event_date) FILTER (WHERE category IN {IN_I}) - min(event_date) FILTER (WHERE category IN {IN_S}) AS INTEGER) AS g FROM anch GROUP BY 1)
SELECT entity, coalesce(g, -1) AS gap_days, CAST(coalesce(g, -1) >= 0 AS INTEGER) AS y_after_x FROM d""")
def _(t):
    return a.gap(t.anch, SYMPTOMS, INVEST)


@query("a15_odyssey", f"""{AN} SELECT entity, CAST(count(DISTINCT event_date) >= 5 AND CAST(bool_or(category IN {IN_S}) AS INTEGER) + CAST(bool_or(category IN {IN_I}) AS INTEGER)
  + CAST(bool_or(category = 'STANDARD') AS INTEGER) >= 2 AS INTEGER) AS odyssey FROM anch WHERE time_window IS NOT NULL GROUP BY 1""")
def _(t):
    ev = a.windowed(t.anch)
    systems = a.clusters(ev, {"s": SYMPTOMS, "i": INVEST, "p": ["STANDARD"]})
    return a.odyssey(a.visits(ev).join(systems, "entity")).select("entity", "odyssey")


@query("a16_decay", f"""{AN} SELECT entity, round(sum(exp(-0.1::DOUBLE * months_before)), 6) AS decay_total,
  round(sum(CASE WHEN category IN {IN_S} THEN exp(-0.1::DOUBLE * months_before) ELSE 0 END), 6) AS decay_symptom,
  round(sum(CASE WHEN category = 'PROMO' THEN exp(-0.1::DOUBLE * months_before) ELSE 0 END), 6) AS decay_promo FROM anch GROUP BY 1""")
def _(t):
    return rounded(a.decay(t.anch, 0.1, {"symptom": SYMPTOMS, "promo": ["PROMO"]}))


_BINS = ", ".join(f"count(*) FILTER (WHERE months_before > {m} AND months_before <= {m + 3}) AS bin_{m}_{m + 3}, count(DISTINCT category) FILTER (WHERE months_before > {m} AND months_before <= {m + 3}) AS bin_cats_{m}_{m + 3}" for m in range(0, 15, 3))


@query("a17_monthly_bins", f"{AN} SELECT entity, {_BINS} FROM anch WHERE time_window IS NOT NULL GROUP BY 1")
def _(t):
    return a.binned(a.windowed(t.anch), [0, 3, 6, 9, 12, 15], distinct=True)


@query("a18_granular", f"""{AN}, big AS (SELECT brand FROM anch WHERE time_window IS NOT NULL GROUP BY 1 HAVING count(*) >= 1150)
SELECT entity, brand, count(*) AS total, count(DISTINCT code) AS unique_codes FROM anch WHERE time_window IS NOT NULL AND brand IN (SELECT brand FROM big) GROUP BY 1, 2""")
def _(t):
    return a.granular(t.anch, 1150, by="brand")


@query("a19_rates", f"{AN} SELECT entity, round(count(*) / count(DISTINCT category)::DOUBLE, 6) AS events_per_category FROM anch WHERE time_window IS NOT NULL GROUP BY 1")
def _(t):
    return rounded(a.rates(t.anch))


def _pairs_sql():
    cats = ["SMALL", "LARGE", "MEDIUM"]
    has = ", ".join([f"CAST(bool_or(category = '{c}') AS INTEGER) AS h_{c}" for c in cats] + [f"CAST(bool_or(brand = 'Brand#{b}') AS INTEGER) AS b_{b}" for b in (4, 19)])
    both = [f"h_{p} * h_{q} AS {p}_x_{q}" for i, p in enumerate(cats) for q in cats[i + 1:]]
    both += [f"h_{p} * b_{b} AS \"{p}_x_Brand#{b}\"" for p in cats for b in (4, 19)]
    return f"{AN}, p AS (SELECT entity, {has} FROM anch WHERE time_window IS NOT NULL GROUP BY 1) SELECT entity, {', '.join(both)} FROM p"


@query("a20_pair_cooccurrence", _pairs_sql())
def _(t):
    return a.pairs(a.windowed(t.anch), SYMPTOMS, ["Brand#4", "Brand#19"], "brand")


@query("a21_age_flags", f"""{AN} SELECT entity, CAST(max(age) >= 50 AS INTEGER) AS age_over_50, CAST(max(age) >= 65 AS INTEGER) AS age_over_65, CAST(max(age) >= 75 AS INTEGER) AS age_over_75,
  CAST(max(age) >= 65 AND bool_or(category = 'SMALL') AS INTEGER) AS small_over65 FROM anch GROUP BY 1""")
def _(t):
    m = t.anch.groupBy("entity").agg(F.max("age").alias("age"), F.max(x.flag(F.col("category") == "SMALL")).alias("small"))
    return a.age_flags(m, ["small"]).drop("age", "small")


_CNT = "n AS (SELECT entity, category, count(*) AS n FROM anch GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY entity)::DOUBLE AS p, row_number() OVER (PARTITION BY entity ORDER BY n) AS i, count(*) OVER (PARTITION BY entity) AS k, sum(n) OVER (PARTITION BY entity)::DOUBLE AS tot FROM n)"


@query("a22_entropy", f"{with_(ANCH, _CNT)} SELECT entity, round(-sum(p * log2(p + 1e-10::DOUBLE)), 6) AS entropy_log2, round(-sum(p * ln(p)), 6) AS entropy_ln FROM p GROUP BY 1")
def _(t):
    e2, e = a.entropy(t.anch), a.entropy(t.anch, "ln")
    return e2.select("entity", r("entropy", "entropy_log2")).join(e.select("entity", r("entropy", "entropy_ln")), "entity")


@query("a23_gini", f"{with_(ANCH, _CNT)} SELECT entity, CASE WHEN max(k) <= 1 THEN 0.0::DOUBLE ELSE round(2 * sum(i * n) / (max(k) * max(tot)) - (max(k) + 1) / max(k)::DOUBLE, 6) END AS gini FROM p GROUP BY entity")
def _(t):
    return rounded(a.gini(t.anch))


@query("a24_recency_per_category", f"""{AN} SELECT entity, category, CAST(max(anchor_date) - max(event_date) AS INTEGER) AS days_since_last,
  CAST(CAST(max(anchor_date) - max(event_date) AS INTEGER) <= 90 AS INTEGER) AS within_90, CAST(CAST(max(anchor_date) - max(event_date) AS INTEGER) <= 365 AS INTEGER) AS within_365 FROM anch GROUP BY 1, 2""")
def _(t):
    return a.recent_within(t.anch, [90, 365])


@query("a25_visits_per_category", f"{AN} SELECT entity, category, count(DISTINCT event_date) AS visits FROM anch GROUP BY 1, 2")
def _(t):
    return a.visits_by(t.anch)


@query("a26_acceleration_block", f"""{with_(ANCH, CELLS, _VIS)}, c AS (SELECT entity, sum(ca) AS ea, sum(cb) AS eb, count(*) FILTER (WHERE ca > 0) AS ka, count(*) FILTER (WHERE cb > 0) AS kb,
  count(*) FILTER (WHERE cb > ca) AS n_accelerating, count(*) FILTER (WHERE cb > 0 AND ca = 0) AS new_in_B FROM cells WHERE ct > 0 GROUP BY 1)
SELECT c.entity, round(eb / greatest(ea, 1)::DOUBLE, 6) AS events_ratio, CAST(eb - ea AS BIGINT) AS events_diff, round(kb / greatest(ka, 1)::DOUBLE, 6) AS cats_ratio, kb - ka AS cats_diff,
  round(visits_B / greatest(visits_A, 1)::DOUBLE, 6) AS visits_ratio, n_accelerating, new_in_B, CAST(new_in_B >= 2 AS INTEGER) AS acute_onset FROM c JOIN vis USING (entity)""")
def _(t):
    return rounded(a.acceleration(t.anch))


@query("a27_recurrence_flags", f"{with_(ANCH, CELLS)} SELECT entity, category, CAST(ct >= 2 AS INTEGER) AS ge_2, CAST(ct >= 3 AS INTEGER) AS ge_3, CAST(ct >= 4 AS INTEGER) AS ge_4 FROM cells")
def _(t):
    return a.recurrence_flags(a.category_counts(t.anch)).select("entity", "category", "ge_2", "ge_3", "ge_4")


@query("a28_near_far", f"""{AN}, n AS (SELECT entity, category, count(*) FILTER (WHERE months_before >= 0 AND months_before < 12) AS near, count(*) FILTER (WHERE months_before >= 12 AND months_before < 36) AS far FROM anch GROUP BY 1, 2)
SELECT entity, category, near, far, round((near + 1) / (far + 1)::DOUBLE, 6) AS near_far_ratio, near - far AS near_far_diff FROM n""")
def _(t):
    return rounded(a.near_far(t.anch, (0, 12), (12, 36)))


@query("a29_distinct_months", f"{AN} SELECT entity, category, count(DISTINCT date_trunc('month', event_date)) AS months, CAST(count(DISTINCT date_trunc('month', event_date)) >= 3 AS INTEGER) AS recurring FROM anch GROUP BY 1, 2")
def _(t):
    return a.distinct_months(t.anch)


@query("a30_same_month_multi", f"""{AN}, m AS (SELECT entity, months_before, count(DISTINCT category) AS k FROM anch WHERE category IN {IN_S} GROUP BY 1, 2)
SELECT entity, count(*) AS n_months, CAST(count(*) >= 3 AS INTEGER) AS sustained, max(months_before) - min(months_before) AS span_months, CAST(max(k) >= 2 AS INTEGER) AS multi_same_month FROM m GROUP BY 1""")
def _(t):
    return a.same_month(t.anch, SYMPTOMS)


@query("a31_engagement", f"""{AN}, e AS (SELECT entity, count(*) AS n, max(months_before) - min(months_before) AS span, count(*) FILTER (WHERE months_before <= 12) AS l12, count(*) FILTER (WHERE months_before <= 6) AS l6,
  greatest(CAST(max(event_date) - min(event_date) AS INTEGER), 1) AS d, min(days_before) AS rec, count(*) FILTER (WHERE v IS NULL) AS nov, count(DISTINCT event_type) AS nv
  FROM (SELECT *, CASE WHEN value > 10 THEN value END AS v FROM anch) GROUP BY 1)
SELECT entity, span AS record_span_months, round(span / 12.0::DOUBLE, 6) AS record_span_years, CAST(span >= 60 AS INTEGER) AS long_record, round(n / greatest(span, 1)::DOUBLE * 12, 6) AS events_per_year,
  round(l12 / n::DOUBLE, 6) AS recent_density, l6 AS recent_6, CAST(l6 >= 5 AS INTEGER) AS active_recent, round(n / (d / 30.4375::DOUBLE), 6) AS density, rec AS recency_days, nov AS orders_without_value, nv AS n_vocabularies FROM e""")
def _(t):
    ev = t.anch.withColumn("value", F.when(F.col("value") > 10, F.col("value")))
    return rounded(a.engagement(ev))


@query("a32_normalise_by_engagement", f"""{with_(ANCH, CELLS)}, tot AS (SELECT entity, count(*) AS n FROM anch WHERE time_window IS NOT NULL GROUP BY 1)
SELECT c.entity, category, round(ct / greatest(coalesce(n, 0), 1)::DOUBLE, 6) AS share FROM cells c LEFT JOIN tot USING (entity)""")
def _(t):
    out = a.normalise(a.category_counts(t.anch), a.totals(t.anch))
    return out.select("entity", "category", r("count_total_share", "share"))


@query("a33_share_ratios", f"""{with_(ANCH, _WIDE)} SELECT entity, round(CASE WHEN SMALL_B + SMALL_A > 0 THEN SMALL_B / (SMALL_B + SMALL_A)::DOUBLE ELSE 0.5 END, 6) AS small_recent,
  round(CASE WHEN PROMO_B + LARGE_B > 0 THEN PROMO_B / (PROMO_B + LARGE_B)::DOUBLE ELSE 0.5 END, 6) AS promo_share FROM wide""")
def _(t):
    out = a.shares(wide(t), {"small_recent": ("SMALL_B", "SMALL_A"), "promo_share": ("PROMO_B", "LARGE_B")}, 0.5)
    return rounded(out.select("entity", "small_recent", "promo_share"))


@query("a34_cross_window", f"""{with_(ANCH, CELLS)} SELECT entity, category, round(cb / (ca + 1)::DOUBLE, 6) AS b_over_a1, cb - ca AS b_minus_a,
  round(CASE WHEN ca > 0 THEN (cb - ca) / ca::DOUBLE ELSE cb END, 6) AS growth FROM cells""")
def _(t):
    return rounded(a.cross_window(a.category_counts(t.anch)).select("entity", "category", "b_over_a1", "b_minus_a", "growth"))


_CODES = """ends AS (SELECT entity, min(event_date) AS f, max(event_date) AS l FROM anch GROUP BY 1),
codes AS (SELECT a.entity, code, min(category) AS category, min(event_type) AS event_type, count(*) AS count,
  count(*) FILTER (WHERE event_date < f + CAST((l - f) // 2 AS INTEGER)) AS count_h1, count(*) FILTER (WHERE event_date >= f + CAST((l - f) // 2 AS INTEGER)) AS count_h2,
  avg(value) AS value_mean, max(row(event_date, value))[2] AS value_last, sum(CASE WHEN event_type = 'med' THEN value ELSE 0 END) AS duration_sum,
  min(event_date) AS first_event, max(event_date) AS last_event FROM anch a JOIN ends USING (entity) GROUP BY 1, 2)"""


def codes(t):
    return a.code_aggs(t.anch.withColumn("duration", F.when(F.col("event_type") == "med", F.col("value"))))


@query("a35_category_aggregates", f"""{with_(ANCH, _CODES)} SELECT entity, category, CAST(sum(count) AS BIGINT) AS count, round(avg(value_mean), 6) AS value_mean, round(sum(duration_sum), 6) AS duration_sum, min(first_event) AS first_event, max(last_event) AS last_event,
  CAST(sum(count_h1) AS BIGINT) AS count_h1, CAST(sum(count_h2) AS BIGINT) AS count_h2, 1 AS present, CAST(max(anchor_date) - max(last_event) AS INTEGER) AS recency_days,
  round(sum(count) / (greatest(CAST(max(last_event) - min(first_event) AS INTEGER), 1) / 30.4375::DOUBLE), 6) AS event_density FROM codes JOIN spine USING (entity) GROUP BY 1, 2""")
def _(t):
    return rounded(a.category_aggs(codes(t), t.spine))


@query("a36_code_aggregates_midpoint", f"{with_(ANCH, _CODES)} SELECT * REPLACE (round(value_mean, 6) AS value_mean) FROM codes")
def _(t):
    return rounded(codes(t))


@query("a37_config_thresholds", f"""{AN}, m AS (SELECT entity, sum(value) AS days, max(value) AS top FROM anch WHERE event_type = 'med' GROUP BY 1)
SELECT entity, round(days / 365.25::DOUBLE, 6) AS exposure_years, CAST(days >= 300 AS INTEGER) AS long_exposure, CAST(top >= 48 AS INTEGER) AS high_value FROM m""")
def _(t):
    m = t.anch.where("event_type = 'med'").groupBy("entity").agg(F.sum("value").alias("days"), F.max("value").alias("top"))
    out = a.declared(m, [("exposure_years", "years", "days", 365.25), ("long_exposure", "ge", "days", 300), ("high_value", "ge", "top", 48), ("skipped", "ge", "none", 1)])
    return rounded(out.drop("days", "top"))


@query("a38_half_trend", f"""{with_(ANCH, _CODES)}, c AS (SELECT entity, category, CAST(sum(count_h1) AS DOUBLE) AS h1, CAST(sum(count_h2) AS DOUBLE) AS h2 FROM codes GROUP BY 1, 2)
SELECT entity, category, round(CASE WHEN h1 > 0 THEN h2 / (h1 + 1) ELSE 0 END, 6) AS trend_h2_over_h1, CAST(h1 > 0 AND h2 > h1 AS INTEGER) AS is_worsening, round(CASE WHEN h1 > 0 THEN h2 / (h1 + h2) ELSE 0 END, 6) AS recent_frac FROM c""")
def _(t):
    out = a.half_trend(a.category_aggs(codes(t), t.spine))
    return rounded(out.select("entity", "category", "trend_h2_over_h1", "is_worsening", "recent_frac"))


@query("a39_global_volume", f"""{AN} SELECT entity, count(*) AS total_events, count(DISTINCT code) FILTER (WHERE event_type = 'obs') AS distinct_obs_codes, count(DISTINCT code) FILTER (WHERE event_type = 'med') AS distinct_med_codes,
  count(value) AS measured, count(DISTINCT event_date) AS consultation_days FROM anch GROUP BY 1""")
def _(t):
    return a.volume(t.anch)


@query("a40_demographics", f"""{with_(SPINE)} SELECT entity, age, CAST(sex = 'M' AS INTEGER) AS male, CAST(age < 50 AS DOUBLE) AS "band_<50", CAST(age >= 50 AND age < 65 AS DOUBLE) AS "band_50-65", CAST(age >= 65 AND age < 120 AS DOUBLE) AS "band_65+", 0.0::DOUBLE AS band_Unknown,
  CAST(segment = 'BUILDING' AS DOUBLE) AS group_BUILDING, CAST(segment = 'FURNITURE' AS DOUBLE) AS group_FURNITURE, CAST(segment NOT IN ('BUILDING', 'FURNITURE') AS DOUBLE) AS "group_Unknown" FROM spine""")
def _(t):
    return a.demographics(t.spine, [0, 50, 65, 120], ["<50", "50-65", "65+"], ["BUILDING", "FURNITURE"], "segment")


@query("a41_top_code_flags", f"""{AN}, has AS (SELECT DISTINCT entity, code FROM anch WHERE time_window IS NOT NULL), tot AS (SELECT count(*) FILTER (WHERE label = 1)::DOUBLE AS P, count(*) FILTER (WHERE label = 0)::DOUBLE AS N FROM spine),
top AS (SELECT code, abs(count(*) FILTER (WHERE label = 1) / max(P) - count(*) FILTER (WHERE label = 0) / max(N)) AS d FROM has JOIN spine USING (entity), tot GROUP BY 1 HAVING count(*) >= 20
  ORDER BY round(d, 12) DESC, code LIMIT 50)
SELECT code, entity, round(d, 6) AS abs_diff FROM has JOIN top USING (code)""")
def _(t):
    return rounded(a.top_code_flags(t.anch, t.spine))
