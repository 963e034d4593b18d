"""P: pattern features on the anchored history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as x
from ..operators import counts as a, patterns as p
from .base import ANCH, SPINE, query, r, rounded, with_

AN = with_(ANCH)


@query("p01_term_subtypes", f"""{AN} SELECT entity, count(*) FILTER (WHERE category = 'SMALL' AND regexp_matches(lower(term), 'ring|bolt')) AS fasteners_count,
  count(*) FILTER (WHERE category = 'LARGE' AND regexp_matches(lower(term), '^red')) AS red_count, CAST(count(*) FILTER (WHERE category = 'SMALL' AND regexp_matches(lower(term), 'ring|bolt')) > 0 AS INTEGER) AS fasteners_flag,
  CAST(count(*) FILTER (WHERE category = 'LARGE' AND regexp_matches(lower(term), '^red')) > 0 AS INTEGER) AS red_flag FROM anch GROUP BY 1""")
def _(t):
    return p.term_counts(t.anch, {"fasteners": ("SMALL", "ring|bolt"), "red": ("LARGE", "^red")})


@query("p01_subtype_block", f"""{AN}, s AS (SELECT entity, count(*) AS total, count(DISTINCT term) AS unique_terms, count(DISTINCT event_date) AS unique_dates, count(*) FILTER (WHERE time_window = 'A') AS count_A,
  count(*) FILTER (WHERE time_window = 'B') AS count_B, CAST(max(months_before) AS BIGINT) AS first_months, CAST(min(months_before) AS BIGINT) AS last_months, round(avg(months_before), 6) AS mean_months,
  count(*) FILTER (WHERE term LIKE '%ring%') AS ring_count, count(*) FILTER (WHERE term LIKE '%blue%') AS blue_count FROM anch WHERE category = 'SMALL' GROUP BY 1)
SELECT *, first_months - last_months AS span_months, CAST(total > 1 AS INTEGER) AS recurrent, CAST(total >= 3 AS INTEGER) AS frequent,
  round(CASE WHEN count_A > 0 THEN count_B / count_A::DOUBLE WHEN count_B > 0 THEN 2 ELSE 0 END, 6) AS acceleration FROM s""")
def _(t):
    return rounded(p.subtype_block(t.anch, "SMALL", {"ring": "ring", "blue": "blue"}))


_W = {"SMALL": 3.0, "LARGE": 2.0, "PROMO": 1.5, "STANDARD": 0.5}


@query("p02_weighted_score", f"""{AN}, s AS (SELECT entity, sum(DISTINCT CASE category WHEN 'SMALL' THEN 3.0::DOUBLE WHEN 'LARGE' THEN 2.0::DOUBLE WHEN 'PROMO' THEN 1.5::DOUBLE WHEN 'STANDARD' THEN 0.5::DOUBLE ELSE 0 END) AS score, max(age) AS age FROM anch GROUP BY 1)
SELECT entity, score, CAST(score >= 5 AS INTEGER) AS score_high, score * age AS score_x_age FROM s""")
def _(t):
    return p.score(t.anch, _W)


_DEF = {"size": ["SMALL", "LARGE"], "deal": ["PROMO"], "plain": ["STANDARD", "MEDIUM"]}


@query("p03_multi_system", f"""{AN}, s AS (SELECT entity, max(CAST(category IN ('SMALL', 'LARGE') AS INTEGER)) AS size, max(CAST(category = 'PROMO' AS INTEGER)) AS deal, max(CAST(category IN ('STANDARD', 'MEDIUM') AS INTEGER)) AS plain
  FROM anch WHERE time_window = 'B' GROUP BY 1) SELECT *, size + deal + plain AS n_systems, CAST(size + deal + plain >= 2 AS INTEGER) AS pair, CAST(size + deal + plain >= 3 AS INTEGER) AS trifecta FROM s""")
def _(t):
    return p.systems(t.anch, _DEF)


CELLS = "cells AS (SELECT entity, category, count(*) FILTER (WHERE time_window = 'A') AS ca, count(*) FILTER (WHERE time_window = 'B') AS cb FROM anch GROUP BY 1, 2)"


@query("p04_velocity_counts", f"""{with_(ANCH, CELLS)} SELECT entity, category, greatest(cb - ca, 0) AS velocity, round(least(cb / (CASE WHEN ca = 0 THEN 1 ELSE ca END)::DOUBLE, 10), 6) AS activity_ratio FROM cells""")
def _(t):
    return rounded(p.velocity_counts(a.category_counts(t.anch)).select("entity", "category", "velocity", "activity_ratio"))


@query("p05_deciles", f"""{with_(SPINE)}, rk AS (SELECT entity, balance, age, row_number() OVER (ORDER BY age, md5(concat_ws('|', entity, 'qcut'))) AS ra, row_number() OVER (ORDER BY balance, md5(concat_ws('|', entity, 'qcut'))) AS rb, count(*) OVER () AS n FROM spine)
SELECT entity, CAST(greatest(ceil((ra - 1) * 10.0::DOUBLE / (n - 1)) - 1, 0) AS INTEGER) AS age_decile, CAST(greatest(ceil((rb - 1) * 10.0::DOUBLE / (n - 1)) - 1, 0) AS INTEGER) AS balance_decile FROM rk""")
def _(t):
    out = p.deciles(p.deciles(t.spine, "age", name="age_decile"), "balance", name="balance_decile")
    return out.select("entity", "age_decile", "balance_decile")


@query("p06_months_since_first", f"""{AN}, f AS (SELECT entity, coalesce(CAST(max(anchor_date) - min(event_date) FILTER (WHERE category = 'SMALL') AS INTEGER) / 30.44::DOUBLE, -1) AS s,
  coalesce(CAST(max(anchor_date) - min(event_date) FILTER (WHERE category IN ('PROMO', 'ECONOMY')) AS INTEGER) / 30.44::DOUBLE, -1) AS d FROM anch GROUP BY 1)
SELECT entity, round(s, 6) AS small_months, round(d, 6) AS deal_months, CAST(s >= 0 AND s < 30 AS INTEGER) AS small_recent, CAST(d >= 0 AND d < 30 AS INTEGER) AS deal_recent FROM f""")
def _(t):
    return rounded(p.since_first(t.anch, {"small": ["SMALL"], "deal": ["PROMO", "ECONOMY"]}, 30))


_FD = """fd AS (SELECT entity, CAST(min(event_date) FILTER (WHERE category = 'LARGE') - min(event_date) FILTER (WHERE category = 'SMALL') AS INTEGER) AS sl,
  CAST(min(event_date) FILTER (WHERE category = 'PROMO' AND event_type = 'med') - min(event_date) FILTER (WHERE category = 'ECONOMY' AND event_type = 'obs') AS INTEGER) AS ep FROM anch GROUP BY 1)"""


@query("p07_then_within", f"""{with_(ANCH, _FD)} SELECT entity, coalesce(CAST(sl BETWEEN 0 AND 60 AS INTEGER), 0) AS small_then_large_60, coalesce(CAST(ep BETWEEN 0 AND 180 AS INTEGER), 0) AS economy_then_promo_180 FROM fd""")
def _(t):
    return p.then_within(t.anch, {"small_then_large_60": (["SMALL"], ["LARGE"], 60), "economy_then_promo_180": (("obs", ["ECONOMY"]), ("med", ["PROMO"]), 180)})


@query("p08_time_between", f"""{with_(ANCH, _FD)} SELECT entity, ep AS ep_days, coalesce(CAST(ep < 0 AS INTEGER), 0) AS ep_y_first, coalesce(CAST(ep BETWEEN 0 AND 30 AS INTEGER), 0) AS ep_within_30,
  coalesce(CAST(ep BETWEEN 0 AND 90 AS INTEGER), 0) AS ep_within_90, coalesce(CAST(ep > 90 AS INTEGER), 0) AS ep_delayed FROM fd""")
def _(t):
    return p.time_between(t.anch, {"ep": (("obs", ["ECONOMY"]), ("med", ["PROMO"]))})


@query("p09_burst", f"""{AN}, d AS (SELECT DISTINCT entity, event_date, category FROM anch), k AS (SELECT a.entity, a.event_date, count(DISTINCT b.category) AS k FROM d a JOIN d b ON a.entity = b.entity AND b.event_date BETWEEN a.event_date - 30 AND a.event_date GROUP BY 1, 2)
SELECT entity, CAST(max(k) AS INTEGER) AS max_in_window, CAST(max(k) >= 3 AS INTEGER) AS burst_3, CAST(max(k) >= 4 AS INTEGER) AS burst_4 FROM k GROUP BY 1""")
def _(t):
    return p.burst(t.anch)


@query("p10_weekly_bursts", f"""{AN}, m AS (SELECT DISTINCT entity, event_date FROM anch WHERE category = 'PROMO'), w AS (SELECT a.entity, year(a.event_date) AS y, week(a.event_date) AS w, count(*) AS n, count(DISTINCT category) AS k, max(CAST(m.entity IS NOT NULL AS INTEGER)) AS m
  FROM anch a LEFT JOIN m ON m.entity = a.entity AND m.event_date = a.event_date GROUP BY 1, 2, 3)
SELECT entity, count(*) FILTER (WHERE n >= 3) AS burst_weeks, count(*) FILTER (WHERE k >= 2) AS diverse_weeks, max(n) AS max_per_week, count(*) FILTER (WHERE m = 1 AND n > 1) AS together_weeks FROM w GROUP BY 1""")
def _(t):
    return p.weekly(t.anch, "PROMO")


@query("p11_gaps", f"""{AN}, g AS (SELECT entity, CAST(event_date - lag(event_date) OVER (PARTITION BY entity ORDER BY event_date) AS INTEGER) AS g FROM anch)
SELECT entity, max(g) AS max_gap, round(avg(g), 6) AS mean_gap, round(median(g), 6) AS median_gap FROM g GROUP BY 1""")
def _(t):
    return rounded(p.gaps(t.anch))


@query("p12_per_day", f"""{AN}, d AS (SELECT entity, event_date, count(*) AS n FROM anch GROUP BY 1, 2) SELECT entity, max(n) AS max_per_day, round(avg(n), 6) AS mean_per_day, count(*) FILTER (WHERE n > 1) AS multi_days FROM d GROUP BY 1""")
def _(t):
    return rounded(p.per_day(t.anch))


@query("p13_burstiness", f"""{AN}, m AS (SELECT entity, months_before, count(*) AS n FROM anch GROUP BY 1, 2), b AS (SELECT entity, round(stddev_samp(n), 6) AS monthly_std, max(n) AS monthly_max, count(*) AS active_months,
  CAST(coalesce(sum(n) FILTER (WHERE months_before BETWEEN 1 AND 6), 0) AS BIGINT) AS w1, CAST(coalesce(sum(n) FILTER (WHERE months_before BETWEEN 7 AND 12), 0) AS BIGINT) AS w2, CAST(coalesce(sum(n) FILTER (WHERE months_before BETWEEN 13 AND 18), 0) AS BIGINT) AS w3 FROM m GROUP BY 1)
SELECT *, w2 - w1 AS w2_minus_w1, w3 - w2 AS w3_minus_w2, w1 - w3 AS slope FROM b""")
def _(t):
    return rounded(p.burstiness(t.anch, {"w1": (1, 6), "w2": (7, 12), "w3": (13, 18)}))


_MAT = """mat AS (SELECT entity, max(age) AS age, count(*) FILTER (WHERE category = 'SMALL' AND time_window = 'B') AS small_B, count(*) FILTER (WHERE category = 'LARGE') AS large, count(*) FILTER (WHERE category = 'PROMO') AS promo,
  count(DISTINCT category) AS n_cat, sum(value) AS total FROM anch GROUP BY 1)"""


def mat(t):
    c = F.col("category")
    return t.anch.groupBy("entity").agg(
        F.max("age").alias("age"), F.count_if((c == "SMALL") & (F.col("time_window") == "B")).alias("small_B"), F.count_if(c == "LARGE").alias("large"),
        F.count_if(c == "PROMO").alias("promo"), F.count_distinct("category").alias("n_cat"), F.sum("value").alias("total"))


@query("p14_triple_products", f"""{with_(ANCH, _MAT)} SELECT entity, CAST(age * small_B * large AS DOUBLE) AS age_small_large, CAST(age * promo AS DOUBLE) AS age_promo, CAST(age >= 70 AND small_B > 0 AS INTEGER) AS elderly_small FROM mat""")
def _(t):
    out = p.products(mat(t), {"age_small_large": ["age", "small_B", "large"], "age_promo": ["age", "promo"]}, {"elderly_small": "small_B"})
    return out.select("entity", "age_small_large", "age_promo", "elderly_small")


@query("p15_risk_composites", f"""{with_(ANCH, _MAT)} SELECT entity, CAST(small_B > 0 OR promo > 0 AS INTEGER) AS any_small_promo, small_B * 3.0::DOUBLE + promo * 1.0::DOUBLE AS rf_score, CAST(small_B > 0 AND large = 0 AS INTEGER) AS unexplained_small FROM mat""")
def _(t):
    out = p.risk_composites(mat(t), {"any_small_promo": ["small_B", "promo"]}, {"rf_score": {"small_B": 3.0, "promo": 1.0}}, {"unexplained_small": ("small_B", ["large"])})
    return out.select("entity", "any_small_promo", "rf_score", "unexplained_small")


@query("p16_residual_vs_expected", f"""{with_(ANCH, _MAT)}, b AS (SELECT *, CASE WHEN n_cat <= 3 THEN 'few' WHEN n_cat <= 5 THEN 'some' ELSE 'all' END AS bin FROM mat), e AS (SELECT entity, total - avg(total) OVER (PARTITION BY bin) AS res FROM b)
SELECT entity, round(res, 6) AS residual, CAST(res > 0 AS INTEGER) AS above_expected FROM e""")
def _(t):
    out = p.residual(mat(t), "total", x.band("n_cat", [0, 3, 5, 99], ["few", "some", "all"], right=True))
    return rounded(out.select("entity", "residual", "above_expected"))
