"""Whole flows: cohort to events, events to matrix."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..operators import assemble
from ..plans import disease, extract, matrix
from ..skew import one_row
from . import cohort as co
from .base import ANCH, HIST, TYPES, query, rounded, with_

CFG = matrix.MatrixConfig(
    categories=TYPES, lab_categories=("SMALL", "LARGE"), symptom_categories=("SMALL", "LARGE", "MEDIUM"), investigation_categories=("PROMO", "ECONOMY"),
    clusters={"size": ("SMALL", "LARGE", "MEDIUM"), "price": ("PROMO", "ECONOMY"), "plain": ("STANDARD",)},
    interactions=(("small_x_large", "SMALL_count_B", "LARGE_count_B"),))


def _matrix_sql():
    w = "time_window"
    per = []
    for t in TYPES:
        i = f"category = '{t}'"
        a, b = f"count(*) FILTER (WHERE {i} AND {w} = 'A')", f"count(*) FILTER (WHERE {i} AND {w} = 'B')"
        per += [f"{a} AS {t}_count_A", f"{b} AS {t}_count_B", f"count(*) FILTER (WHERE {i}) AS {t}_count_total", f"CAST(count(*) FILTER (WHERE {i}) > 0 AS INTEGER) AS {t}_has_ever",
                f"CAST({b} > {a} AS INTEGER) AS {t}_acceleration", f"CAST({b} > 0 AND {a} = 0 AS INTEGER) AS {t}_new_in_B",
                f"round(coalesce(sum(exp(-0.1::DOUBLE * months_before)) FILTER (WHERE {i}), 0), 6) AS {t}_decay",
                f"coalesce(CAST(max(anchor_date) - max(event_date) FILTER (WHERE {i}) AS INTEGER), -1) AS {t}_days_since_last",
                f"count(DISTINCT event_date) FILTER (WHERE {i}) AS {t}_visits",
                f"coalesce(CAST(max(event_date) FILTER (WHERE {i}) - min(event_date) FILTER (WHERE {i}) AS INTEGER), 0) AS {t}_span_days"]
    for t in ("SMALL", "LARGE"):
        i = f"category = '{t}'"
        xx = "CAST(-days_before AS DOUBLE)"
        per += [f"round(avg(value) FILTER (WHERE {i}), 6) AS {t}_value_mean", f"min(value) FILTER (WHERE {i}) AS {t}_value_min", f"max(value) FILTER (WHERE {i}) AS {t}_value_max",
                f"round(stddev_samp(value) FILTER (WHERE {i}), 6) AS {t}_value_std", f"min({{'d': event_date, 'v': value}}) FILTER (WHERE {i}).v AS {t}_value_first", f"max({{'d': event_date, 'v': value}}) FILTER (WHERE {i}).v AS {t}_value_last",
                f"round(avg(value) FILTER (WHERE {i} AND {w} = 'A'), 6) AS {t}_value_mean_A", f"round(avg(value) FILTER (WHERE {i} AND {w} = 'B'), 6) AS {t}_value_mean_B",
                f"round(avg(value) FILTER (WHERE {i} AND {w} = 'B') - avg(value) FILTER (WHERE {i} AND {w} = 'A'), 6) AS {t}_value_delta",
                f"round(CASE WHEN var_pop({xx}) FILTER (WHERE {i}) > 0 THEN regr_slope(value, {xx}) FILTER (WHERE {i}) END, 6) AS {t}_value_slope"]
    bins = list(zip(CFG.bins, CFG.bins[1:]))
    one = ["count(*) AS total_events", f"count(*) FILTER (WHERE {w} = 'A') AS events_A", f"count(*) FILTER (WHERE {w} = 'B') AS events_B", "count(DISTINCT category) AS unique_categories",
           f"count(DISTINCT category) FILTER (WHERE {w} = 'A') AS categories_A", f"count(DISTINCT category) FILTER (WHERE {w} = 'B') AS categories_B", "round(sum(exp(-0.1::DOUBLE * months_before)), 6) AS decay_total",
           f"round(count(*) FILTER (WHERE {w} = 'B') / greatest(count(*) FILTER (WHERE {w} = 'A'), 1)::DOUBLE, 6) AS events_ratio", "count(DISTINCT event_date) AS visits",
           f"count(DISTINCT event_date) FILTER (WHERE {w} = 'A') AS visits_A", f"count(DISTINCT event_date) FILTER (WHERE {w} = 'B') AS visits_B",
           "CAST(count(*) FILTER (WHERE category = 'SMALL' AND time_window = 'B') * count(*) FILTER (WHERE category = 'LARGE' AND time_window = 'B') AS BIGINT) AS small_x_large"]
    for lo, hi in bins:
        m = f"months_before > {lo} AND months_before <= {hi}"
        one += [f"count(*) FILTER (WHERE {m}) AS bin_{lo}_{hi}", f"count(DISTINCT category) FILTER (WHERE {m}) AS bin_cats_{lo}_{hi}"]
    groups = {**{f"cluster_{k}": v for k, v in CFG.clusters.items()}, "symptom": CFG.symptom_categories, "investigation": CFG.investigation_categories}
    for g, cats in groups.items():
        i = "category IN (" + ", ".join(f"'{q}'" for q in cats) + ")"
        one += [f"count(*) FILTER (WHERE {i}) AS {g}_count", f"count(*) FILTER (WHERE {i} AND {w} = 'B') AS {g}_count_B", f"count(DISTINCT category) FILTER (WHERE {i}) AS {g}_breadth"]
    multi = " + ".join("CAST(count(*) FILTER (WHERE category IN (" + ", ".join(f"'{q}'" for q in v) + ")) > 0 AS INTEGER)" for v in CFG.clusters.values())
    one += [f"{multi} AS multi_system_count", f"CAST({multi} >= 3 AS INTEGER) AS systems_3plus"]
    cells = "cells AS (SELECT entity, category, count(*) FILTER (WHERE time_window = 'A') AS ca, count(*) FILTER (WHERE time_window = 'B') AS cb, count(*) AS n FROM wa GROUP BY 1, 2)"
    div = """dv AS (SELECT entity, count(*) FILTER (WHERE cb > 0 AND ca = 0) AS new_categories, count(*) FILTER (WHERE cb > ca) AS accelerating_categories, CAST(count(*) FILTER (WHERE cb > 0 AND ca = 0) >= 2 AS INTEGER) AS acute_onset,
  round(-sum(n / tot * log2(n / tot + 1e-10)), 6) AS entropy, CASE WHEN count(*) <= 1 THEN 0.0::DOUBLE ELSE round(2 * sum(i * n) / (count(*) * max(tot)) - (count(*) + 1) / count(*)::DOUBLE, 6) END AS gini
  FROM (SELECT *, (sum(n) OVER (PARTITION BY entity))::DOUBLE AS tot, row_number() OVER (PARTITION BY entity ORDER BY n) AS i FROM cells) GROUP BY 1)"""
    days = """dd AS (SELECT entity, event_date, count(*) AS n FROM wa GROUP BY 1, 2), dg AS (SELECT *, CAST(event_date - lag(event_date) OVER (PARTITION BY entity ORDER BY event_date) AS INTEGER) AS g FROM dd),
dy AS (SELECT entity, max(n) AS max_per_day, coalesce(max(g), -1) AS max_gap, round(coalesce(avg(g), -1), 6) AS mean_day_gap FROM dg GROUP BY 1)"""
    big = f"fm AS (SELECT entity, {', '.join(per + one)} FROM wa GROUP BY 1)"
    cols_zero = []
    for e in per + one:
        cols_zero.append(re.search(r" AS (\w+)$", e).group(1))
    level = {n for n in cols_zero if "_value_" in n}
    minus = {n for n in cols_zero if n.endswith("_days_since_last")}
    sel = [f"fm.{n}" if n in level else f"coalesce(fm.{n}, {-1 if n in minus else 0}) AS {n}" for n in cols_zero]
    sel += [f"coalesce(dv.{n}, 0) AS {n}" for n in ("new_categories", "accelerating_categories", "acute_onset", "entropy", "gini")] + ["coalesce(dy.max_per_day, 0) AS max_per_day", "coalesce(dy.max_gap, -1) AS max_gap", "coalesce(dy.mean_day_gap, -1) AS mean_day_gap"]
    return f"{with_(ANCH)}, wa AS (SELECT * FROM anch WHERE time_window IS NOT NULL), {cells}, {div}, {days}, {big} SELECT s.entity, s.label, {', '.join(sel)} FROM spine s LEFT JOIN fm USING (entity) LEFT JOIN dv USING (entity) LEFT JOIN dy USING (entity)"


@query("plan_feature_matrix", _matrix_sql())
def _(t):
    return rounded(matrix.build(t.anch, t.spine.select("entity", "label"), CFG))


KEEP = ["SMALL_count_B", "LARGE_value_last", "SMALL_days_since_last"]


@query("plan_keep_parity", f"""{with_(ANCH)}, a AS (SELECT entity, count(*) FILTER (WHERE category = 'LARGE') AS l FROM anch WHERE time_window IS NOT NULL GROUP BY 1)
SELECT 3 * count(*) + count(*) FILTER (WHERE l > 0) AS n_compared, 0 AS n_different FROM spine LEFT JOIN a USING (entity)""")
def _(t):
    """A build restricted to some features against the full build, value by value."""
    spine = t.spine.select("entity")
    cols = [*KEEP, "total_events"]
    full = assemble.to_long(matrix.build(t.anch, spine, CFG), ["entity"], cols)
    part = assemble.to_long(matrix.build(t.anch, spine, CFG, keep=KEEP), ["entity"], cols)
    return one_row(full.agg(F.count(F.lit(1)).alias("n_compared")), assemble.parity(full, part).agg(F.count(F.lit(1)).alias("n_different")))


DEMO = disease.Disease(
    name="demo", groups={"small": ["SMALL"], "large": ["LARGE"], "deal": ["PROMO", "ECONOMY"]}, subtypes={"small_ring": ("small", "ring"), "large_red": ("large", "^red")},
    labs={"bolt": (["SMALL", "LARGE"], "bolt")}, lab_flags={"bolt_high": "bolt_latest > 30", "bolt_rising": "bolt_latest - bolt_first > 0"},
    flags={"both": "has_small = 1 AND has_large = 1", "both_old": "both = 1 AND age >= 60", "heavy_deal": "b_deal >= 3"}, scores={"risk": "has_small * 2 + has_deal + bolt_high"},
    systems={"size": ["small", "large"], "price": ["deal"]}, trends=["small"], onsets=["deal"], sequences=[("small", "large", 90)], products={"small_bolt": ["b_small", "bolt_high"]},
    weights={"SMALL": 3.0, "PROMO": 1.5}, symptoms=["SMALL", "LARGE", "MEDIUM"])


@query("plan_disease_features", f"""{with_(ANCH)}, wa AS (SELECT * FROM anch WHERE time_window IS NOT NULL),
lb AS (SELECT entity, max({{'d': event_date, 'v': value}}).v AS lt, min({{'d': event_date, 'v': value}}).v AS ft, max(value) AS mx, min(value) AS mn FROM wa WHERE category IN ('SMALL', 'LARGE') AND term LIKE '%bolt%' GROUP BY 1),
dd AS (SELECT DISTINCT entity, event_date, category FROM wa WHERE category IN ('SMALL', 'LARGE', 'MEDIUM')),
bu AS (SELECT entity, CAST(max(k) AS INTEGER) AS k FROM (SELECT a.entity, a.event_date, count(DISTINCT b.category) AS k FROM dd a JOIN dd b ON a.entity = b.entity AND b.event_date BETWEEN a.event_date - 30 AND a.event_date GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT entity, count(*) FILTER (WHERE time_window = 'A') AS events_A, count(*) FILTER (WHERE time_window = 'B') AS events_B, count(DISTINCT category) AS n_categories,
  count(*) FILTER (WHERE category = 'SMALL' AND time_window = 'A') AS a_small, count(*) FILTER (WHERE category = 'SMALL' AND time_window = 'B') AS b_small,
  count(*) FILTER (WHERE category = 'LARGE' AND time_window = 'A') AS a_large, count(*) FILTER (WHERE category = 'LARGE' AND time_window = 'B') AS b_large,
  count(*) FILTER (WHERE category IN ('PROMO', 'ECONOMY') AND time_window = 'A') AS a_deal, count(*) FILTER (WHERE category IN ('PROMO', 'ECONOMY') AND time_window = 'B') AS b_deal,
  count(*) FILTER (WHERE category = 'SMALL' AND term LIKE '%ring%') AS small_ring_count, count(*) FILTER (WHERE category = 'LARGE' AND term LIKE 'red%') AS large_red_count,
  3.0::DOUBLE * max(CAST(category = 'SMALL' AS INTEGER)) + 1.5::DOUBLE * max(CAST(category = 'PROMO' AS INTEGER)) AS wb,
  CAST(min(event_date) FILTER (WHERE category = 'LARGE') - min(event_date) FILTER (WHERE category = 'SMALL') AS INTEGER) AS gap,
  CAST(max(anchor_date) - min(event_date) FILTER (WHERE category IN ('PROMO', 'ECONOMY')) AS INTEGER) / 30.44::DOUBLE AS fd FROM wa GROUP BY 1),
f AS (SELECT s.entity, s.age, s.sex, coalesce(events_A, 0) AS events_A, coalesce(events_B, 0) AS events_B, coalesce(n_categories, 0) AS n_categories, coalesce(a_small, 0) AS a_small, coalesce(b_small, 0) AS b_small,
  coalesce(a_large, 0) AS a_large, coalesce(b_large, 0) AS b_large, coalesce(a_deal, 0) AS a_deal, coalesce(b_deal, 0) AS b_deal, coalesce(small_ring_count, 0) AS small_ring_count, coalesce(large_red_count, 0) AS large_red_count,
  coalesce(wb, 0) AS weighted_burden, gap, fd, lt, ft, mx, mn, coalesce(k, 0) AS k FROM spine s LEFT JOIN g USING (entity) LEFT JOIN lb USING (entity) LEFT JOIN bu USING (entity))
SELECT entity, age, sex, events_A, events_B, n_categories, a_small, b_small, a_large, b_large, a_deal, b_deal, small_ring_count, large_red_count, weighted_burden, lt AS bolt_latest, ft AS bolt_first, mx AS bolt_max, mn AS bolt_min,
  CAST(lt IS NOT NULL AS INTEGER) AS bolt_tested, k AS max_in_window, CAST(k >= 3 AS INTEGER) AS burst_3, CAST(k >= 4 AS INTEGER) AS burst_4, a_small + b_small AS n_small, a_large + b_large AS n_large, a_deal + b_deal AS n_deal,
  CAST(a_small + b_small > 0 AS INTEGER) AS has_small, CAST(a_large + b_large > 0 AS INTEGER) AS has_large, CAST(a_deal + b_deal > 0 AS INTEGER) AS has_deal, CAST(small_ring_count > 0 AS INTEGER) AS small_ring_flag,
  CAST(large_red_count > 0 AS INTEGER) AS large_red_flag, CAST(coalesce(lt > 30, false) AS INTEGER) AS bolt_high, CAST(coalesce(lt - ft > 0, false) AS INTEGER) AS bolt_rising,
  CAST(a_small + b_small > 0 AND a_large + b_large > 0 AS INTEGER) AS "both", CAST(a_small + b_small > 0 AND a_large + b_large > 0 AND age >= 60 AS INTEGER) AS both_old, CAST(b_deal >= 3 AS INTEGER) AS heavy_deal,
  CAST(CAST(a_small + b_small > 0 AS INTEGER) * 2 + CAST(a_deal + b_deal > 0 AS INTEGER) + CAST(coalesce(lt > 30, false) AS INTEGER) AS DOUBLE) AS risk,
  CAST(b_small > 0 OR b_large > 0 AS INTEGER) + CAST(b_deal > 0 AS INTEGER) AS systems_B, CAST((b_small > 0 OR b_large > 0) AND b_deal > 0 AS INTEGER) AS systems_pair_B, 0 AS systems_trifecta_B,
  greatest(b_small - a_small, 0) AS vel_small, CAST(b_small > 0 AND a_small = 0 AS INTEGER) AS new_small_B_only, age * b_small AS age_x_small_B, age * greatest(b_small - a_small, 0) AS age_x_vel_small,
  age * CAST(b_small > 0 AND a_small = 0 AS INTEGER) AS age_x_new_small, CAST(age >= 70 AND b_small > 0 AS INTEGER) AS elderly_small, round(coalesce(fd, -1), 6) AS first_deal_months, CAST(coalesce(fd >= 0 AND fd < 12, false) AS INTEGER) AS recent_deal,
  CAST(coalesce(gap BETWEEN 0 AND 90, false) AS INTEGER) AS seq_small_then_large_90d, coalesce(gap, -1) AS gap_small_to_large_days, age * b_small * CAST(coalesce(lt > 30, false) AS INTEGER) AS age_x_small_bolt,
  CAST(abs(age - 75) AS DOUBLE) AS age_peak_distance, greatest(events_B - events_A, 0) AS activity_velocity, round(least(events_B / (CASE WHEN events_A = 0 THEN 1 ELSE events_A END)::DOUBLE, 10), 6) AS activity_ratio,
  age * n_categories AS age_x_categories, CAST(n_categories >= 5 AS INTEGER) AS many_categories, CAST(weighted_burden >= 5 AS INTEGER) AS weighted_burden_high, age * weighted_burden AS age_x_weighted_burden FROM f""")
def _(t):
    return rounded(disease.features(t.anch, t.spine, DEMO))


PARAMS = extract.CohortParams("1997-01-01", "2001-01-01", years_before=3, months_before=1, min_obs=5, min_med=3, min_age=30, ratio=1, admin_codes=(7, 11), excluded_types=("A",), excluded_like="%plate%")
_WIN = "event_date >= anchor_date - INTERVAL 36 MONTH AND event_date < anchor_date - INTERVAL 1 MONTH"
_B = "CAST(DATE '1930-06-15' + CAST(entity % 20000 AS INTEGER) AS DATE)"
_OUT = "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%red ring%' OR lower(p_name) LIKE '%red bolt%'"


@query("plan_cohort_extraction", f"""{with_(HIST)}, ob AS (SELECT entity, event_date, code, term, value, status FROM hist WHERE event_type = 'obs'), md AS (SELECT entity, event_date, code, term, value AS duration FROM hist WHERE event_type = 'med'),
gd AS (SELECT * FROM ob WHERE code NOT IN (7, 11) AND status NOT IN ('A') AND lower(term) NOT LIKE '%plate%' AND code NOT IN ({_OUT})),
ex AS (SELECT DISTINCT entity FROM ob WHERE code IN (SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%blue bolt%')),
ca AS (SELECT entity, min(event_date) AS anchor_date FROM ob WHERE code IN (SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%red ring%') AND event_date >= DATE '1997-01-01' AND event_date < DATE '2001-01-01'
  AND date_diff('year', {_B}, event_date) >= 30 AND entity NOT IN (SELECT entity FROM ex) GROUP BY 1),
ct AS (SELECT entity, event_date AS anchor_date FROM (SELECT entity, event_date, row_number() OVER (PARTITION BY entity ORDER BY md5(concat_ws('|', entity, event_date, code)), event_date) AS k FROM gd
  WHERE event_date >= DATE '1997-01-01' AND event_date < DATE '2001-01-01' AND date_diff('year', {_B}, event_date) >= 30 AND entity NOT IN (SELECT entity FROM ob WHERE code IN ({_OUT})) AND entity NOT IN (SELECT entity FROM ex)) WHERE k = 1),
cd AS (SELECT entity, anchor_date, 1 AS label FROM ca UNION ALL SELECT entity, anchor_date, 0 FROM ct),
ro AS (SELECT DISTINCT cd.entity, cd.label, anchor_date, event_date, code, term, value FROM cd JOIN gd USING (entity) WHERE {_WIN}), rm AS (SELECT DISTINCT cd.entity, cd.label, anchor_date, event_date, code, term, duration FROM cd JOIN md USING (entity) WHERE {_WIN}),
el AS (SELECT entity, anchor_date, label, year(anchor_date) AS y FROM cd WHERE entity IN (SELECT entity FROM ro GROUP BY 1 HAVING count(*) >= 5) AND entity IN (SELECT entity FROM rm GROUP BY 1 HAVING count(*) >= 3)),
rk AS (SELECT *, row_number() OVER (PARTITION BY label, y ORDER BY md5(concat_ws('|', entity, 'ncsalt'))) AS k, count(*) FILTER (WHERE label = 1) OVER (PARTITION BY y) AS need FROM el), sp AS (SELECT * FROM rk WHERE label = 1 OR k <= need),
ev AS (SELECT entity, anchor_date, 'observation' AS event_type, event_date, code, term, value, CAST(NULL AS DOUBLE) AS duration FROM ro UNION ALL SELECT entity, anchor_date, 'medication', event_date, code, term, NULL, duration FROM rm)
SELECT ev.entity, sp.label, ev.anchor_date, sp.y AS anchor_year, event_type, event_date, code, term, value, duration, CAST(ev.anchor_date - event_date AS INTEGER) AS days_before,
  date_diff('year', {_B.replace('entity', 'ev.entity')}, ev.anchor_date) AS age_at_anchor, date_diff('year', {_B.replace('entity', 'ev.entity')}, event_date) AS event_age FROM ev JOIN sp ON sp.entity = ev.entity""")
def _(t):
    obs = t.hist.where("event_type = 'obs'").select("entity", "event_date", "code", "term", "value", F.col("status").alias("obs_type"))
    med = t.hist.where("event_type = 'med'").select("entity", "event_date", "code", "term", F.col("value").alias("duration"))
    red = t.part.where("lower(p_name) LIKE '%red ring%' OR lower(p_name) LIKE '%red bolt%'").select(F.col("p_partkey").alias("code"))
    _, events = extract.extract(obs, med, co.target(t), red, co.other(t), co.birth(t), PARAMS)
    return events.withColumn("age_at_anchor", F.col("age_at_anchor").cast("bigint")).withColumn("event_age", F.col("event_age").cast("bigint"))
