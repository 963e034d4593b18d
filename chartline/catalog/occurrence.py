"""B: occurrence, interval and band features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemble, occurrence as o, timeline as tl, values as v
from .base import ANCH, TYPES, query, r, rounded, with_
from .values import AGED, DERANGE, FIRST, GAPS, K, LAST, SETS, X, aged, gaps, sets, slope_sql

AN = with_(ANCH)


def own(cte="anch"):
    return f"own AS (SELECT *, (days_before - min(days_before) OVER (PARTITION BY entity)) / 30.44::DOUBLE AS mo FROM {cte})"


def steps_sql(src, keys, order="event_date"):
    """Row-level positions, gaps and halves, the slow way."""
    return f"""st AS (SELECT *, CAST(event_date - lag(event_date) OVER w AS INTEGER) AS iv, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY {order}))"""


def half_freq(cond):
    return f"count(*) FILTER (WHERE {cond}) / nullif(CAST(max(event_date) FILTER (WHERE {cond}) - min(event_date) FILTER (WHERE {cond}) AS INTEGER) / 365.25::DOUBLE, 0)"


IV = """round(median(iv), 6) AS interval_median, min(iv) AS interval_min, max(iv) AS interval_max"""
ISLOPE = "CASE WHEN max(n) >= 3 THEN regr_slope(iv, i::DOUBLE) FILTER (WHERE iv IS NOT NULL) END"


@query("b01_occurrence", f"""{with_(ANCH, own(), steps_sql('own', K))}
SELECT {K}, count(*) AS count, round(min(mo), 6) AS recency, round(max(mo), 6) AS onset, round(sum(exp(-mo / 12)), 6) AS decay,
  count(*) FILTER (WHERE mo >= 0 AND mo < 6) - 2 * count(*) FILTER (WHERE mo >= 6 AND mo < 18) + count(*) FILTER (WHERE mo >= 18 AND mo < 42) AS accel, round(avg(CAST(mo <= 24 AS INTEGER)), 6) AS recent_ratio,
  round(CAST(max(event_date) - min(event_date) AS INTEGER) / 365.25::DOUBLE, 6) AS span_years, round(count(*) / nullif(CAST(max(event_date) - min(event_date) AS INTEGER) / 365.25::DOUBLE, 0), 6) AS freq_per_year,
  {IV}, round(-{ISLOPE}, 6) AS interval_slope, CASE WHEN max(n) >= 2 THEN round({half_freq('i < n / 2.0')}, 6) END AS first_half_freq, CASE WHEN max(n) >= 2 THEN round({half_freq('i >= n / 2.0')}, 6) END AS second_half_freq,
  CASE WHEN max(n) >= 2 THEN coalesce(CAST({half_freq('i >= n / 2.0')} > 1.1::DOUBLE * ({half_freq('i < n / 2.0')}) AS INTEGER), 0) END AS is_worsening FROM st GROUP BY 1, 2""")
def _(t):
    return rounded(o.occurrence(t.anch))


@query("b02_chronicity", f"""{with_(ANCH, own())}, c AS (SELECT {K}, min(mo) AS lo, max(mo) AS hi,
  count(*) FILTER (WHERE mo >= 0 AND mo < 6) - 2 * count(*) FILTER (WHERE mo >= 6 AND mo < 18) + count(*) FILTER (WHERE mo >= 18 AND mo < 42) AS accel FROM own GROUP BY 1, 2)
SELECT {K}, CAST(hi <= 18 AS INTEGER) AS new_onset, CAST(hi >= 36 AND NOT lo <= 12 AS INTEGER) AS chronic_stable, CAST(hi >= 36 AND lo <= 12 AND accel > 0 AS INTEGER) AS escalating_chronic FROM c""")
def _(t):
    return o.chronicity(o.occurrence(t.anch)).select("entity", "category", "new_onset", "chronic_stable", "escalating_chronic")


@query("b03_halves", f"""{with_(ANCH, steps_sql('anch', K))} SELECT {K}, round({half_freq('i < n / 2.0')}, 6) AS first_half_freq, round({half_freq('i >= n / 2.0')}, 6) AS second_half_freq,
  coalesce(CAST({half_freq('i >= n / 2.0')} > 1.1::DOUBLE * ({half_freq('i < n / 2.0')}) AS INTEGER), 0) AS is_worsening FROM st WHERE n >= 2 GROUP BY 1, 2""")
def _(t):
    return rounded(o.halves(t.anch))


@query("b04_interval_stats", f"""{with_(ANCH, steps_sql('anch', K))} SELECT {K}, count(*) AS n, CAST(max(event_date) - min(event_date) AS INTEGER) AS span_days,
  round(coalesce(avg(iv), -1), 6) AS interval_mean, round(coalesce({ISLOPE}, 0), 6) AS interval_slope FROM st GROUP BY 1, 2""")
def _(t):
    return rounded(o.interval_stats(t.anch))


@query("b05_half_window_split", f"""{AN}, top AS (SELECT category, max(months_before) / 2.0 AS half FROM anch GROUP BY 1), h AS (SELECT entity, category, count(*) FILTER (WHERE months_before > half) AS h1, count(*) FILTER (WHERE months_before <= half) AS h2
  FROM anch JOIN top USING (category) GROUP BY 1, 2) SELECT *, round(h2 / greatest(h1, 1)::DOUBLE, 6) AS h2_over_h1, h2 - h1 AS h2_minus_h1, CAST(h2 > h1 AS INTEGER) AS is_worsening FROM h""")
def _(t):
    return rounded(o.half_window(t.anch))


_G = {"size": ["SMALL", "LARGE", "MEDIUM"], "deal": ["PROMO", "ECONOMY"]}
GRP = "grp AS (SELECT *, CASE WHEN category IN ('SMALL', 'LARGE', 'MEDIUM') THEN 'size' WHEN category IN ('PROMO', 'ECONOMY') THEN 'deal' END AS g FROM own)"
ACC_R = "count(*) FILTER (WHERE mo <= 6) - 2 * count(*) FILTER (WHERE mo > 6 AND mo <= 18) + count(*) FILTER (WHERE mo > 18 AND mo <= 42)"


@query("b06_symptom_dynamics", f"""{with_(ANCH, own(), GRP)}, d AS (SELECT entity, g, min(days_before) / 30.44::DOUBLE AS rec, max(days_before) / 30.44::DOUBLE AS fst, sum(exp(-mo / 12)) AS dec, {ACC_R} AS acc, avg(CAST(mo <= 24 AS INTEGER)) AS rr, min(mo) AS lo
  FROM grp WHERE g IS NOT NULL GROUP BY 1, 2), b AS (SELECT entity, count(*) AS burden, count(*) FILTER (WHERE lo <= 6) AS burden_6, count(*) FILTER (WHERE lo <= 12) AS burden_12 FROM d GROUP BY 1)
SELECT entity, g AS "group", round(rec, 6) AS recency_months, round(fst, 6) AS first_months, round(fst - rec, 6) AS span_months, round(dec, 6) AS decay, acc AS accel, round(rr, 6) AS recent_ratio, burden, burden_6, burden_12 FROM d JOIN b USING (entity)""")
def _(t):
    d = o.dynamics(t.anch, _G)
    out = d.join(o.symptom_burden(d), "entity")
    return rounded(out.select("entity", "group", "recency_months", "first_months", "span_months", "decay", "accel", "recent_ratio", "burden", "burden_6", "burden_12"))


def profile_sql(keys, agg_extra=""):
    f1, f2 = half_freq("i < n // 2"), half_freq("i >= n // 2")
    return f"""pr AS (SELECT {keys}, count(*) AS n, min(event_date) AS first_date, max(event_date) AS last_date, CAST(max(event_date) - min(event_date) AS INTEGER) AS span_days, avg(iv) AS im, median(iv) AS imed, min(iv) AS imin, max(iv) AS imax,
  {ISLOPE} AS sl, {f1} AS f1, {f2} AS f2 {agg_extra} FROM st GROUP BY {keys}),
pf AS (SELECT * REPLACE (CASE WHEN f1 IS NOT NULL AND f2 IS NOT NULL THEN f1 END AS f1, CASE WHEN f1 IS NOT NULL AND f2 IS NOT NULL THEN f2 END AS f2) FROM pr)"""


PROF_COLS = """n, first_date, last_date, span_days, round(CASE WHEN span_days > 0 THEN n / (span_days / 365.25::DOUBLE) END, 6) AS freq_per_year, round(im, 6) AS interval_mean, round(imed, 6) AS interval_median, imin AS interval_min, imax AS interval_max,
  round(sl, 6) AS interval_slope, CASE WHEN n <= 1 THEN 'Single occurrence' WHEN n < 3 THEN NULL WHEN round(sl, 9) < -1 THEN 'Increasing frequency (worsening)' WHEN round(sl, 9) > 1 THEN 'Decreasing frequency (improving)' ELSE 'Stable frequency' END AS trend,
  round(f1, 6) AS first_half_freq, round(f2, 6) AS second_half_freq, CAST(coalesce(n >= 3 AND round(sl, 9) < -1, false) OR coalesce(f2 > 1.1::DOUBLE * f1, false) AS INTEGER) AS is_worsening"""


@query("b07_occurrence_profile", f"""{with_(AGED, SETS)}, js AS (SELECT a.*, set_name FROM ag a JOIN sets USING (code)), {steps_sql('js', 'entity, set_name')},
{profile_sql('entity, set_name', ", min({'d': event_date, 'v': event_age}).v AS first_age, max({'d': event_date, 'v': event_age}).v AS last_age, array_to_string(list_sort(list(DISTINCT CAST(code AS VARCHAR))), ', ') AS codes, array_to_string(list_sort(list(DISTINCT term))[1:5], ' | ') AS terms")}
SELECT entity, set_name AS "set", {PROF_COLS}, first_age, last_age, codes, terms FROM pf""")
def _(t):
    return rounded(o.occ_profile(aged(t), sets(t)))


@query("b08_visit_profile", f"""{with_(ANCH)}, dd AS (SELECT DISTINCT entity, event_date FROM anch), {steps_sql('dd', 'entity')}, {profile_sql('entity')} SELECT entity, {PROF_COLS} FROM pf""")
def _(t):
    return rounded(o.visit_profile(t.anch))


@query("b09_last_n_months", f"""{AN}, cut AS (SELECT entity, max(event_date) - INTERVAL 24 MONTH AS c FROM anch GROUP BY 1), l AS (SELECT entity, count(*) AS n, round(avg(value), 6) AS mean FROM anch GROUP BY 1),
w AS (SELECT entity, count(*) AS n, round(avg(value), 6) AS mean FROM anch JOIN cut USING (entity) WHERE event_date >= c GROUP BY 1)
SELECT l.entity, l.n, l.mean, w.n AS n_last_24m, w.mean AS mean_last_24m FROM l LEFT JOIN w USING (entity)""")
def _(t):
    def agg(df):
        return df.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value"), "mean"))
    return o.suffix_merge(agg(t.anch), agg(tl.last_months(t.anch, 24)), 24)


_BANDS = [(0, 6), (6, 12), (12, 24), (24, 60), (60, 999)]
_BCASE = "CASE " + " ".join(f"WHEN mo >= {a} AND mo < {b} THEN 'w{a}_{b}'" for a, b in _BANDS) + " END"


@query("b10_bands", f"""{with_(GAPS, own('m'))} SELECT {K}, band, count(*) AS count, round(avg(value), 6) AS value_mean, max({{'d': event_date, 'v': value}}) FILTER (WHERE value IS NOT NULL).v AS value_latest,
  round({slope_sql(cond='value IS NOT NULL')}, 6) AS value_slope FROM (SELECT *, {_BCASE} AS band FROM own) GROUP BY 1, 2, 3""")
def _(t):
    return rounded(o.bands(gaps(t), _BANDS))


def _cum(ns):
    return ", ".join(f"count(*) FILTER (WHERE mo < {n}) AS count_last{n}, round(avg(value) FILTER (WHERE mo < {n}), 6) AS mean_last{n}, max({{'d': event_date, 'v': value}}) FILTER (WHERE mo < {n} AND value IS NOT NULL).v AS latest_last{n}" for n in ns)


@query("b11_cumulative", f"{with_(GAPS, own('m'))} SELECT {K}, {_cum([6, 12, 24, 60])} FROM own GROUP BY 1, 2")
def _(t):
    return rounded(o.cumulative(gaps(t), [6, 12, 24, 60]))


@query("b12_med_dynamics", f"""{ANCH and with_(ANCH)}, md AS (SELECT * FROM anch WHERE event_type = 'med'), {own('md')}, {GRP}
SELECT entity, g AS "group", count(*) AS count, round(min(days_before) / 30.44::DOUBLE, 6) AS recency_months, round(avg(CAST(mo <= 24 AS INTEGER)), 6) AS recent_ratio, count(*) FILTER (WHERE mo >= 0 AND mo < 6) AS w0_6,
  count(*) FILTER (WHERE mo >= 6 AND mo < 18) AS w6_18, count(*) FILTER (WHERE mo < 12) AS last12 FROM grp WHERE g IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return rounded(o.med_dynamics(t.anch.where("event_type = 'med'"), _G, [(0, 6), (6, 18)], [12]))


@query("b13_consultations", f"""{with_(ANCH)}, dd AS (SELECT DISTINCT entity, event_date, days_before FROM anch), {own('dd')}
SELECT entity, count(*) AS consults, round(min(days_before) / 30.44::DOUBLE, 6) AS recency_months, {ACC_R} AS accel, round(avg(CAST(mo <= 24 AS INTEGER)), 6) AS recent_rate FROM own GROUP BY 1""")
def _(t):
    return rounded(o.consultations(t.anch))


_PROB = "pb AS (SELECT entity, category, CASE status WHEN 'A' THEN ' Active Problem' WHEN 'R' THEN 'Past Problem' END AS status, CASE WHEN line % 3 = 0 THEN 'Significant Problem' ELSE 'Minor Problem' END AS significance FROM anch)"


@query("b14_problem_flags", f"""{with_(ANCH, _PROB)}, p AS (SELECT *, lower(trim(status)) = 'active problem' AS act, lower(trim(significance)) = 'significant problem' AS sig FROM pb),
f AS (SELECT entity, CAST(count(*) FILTER (WHERE category = 'SMALL' AND act) > 0 AS INTEGER) AS SMALL_active, CAST(count(*) FILTER (WHERE category = 'SMALL' AND sig) > 0 AS INTEGER) AS SMALL_significant,
  CAST(count(*) FILTER (WHERE category = 'PROMO' AND act) > 0 AS INTEGER) AS PROMO_active, CAST(count(*) FILTER (WHERE category = 'PROMO' AND sig) > 0 AS INTEGER) AS PROMO_significant,
  count(*) FILTER (WHERE act AND sig AND category IN ('SMALL', 'PROMO')) AS n_active_significant FROM p GROUP BY 1) SELECT *, SMALL_significant + PROMO_significant AS significant_burden FROM f""")
def _(t):
    pb = t.anch.select("entity", "category", F.when(F.col("status") == "A", " Active Problem").when(F.col("status") == "R", "Past Problem").alias("status"),
                       F.when(F.col("line") % 3 == 0, "Significant Problem").otherwise("Minor Problem").alias("significance"))
    return o.problem_flags(pb, ["SMALL", "PROMO"])


@query("b15_age_at_event", f"""{with_(AGED)} SELECT {K}, min({{'d': event_date, 'v': event_age}}).v AS age_first, max({{'d': event_date, 'v': event_age}}).v AS age_last, round(median(event_age), 6) AS age_median, min(event_age) AS age_min, max(event_age) AS age_max,
  round(avg(event_age), 6) AS age_mean, max(event_age) - min(event_age) AS age_span FROM ag GROUP BY 1, 2""")
def _(t):
    return rounded(o.event_ages(aged(t)))


@query("b16_redflag_burden", f"""{with_(ANCH)}, rf AS (SELECT * FROM anch WHERE brand IN ('Brand#1', 'Brand#5', 'Brand#9', 'Brand#13')), {own('rf')}
SELECT entity, count(DISTINCT brand) AS n_distinct, count(*) AS n_events, count(DISTINCT brand) FILTER (WHERE mo <= 6) AS recent6, count(DISTINCT brand) FILTER (WHERE mo <= 12) AS recent12, round(sum(exp(-mo / 12)), 6) AS decay,
  count(*) FILTER (WHERE mo >= 0 AND mo < 6) - 2 * count(*) FILTER (WHERE mo >= 6 AND mo < 18) + count(*) FILTER (WHERE mo >= 18 AND mo < 42) AS accel, 1 AS present FROM own GROUP BY 1""")
def _(t):
    return rounded(o.burden(t.anch, ["Brand#1", "Brand#5", "Brand#9", "Brand#13"], by="brand"))


@query("b17_category_structure", f"""{with_(GAPS)}, st AS (SELECT code, avg(value) AS mean, stddev_samp(value) AS std FROM v GROUP BY 1), z AS (SELECT m.*, (value - mean) / nullif(std, 0) AS zz FROM m LEFT JOIN st USING (code)),
c AS (SELECT {K}, count(*) AS n, count(DISTINCT code) AS n_codes, max(days_before) / 30.44::DOUBLE AS fm, count(*) FILTER (WHERE abs(zz) >= 1.5) AS n_extreme, max(abs(zz)) AS mz FROM z GROUP BY 1, 2)
SELECT {K}, n_codes, round(n_codes / n::DOUBLE, 6) AS code_ratio, round(n / (sum(n) OVER (PARTITION BY entity))::DOUBLE, 6) AS share, round(fm, 6) AS first_months, n_extreme, round(mz, 6) AS max_abs_z, count(*) OVER (PARTITION BY entity) AS n_categories FROM c""")
def _(t):
    ev = gaps(t)
    return rounded(o.structure(v.apply_code_z(ev, v.fit_code_z(ev)), 1.5))


def _cross_sql():
    cats = ["LARGE", "PROMO", "SMALL"]
    base = ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS n_{c}, min(event_date) FILTER (WHERE category = '{c}') AS d_{c}" for c in cats)
    out = []
    for i, a in enumerate(cats):
        for b in cats[i + 1:]:
            both = f"n_{a} > 0 AND n_{b} > 0"
            out += [f"CAST({both} AS INTEGER) AS cooc_{a}__{b}", f"least(n_{a}, n_{b}) AS strength_{a}__{b}",
                    f"coalesce(CAST({both} AND d_{a} < d_{b} AS INTEGER), 0) AS seq_{a}__{b}", f"coalesce(CAST({both} AND d_{b} < d_{a} AS INTEGER), 0) AS seq_{b}__{a}"]
    return f"{AN}, c AS (SELECT entity, {base} FROM anch WHERE category IN ('LARGE', 'PROMO', 'SMALL') GROUP BY 1) SELECT entity, {', '.join(out)} FROM c"


@query("b18_cross_category", _cross_sql())
def _(t):
    return o.cross(t.anch, ["LARGE", "PROMO", "SMALL"])


@query("b19_category_x_age", f"""{AN} SELECT entity, count(*) FILTER (WHERE category = 'LARGE') * max(age) AS LARGE_x_age, count(*) FILTER (WHERE category = 'SMALL') * max(age) AS SMALL_x_age FROM anch WHERE category IN ('LARGE', 'SMALL') GROUP BY 1""")
def _(t):
    return o.category_x_age(t.anch, t.spine, ["LARGE", "SMALL"])


@query("b20_category_temporal", f"""{AN}, c AS (SELECT {K}, min(days_before) / 30.44::DOUBLE AS mo FROM anch GROUP BY 1, 2)
SELECT {K}, round(mo, 6) AS months, rank() OVER (PARTITION BY entity ORDER BY mo) AS recency_rank, round(min(mo) OVER (PARTITION BY entity), 6) AS last_months, round(max(mo) OVER (PARTITION BY entity) - min(mo) OVER (PARTITION BY entity), 6) AS span_months,
  count(*) FILTER (WHERE mo <= 6) OVER (PARTITION BY entity) AS n_6, count(*) FILTER (WHERE mo <= 12) OVER (PARTITION BY entity) AS n_12 FROM c""")
def _(t):
    tall, per = o.category_temporal(t.anch)
    return rounded(tall.join(per, "entity").withColumn("recency_rank", F.col("recency_rank").cast("bigint")))


_AS = "asr AS (SELECT entity, category, event_date, CASE line % 4 WHEN 0 THEN 'present' WHEN 1 THEN NULL WHEN 2 THEN 'absent' ELSE 'family' END AS assertion, CASE WHEN code % 2 = 0 THEN value END AS duration, line % 3 + 1 AS frequency FROM anch)"


@query("b21_assertion_features", f"""{with_(ANCH, _AS)}, p AS (SELECT *, coalesce(assertion, '') IN ('present', 'historical', '') AS pos FROM asr)
SELECT {K}, count(*) FILTER (WHERE assertion = 'absent') AS absent_count, count(*) FILTER (WHERE assertion = 'family') AS family_count, round(avg(duration) FILTER (WHERE pos), 6) AS duration_mean, max(duration) FILTER (WHERE pos) AS duration_max,
  max({{'d': event_date, 'v': duration}}) FILTER (WHERE pos AND duration IS NOT NULL).v AS duration_last, round(avg(frequency) FILTER (WHERE pos), 6) AS frequency_mean, max(frequency) FILTER (WHERE pos) AS frequency_max,
  max({{'d': event_date, 'v': frequency}}) FILTER (WHERE pos AND frequency IS NOT NULL).v AS frequency_last, CAST(count(*) FILTER (WHERE assertion = 'absent') > 0 AS INTEGER) AS absent_present, CAST(count(*) FILTER (WHERE assertion = 'family') > 0 AS INTEGER) AS family_present FROM p GROUP BY 1, 2""")
def _(t):
    k = F.col("line") % 4
    ev = t.anch.select("entity", "category", "event_date", F.when(k == 0, "present").when(k == 2, "absent").when(k == 3, "family").alias("assertion"),
                       F.when(F.col("code") % 2 == 0, F.col("value")).alias("duration"), (F.col("line") % 3 + 1).alias("frequency"))
    return rounded(o.assertions(ev))


@query("b22_month_zero", f"""{with_(ANCH)}, z AS (SELECT min(days_before) / 30.44::DOUBLE AS z FROM anch WHERE entity % 5 <> 0)
SELECT entity, round(min(days_before / 30.44::DOUBLE - z), 6) AS fitted_lo, round(min(days_before / 30.44::DOUBLE) - min(days_before) / 30.44::DOUBLE, 6) AS own_lo, round(max(days_before) / 30.44::DOUBLE - min(days_before) / 30.44::DOUBLE, 6) AS own_hi FROM anch, z GROUP BY entity""")
def _(t):
    zero = o.fit_zero(t.anch.where("entity % 5 <> 0"))
    a = o.with_zero(t.anch, zero).groupBy("entity").agg(r(F.min("mo"), "fitted_lo"))
    b = o.with_zero(t.anch).groupBy("entity").agg(r(F.min("mo"), "own_lo"), r(F.max("mo"), "own_hi"))
    return a.join(b, "entity")


@query("b23_fill_policy", f"""{with_(GAPS)}, a AS (SELECT entity, count(*) FILTER (WHERE category = 'SMALL') AS n, CAST(max(anchor_date) - max(event_date) FILTER (WHERE category = 'SMALL') AS INTEGER) AS since, avg(value) FILTER (WHERE category = 'SMALL') AS level FROM m GROUP BY 1)
SELECT s.entity, coalesce(n, 0) AS n, coalesce(since, -1) AS since, round(level, 6) AS level FROM spine s LEFT JOIN a USING (entity)""")
def _(t):
    s = F.col("category") == "SMALL"
    a = gaps(t).groupBy("entity").agg(F.count_if(s).alias("n"), F.date_diff(F.max("anchor_date"), F.max(F.when(s, F.col("event_date")))).alias("since"), F.avg(F.when(s, F.col("value"))).alias("level"))
    out = t.spine.select("entity").join(a, "entity", "left")
    return rounded(assemble.fill_policy(out, {"zero": ["n"], "minus_one": ["since"], "level": ["level"]}))


_LONG = "lg AS (SELECT entity, category || '_count' AS feature, CAST(count(*) AS DOUBLE) AS value FROM anch GROUP BY 1, 2 UNION ALL SELECT entity, category || '_last', max({'d': event_date, 'v': value}).v FROM anch GROUP BY 1, category UNION ALL SELECT entity, 'age', CAST(max(age) AS DOUBLE) FROM anch GROUP BY 1)"


def long_features(t):
    tall = t.anch.groupBy("entity", "category").agg(F.count(F.lit(1)).alias("count"), v.last_value().alias("last"))
    one = t.anch.groupBy("entity").agg(F.max("age").alias("age"))
    return assemble.union_long(assemble.to_long(tall, ["entity"], ["count", "last"], F.col("category")), assemble.to_long(one, ["entity"], ["age"]))


@query("b24_prune_families", f"{with_(ANCH, _LONG)} SELECT * FROM lg WHERE feature NOT LIKE 'PROMO%' AND feature NOT LIKE '%\\_last' ESCAPE '\\' AND feature <> 'age'")
def _(t):
    return assemble.prune(long_features(t), drop_prefix=["PROMO"], drop_suffix=["_last"], drop=["age"])


@query("b25_keep_features", f"""{with_(ANCH, _LONG)} SELECT s.entity, max(value) FILTER (WHERE feature = 'SMALL_count') AS SMALL_count, max(value) FILTER (WHERE feature = 'LARGE_last') AS LARGE_last, max(value) FILTER (WHERE feature = 'age') AS age,
  CAST(NULL AS DOUBLE) AS unseen FROM spine s LEFT JOIN lg ON lg.entity = s.entity GROUP BY 1""")
def _(t):
    return assemble.widen(long_features(t), ["SMALL_count", "LARGE_last", "age", "unseen"], t.spine.select("entity"))
