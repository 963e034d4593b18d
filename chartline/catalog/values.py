"""L: measurement features; the measurement is the ordered quantity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import values as v
from .base import ANCH, query, r, rounded, with_

AN = with_(ANCH)
K = "entity, category"
FIRST, LAST = "min({'d': event_date, 'v': value}).v", "max({'d': event_date, 'v': value}).v"
X = "CAST(-days_before AS DOUBLE)"


def slope_sql(y="value", x=X, cond="true"):
    return (f"CASE WHEN var_pop({x}) FILTER (WHERE {cond}) > 0 THEN regr_slope({y}, {x}) FILTER (WHERE {cond}) END")


def corr_sql(y="value", x=X):
    return f"CASE WHEN var_pop({x}) > 0 AND var_pop({y}) > 0 THEN corr({y}, {x}) END"


def gaps(t):
    """History with some quantities missing, as a measurement stream."""
    return t.anch.withColumn("value", F.when(F.col("code") % 5 != 0, F.col("value")))


GAPS = f"{ANCH}, m AS (SELECT * REPLACE (CASE WHEN code % 5 <> 0 THEN value END AS value) FROM anch), v AS (SELECT * FROM m WHERE value IS NOT NULL)"
GN = with_(GAPS)


@query("l01_value_stats", f"""{GN} SELECT {K}, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max, round(stddev_samp(value), 6) AS std, count(value) AS count, {FIRST} AS first, {LAST} AS last,
  round(avg(value) FILTER (WHERE time_window = 'A'), 6) AS mean_A, round(avg(value) FILTER (WHERE time_window = 'B'), 6) AS mean_B,
  round(avg(value) FILTER (WHERE time_window = 'B') - avg(value) FILTER (WHERE time_window = 'A'), 6) AS delta,
  round((avg(value) FILTER (WHERE time_window = 'B') - avg(value) FILTER (WHERE time_window = 'A')) / abs(avg(value) FILTER (WHERE time_window = 'A')), 6) AS pct_change FROM v GROUP BY 1, 2""")
def _(t):
    return rounded(v.value_stats(gaps(t)))


@query("l02_ols", f"{GN} SELECT {K}, round({slope_sql()}, 6) AS slope, round({corr_sql()}, 6) AS corr, count(*) AS n FROM v GROUP BY 1, 2")
def _(t):
    return rounded(v.ols(gaps(t)))


@query("l03_trend_r2", f"""{GN} SELECT {K}, round({slope_sql()}, 6) AS slope, round({corr_sql()}, 6) AS corr, count(*) AS n,
  round(CASE WHEN var_pop({X}) > 0 THEN CASE WHEN var_pop(value) > 0 THEN corr(value, {X}) * corr(value, {X}) ELSE 1 END END, 6) AS r2, CAST(sign({slope_sql()}) AS DOUBLE) AS direction FROM v GROUP BY 1, 2""")
def _(t):
    return rounded(v.ols(gaps(t), r2=True))


@query("l04_volatility", f"""{GN}, s AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY {K} ORDER BY event_date, value)) AS step FROM v)
SELECT {K}, count(*) AS n, round(stddev_samp(value) / nullif(avg(value), 0), 6) AS cv, max(value) - min(value) AS range, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, max(step) AS max_step,
  {LAST} - {FIRST} AS first_last_diff FROM s GROUP BY 1, 2""")
def _(t):
    return rounded(v.volatility(gaps(t)))


@query("l05_value_accel", f"""{GN}, h AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY event_date, value) - 1 AS i, count(*) OVER (PARTITION BY {K}) AS n FROM v)
SELECT {K}, round({slope_sql(cond='i >= n / 2.0')} - {slope_sql(cond='i < n / 2.0')}, 6) AS value_accel FROM h WHERE n >= 4 GROUP BY 1, 2""")
def _(t):
    return rounded(v.value_accel(gaps(t)))


@query("l06_missing_flags", f"""{GN} SELECT s.entity, CAST(count(*) FILTER (WHERE category = 'SMALL') > 0 AS INTEGER) AS SMALL_measured, CAST(count(*) FILTER (WHERE category = 'PROMO') > 0 AS INTEGER) AS PROMO_measured,
  CAST(count(*) FILTER (WHERE category = 'SMALL') = 0 AS INTEGER) AS SMALL_missing, CAST(count(*) FILTER (WHERE category = 'PROMO') = 0 AS INTEGER) AS PROMO_missing FROM spine s LEFT JOIN v ON v.entity = s.entity GROUP BY 1""")
def _(t):
    return v.missing_flags(t.spine, gaps(t), ["SMALL", "PROMO"])


@query("l07_worsening_rules", f"""{GN}, s AS (SELECT {K}, {slope_sql()} AS slope, avg(value) AS mean, max(value) AS max, {LAST} AS last, count(*) AS n FROM v GROUP BY 1, 2)
SELECT {K}, CASE category WHEN 'SMALL' THEN coalesce(CAST(slope > 0 AS INTEGER), 0) WHEN 'LARGE' THEN coalesce(CAST(slope < 0 AS INTEGER), 0) WHEN 'PROMO' THEN coalesce(CAST(slope > 0 AND last > mean AND n >= 3 AS INTEGER), 0) END AS worsening FROM s""")
def _(t):
    stats = v.value_stats(gaps(t)).join(v.ols(gaps(t)).select("entity", "category", "slope"), ["entity", "category"])
    rules = {"SMALL": "up", "LARGE": "down", "PROMO": lambda c: (c["slope"] > 0) & (c["last"] > c["mean"]) & (c["count"] >= 3)}
    return v.worsening(stats, rules).select("entity", "category", "worsening")


@query("l08_per_term", f"""{GN}, top AS (SELECT term, count(*) AS rows FROM v GROUP BY 1 ORDER BY rows DESC, term LIMIT 30)
SELECT term, entity, count(*) AS count, round(avg(value), 6) AS mean, {LAST} AS last, round(CASE WHEN max(rows) >= 580 THEN coalesce({slope_sql()}, 0) END, 6) AS slope FROM v JOIN top USING (term) WHERE rows >= 20 GROUP BY 1, 2""")
def _(t):
    return rounded(v.per_term(gaps(t), slope_rows=580))


@query("l09_velocity", f"""{GN}, s AS (SELECT {K}, count(*) AS n, count(*) FILTER (WHERE time_window = 'B') AS nb, CAST(max(event_date) - min(event_date) AS INTEGER) AS d,
  CAST(max(event_date) FILTER (WHERE time_window = 'B') - min(event_date) FILTER (WHERE time_window = 'B') AS INTEGER) AS db, {LAST} - {FIRST} AS diff,
  max({{'d': event_date, 'v': value}}) FILTER (WHERE time_window = 'B').v - min({{'d': event_date, 'v': value}}) FILTER (WHERE time_window = 'B').v AS diffb FROM v GROUP BY 1, 2),
u AS (SELECT {K}, CASE WHEN n >= 2 AND d > 30 THEN diff / d * 365.25::DOUBLE END AS life, CASE WHEN nb >= 2 AND db > 14 THEN diffb / db * 365.25::DOUBLE END AS rec FROM s)
SELECT {K}, round(life, 6) AS life_velocity, round(rec, 6) AS recent_velocity, round(CASE WHEN life IS NOT NULL AND rec IS NOT NULL THEN least(greatest(rec / greatest(abs(life), 0.05), -50), 50) ELSE -50 END, 6) AS velocity_accel,
  CAST(coalesce(rec > 0.75, false) AS INTEGER) AS velocity_high, CAST(coalesce(rec > 2, false) AS INTEGER) AS velocity_very_high FROM u""")
def _(t):
    return rounded(v.velocity(gaps(t)))


@query("l10_doubling_time", f"""{GN}, s AS (SELECT {K}, {slope_sql('ln(value + 0.01::DOUBLE)', '(-days_before / 30.44::DOUBLE)')} AS sl, {FIRST} AS f, {LAST} AS l FROM v GROUP BY 1, 2),
d AS (SELECT {K}, CASE WHEN sl > 0 AND f > 0 AND l > 0 THEN ln(2) / sl END AS m FROM s)
SELECT {K}, round(m, 4) AS doubling_months, coalesce(CAST(m < 24 AS INTEGER), 0) AS fast, coalesce(CAST(m < 12 AS INTEGER), 0) AS very_fast FROM d""")
def _(t):
    out = v.doubling_time(gaps(t))
    return out.withColumn("doubling_months", F.round("doubling_months", 4))


@query("l11_own_zscore", f"""{GN}, z AS (SELECT {K}, count(*) AS n_reads, least(greatest(coalesce(({LAST} - avg(value)) / nullif(stddev_samp(value), 0), 0), -10), 10) AS z FROM v GROUP BY 1, 2)
SELECT {K}, n_reads, round(z, 6) AS z, CAST(z > 1.5 AS INTEGER) AS high, CAST(z > 3 AS INTEGER) AS extreme, CAST(z < -1.5 AS INTEGER) AS low FROM z""")
def _(t):
    return rounded(v.own_z(gaps(t)))


@query("l12_max_jump", f"""{GN}, s AS (SELECT *, lag(value) OVER (PARTITION BY {K} ORDER BY event_date, value) AS p FROM v),
j AS (SELECT {K}, coalesce(max(value - p), 0) AS a, least(greatest(coalesce(max((value - p) / greatest(p, 0.1)), 0), 0), 50) AS b FROM s GROUP BY 1, 2)
SELECT {K}, a AS max_jump, round(b, 6) AS max_rel_jump, CAST(a > 2 AS INTEGER) AS over_2, CAST(a > 5 AS INTEGER) AS over_5, CAST(b > 0.5 AS INTEGER) AS rel_half FROM j""")
def _(t):
    return rounded(v.max_jump(gaps(t)))


_BOUNDS = {"small_high": ("SMALL", "above", 40.0), "large_low": ("LARGE", "below", 10.0)}


def _thr_sql():
    cols = []
    for n, (c, side, lim) in _BOUNDS.items():
        op, ext = (">", "max") if side == "above" else ("<", "min")
        here = f"category = '{c}' AND value IS NOT NULL"
        cols += [f"CAST(count(*) FILTER (WHERE {here} AND value {op} {lim}) > 0 AS INTEGER) AS {n}_ever",
                 f"coalesce(CAST(max({{'d': event_date, 'v': value}}) FILTER (WHERE {here}).v {op} {lim} AS INTEGER), 0) AS {n}_latest",
                 f"count(*) FILTER (WHERE {here} AND value {op} {lim}) AS {n}_count", f"{ext}(value) FILTER (WHERE {here}) AS {n}_extreme"]
    return f"{GN} SELECT entity, {', '.join(cols)} FROM m GROUP BY 1"


@query("l13_threshold_flags", _thr_sql())
def _(t):
    return v.thresholds(gaps(t), _BOUNDS)


@query("l14_ratio_of_latest", f"""{GN}, d AS (SELECT entity, event_date, max(days_before) AS days_before, avg(value) FILTER (WHERE category = 'SMALL') AS n, avg(value) FILTER (WHERE category IN ('LARGE', 'MEDIUM')) AS d,
  max(value) FILTER (WHERE category = 'SMALL') AS ln, max(value) FILTER (WHERE category IN ('LARGE', 'MEDIUM')) AS ld FROM v WHERE category IN ('SMALL', 'LARGE', 'MEDIUM') GROUP BY 1, 2),
q AS (SELECT *, n / nullif(d, 0) AS q FROM d)
SELECT entity, round(max({{'d': event_date, 'v': ln}}) FILTER (WHERE ln IS NOT NULL).v / nullif(max({{'d': event_date, 'v': ld}}) FILTER (WHERE ld IS NOT NULL).v, 0), 6) AS s_over_l,
  round({slope_sql('q', X, 'q IS NOT NULL')}, 6) AS s_over_l_trend FROM q GROUP BY 1""")
def _(t):
    return rounded(v.value_ratio(gaps(t), {"s_over_l": (["SMALL"], ["LARGE", "MEDIUM"])}))


def aged(t):
    return gaps(t).withColumn("event_age", F.col("age") - F.floor(F.col("days_before") / 365.25).cast("int"))


AGED = f"{GAPS}, ag AS (SELECT *, age - CAST(floor(days_before / 365.25) AS INTEGER) AS event_age FROM m)"
SETS = "sets AS (SELECT p_partkey AS code, CASE WHEN p_size <= 15 THEN 'alpha' ELSE 'beta' END AS set_name FROM part WHERE p_size <= 30)"


def sets(t):
    return t.part.where("p_size <= 30").select(F.col("p_partkey").alias("code"), F.when(F.col("p_size") <= 15, "alpha").otherwise("beta").alias("set"))


@query("l15_value_trend_profile", f"""{with_(AGED, SETS)}, j AS (SELECT a.*, set_name FROM ag a JOIN sets USING (code) WHERE value IS NOT NULL),
g AS (SELECT entity, set_name, count(*) AS n_records, min(event_date) AS first_date, max(event_date) AS last_date, {FIRST} AS first, {LAST} AS last, avg(value) AS mean, median(value) AS median, min(value) AS min, max(value) AS max,
  stddev_pop(value) AS std_pop, {slope_sql()} AS slope, {corr_sql()} AS corr, min({{'d': event_date, 'v': event_age}}).v AS first_age, max({{'d': event_date, 'v': event_age}}).v AS last_age,
  array_to_string(list_sort(list(DISTINCT CAST(code AS VARCHAR))), ', ') AS codes, array_to_string(list_sort(list(DISTINCT term))[1:5], ' | ') AS terms FROM j GROUP BY 1, 2)
SELECT entity, set_name AS "set", n_records, first_date, last_date, first, last, round(mean, 6) AS mean, round(median, 6) AS median, min, max, round(std_pop, 6) AS std_pop, round(slope, 6) AS slope, round(corr, 6) AS corr, first_age, last_age, codes, terms,
  last - first AS abs_change, round((last - first) / first * 100, 6) AS pct_change, round(CAST(last_date - first_date AS INTEGER) / 365.25::DOUBLE, 6) AS span_years,
  CASE WHEN n_records < 2 THEN NULL WHEN first_date = last_date THEN CASE WHEN min < max THEN 'Multiple measurements on same date' ELSE 'Stable' END
    WHEN abs(slope) <= 0.0001 THEN 'Stable' WHEN (slope > 0) = (set_name = 'alpha') THEN 'Improving' ELSE 'Declining' END AS direction FROM g""")
def _(t):
    return rounded(v.value_profile(aged(t), sets(t), {"beta": v.lower_is_better}))


@query("l16_dose_max", f"""{GN} SELECT entity, max(value) FILTER (WHERE brand IN ('Brand#1', 'Brand#2')) AS pack_years, max(value) FILTER (WHERE brand = 'Brand#3') AS per_day FROM m GROUP BY 1""")
def _(t):
    return v.dose_max(gaps(t), {"pack_years": ["Brand#1", "Brand#2"], "per_day": ["Brand#3"]}, on="brand")


_LAT = f"lat AS (SELECT {K}, {LAST} AS latest FROM v GROUP BY 1, 2), lb AS (SELECT l.*, CAST(floor(s.age / 10) * 10 AS INTEGER) AS band FROM lat l JOIN spine s USING (entity))"


def latest(t):
    band = (F.floor(F.col("age") / 10) * 10).cast("int")
    return v.latest_values(gaps(t)).join(t.spine.select("entity", band.alias("band")), "entity")


@query("l17_percentile_vs_reference", f"""{with_(GAPS, _LAT)}, ref AS (SELECT * FROM lb WHERE entity % 4 <> 0 AND NOT (band = 80 AND entity % 3 <> 0)), q AS (SELECT * FROM lb WHERE entity % 4 = 0)
SELECT q.entity, q.category, q.band, q.latest, round(avg(CAST(ref.latest < q.latest AS INTEGER)), 6) AS pctl,
  round(CASE WHEN count(*) FILTER (WHERE ref.band = q.band) >= 170 THEN avg(CAST(ref.latest < q.latest AS INTEGER)) FILTER (WHERE ref.band = q.band) ELSE avg(CAST(ref.latest < q.latest AS INTEGER)) END, 6) AS band_pctl
FROM q JOIN ref ON ref.category = q.category GROUP BY 1, 2, 3, 4""")
def _(t):
    lv = latest(t)
    ref = lv.where("entity % 4 <> 0 AND NOT (band = 80 AND entity % 3 <> 0)")
    return rounded(v.apply_pctl(lv.where("entity % 4 = 0"), ref, min_band=170))


@query("l18_cohort_percentile", f"""{with_(GAPS, _LAT)}, r AS (SELECT *, (rank() OVER (PARTITION BY category ORDER BY latest) + (count(*) OVER (PARTITION BY category, latest) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY category) AS p,
  (rank() OVER (PARTITION BY category, band ORDER BY latest) + (count(*) OVER (PARTITION BY category, band, latest) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY category, band) AS b FROM lb)
SELECT entity, category, band, latest, round(p, 6) AS pctl, CAST(p >= 0.95::DOUBLE AS INTEGER) AS pctl_top5, CAST(p >= 0.9::DOUBLE AS INTEGER) AS pctl_top10, CAST(p >= 0.75::DOUBLE AS INTEGER) AS pctl_top25,
  round(b, 6) AS band_pctl, CAST(b >= 0.95::DOUBLE AS INTEGER) AS band_pctl_top5, CAST(b >= 0.9::DOUBLE AS INTEGER) AS band_pctl_top10, CAST(b >= 0.75::DOUBLE AS INTEGER) AS band_pctl_top25 FROM r""")
def _(t):
    return rounded(v.pctl_rank(v.pctl_rank(latest(t)), by=("category", "band"), name="band_pctl"))


@query("l19_code_zscores", f"""{GN}, st AS (SELECT code, avg(value) AS mean, stddev_samp(value) AS std FROM v WHERE entity % 5 <> 0 GROUP BY 1)
SELECT entity, event_date, code, line, round((value - mean) / nullif(std, 0), 6) AS value FROM m LEFT JOIN st USING (code)""")
def _(t):
    ev = gaps(t).select("entity", "event_date", "code", "line", "value")
    return rounded(v.apply_code_z(ev, v.fit_code_z(ev.where("entity % 5 <> 0"))).select("entity", "event_date", "code", "line", "value"))


@query("l20_value_bearing", f"""{AN} SELECT code, count(*) AS n, count(value) FILTER (WHERE value > 40) AS n_value FROM anch GROUP BY 1 HAVING count(value) FILTER (WHERE value > 40) >= 0.1 * count(*) AND count(value) FILTER (WHERE value > 40) > 0""")
def _(t):
    return v.value_codes(t.anch.withColumn("value", F.when(F.col("value") > 40, F.col("value"))))


DERANGE = f"""own AS (SELECT *, (days_before - min(days_before) OVER (PARTITION BY entity)) / 30.44::DOUBLE AS mo FROM m),
hf AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY event_date) - 1 AS i, count(*) OVER (PARTITION BY {K}) AS n FROM own),
oc AS (SELECT {K}, count(*) FILTER (WHERE mo >= 0 AND mo < 6) - 2 * count(*) FILTER (WHERE mo >= 6 AND mo < 18) + count(*) FILTER (WHERE mo >= 18 AND mo < 42) AS accel,
  CASE WHEN max(n) >= 2 THEN coalesce(CAST(count(*) FILTER (WHERE i >= n / 2.0) / nullif(CAST(max(event_date) FILTER (WHERE i >= n / 2.0) - min(event_date) FILTER (WHERE i >= n / 2.0) AS INTEGER) / 365.25::DOUBLE, 0)
    > 1.1::DOUBLE * (count(*) FILTER (WHERE i < n / 2.0) / nullif(CAST(max(event_date) FILTER (WHERE i < n / 2.0) - min(event_date) FILTER (WHERE i < n / 2.0) AS INTEGER) / 365.25::DOUBLE, 0)) AS INTEGER), 0) END AS w FROM hf GROUP BY 1, 2)"""


@query("l21_derangement", f"""{with_(GAPS, DERANGE)}, z AS (SELECT {K}, ({LAST} - avg(value)) / nullif(stddev_samp(value), 0) AS z, {slope_sql()} AS s FROM v GROUP BY 1, 2),
a AS (SELECT entity, count(*) FILTER (WHERE abs(z) >= 1.5) AS n_extreme, round(avg(abs(z)), 6) AS mean_abs_z, count(*) FILTER (WHERE s > 0) AS n_rising, count(*) FILTER (WHERE accel > 0) AS n_accelerating, count(*) FILTER (WHERE w = 1) AS n_worsening
  FROM oc LEFT JOIN z USING (entity, category) GROUP BY 1),
b AS (SELECT entity, count(*) FILTER (WHERE mo >= 0 AND mo < 12) AS events_w0_12, count(*) FILTER (WHERE mo >= 12 AND mo < 36) AS events_w12_36, count(DISTINCT event_date) FILTER (WHERE mo >= 0 AND mo < 12) AS consults_w0_12,
  count(DISTINCT event_date) FILTER (WHERE mo >= 12 AND mo < 36) AS consults_w12_36, count(DISTINCT code) FILTER (WHERE mo < 6) AS distinct_last6, count(DISTINCT code) FILTER (WHERE mo < 12) AS distinct_last12 FROM own GROUP BY 1)
SELECT * FROM a JOIN b USING (entity)""")
def _(t):
    ev = gaps(t)
    return rounded(v.derangement(ev, extreme=1.5).join(v.activity_bands(ev, [(0, 12), (12, 36)]), "entity"))


@query("l22_co_elevation", f"""{GN}, f AS (SELECT entity, CAST(coalesce(max(value) FILTER (WHERE category = 'SMALL') > 40, false) AS INTEGER) AS s, CAST(coalesce(min(value) FILTER (WHERE category = 'LARGE') < 10, false) AS INTEGER) AS l FROM m GROUP BY 1)
SELECT entity, s * l AS both, s + l AS flag_score FROM f""")
def _(t):
    out = v.co_elevation(v.thresholds(gaps(t), _BOUNDS), {"both": ["small_high_ever", "large_low_ever"]}, ["small_high_ever", "large_low_ever"])
    return out.select("entity", "both", "flag_score")
