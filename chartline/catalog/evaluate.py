"""V: evaluation and audit; orders carry a reproducible pseudo-score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as x
from ..operators import evaluate as e, resample
from . import learn
from .base import ANCH, PRED, SPINE, query, r, rounded, with_
from .hygiene import FEATS, features

PR = with_(PRED)
THR = 0.55


def rates_sql(tp="tp", fp="fp", fn="fn", tn="tn"):
    return (f"round({tp} / nullif({tp} + {fn}, 0)::DOUBLE, 6) AS sensitivity, round({tn} / nullif({tn} + {fp}, 0)::DOUBLE, 6) AS specificity, round({tp} / nullif({tp} + {fp}, 0)::DOUBLE, 6) AS ppv, "
            f"round({tn} / nullif({tn} + {fn}, 0)::DOUBLE, 6) AS npv, round(({tp} + {fn}) / nullif({tp} + {fp} + {fn} + {tn}, 0)::DOUBLE, 6) AS prevalence, "
            f"round(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0)::DOUBLE, 6) AS f1, round(5 * {tp} / nullif(5 * {tp} + 4 * {fn} + {fp}, 0)::DOUBLE, 6) AS f2")


def cells_sql(thr=THR):
    t = f"{thr}::DOUBLE" if not isinstance(thr, str) else thr
    return (f"count(*) FILTER (WHERE score >= {t} AND label = 1) AS tp, count(*) FILTER (WHERE score >= {t} AND label = 0) AS fp, "
            f"count(*) FILTER (WHERE score < {t} AND label = 1) AS fn, count(*) FILTER (WHERE score < {t} AND label = 0) AS tn")


def auc_sql(src, by):
    """Rank-sum AUROC and average precision per group, on rows."""
    keys = by + ", " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""ar AS (SELECT {keys}label, score, rank() OVER ({part} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}score) - 1) / 2.0::DOUBLE AS rk,
  sum(label) OVER ({part} ORDER BY score DESC) AS ctp, count(*) OVER ({part} ORDER BY score DESC) AS cn FROM {src}),
au AS (SELECT {keys}CAST(sum(label) AS BIGINT) AS n_pos, CAST(count(*) - sum(label) AS BIGINT) AS n_neg, (sum(rk * label) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / nullif(sum(label) * (count(*) - sum(label)), 0) AS auroc,
  sum(label * ctp / cn::DOUBLE) / nullif(sum(label), 0) AS auprc FROM ar {grp})"""


@query("v01_confusion_metrics", f"{PR}, c AS (SELECT grp, {cells_sql()} FROM pred GROUP BY 1) SELECT grp, tp, fp, fn, tn, {rates_sql()} FROM c")
def _(t):
    return rounded(e.confusion(t.pred, THR, ["grp"]))


@query("v02_auroc_auprc", f"{with_(PRED, auc_sql('pred', 'grp'))} SELECT grp, n_pos, n_neg, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM au")
def _(t):
    return rounded(e.auroc_auprc(t.pred, ["grp"]))


_CUTS = " ".join(f"WHEN u < {c!r} THEN {i}" for i, c in enumerate(resample.POISSON))


@query("v03_bootstrap_ci", f"""{PR}, dr AS (SELECT unnest(range(-1, 1000)) AS draw), u AS (SELECT label, score, draw, CASE WHEN draw < 0 THEN -1 ELSE CAST('0x' || substr(sha256(concat_ws('|', entity, '42', draw // 8)), CAST(1 + 8 * (draw % 8) AS INTEGER), 8) AS BIGINT) / 4294967296.0::DOUBLE END AS u FROM pred, dr),
w AS (SELECT draw, score, label, CASE WHEN draw < 0 THEN 1 {_CUTS} ELSE {len(resample.POISSON)} END AS w FROM u),
c AS (SELECT draw, score, sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS p, sum(CASE WHEN label = 0 THEN w ELSE 0 END) AS q FROM w GROUP BY 1, 2),
k AS (SELECT *, sum(q) OVER (PARTITION BY draw ORDER BY score) - q AS qb, sum(p) OVER d AS tp, sum(q) OVER d AS fp FROM c WINDOW d AS (PARTITION BY draw ORDER BY score DESC)),
m AS (SELECT draw, sum(p * (qb + q / 2.0::DOUBLE)) / (sum(p) * sum(q)) AS auroc, sum(CASE WHEN tp + fp > 0 THEN p * tp / (tp + fp)::DOUBLE ELSE 0 END) / sum(p) AS auprc, sum(p) FILTER (WHERE score >= 0.55::DOUBLE) / sum(p)::DOUBLE AS sensitivity, (sum(q) - sum(q) FILTER (WHERE score >= 0.55::DOUBLE)) / sum(q)::DOUBLE AS specificity,
  sum(p) FILTER (WHERE score >= 0.55::DOUBLE) / (sum(p) FILTER (WHERE score >= 0.55::DOUBLE) + sum(q) FILTER (WHERE score >= 0.55::DOUBLE))::DOUBLE AS ppv,
  sum(q) FILTER (WHERE score < 0.55::DOUBLE) / (sum(q) FILTER (WHERE score < 0.55::DOUBLE) + sum(p) FILTER (WHERE score < 0.55::DOUBLE))::DOUBLE AS npv FROM k GROUP BY 1),
l AS (UNPIVOT m ON auroc, auprc, sensitivity, specificity, ppv, npv INTO NAME metric VALUE v)
SELECT metric, round(max(v) FILTER (WHERE draw < 0), 6) AS point, round(quantile_cont(v, 0.025) FILTER (WHERE draw >= 0), 6) AS lo, round(quantile_cont(v, 0.975) FILTER (WHERE draw >= 0), 6) AS hi FROM l GROUP BY 1""")
def _(t):
    return rounded(resample.bootstrap(t.pred, THR))


ROC = """sc AS (SELECT grp, score, sum(label) AS p, count(*) - sum(label) AS q FROM pred GROUP BY 1, 2),
rc AS (SELECT grp, score, sum(p) OVER (PARTITION BY grp ORDER BY score DESC) / (sum(p) OVER (PARTITION BY grp))::DOUBLE AS se, 1 - sum(q) OVER (PARTITION BY grp ORDER BY score DESC) / (sum(q) OVER (PARTITION BY grp))::DOUBLE AS sp FROM sc)"""
_RULES = [("youden", "se + sp", "true"), ("tier0", "se + sp", "se >= 0.8 AND sp >= 0.7"), ("tier1", "se + sp", "se >= 0.75 AND sp >= 0.65"), ("tier2", "se + sp", "se >= 0.7 AND sp >= 0.65"),
          ("tier2b", "se + sp", "se >= 0.7 AND sp >= 0.6"), ("tier3", "least(se, sp)", "true"), ("tier90", "sp", "se >= 0.9"), ("floors", "se + sp", "se >= 0.6 AND sp >= 0.5")]


@query("v04_threshold_search", f"""{with_(PRED, ROC)}, ru AS ({' UNION ALL '.join(f"SELECT '{n}' AS rule, grp, max({{'o': round({o}, 12), 't': score, 'se': se, 'sp': sp}}) AS b FROM rc WHERE {c} GROUP BY grp" for n, o, c in _RULES)}),
ch AS (SELECT grp, min(rule) AS rule FROM ru WHERE rule LIKE 'tier%' AND rule <> 'tier90' GROUP BY 1)
SELECT ru.rule, ru.grp, round(b.t, 6) AS threshold, round(b.se, 6) AS sensitivity, round(b.sp, 6) AS specificity, CAST(ch.rule = ru.rule AS INTEGER) AS chosen FROM ru JOIN ch USING (grp)""")
def _(t):
    return rounded(e.operating_points(t.pred, ["grp"], 0.6, 0.5))


_ST = "ps AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY {k}) AS n FROM {s} WHERE label = 1)"


@query("v05_threshold_by_group", f"""{PR}, cal AS (SELECT *, CASE WHEN age < 50 THEN '<50' WHEN age < 60 THEN '50-60' WHEN age < 89 THEN '60+' ELSE '89' END AS band FROM pred WHERE entity % 3 = 0 AND NOT (age = 89 AND label = 1 AND entity % 30 <> 0)), {_ST.format(k='band', s='cal')},
gl AS (SELECT score FROM (SELECT *, row_number() OVER (ORDER BY score) - 1 AS i, count(*) OVER () AS n FROM cal WHERE label = 1) WHERE i = floor(0.1::DOUBLE * n)),
tb AS (SELECT band, max(n) AS n_pos, max(score) FILTER (WHERE i = floor((1.0::DOUBLE - 0.9::DOUBLE) * n)) AS thr FROM ps GROUP BY 1),
qe AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.5) AS b, quantile_cont(price, 0.75) AS c FROM cal),
cq AS (SELECT cal.*, CASE WHEN price < a THEN 'Q1' WHEN price < b THEN 'Q2' WHEN price < c THEN 'Q3' ELSE 'Q4' END AS q FROM cal, qe),
pq AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY q) AS n FROM cq WHERE label = 1), tq AS (SELECT q, max(n) AS n_pos, max(score) FILTER (WHERE i = floor((1.0::DOUBLE - 0.9::DOUBLE) * n)) AS thr FROM pq GROUP BY 1)
SELECT 'age' AS kind, b.band AS "group", coalesce(n_pos, 0) AS n_pos, round(CASE WHEN n_pos >= 20 THEN thr ELSE gl.score END, 6) AS threshold, CASE WHEN n_pos >= 20 THEN 0 ELSE 1 END AS is_global FROM (SELECT DISTINCT band FROM cal) b LEFT JOIN tb USING (band), gl
UNION ALL SELECT 'density', q, n_pos, round(CASE WHEN n_pos >= 20 THEN thr ELSE gl.score END, 6), CASE WHEN n_pos >= 20 THEN 0 ELSE 1 END FROM tq, gl""")
def _(t):
    cal = t.pred.where("entity % 3 = 0 AND NOT (age = 89 AND label = 1 AND entity % 30 <> 0)")
    a = e.threshold_by(cal.withColumn("group", x.band("age", [0, 50, 60, 89, 200], ["<50", "50-60", "60+", "89"])), "group")
    edges = e.fit_quartiles(cal, "price")
    b = e.threshold_by(cal.withColumn("group", e.quartile("price", edges)), "group")
    return rounded(a.withColumn("kind", F.lit("age")).unionByName(b.withColumn("kind", F.lit("density"))))


_BANDS = "CASE WHEN age < 55 THEN '<55' WHEN age < 65 THEN '55-65' WHEN age < 75 THEN '65-75' ELSE '75+' END"


@query("v06_within_age", f"""{PR}, bd AS (SELECT *, {_BANDS} AS band FROM pred), {auc_sql('bd', 'band')}, {auc_sql('pred', '').replace('ar AS', 'gr AS').replace('au AS', 'gu AS').replace('FROM ar', 'FROM gr')}
SELECT band, n_pos, n_neg, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM au UNION ALL SELECT 'MACRO', CAST(sum(n_pos) AS BIGINT), CAST(sum(n_neg) AS BIGINT), round(avg(auroc), 6), round(avg(auprc), 6) FROM au
UNION ALL SELECT 'GLOBAL', n_pos, n_neg, round(auroc, 6), round(auprc, 6) FROM gu""")
def _(t):
    return rounded(e.within(t.pred, [0, 55, 65, 75, 200], ["<55", "55-65", "65-75", "75+"]))


def cal_sql(src, by):
    keys = by + ", " if by else ""
    g = f"GROUP BY {by}" if by else ""
    return f"""rl AS (SELECT {keys}least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS ms, avg(label) AS rt FROM {src} GROUP BY {keys}2), ec AS (SELECT {keys}sum(n * abs(ms - rt)) / sum(n) AS ece FROM rl {g}),
lg AS (SELECT *, ln(pc / (1 - pc)) AS lo FROM (SELECT *, least(greatest(score, 1e-6), 1 - 1e-6) AS pc FROM {src})),
br AS (SELECT {keys}count(*) AS n, avg((score - label) * (score - label)) AS brier, avg(label) AS base, regr_slope(label, lo) AS slope, regr_intercept(label, lo) AS intercept FROM lg {g})"""


@query("v07_calibration_error", f"""{PR}, {cal_sql('pred', 'grp').replace("GROUP BY grp, 2", "GROUP BY grp, bin")} SELECT grp, n, round(brier, 6) AS brier, round(base, 6) AS base, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(1 - brier / nullif(base * (1 - base), 0), 6) AS brier_skill, round(ece, 6) AS ece FROM br JOIN ec USING (grp)""")
def _(t):
    return rounded(e.calibration(t.pred, ["grp"]))


@query("v07_reliability", f"""{PR} SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS rate FROM pred GROUP BY 1""")
def _(t):
    return rounded(e.reliability(t.pred))


STRATA = f"ss AS (SELECT label, score, unnest([{{'s': 'sex', 'g': sex}}, {{'s': 'group', 'g': grp}}, {{'s': 'age', 'g': {_BANDS}}}]) AS k FROM pred), st AS (SELECT label, score, k.s || '|' || k.g AS sg FROM ss)"


@query("v08_subgroup_audit", f"""{with_(PRED, STRATA, auc_sql('st', 'sg'), cal_sql('st', 'sg').replace("GROUP BY sg, 2", "GROUP BY sg, bin"))}, c AS (SELECT sg, {cells_sql()} FROM st GROUP BY 1),
m AS (SELECT split_part(sg, '|', 1) AS stratum, split_part(sg, '|', 2) AS "group", tp, fp, fn, tn, {rates_sql()}, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc, round(brier, 6) AS brier, round(ece, 6) AS ece, tp / (tp + fn)::DOUBLE AS se
  FROM c JOIN au USING (sg) JOIN br USING (sg) JOIN ec USING (sg))
SELECT * EXCLUDE (se), round(max(se) OVER (PARTITION BY stratum) - min(se) OVER (PARTITION BY stratum), 6) AS sens_spread, CAST(max(se) OVER (PARTITION BY stratum) - min(se) OVER (PARTITION BY stratum) > 0.02::DOUBLE AS INTEGER) AS disparity FROM m""")
def _(t):
    return rounded(e.audit(t.pred, {"sex": "sex", "group": "grp", "age": x.band("age", [0, 55, 65, 75, 200], ["<55", "55-65", "65-75", "75+"])}, THR, points=0.02))


TEST = "te AS (SELECT * FROM pred WHERE entity % 2 = 0), ho AS (SELECT * FROM pred WHERE entity % 2 = 1 AND label = 0)"


def halves(t):
    return t.pred.where("entity % 2 = 0"), t.pred.where("entity % 2 = 1 AND label = 0")


@query("v09_iso_sensitivity", f"""{with_(PRED, TEST)}, s AS (SELECT unnest([0.80::DOUBLE, 0.85::DOUBLE, 0.90::DOUBLE, 0.95::DOUBLE]) AS s),
q AS (SELECT 0.80::DOUBLE AS s, quantile_cont(score, 0.2) AS t FROM te WHERE label = 1 UNION ALL SELECT 0.85::DOUBLE, quantile_cont(score, 0.15) FROM te WHERE label = 1 UNION ALL SELECT 0.90::DOUBLE, quantile_cont(score, 0.1) FROM te WHERE label = 1 UNION ALL SELECT 0.95::DOUBLE, quantile_cont(score, 0.05) FROM te WHERE label = 1),
b AS (SELECT s, t, (SELECT avg(CAST(score < t AS INTEGER)) FROM te WHERE label = 0) AS st, (SELECT avg(CAST(score < t AS INTEGER)) FROM ho) AS sh FROM q),
d AS (SELECT *, s * 0.0015::DOUBLE + (1 - sh) * (1 - 0.0015::DOUBLE) AS den FROM b)
SELECT s AS sens, round(t, 6) AS threshold, round(st, 6) AS spec_test, round(sh, 6) AS spec_holdout, round(s * 0.0015::DOUBLE / den, 6) AS ppv, round(den * 1000, 6) AS alerts_per_1k FROM d""")
def _(t):
    return rounded(e.iso_sensitivity(*halves(t)))


def _iso_spec(score: str) -> str:
    at = ", ".join(f"quantile_cont({score}, {round(1 - p, 2)}) FILTER (WHERE label = 1) AS t{round(p * 100)}" for p in e.SENS_POINTS)
    return "(" + " UNION ALL ".join(f"SELECT {p}::DOUBLE AS sens, (SELECT avg(CAST({score} < t{round(p * 100)} AS INTEGER)) FROM ho) AS v FROM (SELECT {at} FROM te)" for p in e.SENS_POINTS) + ")"


_FLAT, _STEEP = "(0.5::DOUBLE * score + 0.5::DOUBLE * (age - 40) / 50.0::DOUBLE)", "(score * score)"


@query("v09_iso_winner", f"""{with_(PRED, TEST)}, a AS {_iso_spec('score')}, b AS {_iso_spec(_FLAT)}, c AS {_iso_spec(_STEEP)}
SELECT sens, round(a.v, 6) AS plain, round(b.v, 6) AS with_age, round(c.v, 6) AS squared, CASE WHEN a.v >= b.v AND a.v >= c.v THEN 'plain' WHEN b.v >= c.v THEN 'with_age' ELSE 'squared' END AS winner
FROM a JOIN b USING (sens) JOIN c USING (sens)""")
def _(t):
    with_age = F.lit(0.5) * F.col("score") + F.lit(0.5) * (F.col("age") - 40) / F.lit(50.0)
    test, hold = halves(t)
    make = {"plain": F.col("score"), "with_age": with_age, "squared": F.col("score") * F.col("score")}
    return rounded(e.iso_winner({n: (test.withColumn("score", c), hold.withColumn("score", c)) for n, c in make.items()}))


@query("v10_combined_eval", f"""{with_(PRED, TEST)}, bo AS (SELECT entity, label, score FROM te UNION ALL SELECT entity, 0, score FROM ho), {auc_sql('bo', '')},
rc AS (SELECT score, sum(sum(label)) OVER (ORDER BY score DESC) / (sum(sum(label)) OVER ())::DOUBLE AS se, 1 - sum(count(*) - sum(label)) OVER (ORDER BY score DESC) / (sum(count(*) - sum(label)) OVER ())::DOUBLE AS sp FROM bo GROUP BY 1),
ts AS (SELECT 'A' AS run, 0.5::DOUBLE AS threshold UNION ALL SELECT 'B', 0.7::DOUBLE UNION ALL SELECT 'fresh', max({{'o': round(se + sp, 12), 't': score}}).t FROM rc),
c AS (SELECT run, threshold, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp, count(*) FILTER (WHERE score < threshold AND label = 1) AS fn, count(*) FILTER (WHERE score < threshold AND label = 0) AS tn FROM ts, bo GROUP BY 1, 2)
SELECT run, round(threshold, 6) AS threshold, tp, fp, fn, tn, {rates_sql()}, (SELECT round(auroc, 6) FROM au) AS auroc FROM c""")
def _(t):
    return rounded(e.combined(*halves(t), {"A": 0.5, "B": 0.7}))


GRID = [round(0.05 * i, 2) for i in range(1, 20)]


@query("v11_threshold_sweep", f"""{PR}, ts AS (SELECT unnest([{', '.join(f'{g}::DOUBLE' for g in GRID)}]) AS threshold), c AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp,
  count(*) FILTER (WHERE score < threshold AND label = 1) AS fn, count(*) FILTER (WHERE score < threshold AND label = 0) AS tn FROM ts, pred GROUP BY 1) SELECT threshold, tp, fp, fn, tn, {rates_sql()} FROM c""")
def _(t):
    return rounded(e.sweep(t.pred, GRID).drop("i"), "threshold")


@query("v11_best_points", f"""{PR}, ts AS (SELECT unnest([{', '.join(f'{g}::DOUBLE' for g in GRID)}]) AS t), c AS (SELECT t, count(*) FILTER (WHERE score >= t AND label = 1) / (count(*) FILTER (WHERE label = 1))::DOUBLE AS se, count(*) FILTER (WHERE score < t AND label = 0) / (count(*) FILTER (WHERE label = 0))::DOUBLE AS sp FROM ts, pred GROUP BY 1),
b AS (SELECT 'youden' AS rule, max({{'o': round(se + sp, 12), 'm': -t, 's': se, 'c': sp}}) AS b FROM c UNION ALL SELECT 'sens90', max({{'o': round(sp, 12), 'm': -t, 's': se, 'c': sp}}) FROM c WHERE se >= 0.9 UNION ALL SELECT 'spec90', max({{'o': round(se, 12), 'm': -t, 's': se, 'c': sp}}) FROM c WHERE sp >= 0.9)
SELECT rule, -b.m AS threshold, round(b.s, 6) AS sensitivity, round(b.c, 6) AS specificity FROM b WHERE b IS NOT NULL""")
def _(t):
    return rounded(e.best_points(e.sweep(t.pred, GRID)), "threshold")


EP = """ep AS (SELECT entity, label, CAST((entity * 31 + 7) % 101 AS DOUBLE) / 101 AS score FROM spine), eg AS (SELECT entity, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS caught FROM ep WHERE label = 1)"""


def ep(t):
    return t.spine.select("entity", "label", ((F.col("entity") * 31 + 7) % 101 / 101.0).alias("score"))


@query("v12_error_groups", f"""{with_(ANCH, FEATS, EP)}, j AS (SELECT feature, value, caught FROM fl JOIN eg USING (entity)), rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rk FROM j),
tie AS (SELECT feature, sum(n * n * n - n)::DOUBLE AS ties FROM (SELECT feature, value, count(*)::DOUBLE AS n FROM j GROUP BY 1, 2) GROUP BY 1),
u AS (SELECT feature, avg(value) FILTER (WHERE caught = 0) AS fm, avg(value) FILTER (WHERE caught = 1) AS tm, count(*) FILTER (WHERE caught = 0)::DOUBLE AS n1, count(*) FILTER (WHERE caught = 1)::DOUBLE AS n2, coalesce(sum(rk) FILTER (WHERE caught = 0), 0) AS r1 FROM rk GROUP BY 1),
z AS (SELECT feature, fm, tm, r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2 AS d, sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / nullif((n1 + n2) * (n1 + n2 - 1), 0))) AS sd FROM u JOIN tie USING (feature)),
zz AS (SELECT *, sign(d) * greatest(abs(d) - 0.5, 0) / nullif(sd, 0) AS z FROM z)
SELECT feature, round(fm, 6) AS fn_mean, round(tm, 6) AS tp_mean, round(fm - tm, 6) AS difference, round(z, 6) AS z, CASE WHEN abs(z) > 3.290527 THEN '***' WHEN abs(z) > 2.575829 THEN '**' WHEN abs(z) > 1.959964 THEN '*' ELSE '' END AS significance FROM zz""")
def _(t):
    return rounded(e.error_profile(ep(t), features(t), 0.5))


@query("v12_fn_rates", f"""{PR}, k AS (SELECT score, unnest([{{'s': 'sex', 'g': sex}}, {{'s': 'group', 'g': grp}}]) AS k FROM pred WHERE label = 1) SELECT k.s AS stratum, k.g AS "group", count(*) AS cases, count(*) FILTER (WHERE score < 0.55) AS missed, round(avg(CAST(score < 0.55 AS INTEGER)), 6) AS fn_rate,
  count(*) FILTER (WHERE score < 0.55 AND score >= 0.8::DOUBLE * 0.55::DOUBLE) AS near_miss, count(*) FILTER (WHERE score < 0.1) AS very_low FROM k GROUP BY 1, 2""")
def _(t):
    return rounded(e.fn_rates(t.pred, {"sex": "sex", "group": "grp"}, THR))


@query("v12_archetypes", f"""{PR}, h AS (SELECT o_custkey AS cust, count(*) AS orders FROM orders GROUP BY 1), m AS (SELECT p.*, h.orders FROM pred p JOIN h USING (cust) WHERE label = 1 AND score < 0.55),
k AS (SELECT 'silent' AS archetype, m.*, orders <= 9 AND price < 100000 AS hit FROM m UNION ALL SELECT 'young', m.*, age < 50 FROM m UNION ALL SELECT 'busy', m.*, orders > 11 FROM m UNION ALL SELECT 'near_miss', m.*, score >= 0.44::DOUBLE FROM m)
SELECT archetype, count(*) FILTER (WHERE hit) AS missed, round(avg(CAST(hit AS INTEGER)), 6) AS share, round(avg(age) FILTER (WHERE hit), 6) AS mean_age, round(avg(CAST(sex = 'M' AS INTEGER)) FILTER (WHERE hit), 6) AS male_share,
  round(avg(score) FILTER (WHERE hit), 6) AS mean_score FROM k GROUP BY 1""")
def _(t):
    n = t.orders.groupBy(F.col("o_custkey").alias("cust")).agg(F.count(F.lit(1)).alias("orders"))
    rows = t.pred.select("entity", "age", "sex", "price", "cust", F.col("score").alias("s")).join(n, "cust")
    kinds = {"silent": (F.col("orders") <= 9) & (F.col("price") < 100000), "young": F.col("age") < 50, "busy": F.col("orders") > 11, "near_miss": F.col("s") >= 0.44}
    return rounded(e.archetypes(t.pred, rows, 0.55, kinds))


@query("v13_rule_mining", f"""{with_(ANCH, FEATS)}, cu AS (SELECT feature, unnest([quantile_cont(value, 0.25), quantile_cont(value, 0.5), quantile_cont(value, 0.75), quantile_cont(value, 0.9)]) AS cut FROM fl WHERE value > 0 GROUP BY feature), dc AS (SELECT DISTINCT feature, cut FROM cu),
tot AS (SELECT count(*) FILTER (WHERE label = 1)::DOUBLE AS tp, count(*) FILTER (WHERE label = 0)::DOUBLE AS tn FROM spine),
ab AS (SELECT dc.feature, cut, count(*) FILTER (WHERE value > cut AND label = 1)::DOUBLE AS pa, count(*) FILTER (WHERE value > cut AND label = 0)::DOUBLE AS qa FROM dc JOIN fl ON fl.feature = dc.feature JOIN spine USING (entity) GROUP BY 1, 2),
tw AS (SELECT feature, cut, '>' AS direction, pa AS p, qa AS q, tp, tn FROM ab, tot UNION ALL SELECT feature, cut, '<=', tp - pa, tn - qa, tp, tn FROM ab, tot),
li AS (SELECT *, (p / (p + q)) / greatest((tp - p) / (tp + tn - p - q), 0.001) AS lift FROM tw WHERE p + q >= 50 AND tp + tn - p - q >= 50)
SELECT feature, round(cut, 6) AS threshold, direction, round(p / tp * 100, 6) AS pct_pos, round(q / tn * 100, 6) AS pct_neg, round(lift, 6) AS lift FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(lift, 9) DESC, cut, direction) AS k FROM li) WHERE k = 1""")
def _(t):
    return rounded(e.rules(features(t), t.spine))


@query("v13_combination_rules", f"""{PR}, b AS (SELECT count(*)::DOUBLE AS n, sum(label)::DOUBLE AS p FROM pred), r AS (SELECT 'old and dear' AS rule, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_pos FROM pred WHERE age >= 70 AND price > 300000 UNION ALL SELECT 'high score', count(*), CAST(sum(label) AS BIGINT) FROM pred WHERE score > 0.9)
SELECT rule, r.n, n_pos, round(n_pos / r.n::DOUBLE, 6) AS rate, round((n_pos / r.n::DOUBLE) / (b.p / b.n), 6) AS lift, round(n_pos / b.p, 6) AS sensitivity FROM r, b""")
def _(t):
    return rounded(e.combo(t.pred, {"old and dear": (F.col("age") >= 70) & (F.col("price") > 300000), "high score": F.col("score") > 0.9}))


_SPEC = [("age", ">=", 70, 2), ("price", ">", 300000, 3), ("score", ">", 0.5, 4), ("missing", ">", 0, 9)]


@query("v14_points_score", f"""{PR}, p AS (SELECT label, CASE WHEN age >= 70 THEN 2 ELSE 0 END + CASE WHEN price > 300000 THEN 3 ELSE 0 END + CASE WHEN score > 0.5 THEN 4 ELSE 0 END AS pt FROM pred), c AS (SELECT CAST(unnest(range(16)) AS INTEGER) AS cut),
g AS (SELECT cut, count(*) FILTER (WHERE pt >= cut) AS n, count(*) FILTER (WHERE pt >= cut AND label = 1) AS tp, count(*) FILTER (WHERE label = 1) AS pp, count(*) FILTER (WHERE pt < cut AND label = 0) AS tn, count(*) FILTER (WHERE label = 0) AS nn FROM c, p GROUP BY 1)
SELECT cut, n, tp, round(tp / pp::DOUBLE, 6) AS sensitivity, round(tn / nn::DOUBLE, 6) AS specificity, round(tp / n::DOUBLE, 6) AS ppv FROM g WHERE n > 0""")
def _(t):
    return rounded(e.points_table(e.points(t.pred, _SPEC)))


@query("v16_top_factors", f"""{with_(PRED, learn.CONTRIB)} SELECT entity, feature, round(contribution, 6) AS contribution, CAST(row_number() OVER (PARTITION BY entity ORDER BY abs(contribution) DESC, feature) AS INTEGER) AS "rank" FROM ct QUALIFY "rank" <= 2""")
def _(t):
    return rounded(e.top_factors(learn.contrib(t), 2))


def banded(t):
    return learn.contrib(t).join(t.pred.select("entity", x.band("age", [0, 55, 65, 75, 200], ["<55", "55-65", "65-75", "75+"]).alias("band"), "grp"), "entity")


_BC = f"bc AS (SELECT {_BANDS} AS band, grp, feature, contribution FROM ct)"


@query("v16_band_stability", f"""{with_(PRED, learn.CONTRIB, _BC)}, m AS (SELECT band, feature, avg(abs(contribution)) AS ma FROM bc GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY round(ma, 12) DESC, feature) AS k FROM m),
ks AS (SELECT unnest([1, 2]) AS top_k), s AS (SELECT top_k, band, feature FROM r JOIN ks ON k <= top_k), bb AS (SELECT DISTINCT top_k, band FROM s),
pr AS (SELECT a.top_k, a.band AS band_a, b.band AS band_b FROM bb a JOIN bb b ON a.top_k = b.top_k AND a.band < b.band), ix AS (SELECT pr.*, (SELECT count(*) FROM s x JOIN s y ON x.feature = y.feature WHERE x.top_k = pr.top_k AND y.top_k = pr.top_k AND x.band = band_a AND y.band = band_b) AS i FROM pr)
SELECT top_k, band_a, band_b, i AS intersection, 2 * top_k - i AS union_size, round(i / (2 * top_k - i)::DOUBLE, 6) AS jaccard FROM ix""")
def _(t):
    return rounded(e.band_stability(banded(t), (1, 2)))


@query("v16_segment_drivers", f"""{with_(PRED, learn.CONTRIB, _BC)}, m AS (SELECT grp, feature, avg(abs(contribution)) AS ma, avg(contribution) AS ms FROM bc GROUP BY 1, 2)
SELECT grp, feature, round(ma, 6) AS mean_abs, round(ms, 6) AS mean_signed, CASE WHEN ms >= 0 THEN '+' ELSE '-' END AS direction, CAST(row_number() OVER (PARTITION BY grp ORDER BY round(ma, 12) DESC, feature) AS INTEGER) AS "rank" FROM m QUALIFY "rank" <= 2""")
def _(t):
    return rounded(e.segment_drivers(banded(t), "grp", 2))


@query("v18_score_parity", f"""{PR}, j AS (SELECT score AS a, CASE WHEN entity % 100 = 5 THEN score + 0.002 ELSE score END AS b FROM pred WHERE entity % 3 <> 0) SELECT count(*) AS n, round(max(abs(a - b)), 6) AS max_diff, round(avg(abs(a - b)), 6) AS mean_diff, round(corr(a, b), 6) AS corr, CAST(max(abs(a - b)) >= 1e-3 AS INTEGER) AS differs FROM j""")
def _(t):
    b = t.pred.where("entity % 3 <> 0").withColumn("score", F.when(F.col("entity") % 100 == 5, F.col("score") + 0.002).otherwise(F.col("score")))
    return rounded(e.parity(t.pred, b))
