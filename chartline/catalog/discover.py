"""K: code discovery and curation on brands and parts of the anchored history."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import skew
from ..operators import discover as d
from .base import ANCH, query, r, rounded, with_

TOT = "tot AS (SELECT count(*) FILTER (WHERE label = 1) AS tp, count(*) FILTER (WHERE label = 0) AS tn FROM spine)"


def counts_sql(by):
    return f"""pr AS (SELECT DISTINCT entity, {by} AS code FROM anch), nn AS (SELECT code, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label = 0) AS n_neg FROM pr JOIN spine USING (entity) GROUP BY 1),
tt AS (SELECT code, term FROM (SELECT {by} AS code, term, row_number() OVER (PARTITION BY {by} ORDER BY count(*) DESC, term) AS k FROM anch GROUP BY 1, 2) WHERE k = 1),
{TOT}, cc AS (SELECT nn.code, n_pos, n_neg, term, tp AS total_pos, tn AS total_neg FROM nn JOIN tt USING (code), tot)"""


STAT = """st AS (SELECT *, (n_pos + 0.5::DOUBLE) * (total_neg - n_neg + 0.5::DOUBLE) / ((total_pos - n_pos + 0.5::DOUBLE) * (n_neg + 0.5::DOUBLE)) AS orr,
  sqrt(1 / (n_pos + 0.5::DOUBLE) + 1 / (total_pos - n_pos + 0.5::DOUBLE) + 1 / (n_neg + 0.5::DOUBLE) + 1 / (total_neg - n_neg + 0.5::DOUBLE)) AS se FROM cc)"""
CHI = """c0 AS (SELECT *, CAST(total_pos - n_pos AS DOUBLE) AS b, CAST(total_neg - n_neg AS DOUBLE) AS d, CAST(total_pos + total_neg AS DOUBLE) AS n FROM cc),
c1 AS (SELECT *, greatest(abs(n_pos * d - b * n_neg) - least(abs(n_pos * d - b * n_neg), n / 2), 0) AS cut FROM c0),
c2 AS (SELECT *, n * cut * cut / nullif((n_pos + b) * (n_neg + d) * (n_pos + n_neg) * (b + d), 0) AS x2 FROM c1),
c3 AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * sqrt(x2 / 2)) AS u FROM c2),
c4 AS (SELECT *, ((((1.061405429::DOUBLE * u - 1.453152027::DOUBLE) * u + 1.421413741::DOUBLE) * u - 0.284496736::DOUBLE) * u + 0.254829592::DOUBLE) * u * exp(-x2 / 2) AS pv FROM c3)"""


def counts(t, by="code"):
    ev = t.anch if by == "code" else t.anch.withColumn("code", F.col(by))
    return d.code_counts(ev, t.spine)


@query("k01_code_counts", f"{with_(ANCH, counts_sql('code'))} SELECT * FROM cc")
def _(t):
    return counts(t)


@query("k02_entity_code_matrix", f"{with_(ANCH)} SELECT entity, code, count(*) AS event_count, max(label) AS label FROM anch GROUP BY 1, 2")
def _(t):
    return d.code_matrix(t.anch, t.spine).select("entity", "code", "event_count", "label")


@query("k03_association", f"""{with_(ANCH, counts_sql('code'), STAT)} SELECT code, n_pos, n_neg, round(n_pos / total_pos::DOUBLE, 6) AS prevalence_pos, round(n_neg / total_neg::DOUBLE, 6) AS prevalence_neg,
  round(n_pos / total_pos::DOUBLE - n_neg / total_neg::DOUBLE, 6) AS prevalence_diff, round(CASE WHEN n_neg > 0 THEN (n_pos / total_pos::DOUBLE) / (n_neg / total_neg::DOUBLE) END, 6) AS prevalence_ratio, round(orr, 6) AS odds_ratio,
  round(ln(orr), 6) AS log_odds_ratio, round(se, 6) AS log_or_se, round(exp(ln(orr) - 1.96::DOUBLE * se), 6) AS or_ci_lower, round(exp(ln(orr) + 1.96::DOUBLE * se), 6) AS or_ci_upper FROM st""")
def _(t):
    return rounded(d.association(counts(t)).drop("term", "total_pos", "total_neg"))


@query("k04_chi2_yates", f"""{with_(ANCH, counts_sql('brand'), CHI)} SELECT code, round(x2, 6) AS chi_squared, round(pv, 4) AS p_value, round(least(pv * (SELECT count(*) FROM cc), 1), 4) AS p_bonferroni FROM c4""")
def _(t):
    return rounded(d.chi2(counts(t, "brand")).select("code", "chi_squared", F.round("p_value", 4).alias("p_value"), F.round("p_bonferroni", 4).alias("p_bonferroni")), "p_value", "p_bonferroni")


@query("k05_significance_filter", f"""{with_(ANCH, counts_sql('code'), STAT)}, {CHI}, f AS (SELECT st.code, st.n_pos, st.orr FROM st JOIN c4 USING (code) WHERE orr > 1.05 AND least(pv * (SELECT count(*) FROM cc), 1) < 2 AND st.n_pos >= 12)
SELECT code, n_pos, round(orr, 6) AS odds_ratio, CAST(row_number() OVER (ORDER BY round(orr, 12) DESC, code) AS INTEGER) AS stat_rank FROM f""")
def _(t):
    out = d.filter_rank(d.chi2(d.association(counts(t))), min_or=1.05, max_p=2.0, min_n=12)
    return rounded(out.select("code", "n_pos", "odds_ratio", "stat_rank"))


MI = """mi AS (SELECT code, CASE WHEN n_pos > 0 THEN n_pos / n * ln(n_pos * n / ((n_pos + n_neg) * total_pos)) ELSE 0 END + CASE WHEN n_neg > 0 THEN n_neg / n * ln(n_neg * n / ((n_pos + n_neg) * total_neg)) ELSE 0 END
  + CASE WHEN b > 0 THEN b / n * ln(b * n / ((n - n_pos - n_neg) * total_pos)) ELSE 0 END + CASE WHEN d > 0 THEN d / n * ln(d * n / ((n - n_pos - n_neg) * total_neg)) ELSE 0 END AS mi FROM c0)"""


@query("k06_mutual_information", f"{with_(ANCH, counts_sql('brand'), CHI, MI)} SELECT code, round(greatest(mi, 0), 6) AS mutual_info FROM mi")
def _(t):
    return rounded(d.mutual_info(counts(t, "brand")).select("code", "mutual_info"))


@query("k08_bootstrap_stability", f"""{with_(ANCH)}, pr AS (SELECT DISTINCT entity, code FROM anch), dr AS (SELECT unnest(range(20)) AS draw),
u AS (SELECT entity, label, draw, CAST('0x' || substr(md5(concat_ws('|', entity, '42', draw)), 1, 7) AS BIGINT) / 268435456.0::DOUBLE AS u FROM spine, dr),
w AS (SELECT *, CASE WHEN u < 0.36787944 THEN 0 WHEN u < 0.73575888 THEN 1 WHEN u < 0.91969860 THEN 2 WHEN u < 0.98101184 THEN 3 WHEN u < 0.99634015 THEN 4 WHEN u < 0.99940582 THEN 5 WHEN u < 0.99991676 THEN 6 ELSE 7 END AS w FROM u),
tt AS (SELECT draw, sum(w) FILTER (WHERE label = 1) AS tp, sum(w) FILTER (WHERE label = 0) AS tn FROM w GROUP BY 1),
s AS (SELECT code, draw, sum(CASE WHEN label = 1 THEN w ELSE 0 END) + 0.5::DOUBLE AS p, sum(CASE WHEN label = 0 THEN w ELSE 0 END) + 0.5::DOUBLE AS q FROM pr JOIN w USING (entity) GROUP BY 1, 2),
o AS (SELECT code, draw, row_number() OVER (PARTITION BY draw ORDER BY round(p * (tn + 1 - q) / ((tp + 1 - p) * q), 9) DESC, code) AS k FROM s JOIN tt USING (draw)),
h AS (SELECT code, count(*) FILTER (WHERE k <= 150) / 20.0::DOUBLE AS stability FROM o GROUP BY 1)
SELECT code, stability, CAST(stability >= 0.5 AS INTEGER) AS stable FROM h""")
def _(t):
    pairs = t.anch.select("entity", "code").distinct()
    return d.bootstrap_stability(pairs, t.spine, threshold=0.5)


COMB = """sc AS (SELECT st.code, ln(orr) AS lo, x2, greatest(mi, 0) AS mi, row_number() OVER (ORDER BY round(orr, 12) DESC, st.code) AS stat_rank, row_number() OVER (ORDER BY st.code) AS ml_rank FROM st JOIN c2 USING (code) JOIN mi USING (code)),
n1 AS (SELECT *, (lo - min(lo) OVER ()) / (max(lo) OVER () - min(lo) OVER ()) AS stat_score, (x2 - min(x2) OVER ()) / (max(x2) OVER () - min(x2) OVER ()) AS chi2_score, (mi - min(mi) OVER ()) / (max(mi) OVER () - min(mi) OVER ()) AS mi_score FROM sc),
cb AS (SELECT *, stat_score * 0.25::DOUBLE + chi2_score * 0.15::DOUBLE + mi_score * 0.15::DOUBLE AS combined FROM n1),
rk AS (SELECT *, row_number() OVER (ORDER BY round(combined, 12) DESC, code) AS combined_rank FROM cb)"""


def combined(t):
    s = d.mutual_info(d.chi2(d.association(counts(t, "brand"))))
    s = skew.rank_all(d.ranked(s, F.round("odds_ratio", 12), "code", "stat_rank"), [F.col("code")], "ml_rank")
    w = {k: v for k, v in d.RANK_WEIGHTS.items() if k != "ml_importance"}
    return d.combine_ranks(s, {"stat_score": "log_odds_ratio", "chi2_score": "chi_squared", "mi_score": "mutual_info"}, w, top_n=10)


@query("k09_combined_rank", f"""{with_(ANCH, counts_sql('brand'), STAT, CHI, MI, COMB)} SELECT code, round(stat_score, 6) AS stat_score, round(chi2_score, 6) AS chi2_score, round(mi_score, 6) AS mi_score, round(combined, 6) AS combined_score,
  CAST(combined_rank AS INTEGER) AS combined_rank, CASE WHEN combined > 0.8 THEN 'high' WHEN combined > 0.5 THEN 'medium' WHEN combined > 0.2 THEN 'low' WHEN combined > -0.01 THEN 'very_low' END AS tier, stat_rank <= 10 AND ml_rank <= 10 AS both_agree FROM rk""")
def _(t):
    return rounded(combined(t).select("code", "stat_score", "chi2_score", "mi_score", "combined_score", "combined_rank", "tier", "both_agree"))


@query("k10_curation_compare", f"""{with_(ANCH, counts_sql('brand'), STAT, CHI, MI, COMB)}, cur AS (SELECT DISTINCT p_brand || CASE WHEN p_partkey % 97 = 5 THEN 'x' ELSE '' END AS code, 'cat' AS category FROM part WHERE p_brand LIKE '%3' OR p_brand = 'Brand#1'),
fr AS (SELECT rk.code, rk.combined_rank, st.orr, c4.pv FROM rk JOIN st USING (code) JOIN c4 USING (code)),
j AS (SELECT coalesce(r.code, cur.code) AS code, cur.category, cur.code IS NOT NULL AS cu, combined_rank, orr, least(pv * 25, 1) AS pb FROM fr r FULL JOIN cur ON cur.code = r.code)
SELECT code, category, cu AS in_curated, CAST(combined_rank AS INTEGER) AS combined_rank, CASE WHEN cu AND combined_rank IS NULL THEN 'KEEP_BUT_RARE' WHEN cu AND coalesce(orr > 1.0 AND pb < 1.0, false) THEN 'KEEP' WHEN cu THEN 'KEEP_BUT_WEAK'
  WHEN combined_rank IS NULL THEN 'IGNORE' WHEN combined_rank <= 5 THEN 'ADD_HIGH' WHEN combined_rank <= 12 THEN 'ADD_MEDIUM' ELSE 'IGNORE' END AS action,
  concat_ws('; ', CASE WHEN cu AND combined_rank IS NULL THEN 'not in ranking' END, CASE WHEN cu AND combined_rank > 12 THEN 'curated but rank ' || combined_rank || ' > 12' END, CASE WHEN NOT cu AND orr > 5 THEN 'high odds ratio' END) AS notes FROM j""")
def _(t):
    name = F.concat(F.col("p_brand"), F.when(F.col("p_partkey") % 97 == 5, "x").otherwise(""))
    cur = t.part.where("p_brand LIKE '%3' OR p_brand = 'Brand#1'").select(name.alias("code"), F.lit("cat").alias("category")).distinct()
    out = d.curate(combined(t), cur, high=5, medium=12, min_or=1.0, max_p=1.0)
    return out.select("code", "category", "in_curated", "combined_rank", "action", "notes")


_RULES = [("blue nut", "REMOVE_NOISE", "generic:blue nut"), ("ring", "KEEP", "override"), ("family-history", "KEEP", "valid signal"), ("red", "REMOVE_LEAKAGE", "drug:red"), ("bolt", "BORDERLINE_DX_PATHWAY", "dx-pathway:bolt"), ("small", "REMOVE_NOISE", "generic:small")]


@query("k11_term_classifier", """
WITH t AS (SELECT DISTINCT CASE WHEN p_partkey % 50 = 0 THEN 'Family history of ' || p_name WHEN p_partkey % 50 = 1 THEN ' ' ELSE p_name END AS term FROM part), l AS (SELECT term, lower(trim(term)) AS k FROM t)
SELECT term, CASE WHEN k = '' THEN 'REMOVE_NOISE' WHEN k LIKE '%blue nut%' THEN 'REMOVE_NOISE' WHEN k LIKE '%ring%' THEN 'KEEP' WHEN k LIKE 'family history%' THEN 'KEEP' WHEN k LIKE '%red%' THEN 'REMOVE_LEAKAGE' WHEN k LIKE '%bolt%' THEN 'BORDERLINE_DX_PATHWAY'
  WHEN k LIKE '%small%' THEN 'REMOVE_NOISE' ELSE 'KEEP' END AS decision, CASE WHEN k = '' THEN 'generic:empty term' WHEN k LIKE '%blue nut%' THEN 'generic:blue nut' WHEN k LIKE '%ring%' THEN 'override' WHEN k LIKE 'family history%' THEN 'valid signal' WHEN k LIKE '%red%' THEN 'drug:red'
  WHEN k LIKE '%bolt%' THEN 'dx-pathway:bolt' WHEN k LIKE '%small%' THEN 'generic:small' ELSE 'valid signal' END AS reason, CASE WHEN regexp_matches(lower(term), 'gizmo|widget') THEN 'gadget' WHEN regexp_matches(lower(term), '^new') THEN 'new' ELSE '' END AS suggested_category FROM l""")
def _(t):
    k = F.col("p_partkey") % 50
    terms = t.part.select(F.when(k == 0, F.concat(F.lit("Family history of "), F.col("p_name"))).when(k == 1, " ").otherwise(F.col("p_name")).alias("term")).distinct()
    return d.classify_terms(terms, _RULES, [("gadget", "gizmo|widget"), ("new", "^new")])


_BIN = "CASE WHEN months_before < 3 THEN 'a' WHEN months_before < 12 THEN 'b' WHEN months_before < 24 THEN 'c' WHEN months_before < 60 THEN 'd' ELSE 'e' END"


def _lead():
    def lift(b):
        return f"((count(*) FILTER (WHERE bin = '{b}' AND label = 1) + 0.5::DOUBLE) / max(tp)) / ((count(*) FILTER (WHERE bin = '{b}' AND label = 0) + 0.5::DOUBLE) / max(tn))"
    npos = "greatest(" + ", ".join(f"count(*) FILTER (WHERE bin = '{b}' AND label = 1)" for b in "abcde") + ")"
    return f"""{with_(ANCH, TOT)}, ce AS (SELECT DISTINCT entity, code, {_BIN} AS bin FROM anch), l AS (SELECT code, {npos} AS n_pos, {lift('a')} AS near, ({lift('c')} + {lift('d')}) / 2 AS mid, {lift('e')} AS far FROM ce JOIN spine USING (entity), tot GROUP BY 1),
tt AS (SELECT code, term FROM (SELECT code, term, row_number() OVER (PARTITION BY code ORDER BY count(*) DESC, term) AS k FROM anch GROUP BY 1, 2) WHERE k = 1),
s AS (SELECT *, near >= 3 AND mid < 1.5 AND far < 1.5 AS spike, regexp_matches(lower(term), 'ring|bolt') AS proc FROM l JOIN tt USING (code))
SELECT code, term, n_pos, round(near, 6) AS near, round(mid, 6) AS mid, round(far, 6) AS far, proc AS process_term, CASE WHEN n_pos < 4 THEN 'rare' WHEN spike AND proc THEN 'REACTIVE-LEAK' WHEN mid >= 1.5 AND near >= mid * 1.6::DOUBLE THEN 'PRODROMAL' WHEN far >= 1.4 AND mid >= 1.4 THEN 'LIFETIME'
  WHEN mid >= 1.4 OR far >= 1.4 THEN 'EARLY' WHEN spike THEN 'near-dx-symptom' ELSE 'weak' END AS class FROM s"""


@query("k12_leadtime_screen", _lead())
def _(t):
    return rounded(d.leadtime(t.anch, t.spine, process="ring|bolt", min_pos=4))
