"""F: matrix hygiene on a long feature table of the anchored history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as x
from ..operators import assemble, hygiene as h, sparse_correlation as sc, values as v
from .base import ANCH, query, r, rounded, with_

AN = with_(ANCH)
# counts per brand and category, a constant, a copy, a rare flag, sums and the latest value
FEATS = """fl AS (SELECT entity, brand || '_count' AS feature, CAST(count(*) AS DOUBLE) AS value FROM anch GROUP BY 1, 2
  UNION ALL SELECT entity, category || '_last', max({'d': event_date, 'v': value}).v FROM anch GROUP BY 1, category
  UNION ALL SELECT entity, category || '_copy', max({'d': event_date, 'v': value}).v FROM anch WHERE category = 'SMALL' GROUP BY 1, category
  UNION ALL SELECT DISTINCT entity, 'constant', 1.0::DOUBLE FROM anch
  UNION ALL SELECT entity, 'mostly_one', CASE WHEN entity % 400 = 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END FROM (SELECT DISTINCT entity FROM anch)
  UNION ALL SELECT DISTINCT entity, 'rare', CAST(entity AS DOUBLE) FROM anch WHERE entity % 40 = 1
  UNION ALL SELECT entity, 'total', sum(value) FROM anch GROUP BY 1)"""


def features(t, events=None):
    a, one = t.anch if events is None else events, F.lit(1.0)

    def named(name, value):
        return F.struct(F.lit(name).alias("feature"), value.cast("double").alias("value"))

    brand = a.groupBy("entity", "brand").agg(F.count(F.lit(1)).cast("double").alias("value")).select("entity", F.concat("brand", F.lit("_count")).alias("feature"), "value")
    cat = a.groupBy("entity", "category").agg(v.last_value().alias("value"))
    last = F.struct(F.concat("category", F.lit("_last")).alias("feature"), F.col("value"))
    copies = F.when(F.col("category") == "SMALL", F.array(last, named("SMALL_copy", F.col("value")))).otherwise(F.array(last))
    own = a.groupBy("entity").agg(F.sum("value").alias("total"))
    flags = [named("constant", one), named("mostly_one", F.when(F.col("entity") % 400 == 1, 2.0).otherwise(1.0)), named("total", F.col("total"))]
    rare = F.when(F.col("entity") % 40 == 1, F.array(named("rare", F.col("entity")), *flags)).otherwise(F.array(*flags))
    return assemble.union_long(brand, cat.select("entity", F.explode(copies).alias("s")).select("entity", "s.*"),
                               own.select("entity", F.explode(rare).alias("s")).select("entity", "s.*"))


@query("f01_profile", f"""{AN} SELECT label, count(*) AS "rows", count(DISTINCT entity) AS entities, min(event_date) AS first_date, max(event_date) AS last_date, count(*) FILTER (WHERE time_window = 'A') AS rows_A, count(*) FILTER (WHERE time_window = 'B') AS rows_B,
  count(*) FILTER (WHERE months_before < 0 OR months_before > 60) AS months_out_of_range, count(*) FILTER (WHERE event_date IS NULL) AS null_event_date, count(*) FILTER (WHERE category IS NULL) AS null_category, count(*) FILTER (WHERE code IS NULL) AS null_code, count(*) FILTER (WHERE value IS NULL) AS null_value FROM anch GROUP BY 1""")
def _(t):
    return h.profile(t.anch)


@query("f01_top_categories", f"{AN} SELECT brand, count(*) AS \"rows\", count(DISTINCT entity) AS entities FROM anch GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(t):
    return h.top_categories(t.anch, 10, "brand")


@query("f02_prevalence_report", f"""{AN}, p AS (SELECT entity, max(CAST(category = 'SMALL' AS INTEGER)) AS small, max(CAST(term = 'red ring' AS INTEGER)) AS red_ring FROM anch GROUP BY 1),
s AS (SELECT label, coalesce(small, 0) AS small, coalesce(red_ring, 0) AS red_ring FROM spine LEFT JOIN p USING (entity)), a AS (SELECT 'small' AS item, avg(small) FILTER (WHERE label = 1) AS p1, avg(small) FILTER (WHERE label = 0) AS p0 FROM s UNION ALL SELECT 'red_ring', avg(red_ring) FILTER (WHERE label = 1), avg(red_ring) FILTER (WHERE label = 0) FROM s)
SELECT item, round(p1 * 100, 6) AS pct_pos, round(p0 * 100, 6) AS pct_neg, round((p1 - p0) * 100, 6) AS diff, round(p1 / p0, 6) AS ratio FROM a""")
def _(t):
    return rounded(h.prevalence(t.anch, t.spine, {"small": F.col("category") == "SMALL", "red_ring": F.col("term") == "red ring"}))


@query("f03_drop_null_constant", f"""{with_(ANCH, FEATS)}, c AS (SELECT feature, value, count(*) AS n FROM fl GROUP BY 1, 2), s AS (SELECT feature, CAST(sum(n) AS BIGINT) AS n, 1 - sum(n) / (SELECT count(*) FROM spine)::DOUBLE AS nl, max(n) / sum(n)::DOUBLE AS tp, sum(value * n) / sum(n) AS mean, min(value) = max(value) AS constant FROM c GROUP BY 1)
SELECT feature, n, round(nl, 6) AS null_share, round(tp, 6) AS top_share, round(mean, 6) AS mean, constant, CASE WHEN nl > 0.95 THEN 'high_null' WHEN constant THEN 'constant' WHEN tp > 0.995 THEN 'near_constant' ELSE 'keep' END AS verdict FROM s""")
def _(t):
    return rounded(h.weak_features(features(t), t.spine.count()))


@query("f04_duplicate_columns", f"""{with_(ANCH, FEATS)}, p AS (SELECT a.feature AS f1, b.feature AS f2, count(*) AS same FROM fl a JOIN fl b ON a.entity = b.entity AND a.value = b.value AND a.feature < b.feature GROUP BY 1, 2),
n AS (SELECT feature, count(*) AS n FROM fl GROUP BY 1) SELECT f2 AS feature, min(f1) AS same_as FROM p JOIN n x ON x.feature = f1 JOIN n y ON y.feature = f2 WHERE same = x.n AND same = y.n GROUP BY 1""")
def _(t):
    return h.duplicate_features(features(t)).select("feature", "same_as")


@query("f05_typed_fill", f"""{with_(ANCH, FEATS)}, f AS (SELECT 'SMALL_last' AS feature, (SELECT median(value) FROM fl WHERE feature = 'SMALL_last') AS fill UNION ALL SELECT 'Brand#1_count', 0 UNION ALL SELECT 'LARGE_last', -1)
SELECT s.entity, f.feature, round(coalesce(fl.value, f.fill), 6) AS value FROM spine s CROSS JOIN f LEFT JOIN fl ON fl.entity = s.entity AND fl.feature = f.feature""")
def _(t):
    long = features(t)
    fills = h.fit_fill(long, {"median": ["SMALL_last"], "zero": ["Brand#1_count"], "minus_one": ["LARGE_last"]})
    return rounded(h.typed_fill(long, t.spine, fills))


@query("f06_utilisation_confounds", f"""{with_(ANCH, FEATS)}, tot AS (SELECT count(*) FILTER (WHERE label = 1)::DOUBLE AS p, count(*) FILTER (WHERE label = 0)::DOUBLE AS q FROM spine),
d AS (SELECT feature, (1 - count(*) FILTER (WHERE label = 1) / max(p)) - (1 - count(*) FILTER (WHERE label = 0) / max(q)) AS diff FROM fl JOIN spine USING (entity), tot WHERE feature LIKE '%\\_count' ESCAPE '\\' AND value <> 0 GROUP BY 1),
b AS (SELECT left(feature, length(feature) - 6) AS stem, diff FROM d WHERE diff > 0.02) SELECT DISTINCT f.feature, b.stem, round(b.diff, 6) AS diff FROM fl f JOIN b ON regexp_replace(f.feature, '_[^_]*$', '') = b.stem""")
def _(t):
    return rounded(h.utilisation_confounds(features(t), t.spine, limit=0.02))


@query("f07_family_drop", f"{with_(ANCH, FEATS)} SELECT feature, count(*) AS n FROM fl WHERE NOT regexp_matches(feature, '_copy$|^rare') AND regexp_matches(feature, '_last$|^Brand#1') GROUP BY 1")
def _(t):
    out = h.select_families(features(t), drop=["_copy$", "^rare"], keep=["_last$", "^Brand#1"])
    return out.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


_CM = "cm AS (SELECT entity, max(label) AS label, count(*) AS n, sum(value) AS total, sum(price) AS price, count(DISTINCT event_date) AS days, avg(value) AS mean FROM anch GROUP BY 1)"
_CF = ["n", "total", "price", "days", "mean"]


def corr_matrix(t):
    return t.anch.groupBy("entity").agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.sum("price").alias("price"),
                                        F.count_distinct("event_date").alias("days"), F.avg("value").alias("mean"))


def _corr_sql(limit):
    """The same greedy choice, unrolled over the pairs."""
    pairs = [(_CF[i], _CF[j]) for j in range(len(_CF)) for i in range(j)]
    own = ", ".join(f"abs(corr({f}, label)) AS o_{f}" for f in _CF)
    prs = ", ".join(f"abs(corr({a}, {b})) AS c_{a}_{b}" for a, b in pairs)
    sql = f"{with_(ANCH, _CM)}, k0 AS (SELECT {own}, {prs}, " + ", ".join(f"false AS g_{f}" for f in _CF) + " FROM cm)"
    for s, (i, j) in enumerate(pairs):
        hit = f"NOT g_{i} AND NOT g_{j} AND c_{i}_{j} > {limit}"
        # once j itself is dropped its scan stops; i keeps its state
        sql += f", k{s + 1} AS (SELECT * REPLACE (g_{i} OR ({hit} AND o_{j} >= o_{i}) AS g_{i}, g_{j} OR ({hit} AND o_{j} < o_{i}) AS g_{j}) FROM k{s})"
    return sql + " " + " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST(g_{f} AS INTEGER) AS dropped FROM k{len(pairs)}" for f in _CF)


@query("f08_drop_correlated", _corr_sql(0.9))
def _(t):
    gone = set(h.correlated_drops(corr_matrix(t), _CF, limit=0.9))
    m = corr_matrix(t)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(int(f in gone)).alias("dropped")) for f in _CF])
    return m.groupBy().agg(F.count(F.lit(1))).select(F.explode(rows).alias("r")).select("r.*")


@query("f08_sparse_pairs", f"""{with_(ANCH, FEATS)}, grid AS (SELECT s.entity, f.feature, coalesce(fl.value, 0) AS v FROM spine s CROSS JOIN (SELECT DISTINCT feature FROM fl) f LEFT JOIN fl ON fl.entity = s.entity AND fl.feature = f.feature)
SELECT a.feature AS a, b.feature AS b, round(corr(a.v, b.v), 6) AS corr FROM grid a JOIN grid b ON a.entity = b.entity AND a.feature < b.feature GROUP BY 1, 2 HAVING abs(corr(a.v, b.v)) > 0.4""")
def _(t):
    return rounded(sc.correlated_pairs(features(t), t.spine, 0.4))


def _label_corr(src="fl"):
    return f"""n0 AS (SELECT count(*)::DOUBLE AS n, sum(label)::DOUBLE AS sy FROM spine), lc AS (SELECT feature, (max(n) * sum(value * label) - sum(value) * max(sy)) / nullif(sqrt(greatest(max(n) * sum(value * value) - sum(value) * sum(value), 0)) * sqrt(max(n) * max(sy) - max(sy) * max(sy)), 0) AS c FROM {src} JOIN spine USING (entity), n0 GROUP BY 1)"""


@query("f09_leakage_check", f"""{with_(ANCH, FEATS, _label_corr())} SELECT feature, round(c, 6) AS corr, round(abs(c), 6) AS abs_corr, CASE WHEN abs(c) > 0.06 THEN 'drop' WHEN abs(c) > 0.03 THEN 'review' ELSE 'ok' END AS verdict,
  CAST(row_number() OVER (ORDER BY round(abs(c), 12) DESC NULLS LAST, feature) <= 5 AS INTEGER) AS in_top FROM lc""")
def _(t):
    return rounded(h.leakage_check(features(t), t.spine, 0.06, 0.03, 5))


@query("f10_univariate_auc", f"""{with_(ANCH, FEATS)}, g AS (SELECT f.feature, s.label, coalesce(fl.value, 0) AS v FROM (SELECT DISTINCT feature FROM fl) f CROSS JOIN spine s LEFT JOIN fl ON fl.entity = s.entity AND fl.feature = f.feature),
k AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0::DOUBLE AS rk FROM g),
a AS (SELECT feature, (sum(rk) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)) AS a FROM k GROUP BY 1),
b AS (SELECT feature, greatest(a, 1 - a) AS auc FROM a) SELECT feature, round(auc, 6) AS auc, CASE WHEN auc > 0.55 THEN 'signal' WHEN auc <= 0.52 THEN 'noise' ELSE 'weak' END AS band, CAST(row_number() OVER (ORDER BY round(auc, 12) DESC, feature) AS INTEGER) AS "rank",
  CAST(row_number() OVER (ORDER BY round(auc, 12) DESC, feature) <= 10 AS INTEGER) AS in_top FROM b""")
def _(t):
    return rounded(h.univariate_auc(features(t), t.spine, 10))


@query("f15_deconfound", f"""{AN}, m AS (SELECT entity, count(*) AS events, count(*) FILTER (WHERE category = 'SMALL') AS small, CAST(count(*) FILTER (WHERE category = 'PROMO') > 3 AS INTEGER) AS comorbid, count(DISTINCT category) AS burden FROM anch GROUP BY 1)
SELECT entity, small, comorbid, burden, round(small / greatest(events, 1)::DOUBLE, 6) AS small_rate, small * comorbid AS small_despite, small * 5.0::DOUBLE + comorbid * 3.0::DOUBLE AS signal_index, round((small * 5.0::DOUBLE + comorbid * 3.0::DOUBLE) / greatest(burden, 1), 6) AS signal_per_burden FROM m""")
def _(t):
    c = F.col("category")
    m = t.anch.groupBy("entity").agg(F.count(F.lit(1)).alias("events"), F.count_if(c == "SMALL").alias("small"), x.flag(F.count_if(c == "PROMO") > 3).alias("comorbid"), F.count_distinct("category").alias("burden"))
    return rounded(h.deconfound(m, ["events"], {"small_rate": ("small", "events")}, {"small_despite": ("small", "comorbid")}, {"small": 5.0, "comorbid": 3.0}, "burden"))


@query("f16_build_parity", f"""{with_(ANCH, FEATS)}, a AS (SELECT * FROM fl), anch4 AS (SELECT * FROM anch WHERE event_date >= anchor_date - INTERVAL 48 MONTH),
fl2 AS ({FEATS.partition(" AS (")[2][:-1].replace("FROM anch", "FROM anch4")})
SELECT coalesce(a.entity, b.entity) AS entity, coalesce(a.feature, b.feature) AS feature, round(a.value, 6) AS va, round(b.value, 6) AS vb FROM a FULL JOIN fl2 b ON a.entity = b.entity AND a.feature = b.feature
WHERE NOT coalesce(abs(a.value - b.value) <= 1e-9, false)""")
def _(t):
    """Two builds of all features, from five and from four years of events: what differs."""
    short = t.anch.where(F.col("event_date") >= F.add_months("anchor_date", -48))
    return rounded(assemble.parity(features(t), features(t, short)))


