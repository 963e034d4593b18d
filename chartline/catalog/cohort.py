"""C and J: cohort construction on the customer history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as x
from ..operators import cohort as c, hygiene, split as sp
from ..skew import one_row
from .base import ANCH, HIST, SPINE, query, r, with_

TARGET = "SELECT p_partkey AS code FROM part WHERE lower(p_name) LIKE '%red ring%'"
OTHER = "SELECT p_partkey AS code FROM part WHERE lower(p_name) LIKE '%blue bolt%'"


def target(t):
    return c.codes_like(t.part, "p_name", "p_partkey", like="%red ring%")


def other(t):
    return c.codes_like(t.part, "p_name", "p_partkey", like="%blue bolt%")


def one(col="n"):
    return F.count(F.lit(1)).alias(col)


@query("c01_latest_snapshot", """
SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, CAST(l_shipdate AS DATE) AS ship, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey
    ORDER BY l_shipdate DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1""")
def _(t):
    out = c.latest(t.lineitem, ["l_orderkey", "l_partkey"], ["l_shipdate", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", F.to_date("l_shipdate").alias("ship"), "l_quantity", "l_extendedprice")


@query("c02_exclude_holdout", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (
  SELECT c_custkey FROM customer WHERE c_nationkey = 3 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0 OR c_custkey % 10 = 7)""")
def _(t):
    held = t.customer.where("c_nationkey = 3").select(F.col("c_custkey").alias("entity"))
    more = t.customer.where("c_acctbal < 0 OR c_custkey % 10 = 7").select(F.col("c_custkey").alias("entity"))
    o = t.orders.select("o_orderkey", F.col("o_custkey").alias("entity"))
    return c.exclude(o, c.union_ids(held, more)).select("o_orderkey", F.col("entity").alias("o_custkey"))


@query("c03_decode_and_enrich", """
WITH prob AS (SELECT l_orderkey, l_suppkey % 4 AS site, l_linenumber, max(l_returnflag) AS status FROM lineitem
  WHERE l_returnflag <> 'N' GROUP BY ALL),
obs AS (SELECT l_orderkey, l_linenumber, l_suppkey % 4 AS site, l_partkey AS code_id, CAST(l_shipdate AS DATE) AS event_date, l_quantity
  FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '2000-01-01')
SELECT o.l_orderkey AS entity, o.l_linenumber AS obs_id, o.site, o.code_id, o.event_date, o.l_quantity AS value, p.p_name AS term, b.status
FROM obs o LEFT JOIN part p ON o.code_id = p.p_partkey AND o.site = p.p_partkey % 4
LEFT JOIN prob b ON b.l_orderkey = o.l_orderkey AND b.site = o.site AND b.l_linenumber = o.l_linenumber""")
def _(t):
    site = F.col("l_suppkey") % 4
    li = t.lineitem.select(
        F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("obs_id"), site.alias("site"),
        F.concat(F.col("l_partkey").cast("string"), F.lit(".0")).alias("code_id"), F.to_date("l_shipdate").alias("event_date"),
        F.col("l_quantity").alias("value"), F.col("l_returnflag").alias("status"))
    dictionary = t.part.select(F.col("p_partkey").cast("string").alias("code_id"), (F.col("p_partkey") % 4).alias("site"), F.col("p_name").alias("term"))
    prob = li.where("status <> 'N'").groupBy("entity", "site", "obs_id").agg(F.max("status").alias("status"))
    out = c.decode(li.drop("status"), dictionary, prob, "1996-01-01", "2000-01-01")
    return out.select("entity", "obs_id", "site", "code_id", "event_date", "value", "term", "status")


@query("c04_target_codes", "SELECT DISTINCT p_partkey AS code FROM part WHERE lower(p_name) LIKE '%ring%' AND lower(p_name) NOT LIKE '%red%'")
def _(t):
    return c.codes_like(t.part, "p_name", "p_partkey", "%ring%", "%red%")


@query("c05_ever_has", f"{with_(HIST)} SELECT DISTINCT entity FROM hist WHERE code IN ({TARGET})")
def _(t):
    return c.ever_has(t.hist, target(t))


_BIRTH = "CAST(DATE '1930-06-15' + CAST(entity % 20000 AS INTEGER) AS DATE)"


def birth(t):
    return t.spine.select("entity", F.date_add(F.lit("1930-06-15").cast("date"), (F.col("entity") % 20000).cast("int")).alias("birth_date"))


@query("c06_first_event_anchor", f"""{with_(HIST)} SELECT entity, event_date AS anchor_date, code AS target FROM (
  SELECT entity, event_date, code, row_number() OVER (PARTITION BY entity ORDER BY event_date, code) AS rn FROM hist
  WHERE code IN ({TARGET}) AND event_date >= DATE '1996-01-01' AND event_date < DATE '2001-01-01'
    AND date_diff('year', {_BIRTH}, event_date) >= 18) WHERE rn = 1""")
def _(t):
    return c.first_event(t.hist, target(t), "1996-01-01", "2001-01-01", birth(t), 18)


@query("c07_negatives", f"""{with_(HIST)} SELECT DISTINCT entity FROM hist WHERE entity NOT IN (SELECT entity FROM hist WHERE code IN ({TARGET}))
  AND entity NOT IN (SELECT entity FROM hist WHERE code IN ({OTHER}))""")
def _(t):
    return c.negatives(t.hist, c.ever_has(t.hist, target(t)), c.ever_has(t.hist, other(t)))


@query("c08_hash_sampled_anchor", f"""{with_(HIST)} SELECT entity, event_date AS anchor_date FROM (
  SELECT entity, event_date, row_number() OVER (PARTITION BY entity ORDER BY md5(concat_ws('|', entity, event_date, code)), event_date) AS rn
  FROM hist WHERE event_date >= DATE '1996-01-01' AND term NOT LIKE '%ring%') WHERE rn = 1""")
def _(t):
    keep = (F.col("event_date") >= F.lit("1996-01-01").cast("date")) & ~F.col("term").like("%ring%")
    return c.sampled_anchor(t.hist, keep)


@query("c09_last_record_anchor", "SELECT o_custkey AS entity, CAST(max(o_orderdate) AS DATE) AS anchor_date FROM orders GROUP BY 1")
def _(t):
    return c.last_anchor(t.orders.select(F.col("o_custkey").alias("entity"), F.to_date("o_orderdate").alias("event_date")))


@query("c10_count_in_window", f"""{with_(ANCH)},
o AS (SELECT entity, count(*) AS n_obs FROM (SELECT DISTINCT entity, event_date, code, term, value FROM anch WHERE event_type = 'obs') GROUP BY 1 HAVING count(*) >= 10),
m AS (SELECT entity, count(*) AS n_med FROM (SELECT DISTINCT entity, event_date, code, term, value FROM anch WHERE event_type = 'med') GROUP BY 1 HAVING count(*) >= 8)
SELECT entity, n_obs, n_med FROM o JOIN m USING (entity)""")
def _(t):
    on = ["entity", "event_date", "code", "term", "value"]
    obs = c.min_events(t.anch.where("event_type = 'obs'"), 10, distinct_on=on).withColumnRenamed("n_events", "n_obs")
    med = c.min_events(t.anch.where("event_type = 'med'"), 8, distinct_on=on).withColumnRenamed("n_events", "n_med")
    return obs.join(med, "entity")


def cases(t):
    return c.first_event(t.hist, target(t), "1996-01-01", "2001-01-01")


def controls(t):
    neg = c.negatives(t.hist, c.ever_has(t.hist, target(t)))
    return c.sampled_anchor(t.hist.join(neg, "entity", "left_semi"), F.col("event_date") >= F.lit("1996-01-01").cast("date"))


CASES = f"""cases AS (SELECT entity, event_date AS anchor_date, code AS target FROM (
  SELECT entity, event_date, code, row_number() OVER (PARTITION BY entity ORDER BY event_date, code) AS rn FROM hist
  WHERE code IN ({TARGET}) AND event_date >= DATE '1996-01-01' AND event_date < DATE '2001-01-01') WHERE rn = 1)"""
CONTROLS = f"""controls AS (SELECT entity, event_date AS anchor_date FROM (
  SELECT entity, event_date, row_number() OVER (PARTITION BY entity ORDER BY md5(concat_ws('|', entity, event_date, code)), event_date) AS rn
  FROM hist WHERE event_date >= DATE '1996-01-01' AND entity NOT IN (SELECT entity FROM hist WHERE code IN ({TARGET}))) WHERE rn = 1)"""


@query("c11_unify", f"""{with_(HIST, CASES, CONTROLS)}
SELECT entity, anchor_date, target, 1 AS label, year(anchor_date) AS anchor_year FROM cases
UNION ALL SELECT entity, anchor_date, NULL, 0, year(anchor_date) FROM controls""")
def _(t):
    return c.unify(cases(t), controls(t))


@query("c12_ratio_sample", f"""{with_(HIST, CASES, CONTROLS)}, need AS (SELECT year(anchor_date) AS y, count(*) AS n FROM cases GROUP BY 1),
rk AS (SELECT entity, anchor_date, year(anchor_date) AS y,
  row_number() OVER (PARTITION BY year(anchor_date) ORDER BY md5(concat_ws('|', entity, 'ncsalt'))) AS rn FROM controls)
SELECT entity, anchor_date, y AS anchor_year FROM rk JOIN need USING (y) WHERE rn <= 1 * n""")
def _(t):
    year = F.year("anchor_date")
    out = c.ratio_sample(controls(t).withColumn("anchor_year", year), cases(t).withColumn("anchor_year", year), ["anchor_year"], 1)
    return out.select("entity", "anchor_date", "anchor_year")


_SPLIT11 = """ids AS (SELECT entity, label FROM spine WHERE label = 1 AND entity % 10 < 3 OR label = 0 AND entity % 10 < 2),
split AS (SELECT entity, label, CASE WHEN rn <= floor(0.8::DOUBLE * n + 0.5::DOUBLE) THEN 'train' WHEN rn <= floor((0.8::DOUBLE + 0.1::DOUBLE) * n + 0.5::DOUBLE) THEN 'valid' ELSE 'test' END AS split
  FROM (SELECT entity, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', entity, '42'))) AS rn,
    count(*) OVER (PARTITION BY label) AS n FROM ids))"""


def split11(t):
    ids = t.spine.where("label = 1 AND entity % 10 < 3 OR label = 0 AND entity % 10 < 2")
    return sp.split(ids, {"train": 0.8, "valid": 0.1, "test": 0.1}, seed=42)


@query("c13_extend_ratio", f"""{with_(SPINE, _SPLIT11)},
need AS (SELECT split, greatest(2 * count(*) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 0), 0) AS add_n FROM split GROUP BY 1),
rng AS (SELECT split, sum(add_n) OVER (ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'valid' THEN 2 ELSE 3 END) AS hi, add_n FROM need),
pool AS (SELECT entity, row_number() OVER (ORDER BY md5(concat_ws('|', entity, '42'))) AS rn FROM spine WHERE label = 0 AND entity NOT IN (SELECT entity FROM split))
SELECT entity, split, label FROM split UNION ALL SELECT p.entity, g.split, 0 FROM pool p JOIN rng g ON p.rn > g.hi - g.add_n AND p.rn <= g.hi""")
def _(t):
    return c.extend_ratio(split11(t), t.spine.where("label = 0"), 2)


@query("c14_fixed_cohort", f"{with_(HIST, CASES)} SELECT entity, anchor_date FROM cases WHERE entity IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE')")
def _(t):
    ids = t.customer.where("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("entity"))
    return c.fixed(cases(t).select("entity", "anchor_date"), ids)


@query("c15_dispense_facts", """
SELECT o_orderkey AS record_id, o_custkey AS entity, l_linenumber AS issue_id, CAST(l_shipdate AS DATE) AS event_date, l_partkey AS code_id,
  p_name AS drug_term, CAST(l_quantity AS INTEGER) AS duration
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey AND p_partkey % 3 = o_custkey % 3
WHERE coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'F' END, false) = false AND coalesce(l_returnflag = 'R', false) = false""")
def _(t):
    rec = t.orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("entity"), (F.col("o_custkey") % 3).alias("site"),
                          F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("deleted"))
    iss = t.lineitem.select(F.col("l_orderkey").alias("record_id"), F.col("l_linenumber").alias("issue_id"), F.to_date("l_shipdate").alias("event_date"),
                            F.col("l_partkey").alias("code_id"), F.col("l_quantity").cast("int").alias("duration"), (F.col("l_returnflag") == "R").alias("deleted"))
    codes = t.part.select(F.col("p_partkey").alias("code_id"), (F.col("p_partkey") % 3).alias("site"), F.col("p_name").alias("drug_term"))
    return c.dispenses(rec, iss, codes).select("record_id", "entity", "issue_id", "event_date", "code_id", "drug_term", "duration")


@query("c16_lookback_observations", f"""{with_(HIST, SPINE)}
SELECT DISTINCT h.entity, s.anchor_date, s.label, h.event_date, h.code, h.term, h.value, CAST(s.anchor_date - h.event_date AS INTEGER) AS days_before,
  year(s.anchor_date) AS anchor_year
FROM hist h JOIN spine s ON h.entity = s.entity WHERE h.event_type = 'obs' AND h.event_date >= s.anchor_date - INTERVAL 3 YEAR
  AND h.event_date < s.anchor_date - INTERVAL 12 MONTH AND h.code NOT IN ({TARGET}) AND h.status NOT IN ('A') AND lower(h.term) NOT LIKE '%bolt%'""")
def _(t):
    return c.lookback(t.spine, t.hist.where("event_type = 'obs'"), 3, 12, target(t), not_types=["A"], type_col="status", not_like="%bolt%",
                      distinct_on=["entity", "anchor_date", "label", "event_date", "code", "term", "value", "days_before", "anchor_year"])


@query("c17_lookback_medications", f"""{with_(HIST, SPINE)}
SELECT DISTINCT CAST(h.entity AS VARCHAR) AS entity, h.event_date, h.code, h.term AS drug_term, CAST(s.anchor_date - h.event_date AS INTEGER) AS days_before,
  date_diff('year', {_BIRTH.replace('entity', 's.entity')}, s.anchor_date) AS age_at_anchor, date_diff('year', {_BIRTH.replace('entity', 's.entity')}, h.event_date) AS event_age
FROM hist h JOIN spine s ON h.entity = s.entity WHERE h.event_type = 'med' AND h.event_date >= s.anchor_date - INTERVAL 3 YEAR
  AND h.event_date < s.anchor_date - INTERVAL 1 MONTH""")
def _(t):
    braced = F.concat(F.lit("{"), F.col("entity").cast("string"), F.lit("}"))
    med = t.hist.where("event_type = 'med'").withColumn("entity", braced)
    spine = t.spine.join(birth(t), "entity").withColumn("entity", F.col("entity").cast("string"))
    out = c.lookback(spine, med, 3, 1, birth=True, clean=True, admin=(),
                     distinct_on=["entity", "event_date", "code", "term", "days_before", "age_at_anchor", "event_age"])
    return out.withColumnRenamed("term", "drug_term").withColumn("age_at_anchor", F.col("age_at_anchor").cast("bigint")).withColumn(
        "event_age", F.col("event_age").cast("bigint"))


@query("c18_curated_only", f"{with_(ANCH)} SELECT entity, count(*) AS n FROM anch WHERE code IN (SELECT p_partkey FROM part WHERE p_size <= 10) GROUP BY 1")
def _(t):
    codes = t.part.where("p_size <= 10").select(F.col("p_partkey").alias("code"))
    return c.restrict(t.anch, codes).groupBy("entity").agg(one())


@query("c19_concept_patterns", """
SELECT p_partkey, p_brand, p_name FROM part WHERE (p_type = 'PROMO' AND regexp_matches(p_brand, '^Brand#(1|2)[0-3]$'))
  OR (p_type = 'SMALL' AND (lower(p_name) LIKE '%ring%' OR lower(p_name) LIKE 'red%')) OR (p_type = 'LARGE' AND p_brand IN ('Brand#7', 'Brand#8'))""")
def _(t):
    rules = [("PROMO", "code_regex", "^Brand#(1|2)[0-3]$"), ("SMALL", "text_like", "%ring%"), ("SMALL", "text_like", "red%"),
             ("LARGE", "code_in", ("Brand#7", "Brand#8"))]
    return c.concepts(t.part, rules, "p_type", "p_brand", "p_name").select("p_partkey", "p_brand", "p_name")


@query("c20_min_events_window", f"""{with_(ANCH)} SELECT entity, event_date, code, value FROM (
  SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM anch) WHERE n >= 30""")
def _(t):
    return c.min_rows(t.anch, 30).select("entity", "event_date", "code", "value")


@query("c21_event_union", f"""{with_(ANCH)}
SELECT entity, event_date, 'observation' AS event_type, code AS obs_code, value, CAST(NULL AS BIGINT) AS med_code, CAST(NULL AS DOUBLE) AS duration FROM anch WHERE event_type = 'obs'
UNION ALL SELECT entity, event_date, 'medication', NULL, NULL, code, value FROM anch WHERE event_type = 'med'""")
def _(t):
    obs = t.anch.where("event_type = 'obs'").select("entity", "event_date", F.col("code").alias("obs_code"), "value")
    med = t.anch.where("event_type = 'med'").select("entity", "event_date", F.col("code").alias("med_code"), F.col("value").alias("duration"))
    return c.event_union(obs, med)


@query("c22_lifetime_flags", f"""{with_(HIST, SPINE)}
SELECT s.entity, coalesce(max(CASE WHEN brand IN ('Brand#1', 'Brand#2') THEN 1 ELSE 0 END), 0) AS smoker,
  coalesce(max(CASE WHEN brand = 'Brand#9' THEN 1 ELSE 0 END), 0) AS diabetes, coalesce(max(CASE WHEN brand = 'Brand#25' THEN 1 ELSE 0 END), 0) AS other_target
FROM spine s LEFT JOIN hist h ON h.entity = s.entity AND h.event_date < s.anchor_date - INTERVAL 12 MONTH GROUP BY 1""")
def _(t):
    return c.lifetime_flags(t.spine, t.hist, {"smoker": ["Brand#1", "Brand#2"], "diabetes": ["Brand#9"]}, 12, on="brand", other=["Brand#25"])


_ROWLABEL = f"{HIST}, lab AS (SELECT entity, event_date, code, category, line, CASE WHEN status = 'A' AND code % 7 = 0 THEN 1 ELSE entity % 2 END AS label FROM hist)"


def rowlabel(t):
    y = F.when((F.col("status") == "A") & (F.col("code") % 7 == 0), 1).otherwise(F.col("entity") % 2)
    return t.hist.select("entity", "event_date", "code", "category", "line", y.alias("label"))


@query("c23_fix_label_overlap", f"""{with_(_ROWLABEL)}, b AS (SELECT entity FROM lab GROUP BY 1 HAVING count(DISTINCT label) > 1)
SELECT 'keep' AS mode, entity, label, count(*) AS n FROM lab WHERE NOT (label = 0 AND entity IN (SELECT entity FROM b)) GROUP BY ALL
UNION ALL SELECT 'drop', entity, label, count(*) FROM lab WHERE entity NOT IN (SELECT entity FROM b) GROUP BY ALL""")
def _(t):
    ev = rowlabel(t)
    def n(df, mode):
        return df.groupBy("entity", "label").agg(one()).withColumn("mode", F.lit(mode))
    return n(c.fix_overlap(ev), "keep").unionByName(n(c.fix_overlap(ev, "drop"), "drop"))


@query("c24_drop_side_only", f"""{with_(ANCH)} SELECT entity, count(*) AS n FROM anch WHERE event_type = 'med' AND entity IN (
  SELECT entity FROM anch WHERE event_type = 'obs' AND category = 'SMALL') GROUP BY 1""")
def _(t):
    return c.drop_side_only(t.anch.where("event_type = 'obs' AND category = 'SMALL'"), t.anch.where("event_type = 'med'")).groupBy("entity").agg(one())


@query("c25_dedup_rows", f"{with_(ANCH)} SELECT DISTINCT entity, event_date, code, category, label FROM anch")
def _(t):
    return c.dedup(t.anch).select("entity", "event_date", "code", "category", "label")


@query("c26_eligibility", f"""{with_(ANCH)} SELECT entity, count(*) AS n FROM anch WHERE entity NOT IN (
  SELECT entity FROM anch WHERE age < 50 OR sex <> 'M') GROUP BY 1""")
def _(t):
    return c.eligible(t.anch, "M", 50).groupBy("entity").agg(one())


@query("c27_entity_lists", f"""{with_(ANCH)}, m AS (SELECT entity, max(row(event_age, label, sex, anchor_date)) AS r FROM (
  SELECT *, age - CAST(floor(days_before / 365.25) AS INTEGER) AS event_age FROM anch) GROUP BY entity),
ids AS (SELECT entity FROM anch WHERE time_window = 'A' UNION SELECT entity FROM anch WHERE category = 'PROMO')
SELECT m.entity, r[1] AS age, r[2] AS label, r[3] AS sex, r[4] AS anchor_date, CAST(ids.entity IS NOT NULL AS INTEGER) AS in_training
FROM m LEFT JOIN ids ON ids.entity = m.entity""")
def _(t):
    rows = t.anch.withColumn("age", F.col("age") - F.floor(F.col("days_before") / 365.25).cast("int"))
    ids = c.union_ids(t.anch.where("time_window = 'A'"), t.anch.where("category = 'PROMO'")).withColumn("in_training", F.lit(1))
    return c.master(rows).join(ids, "entity", "left").na.fill(0, ["in_training"])


@query("c28_leak_guard", f"""{with_(HIST, SPINE)}, j AS (SELECT h.entity, h.event_date, s.anchor_date FROM hist h JOIN spine s ON s.entity = h.entity)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE event_date >= anchor_date) AS n_leaky, count(*) FILTER (WHERE event_date < anchor_date) AS n_kept FROM j""")
def _(t):
    j = t.hist.join(t.spine.select("entity", "anchor_date"), "entity")
    return one_row(c.leak_counts(j), c.leak_guard(j).agg(one("n_kept")))


@query("c29_drop_leaky_codes", f"{with_(ANCH)} SELECT event_type, count(*) AS n FROM anch WHERE code NOT IN (SELECT p_partkey FROM part WHERE p_name LIKE '%ring%') GROUP BY 1")
def _(t):
    return c.drop_codes(t.anch, c.codes_like(t.part, "p_name", "p_partkey", "%ring%")).groupBy("event_type").agg(one())


@query("c30_range_clamp", f"""{with_(ANCH)} SELECT category, term, count(*) AS n, count(CASE WHEN (category = 'SMALL' AND term = 'red ring' AND value NOT BETWEEN 5 AND 30)
  OR (category = 'LARGE' AND term = 'blue bolt' AND value NOT BETWEEN 10 AND 40) THEN NULL ELSE value END) AS n_value FROM anch GROUP BY 1, 2""")
def _(t):
    out = c.clamp(t.anch, [("SMALL", "red ring", 5, 30), ("LARGE", "blue bolt", 10, 40)])
    return out.groupBy("category", "term").agg(one(), F.count("value").alias("n_value"))


@query("c31_drop_sparse_column", f"""{with_(ANCH)} SELECT entity, count(dose) AS dose FROM (
  SELECT entity, CASE WHEN value > 40 THEN value END AS dose FROM anch) GROUP BY 1""")
def _(t):
    df = t.anch.select("entity", F.when(F.col("value") > 40, F.col("value")).alias("dose"), F.when(F.col("value") > 49, F.col("value")).alias("rare"))
    out = c.drop_sparse(df, ["dose", "rare"])
    return out.groupBy("entity").agg(*[F.count(v).alias(v) for v in out.columns if v != "entity"])


@query("c32_map_categories", f"""{with_(ANCH)} SELECT event_type, p_brand AS category, time_window, count(*) AS n FROM anch JOIN part ON p_partkey = code
  AND ((event_type = 'obs' AND p_size <= 25) OR (event_type = 'med' AND p_size > 20)) WHERE time_window IS NOT NULL GROUP BY ALL""")
def _(t):
    p = t.part.select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("category"), "p_size")
    cmap = p.where("p_size <= 25").withColumn("event_type", F.lit("obs")).unionByName(p.where("p_size > 20").withColumn("event_type", F.lit("med")))
    return c.categorize(t.anch.drop("category"), cmap).groupBy("event_type", "category", "time_window").agg(one())


@query("c33_placeholder_rows", f"""{with_(ANCH)} SELECT entity, label, CAST(anchor_date - INTERVAL 30 MONTH AS DATE) AS event_date, 30 AS months_before,
  'A' AS time_window, '__PLACEHOLDER__' AS category, -1 AS code FROM spine WHERE entity NOT IN (SELECT entity FROM anch WHERE category = 'SMALL' AND value > 45)""")
def _(t):
    out = c.placeholders(t.spine, t.anch.where("category = 'SMALL' AND value > 45"))
    return out.select("entity", "label", "event_date", "months_before", "time_window", "category", "code")


@query("c34_roster_align", f"""{with_(ANCH)}, m AS (SELECT entity, count(*) AS n, round(avg(value), 6) AS mean FROM anch WHERE category = 'SMALL' AND value > 40 GROUP BY 1)
SELECT s.entity, s.label, coalesce(m.n, 0) AS n, m.mean FROM spine s LEFT JOIN m USING (entity)""")
def _(t):
    mat = t.anch.where("category = 'SMALL' AND value > 40").groupBy("entity").agg(one(), r(F.avg("value"), "mean"))
    return c.align(t.spine.select("entity", "label"), mat, zero=["n"])


@query("c35_derive_anchor", f"""{with_(HIST)} SELECT entity, event_date, code, line, anchor_date, CAST(anchor_date - event_date AS INTEGER) AS days_before,
  CAST(floor(CAST(anchor_date - event_date AS INTEGER) / 30.0) AS BIGINT) AS months_before FROM (SELECT *, max(event_date) OVER (PARTITION BY entity) AS anchor_date FROM hist)""")
def _(t):
    return c.derive_anchor(t.hist).select("entity", "event_date", "code", "line", "anchor_date", "days_before", "months_before")


@query("c36_multi_window_fanout", f"""{with_(ANCH)} SELECT gap, time_window, count(*) AS n, count(DISTINCT entity) AS n_entities FROM (
  SELECT entity, gap, CASE WHEN months_before - gap + 1 BETWEEN 1 AND 18 THEN 'B' WHEN months_before - gap + 1 > 18 AND months_before - gap + 1 <= 36 THEN 'A' END AS time_window
  FROM anch, (VALUES (1), (3), (6), (12)) g(gap) WHERE months_before >= gap AND months_before < gap + 36) GROUP BY 1, 2""")
def _(t):
    out = c.fanout(t.anch, [1, 3, 6, 12], 36, mid=18)
    return out.groupBy("gap", "time_window").agg(one(), F.countDistinct("entity").alias("n_entities"))


@query("c37_drop_shortcut_terms", f"{with_(ANCH)} SELECT term, count(*) AS n FROM anch WHERE NOT regexp_matches(lower(term), 'ring|^blue') GROUP BY 1")
def _(t):
    return c.drop_terms(t.anch, ["ring", "^blue"]).groupBy("term").agg(one())


@query("c38_cap_balanced", f"""{with_(SPINE)} SELECT entity, label FROM (SELECT entity, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', entity, 'cap'))) AS rn
  FROM spine) WHERE CASE WHEN label = 1 THEN rn <= 100 ELSE rn <= 250 END""")
def _(t):
    return c.cap_balanced(t.spine, 100, 250, "cap").select("entity", "label")


_TXT = "txt AS (SELECT entity, code, days_before, term, CASE line % 4 WHEN 0 THEN 'present' WHEN 1 THEN 'historical' WHEN 2 THEN 'absent' ELSE 'family' END AS assertion FROM anch WHERE event_type = 'med' OR code % 3 = 0)"


def text_events(t):
    names = F.element_at(F.array(*map(F.lit, ["present", "historical", "absent", "family"])), (F.col("line") % 4 + 1).cast("int"))
    return t.anch.where("event_type = 'med' OR code % 3 = 0").select("entity", "code", "days_before", "term", names.alias("assertion"))


@query("c39_merge_text_events", f"""{with_(ANCH, _TXT)}, st AS (SELECT entity, code, days_before, term FROM anch WHERE event_type = 'obs')
SELECT entity, assertion, count(*) AS n FROM (
  SELECT entity, code, days_before, term, NULL AS assertion FROM st
  UNION ALL SELECT entity, code, days_before, min(term), min(assertion) FROM txt WHERE assertion IN ('present', 'historical')
    AND NOT EXISTS (SELECT 1 FROM st WHERE st.entity = txt.entity AND st.code = txt.code AND st.days_before = txt.days_before) GROUP BY 1, 2, 3
  UNION ALL SELECT DISTINCT entity, code, days_before, term, assertion FROM txt WHERE assertion IN ('absent', 'family')) GROUP BY 1, 2""")
def _(t):
    st = t.anch.where("event_type = 'obs'").select("entity", "code", "days_before", "term")
    return c.merge_text(st, text_events(t)).groupBy("entity", "assertion").agg(one())


@query("c40_assertion_split", f"""{with_(ANCH, _TXT)} SELECT entity, count(*) FILTER (WHERE assertion IN ('present', 'historical')) AS n_base,
  count(*) FILTER (WHERE assertion IN ('absent', 'family')) AS n_side FROM txt GROUP BY 1""")
def _(t):
    base, side = c.split_assertion(text_events(t))
    b, s = base.groupBy("entity").agg(one("n_base")), side.groupBy("entity").agg(one("n_side"))
    return b.join(s, "entity", "full_outer").na.fill(0)


@query("j01_code_pick_join", f"""{with_(ANCH)}, u AS (SELECT entity, event_type, CASE WHEN event_type = 'obs' THEN code END AS obs_code, CASE WHEN event_type = 'med' THEN code + 1 END AS med_code FROM anch)
SELECT event_type, p_brand AS category, count(*) AS n FROM u JOIN part ON p_partkey = CASE WHEN event_type = 'obs' THEN obs_code ELSE med_code END GROUP BY 1, 2""")
def _(t):
    u = t.anch.select("entity", "event_type", F.when(F.col("event_type") == "obs", F.col("code")).alias("obs_code"),
                      F.when(F.col("event_type") == "med", F.col("code") + 1).alias("med_code"))
    p = t.part.select(F.col("p_partkey").alias("code"), F.col("p_brand").alias("category"))
    return u.withColumn("code", c.pick_code()).join(p, "code").groupBy("event_type", "category").agg(one())


@query("j02_merge_by_key_only", f"""{with_(ANCH)}, a AS (SELECT entity, count(*) AS n_small FROM anch WHERE category = 'SMALL' GROUP BY 1),
b AS (SELECT entity, max(value) AS max_large FROM anch WHERE category = 'LARGE' GROUP BY 1), d AS (SELECT entity, min(sex) AS sex, min(age) AS age FROM anch GROUP BY 1)
SELECT coalesce(a.entity, b.entity) AS entity, n_small, max_large, d.sex, d.age FROM a FULL JOIN b ON a.entity = b.entity LEFT JOIN d ON d.entity = coalesce(a.entity, b.entity)""")
def _(t):
    a = t.anch.where("category = 'SMALL'").groupBy("entity").agg(one("n_small"))
    b = t.anch.where("category = 'LARGE'").groupBy("entity").agg(F.max("value").alias("max_large"))
    return c.merge_features([a, b], t.anch, ["sex", "age"])


@query("j03_stamp_split", f"""{with_(SPINE, _SPLIT11)}, mat AS (SELECT entity FROM spine WHERE entity % 9 <> 4)
SELECT (SELECT count(*) FROM mat WHERE entity NOT IN (SELECT entity FROM split)) AS n_uncovered,
  (SELECT count(*) FROM split WHERE entity NOT IN (SELECT entity FROM mat)) AS n_missing, 0 AS n_drift""")
def _(t):
    s = split11(t)
    return c.stamp_problems(c.stamp(t.spine.where("entity % 9 <> 4").select("entity"), s), s)
