"""X: column functions, shown on driver columns that carry the shapes they parse."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as x
from ..operators import hygiene
from .base import SPINE, ANCH, PRED, query, r, rounded, with_


@query("x01_clean_id", """
SELECT c_custkey AS k, trim(regexp_replace('{' || c_name || '} ', '[{}"'']', '', 'g')) AS plain,
       upper(trim(regexp_replace('"' || c_name || '"', '[{}"'']', '', 'g'))) AS up
FROM customer""")
def _(t):
    n = F.col("c_name")
    return t.customer.select(
        F.col("c_custkey").alias("k"), x.clean_id(F.concat(F.lit("{"), n, F.lit("} "))).alias("plain"),
        x.clean_id(F.concat(F.lit('"'), n, F.lit('"')), upper=True).alias("up"),
    )


@query("x02_date_from_path", """
SELECT o_orderkey AS k,
       CAST(try_strptime(nullif(regexp_extract('bulk/' || strftime(o_orderdate, '%Y%m%d') || '/part.csv', '/([0-9]{8})/', 1), ''),
            '%Y%m%d') AS DATE) AS d
FROM orders""")
def _(t):
    path = F.concat(F.lit("bulk/"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("/part.csv"))
    return t.orders.select(F.col("o_orderkey").alias("k"), x.date_from_path(path).alias("d"))


@query("x03_exact_long", """
SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS part,
       39115611000001103 + l_partkey AS exact, CAST(NULL AS BIGINT) AS bad
FROM lineitem""")
def _(t):
    big = F.lit(39115611000001103) + F.col("l_partkey")
    return t.lineitem.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        x.exact_long(F.concat(big.cast("string"), F.lit(".0"))).alias("exact"),
        x.exact_long(F.concat(F.lit("x"), big.cast("string"))).alias("bad"),
    )


_RAW = "CASE l_linenumber WHEN 1 THEN 'nan' WHEN 2 THEN '' WHEN 3 THEN ' None ' WHEN 4 THEN '7 mg' ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END"


@query("x04_parse_value", f"""
SELECT l_linenumber AS line, count(*) AS n, count(try_cast(v AS DOUBLE)) AS n_num, sum(try_cast(v AS DOUBLE)) AS total
FROM (SELECT l_linenumber, nullif(nullif(nullif(lower(trim({_RAW})), 'nan'), 'none'), '') AS v FROM lineitem) GROUP BY 1""")
def _(t):
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    raw = F.when(n == 1, "nan").when(n == 2, "").when(n == 3, " None ").when(n == 4, "7 mg").otherwise(q)
    v = t.lineitem.select(n.alias("line"), x.parse_value(raw).alias("v"))
    return v.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_num"), F.sum("v").alias("total"))


@query("x05_year_age", f"""
{with_(SPINE)} SELECT entity, date_diff('year', CAST(DATE '1930-12-31' + CAST(entity % 9000 AS INTEGER) AS DATE), anchor_date) AS age
FROM spine""")
def _(t):
    birth = F.date_add(F.lit("1930-12-31").cast("date"), (F.col("entity") % 9000).cast("int"))
    return t.spine.select("entity", x.year_age("anchor_date", birth).cast("bigint").alias("age"))


@query("x06_months_before", f"""
{with_(ANCH)} SELECT days_before AS days, count(*) AS n, CAST(floor(days_before / 30.0) AS BIGINT) AS m30,
  round(days_before / 30.44::DOUBLE, 1) AS m3044, round(days_before / 30.4375::DOUBLE, 6) AS m304375
FROM anch GROUP BY days_before""")
def _(t):
    d = F.col("days_before")
    return t.anch.groupBy(d.alias("days")).agg(F.count(F.lit(1)).alias("n")).select(
        "days", "n", x.months_before("days").alias("m30"), x.months_before("days", 30.44, "round").alias("m3044"),
        r(x.months_before("days", 30.4375, "exact"), "m304375"),
    )


@query("x07_window_ab", f"""
{with_(ANCH)}, b AS (
  SELECT CASE WHEN months_before BETWEEN 1 AND 30 THEN 'B' WHEN months_before > 30 THEN 'A' END AS open_a,
         CASE WHEN months_before BETWEEN 6 AND 18 THEN 'B' WHEN months_before > 18 AND months_before <= 40 THEN 'A' END AS closed_a
  FROM anch)
SELECT open_a, closed_a, count(*) AS n FROM b GROUP BY 1, 2""")
def _(t):
    return t.anch.groupBy(
        x.window_ab("months_before").alias("open_a"), x.window_ab("months_before", 18, 6, 40).alias("closed_a")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("x08_band", f"""
{with_(SPINE)} SELECT CAST(floor(age / 5.0) * 5 AS INTEGER) AS five, CAST(floor(age / 10.0) * 10 AS INTEGER) AS decade,
  CASE WHEN age >= 0 AND age < 55 THEN '<55' WHEN age < 65 THEN '55-65' WHEN age < 75 THEN '65-75' ELSE '75+' END AS left_closed,
  CASE WHEN age > 0 AND age <= 55 THEN '<=55' WHEN age <= 65 THEN '56-65' ELSE '66+' END AS right_closed, count(*) AS n
FROM spine GROUP BY 1, 2, 3, 4""")
def _(t):
    return t.spine.groupBy(
        x.floor_band("age", 5).alias("five"), x.floor_band("age", 10).alias("decade"),
        x.band("age", [0, 55, 65, 75, 999], ["<55", "55-65", "65-75", "75+"]).alias("left_closed"),
        x.band("age", [0, 55, 65, 999], ["<=55", "56-65", "66+"], right=True).alias("right_closed"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("x09_labels", f"""
{with_(SPINE)}, fit AS (SELECT segment, row_number() OVER (ORDER BY segment) - 1 AS id
  FROM (SELECT DISTINCT segment FROM spine WHERE entity % 2 = 0 AND segment <> 'BUILDING'))
SELECT s.entity, s.segment, CAST(coalesce(f.id, -1) AS BIGINT) AS id FROM spine s LEFT JOIN fit f USING (segment)""")
def _(t):
    train = t.spine.where("entity % 2 = 0 AND segment <> 'BUILDING'")
    fitted = hygiene.fit_labels(train, "segment")
    return hygiene.apply_labels(t.spine, fitted, "segment", "id").select("entity", "segment", "id")


@query("x10_one_hot", f"""
{with_(SPINE)} SELECT entity, CAST(segment = 'BUILDING' AS DOUBLE) AS s_BUILDING, CAST(segment = 'HOUSEHOLD' AS DOUBLE) AS s_HOUSEHOLD,
  CAST(coalesce(segment NOT IN ('BUILDING', 'HOUSEHOLD'), true) AS DOUBLE) AS s_Unknown FROM spine""")
def _(t):
    return t.spine.select("entity", *x.one_hot("segment", ["BUILDING", "HOUSEHOLD"], "s_"))


@query("x12_tag_values", r"""
SELECT page_id, v, length(v) AS n FROM (
  SELECT page_id, lower(CASE WHEN len(f) > 0 THEN array_to_string(f, ' ') ELSE coalesce(html, '') END) AS v
  FROM (SELECT page_id, html, regexp_extract_all(html, '<b[^>]*>([^<]+)</b>', 1) AS f FROM pages))""")
def _(t):
    return t.pages.select("page_id", x.tag_values("html", "b").alias("v")).withColumn("n", F.length("v").cast("bigint"))


@query("x13_strip_boilerplate", r"""
SELECT doc_id, CASE WHEN NOT regexp_matches(text, 'the\s*of|and\s+in') THEN text
  WHEN length(c) > 200 THEN c END AS body
FROM (SELECT doc_id, text, trim(regexp_replace(text, 'the\s*of|and\s+in', '', 'g'), ' ') AS c FROM documents)""")
def _(t):
    return t.documents.select("doc_id", x.strip_boilerplate("text", [r"the\s*of", r"and\s+in"], 200).alias("body"))


@query("x14_first_words", r"""
SELECT doc_id, CASE WHEN len(w) > 40 THEN array_to_string(w[1:40], ' ') ELSE text END AS head
FROM (SELECT doc_id, text, regexp_split_to_array(trim(text, ' '), '\s+') AS w FROM documents)""")
def _(t):
    return t.documents.select("doc_id", x.first_words("text", 40).alias("head"))


_DUR = "CAST(1 + o_orderkey % 9 AS VARCHAR) || ' ' || (CASE o_orderkey % 5 WHEN 0 THEN 'days' WHEN 1 THEN 'Weeks' WHEN 2 THEN 'month' WHEN 3 THEN 'years' ELSE 'often' END)"
_FRQ = "CASE o_orderkey % 6 WHEN 0 THEN 'Daily' WHEN 1 THEN 'weekly ' WHEN 2 THEN 'now and then' WHEN 3 THEN '3 per day' WHEN 4 THEN '2/day' ELSE 'never' END"


@query("x15_duration_frequency", f"""
SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN 30 WHEN 3 THEN 365 END * (1 + o_orderkey % 9) AS days,
  CASE o_orderkey % 6 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 3 END AS freq FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    unit = F.element_at(F.array(*map(F.lit, ["days", "Weeks", "month", "years", "often"])), (k % 5 + 1).cast("int"))
    freq = F.element_at(F.array(*map(F.lit, ["Daily", "weekly ", "now and then", "3 per day", "2/day", "never"])), (k % 6 + 1).cast("int"))
    return t.orders.select(
        k.alias("k"), x.parse_duration(F.concat((1 + k % 9).cast("string"), F.lit(" "), unit)).cast("bigint").alias("days"),
        x.parse_frequency(freq).alias("freq"),
    )


@query("x16_concern", """
SELECT l_returnflag AS f, l_linestatus AS s, greatest(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 3 END,
  CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END) AS concern, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""")
def _(t):
    sev = F.when(F.col("l_returnflag") == "A", "Mild").when(F.col("l_returnflag") == "R", "+++")
    prog = F.when(F.col("l_linestatus") == "F", "improving").otherwise("stable")
    return t.lineitem.groupBy(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), x.concern(sev, prog).alias("concern")).agg(
        F.count(F.lit(1)).alias("n"))


@query("x17_numeric_transforms", f"""
{with_(SPINE)} SELECT entity, round(ln(1 + greatest(balance, 0)), 6) AS balance_log1p, round(sqrt(greatest(balance, 0)), 6) AS balance_sqrt,
  round(balance * balance, 4) AS balance_sq, round(balance * balance * balance / 1e6::DOUBLE, 4) AS balance_cube, round(abs(balance - 5000), 6) AS balance_from_peak FROM spine""")
def _(t):
    out = t.spine.select("entity", *x.numeric_transforms("balance", peak=5000))
    out = out.withColumn("balance_sq", F.round("balance_sq", 4)).withColumn("balance_cube", F.round(F.col("balance_cube") / 1e6, 4))
    return rounded(out, "balance_sq", "balance_cube")


@query("x18_prior_shift", f"""
{with_(PRED)} SELECT entity, round(1 / (1 + exp(-(ln(q / (1 - q)) + ln(tau / (1 - tau))))), 6) AS p_band,
  round(1 / (1 + exp(-(ln(q / (1 - q)) + ln(0.0018::DOUBLE / (1 - 0.0018::DOUBLE))))), 6) AS p_global
FROM (SELECT entity, least(greatest(score, 1e-6::DOUBLE), (1 - 1e-6)::DOUBLE) AS q,
  CASE WHEN age < 60 THEN 0.001::DOUBLE ELSE 0.004::DOUBLE END AS tau FROM pred)""")
def _(t):
    tau = F.when(F.col("age") < 60, 0.001).otherwise(0.004)
    return t.pred.select("entity", r(x.prior_shift("score", tau), "p_band"), r(x.prior_shift("score", 0.0018), "p_global"))


@query("x19_guarded_ratio", f"""
{with_(ANCH)}, c AS (SELECT entity, count(*) FILTER (WHERE time_window = 'A' AND category = 'SMALL') AS a,
  count(*) FILTER (WHERE time_window = 'B' AND category = 'SMALL') AS b FROM anch GROUP BY entity)
SELECT entity, round(b / greatest(a, 1)::DOUBLE, 6) AS clip, round(least((b + 1) / (a + 1)::DOUBLE, 2), 6) AS plus_one,
  round(b / (a + 1)::DOUBLE, 6) AS denom_one, round(CASE WHEN a > 0 THEN b / a::DOUBLE WHEN b > 0 THEN 2 ELSE 0 END, 6) AS only_b,
  round(CASE WHEN a <> 0 THEN b / a::DOUBLE END, 6) AS null_safe FROM c""")
def _(t):
    small = F.col("category") == "SMALL"
    c = t.anch.groupBy("entity").agg(
        F.count_if(small & (F.col("time_window") == "A")).alias("a"), F.count_if(small & (F.col("time_window") == "B")).alias("b"))
    return c.select("entity", r(x.ratio("b", "a"), "clip"), r(x.ratio("b", "a", "plus_one", 2), "plus_one"),
                    r(x.ratio("b", "a", "denom_one"), "denom_one"), r(x.ratio("b", "a", "only_b"), "only_b"),
                    r(x.ratio("b", "a", "null"), "null_safe"))
