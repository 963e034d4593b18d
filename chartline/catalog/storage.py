"""S: sources and sinks, round trips through the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohort
from ..session import scratch
from ..sources import tables as s
from .base import ANCH, HIST, SPINE, query, r, rounded, with_

AN = with_(ANCH)


@query("s01_read_table", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    # the CSV path is not there: its Parquet sibling is read
    return s.read_table(t.spark, f"{t.folder}/orders.csv").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_totalprice")


@query("s02_write_table", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2")
def _(t):
    path = s.write_table(t.lineitem.select("l_returnflag", "l_linestatus", "l_quantity"), scratch(t.spark, "lineitem.parquet"), "parquet")
    return t.spark.read.parquet(path).groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("s03_read_shards", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _(t):
    path = scratch(t.spark, "customer.csv")
    s.write_table(t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").repartition(4), path, "csv")
    return s.read_shards(t.spark, f"{path}/*.csv", "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")


@query("s04_lifetime_events", f"""{with_(HIST, SPINE)} SELECT h.entity, event_date, code, line, CAST(anchor_date - event_date AS INTEGER) AS days_before FROM hist h JOIN spine s ON s.entity = h.entity WHERE event_date < anchor_date - INTERVAL 1 MONTH""")
def _(t):
    out = s.lifetime_events(t.hist, t.spine, scratch(t.spark, "lifetime"))
    return out.select("entity", "event_date", "code", "line", "days_before")


@query("s06_slice_lookback", f"""{AN} SELECT 'calendar' AS rule, entity, count(*) AS n FROM anch WHERE event_date >= anchor_date - INTERVAL 24 MONTH GROUP BY 2
UNION ALL SELECT 'days', entity, count(*) FROM anch WHERE days_before <= 2 * 365.25 GROUP BY 2""")
def _(t):
    def n(df, rule):
        return df.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).withColumn("rule", F.lit(rule))
    return n(cohort.slice_lookback(t.anch, 2), "calendar").unionByName(n(cohort.slice_lookback(t.anch, 2, "days"), "days"))


def store(t):
    """Two nightly snapshots of a packed feature table; the second run is repeated."""
    path = scratch(t.spark, "store")
    a = t.anch.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("top"), F.max("sex").alias("sex"))
    packed = s.pack_json(a, ["entity"])
    s.append_partition(packed.where("entity % 3 = 0"), path, "2026-01-01")
    for _ in range(2):
        s.append_partition(packed.where("entity % 3 <> 2"), path, "2026-01-02")
    return path


_PACK = "pk AS (SELECT entity, count(*) AS n, max(value) AS top, max(sex) AS sex FROM anch GROUP BY 1), st AS (SELECT *, DATE '2026-01-01' AS partition_date FROM pk WHERE entity % 3 = 0 UNION ALL SELECT *, DATE '2026-01-02' FROM pk WHERE entity % 3 <> 2)"


@query("s07_append_partition", f"{with_(ANCH, _PACK)} SELECT entity, partition_date FROM st WHERE partition_date = DATE '2026-01-02'")
def _(t):
    return s.latest_partition(t.spark, store(t)).select("entity", "partition_date")


@query("s08_code_map_qc", f"""{AN}, mp AS (SELECT e.event_type, p_partkey AS code, p_brand || (CASE WHEN p_partkey % 1000 = 3 THEN 'only' ELSE '' END) AS category FROM part, (VALUES ('obs'), ('med')) e(event_type) WHERE p_size <= 25 OR p_partkey % 1000 = 3),
pe AS (SELECT event_type, code, count(*) AS n FROM anch GROUP BY 1, 2), j AS (SELECT pe.n, mp.category FROM pe FULL JOIN mp ON mp.event_type = pe.event_type AND mp.code = pe.code), c AS (SELECT category, count(DISTINCT code) AS k FROM mp GROUP BY 1)
SELECT 'events' AS "check", CAST(sum(n) AS BIGINT) AS n FROM j UNION ALL SELECT 'mapped_events', CAST(sum(n) FILTER (WHERE category IS NOT NULL) AS BIGINT) FROM j UNION ALL SELECT 'mapped_codes', count(category) FROM j
UNION ALL SELECT 'codes_without_events', count(*) FILTER (WHERE n IS NULL) FROM j UNION ALL SELECT 'categories', count(*) FROM c UNION ALL SELECT 'single_code_categories', count(*) FILTER (WHERE k = 1) FROM c""")
def _(t):
    path = scratch(t.spark, "codes.csv")
    cat = F.concat("p_brand", F.when(F.col("p_partkey") % 1000 == 3, "only").otherwise(""))
    s.write_table(t.part.where("p_size <= 25 OR p_partkey % 1000 = 3").select(F.col("p_partkey").alias("Code"), F.col("p_name").alias("Name"), cat.alias("Category")), path, "csv")
    return s.map_qc(t.anch, s.load_code_map(t.spark, path))


@query("s09_combine_outputs", f"""{AN}, a AS (SELECT entity, count(*) AS n, sum(value) AS total FROM anch WHERE category = 'SMALL' GROUP BY 1), b AS (SELECT entity, max(value) AS top FROM anch WHERE category = 'LARGE' GROUP BY 1)
SELECT s.entity, s.label, coalesce(a.n, 0) AS n, coalesce(b.top, 0) AS top FROM spine s LEFT JOIN a USING (entity) LEFT JOIN b USING (entity)""")
def _(t):
    a = t.anch.where("category = 'SMALL'").groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    b = t.anch.where("category = 'LARGE'").groupBy("entity").agg(F.max("value").alias("top"), F.count(F.lit(1)).alias("n"))
    return s.combine(t.spine.select("entity", "label"), a, b, keep=["n", "top"])


def packed(t):
    s_ = F.col("category") == "SMALL"
    return t.anch.groupBy("entity").agg(F.max("label").alias("cancer_class"), F.count(F.lit(1)).alias("n"), F.max(F.when(s_, F.col("value"))).alias("top_small"),
                                        F.max("sex").alias("sex"), F.max("event_date").alias("last_date"), F.max("segment").alias("segment"))


_PK2 = "pk AS (SELECT entity, max(label) AS cancer_class, count(*) AS n, max(value) FILTER (WHERE category = 'SMALL') AS top_small, max(sex) AS sex, max(event_date) AS last_date, max(segment) AS segment FROM anch GROUP BY 1)"


@query("s10_pack_json", f"""{with_(ANCH, _PK2)} SELECT entity, CAST(to_json({{'n': n, 'top_small': top_small, 'sex': sex, 'last_date': last_date, 'segment': segment}}) AS VARCHAR) AS transformed_features, cancer_class FROM pk""")
def _(t):
    return s.pack_json(packed(t), ["entity"], ["cancer_class"])


@query("s11_feature_catalog", f"""{with_(ANCH, _PK2)} SELECT 'n' AS feature, 'bigint' AS dtype, count(n) AS non_null, count(DISTINCT entity) AS entities, CAST(NULL AS VARCHAR) AS levels FROM pk UNION ALL SELECT 'top_small', 'double', count(top_small), count(DISTINCT entity), NULL FROM pk
UNION ALL SELECT 'sex', 'string', count(sex), count(DISTINCT entity), array_to_string(list_sort(list(DISTINCT sex)), '|') FROM pk UNION ALL SELECT 'segment', 'string', count(segment), count(DISTINCT entity), CASE WHEN count(DISTINCT segment) <= 4 THEN 'x' END FROM pk""")
def _(t):
    return s.feature_catalog(packed(t), ["n", "top_small", "sex", "segment"], max_levels=4)


@query("s12_unpack_json", f"""{with_(ANCH, _PK2)} SELECT entity, cancer_class, CAST(n AS DOUBLE) AS n, top_small, CAST(sex = 'F' AS DOUBLE) AS "sex_F", CAST(sex = 'M' AS DOUBLE) AS "sex_M" FROM pk""")
def _(t):
    return s.unpack_json(s.pack_json(packed(t), ["entity"], ["cancer_class"]), "n bigint, top_small double, sex string, segment string", max_card=4)


@query("s13_feature_store_stats", f"""{with_(ANCH, _PACK)} SELECT partition_date, count(DISTINCT entity) AS entities, count(n) AS n, median(n) AS median FROM st GROUP BY 1""")
def _(t):
    st = t.spark.read.parquet(store(t))
    return s.partition_counts(st).join(s.drift(st, "n"), "partition_date")
