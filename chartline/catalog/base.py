"""Registry and the shared bindings of the driver's tables to timelines.

``hist``  orders x lineitem x part as an event table of customers
``spine`` one row per customer with anchor date, label, age, strata
``anch``  hist inside the five years before the anchor, one month left free
``ev``    the events table as a timeline of users by day
``pred``  orders as scored predictions
The same relations are written once for Spark and once as SQL text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import cohort


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[["Tables"], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"two queries named {name}")
        REGISTRY[name] = Query(name, fn, _nudged(sql) if sql else None)
        return fn

    return add


# Exact halves such as 1/128 round up or down with the last bit of a sum, which
# depends on the order of its terms. Both engines round x + 1e-9 instead.
NUDGE = 1e-9


def _nudged(sql: str) -> str:
    """round(x, 6) in the SQL text as round((x) + 1e-9, 6), like r() below."""
    out, i = [], 0
    while (j := sql.find("round(", i)) >= 0:
        k, depth = j + 6, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        body = _nudged(sql[j + 6:k - 1])
        arg, comma, digits = body.rpartition(",")
        if comma and digits.strip() == "6":
            body = f"({arg}) + {NUDGE}, 6"
        out += [sql[i:j], "round(", body, ")"]
        i = k
    return "".join(out) + sql[i:]


def r(c: Column | str, name: str | None = None) -> Column:
    """Rounded to six digits so that two engines' sums compare equal."""
    out = F.round((F.col(c) if isinstance(c, str) else c) + NUDGE, 6)
    return out.alias(name or c) if isinstance(c, str) or name else out


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Every double column rounded, the others as they are."""
    return df.select(*[r(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


OBS, MED = "obs", "med"
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


class Tables:
    """Lazily loaded driver tables and the derived timelines."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, df)
        return df

    @cached_property
    def hist(self) -> DataFrame:
        o = self.orders.select(
            F.col("o_orderkey").alias("okey"), F.col("o_custkey").alias("entity"),
            F.to_date("o_orderdate").alias("event_date"),
        )
        li = self.lineitem.select(
            F.col("l_orderkey").alias("okey"), F.col("l_partkey").alias("code"), F.col("l_quantity").alias("value"),
            F.col("l_extendedprice").alias("price"), F.col("l_linenumber").alias("line"),
            F.col("l_returnflag").alias("status"),
            F.when(F.col("l_linestatus") == "O", MED).otherwise(OBS).alias("event_type"),
        )
        p = self.part.select(
            F.col("p_partkey").alias("code"), F.col("p_type").alias("category"), F.col("p_name").alias("term"),
            F.col("p_brand").alias("brand"),
        )
        return li.join(o, "okey").join(p, "code")

    @cached_property
    def spine(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.customer.select(
            k.alias("entity"),
            F.date_add(F.lit("2000-01-01").cast("date"), (k % 540).cast("int")).alias("anchor_date"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), 1).otherwise(0).alias("label"),
            (40 + k % 45).cast("int").alias("age"),
            F.when(k % 2 == 0, "F").otherwise("M").alias("sex"),
            F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"),
            F.col("c_acctbal").alias("balance"),
        )

    @cached_property
    def anch(self) -> DataFrame:
        return cohort.anchored(self.hist, self.spine, years=5, months=1)

    @cached_property
    def ev(self) -> DataFrame:
        return self.events.select(
            F.col("user_id").alias("entity"), "event_id", "ts", F.to_date("ts").alias("event_date"),
            F.col("event_type").alias("category"), "value", "props",
        )

    @cached_property
    def pred(self) -> DataFrame:
        k, y = F.col("o_orderkey"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
        return self.orders.select(
            k.alias("entity"), y.alias("label"),
            (((k * 7919 + 13) % 997) / 997.0 * 0.8 + 0.2 * y).alias("score"),
            (40 + F.col("o_custkey") % 50).cast("int").alias("age"),
            F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("M").alias("sex"),
            F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("price"),
            F.col("o_custkey").alias("cust"),
        )


HIST = """hist AS (
  SELECT o_custkey AS entity, CAST(o_orderdate AS DATE) AS event_date, l_orderkey AS okey, l_partkey AS code,
         l_quantity AS value, l_extendedprice AS price, l_linenumber AS line, l_returnflag AS status,
         CASE WHEN l_linestatus = 'O' THEN 'med' ELSE 'obs' END AS event_type,
         p_type AS category, p_name AS term, p_brand AS brand
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
SPINE = """spine AS (
  SELECT c_custkey AS entity, CAST(DATE '2000-01-01' + CAST(c_custkey % 540 AS INTEGER) AS DATE) AS anchor_date,
         CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS label,
         CAST(40 + c_custkey % 45 AS INTEGER) AS age, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
         c_mktsegment AS segment, c_nationkey AS nation, c_acctbal AS balance
  FROM customer)"""
ANCH = f"""{HIST},
{SPINE},
anch0 AS (
  SELECT h.*, s.anchor_date, s.label, s.age, s.sex, s.segment,
         CAST(s.anchor_date - h.event_date AS INTEGER) AS days_before
  FROM hist h JOIN spine s ON h.entity = s.entity
  WHERE h.event_date >= s.anchor_date - INTERVAL 60 MONTH AND h.event_date < s.anchor_date - INTERVAL 1 MONTH),
anch AS (
  SELECT *, days_before // 30 AS months_before,
         CASE WHEN days_before // 30 BETWEEN 1 AND 30 THEN 'B' WHEN days_before // 30 > 30 THEN 'A' END AS time_window
  FROM anch0)"""
EV = """ev AS (
  SELECT user_id AS entity, event_id, ts, CAST(ts AS DATE) AS event_date, event_type AS category, value, props
  FROM events)"""
PRED = """pred AS (
  SELECT o_orderkey AS entity, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
         CAST((o_orderkey * 7919 + 13) % 997 AS DOUBLE) / 997.0::DOUBLE * 0.8::DOUBLE
           + 0.2::DOUBLE * CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS score,
         CAST(40 + o_custkey % 50 AS INTEGER) AS age, CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
         o_orderpriority AS grp, o_totalprice AS price, o_custkey AS cust
  FROM orders)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
