"""Token sequences for sequence models: vocabulary, encoding, last-N windows, padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .. import skew

PAD, RARE, FIRST_ID = 0, 1, 2


def vocab(train: DataFrame, min_freq: int = 10, on: str = "code") -> DataFrame:
    """Ids from 2 upwards in code order for codes seen at least ``min_freq`` times.

    Positions come from bucket totals, so a vocabulary of any size is
    numbered without one global sort.
    """
    n = train.where(F.col(on).isNotNull()).groupBy(on).agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= min_freq)
    bucket = skew.number_buckets(F.col(on)) if dict(n.dtypes)[on] != "string" else F.substring(on, 1, 3)
    r = skew.running_total(n.withColumn("one", F.lit(1).cast("bigint")), [], on, ["one"], bucket)
    return r.select(on, "freq", (F.col("one_before") + FIRST_ID).cast("int").alias("id"))


def encode(ev: DataFrame, fitted: DataFrame, on: str = "code") -> DataFrame:
    return ev.join(fitted.select(on, "id"), on, "left").na.fill(RARE, ["id"])


def sequences(ev: DataFrame, n: int = 30, min_len: int = 10, order: Sequence[str] = ("event_date", "id"), static: Sequence[str] = ()) -> DataFrame:
    """Per entity the last n ids in time order, for entities with at least min_len events.

    The cut to n rows happens per map partition before the shuffle, so no
    task ever holds an entity's whole history. Static columns come from the last row.
    """
    enough = ev.groupBy("entity").agg(F.count(F.lit(1)).alias("n_events")).where(F.col("n_events") >= min_len)
    cols = ["entity", *order, *[c for c in (*static, "id") if c not in order]]
    last = skew.top_by(ev.select(*cols), ["entity"], [F.col(c).desc() for c in order], n, "_rn")
    item = F.struct((-F.col("_rn")).alias("k"), F.col("id").alias("id"))
    got = last.groupBy("entity").agg(
        F.transform(F.array_sort(F.collect_list(item)), lambda s: s["id"]).alias("sequence"),
        *[F.max(F.when(F.col("_rn") == 1, F.col(c))).alias(c) for c in static])
    return got.join(enough, "entity")


def pad(c: Column | str, n: int) -> Column:
    """Last n items, zeros behind."""
    c = F.col(c) if isinstance(c, str) else c
    cut = F.when(F.size(c) > n, F.slice(c, F.size(c) - n + 1, n)).otherwise(c)
    return F.concat(cut, F.array_repeat(F.lit(PAD), F.greatest(n - F.size(c), F.lit(0))))


def length_stats(ev: DataFrame, by: Sequence[str] = ("label", "event_type")) -> DataFrame:
    """Distribution of events per entity in each class (and type)."""
    n = ev.groupBy("entity", *by).agg(F.count(F.lit(1)).alias("len"))
    q = skew.quantiles(n, list(by), "len", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95})
    base = n.groupBy(*by).agg(F.count(F.lit(1)).alias("entities"), F.avg("len").alias("mean"), F.min("len").alias("min"), F.max("len").alias("max"))
    return skew.join_null_safe(base, q, list(by))


def position_mode(seq: DataFrame, c: str = "sequence") -> DataFrame:
    """Most frequent id at each position (counted from the end), ties to the smaller id."""
    items = seq.select(F.posexplode(F.reverse(c)).alias("pos", "id"))
    n = items.groupBy("pos", "id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("pos").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("id"))).alias("_b")).select(
        "pos", F.col("_b.id").alias("id"), (-F.col("_b.m")).alias("n"))
