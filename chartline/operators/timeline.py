"""Ordered views of a timeline with a bounded number of rows per key.

Row-level orderings (intervals, halves, positions) are rebuilt from one row
per (key, day) carrying its number of events, so the windows below sort at
most one row per calendar day of a key, however many events it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def daily(ev: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """One row per (keys, day): n events and the given aggregates."""
    return ev.where(F.col("event_date").isNotNull()).groupBy(*keys, "event_date").agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in aggs.items()])


def steps(days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds n_all, n_before (events on earlier days) and gap (days since the day before)."""
    by = W.partitionBy(*keys)
    past = by.orderBy("event_date")
    return days.select(
        "*", F.sum("n").over(by).alias("n_all"), (F.sum("n").over(past) - F.col("n")).alias("n_before"),
        F.date_diff("event_date", F.lag("event_date").over(past)).alias("gap"),
    )


def half_weights(st: DataFrame, first_half: str = "ceil") -> DataFrame:
    """Adds w1 and w2: how many of the day's events fall in the older and newer half of the key's events.

    first_half: 'ceil' gives an odd middle event to the older half, 'floor' to the newer.
    """
    half = F.ceil(F.col("n_all") / 2) if first_half == "ceil" else F.floor(F.col("n_all") / 2)
    w1 = F.greatest(F.least(half - F.col("n_before"), F.col("n")), F.lit(0))
    return st.withColumn("w1", w1).withColumn("w2", F.col("n") - F.col("w1"))


def span_freq(w: str) -> Column:
    """Aggregate: events of a half per year of its span, NULL for a zero span."""
    d = F.when(F.col(w) > 0, F.col("event_date"))
    return F.try_divide(F.sum(w), F.nullif(F.date_diff(F.max(d), F.min(d)) / 365.25, F.lit(0.0)))


def interval_rows(st: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two rows per day: the gap to the day before with weight 1, and the zero gaps between
    the day's own events with their number as weight. The day's other columns stand on the
    first row only, so that sums over both rows count them once."""
    n, g = F.col("n"), F.col("gap")
    own = [c for c in st.columns if c not in (*keys, "event_date", "n_all", "gap")]
    pair = F.array(
        F.struct(g.alias("iv"), F.when(g.isNull(), 0).otherwise(1).cast("bigint").alias("w"), (F.col("n_before") - 1).alias("idx"),
                 *[F.col(c).alias(c) for c in own]),
        F.struct(F.lit(0).alias("iv"), (n - 1).cast("bigint").alias("w"), F.lit(None).cast("bigint").alias("idx"),
                 *[F.lit(None).cast(t).alias(c) for c, t in st.dtypes if c in own]))
    return st.select(*keys, "event_date", "n_all", F.explode(pair).alias("s")).select(*keys, "event_date", "n_all", "s.*")


def interval_aggs(recent_first: bool = False) -> list[Column]:
    """n, span, mean/median/min/max interval between consecutive events, and the slope of the
    interval against its position (two intervals or more), over interval rows.

    The median runs over distinct gaps of the key, of which there are at most as many as days.
    """
    m = (F.max("n_all") - 1).cast("double")
    sy = F.date_diff(F.max("event_date"), F.min("event_date")).cast("double")
    sxy = F.coalesce(F.sum(F.col("idx") * F.col("iv")), F.lit(0)).cast("double")
    sx, sxx = m * (m - 1) / 2, (m - 1) * m * (2 * m - 1) / 6
    slope = F.when(m >= 2, F.try_divide(m * sxy - sx * sy, m * sxx - sx * sx)) * (-1 if recent_first else 1)
    iv = F.when(F.col("w") > 0, F.col("iv"))
    return [
        F.max("n_all").alias("n"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"),
        sy.cast("int").alias("span_days"), F.when(m > 0, F.try_divide(sy, m)).alias("interval_mean"),
        F.percentile(iv, F.lit(0.5), F.col("w")).alias("interval_median"), F.min(iv).alias("interval_min"),
        F.max(iv).alias("interval_max"), slope.alias("interval_slope"),
    ]


def half_aggs() -> list[Column]:
    """Frequency of each half (two events or more), over rows with half weights."""
    two = F.max("n_all") >= 2
    return [F.when(two, span_freq("w1")).alias("first_half_freq"), F.when(two, span_freq("w2")).alias("second_half_freq")]


def worsening(out: DataFrame, factor: float = 1.1, both: bool = False) -> DataFrame:
    """Newer half more than ``factor`` times as frequent as the older; NULL with one event.

    both: neither frequency counts unless both halves have a span.
    """
    f, s = F.col("first_half_freq"), F.col("second_half_freq")
    if both:
        ok = f.isNotNull() & s.isNotNull()
        out = out.withColumns({"first_half_freq": F.when(ok, f), "second_half_freq": F.when(ok, s)})
    return out.withColumn("is_worsening", F.when(F.col("n") >= 2, F.when(s > factor * f, 1).otherwise(0)))


def profile(st: DataFrame, keys: Sequence[str], extra: Sequence[Column] = (), first_half: str = "ceil", recent_first: bool = False, both: bool = False) -> DataFrame:
    """Intervals, halves and any further aggregates of the day rows, in one grouping that
    reuses the partitioning of the day windows."""
    rows = interval_rows(half_weights(st, first_half), keys)
    return worsening(rows.groupBy(*keys).agg(*interval_aggs(recent_first), *half_aggs(), *extra), both=both)


def last_months(ev: DataFrame, months: int, keys: Sequence[str] = ("entity",)) -> DataFrame:
    """Only the last N months of each key's own record (bounds joined from a combining aggregate)."""
    end = ev.groupBy(*keys).agg(F.add_months(F.max("event_date"), -months).alias("_cut"))
    return ev.join(end, list(keys)).where(F.col("event_date") >= F.col("_cut")).drop("_cut")
