"""Ordered computations that do not put one key's rows into one task.

Built-in aggregates (counts, sums, regr_*, min_by, max_by ...) combine on the
map side, so one key holding a third of the rows costs nothing extra. Window
functions and exact ranks do not combine; these helpers split a key's rows
into ordered segments, work inside the segments and stitch the seams from
one small row per segment.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .session import cut_lineage


def number_bucket(c: Column, per_octave: int) -> Column:
    """Order-preserving bucket of any double: equal steps of its logarithm; depends on nothing but the value."""
    c = c.cast("double")
    return F.when(c == 0, 0).otherwise((F.signum(c) * F.floor((F.log2(F.abs(c)) + 1100.0) * per_octave)).cast("bigint"))


def number_buckets(c: Column) -> list[Column]:
    """Nested buckets of any double, 2^8 and 2^20 to a doubling, so that values crowded in a narrow range spread too:
    those from 36.5 to 37.5 fall into some 40,000 fine buckets, and a coarse one holds at most 4096 of these."""
    fine = number_bucket(c, 1 << 20)
    return [F.floor(fine / 4096).cast("bigint"), fine]


def unit_bucket(c: Column, n: int = 4096) -> Column:
    """Order-preserving bucket of a value in [0, 1]."""
    return F.floor(c.cast("double") * n).cast("int")


def hash_bucket(c: Column) -> Column:
    """Bucket of a hex digest: its first three digits, 4096 even parts."""
    return F.substring(c, 1, 3)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where NULL meets NULL; the right side's keys are dropped."""
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"_r_{k}")
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, measures: Sequence[str], bucket: Column | Sequence[Column]
) -> DataFrame:
    """Adds, per measure m, ``m_before`` (sum over smaller order values of the
    key) and ``m_all`` (sum over the key).

    ``order`` must be unique within a key (aggregate first) and ``bucket`` must
    not decrease with it. Buckets may be nested, the coarsest first: rows are
    summed inside the finest, its totals inside the next, and only the totals
    of the coarsest meet per key, whatever the number of rows.
    """
    keys, levels = list(keys), [bucket] if isinstance(bucket, Column) else list(bucket)
    names = [f"_b{i}" for i in range(len(levels))]
    df = df.withColumns(dict(zip(names, levels)))

    def summed(rows: DataFrame, by: str, sums: dict[str, str], inner: list[str]) -> DataFrame:
        """rows with, per measure, _o_ (sum before by, in the key) and _a_ (sum of the key); inner: buckets still around the rows."""
        earlier = W.partitionBy(*(keys or [F.lit(0)]), *inner).orderBy(by).rowsBetween(W.unboundedPreceding, -1)
        if not inner:
            whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
            return rows.select("*", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_o_{m}") for m, c in sums.items()],
                               *[F.sum(c).over(whole).alias(f"_a_{m}") for m, c in sums.items()])
        part = rows.select("*", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_i_{m}") for m, c in sums.items()])
        total = rows.groupBy(*keys, *inner).agg(*[F.sum(c).alias(f"_t_{m}") for m, c in sums.items()])
        offs = summed(total, inner[-1], {m: f"_t_{m}" for m in sums}, inner[:-1])
        offs = offs.select(*keys, *inner, *[f"_{p}_{m}" for m in sums for p in "oa"])
        out = join_null_safe(part, offs, [*keys, *inner])
        return out.withColumns({f"_o_{m}": F.col(f"_o_{m}") + F.col(f"_i_{m}") for m in sums})

    out = summed(df, order, {m: m for m in measures}, names)
    return out.select(*[c for c in df.columns if c not in names], *[F.col(f"_o_{m}").alias(f"{m}_before") for m in measures],
                      *[F.col(f"_a_{m}").alias(f"{m}_all") for m in measures])


def hash_rank(df: DataFrame, strata: Sequence[str], id_cols: Sequence[str], salt: str) -> DataFrame:
    """Adds ``rank`` (1-based) and ``rank_all`` (size) of every row within its
    stratum in the order of md5(id, salt): a reproducible shuffle of the rows.

    A stratum is ranked in 4096 hash parts, so a class with half of all
    entities is not sorted in one task. Id columns must identify a row.
    """
    strata = list(strata)
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in id_cols], F.lit(salt)))
    df = df.withColumn("_h", h).withColumn("_one", F.lit(1).cast("bigint"))
    out = running_total(df, strata, "_h", ["_one"], hash_bucket(F.col("_h")))
    return out.withColumn("rank", F.col("_one_before") + 1).withColumnRenamed("_one_all", "rank_all").drop(
        "_h", "_one", "_one_before"
    )


def rank_all(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Adds the 1-based place of every row in one order, which must fix it up to identical rows. Rows are sorted in ranges of the
    order; what meets in one task is a row for each range."""
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    laid = cut_lineage(laid).withColumn("_part", F.shiftright("_at", 33))
    ranges = laid.groupBy("_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = laid.join(ranges.select("_part", "_first", before.alias("_before")), "_part")
    return out.select(*df.columns, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int").alias(name))


def value_ranks(
    df: DataFrame, keys: Sequence[str], value: str, bucket: Column | None = None
) -> DataFrame:
    """Distinct values per key with n, n_before, n_all; ranks follow from these."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return running_total(counts, keys, value, ["n"], number_buckets(F.col(value)) if bucket is None else bucket)


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], bucket: Column | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per key.

    Rows are first reduced to distinct values with counts, so repeated values
    cost one row, and no key's values are gathered in one buffer.
    """
    r = value_ranks(df, keys, value, bucket)
    v, last = F.col(value).cast("double"), F.col("n_before") + F.col("n") - 1

    def at(pos: Column) -> Column:
        return F.max(F.when((F.col("n_before") <= pos) & (pos <= last), v))

    aggs = []
    for name, p in probs.items():
        pos = F.lit(float(p)) * (F.col("n_all") - 1)
        aggs += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}"),
                 F.max(pos - F.floor(pos)).alias(f"_w_{name}")]
    out = r.groupBy(*keys).agg(*aggs)
    return out.select(
        *keys,
        *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n) for n in probs],
    )


def previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], segment: Column
) -> DataFrame:
    """Adds ``prev_<col>``: the value on the key's preceding row.

    Works inside ``segment`` (a non-decreasing function of the order, such as
    the month) and takes the first row's predecessor from the tail of the
    segment before. Order columns must fix the order up to identical rows.
    """
    keys = list(keys)
    df = df.withColumn("_s", segment)
    inside = W.partitionBy(*keys, "_s").orderBy(*order)
    local = df.select(
        "*", F.row_number().over(inside).alias("_rn"),
        *[F.lag(c).over(inside).alias(f"_l_{c}") for c in cols],
    )
    tails = df.groupBy(*keys, "_s").agg(
        F.max_by(F.struct(*cols), F.struct(*[F.col(c) for c in order])).alias("_tail")
    )
    prev = tails.select(*keys, "_s", F.lag("_tail").over(W.partitionBy(*keys).orderBy("_s")).alias("_pt"))
    first = F.col("_rn") == 1
    return join_null_safe(local, prev, [*keys, "_s"]).select(
        *[c for c in df.columns if c != "_s"],
        *[F.when(first, F.col("_pt")[c]).otherwise(F.col(f"_l_{c}")).alias(f"prev_{c}") for c in cols],
    )


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, name: str = "rn") -> DataFrame:
    """First k rows per key. Spark limits each map partition to k rows per key
    before the shuffle, so a hot key sends k rows per partition, not all."""
    w = W.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out.drop(name) if k == 1 else out


def high_rows(df: DataFrame, keys: Sequence[str], value: str, k: int, slack: float = 0.0) -> DataFrame:
    """Rows that may be among a key's k highest values, without sorting any: all from the least value of the buckets that hold the
    first k, less ``slack`` for an order by rounded values. Rows without a value are dropped. The rows are read twice; the
    keys must be few (a row for each is broadcast)."""
    keys, v = list(keys), F.col(value)
    cells = df.where(v.isNotNull()).groupBy(*keys, number_bucket(v, 1 << 8).alias("_b")).agg(F.count(F.lit(1)).alias("_n"), F.min(v).alias("_least"))
    above = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy(F.desc("_b")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    least = cells.withColumn("_above", above).where(F.col("_above") < k).groupBy(*keys).agg(F.min("_least").alias("_least"))
    return join_null_safe(df, F.broadcast(least), keys).where(v >= F.col("_least") - slack).drop("_least")


def one_row(*parts: DataFrame) -> DataFrame:
    """Single-row results side by side, without a join: their union reduced by max."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.agg(*[F.max(c).alias(c) for c in every.columns])
