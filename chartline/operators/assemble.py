"""From tall feature tables to long, wide and vector form.

Features stay long, (entity, feature, value), until the very end: a keep
list then filters rows instead of columns, and the pivot gets its columns
from a fixed list, so no extra job looks for them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as x
from ..session import literal_table


def safe_name(s: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_]", "_", s)).strip("_")


def to_long(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: Column | None = None, prefix: str = "") -> DataFrame:
    """(entity, feature, value) rows; NULL values produce no row."""
    pairs = [
        F.struct((F.concat_ws("_", name, F.lit(v)) if name is not None else F.lit(prefix + v)).alias("feature"),
                 F.col(v).cast("double").alias("value"))
        for v in values
    ]
    out = df.select(*keys, F.explode(F.array(*pairs)).alias("_p")).select(*keys, "_p.feature", "_p.value")
    return out.where(F.col("value").isNotNull())


def union_long(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def keep(long: DataFrame, features: Sequence[str]) -> DataFrame:
    """Only the listed features; the filter runs before any pivot or join."""
    return long.where(F.col("feature").isin(*features))


def prune(long: DataFrame, drop_prefix: Sequence[str] = (), drop_suffix: Sequence[str] = (), drop: Sequence[str] = (),
          only_prefix: Sequence[str] = ()) -> DataFrame:
    """Whole feature families out, by name pattern, before the pivot."""
    f = F.col("feature")
    if only_prefix:
        long = long.where(x.any_of([f.startswith(p) for p in only_prefix]))
    bad = [f.startswith(p) for p in drop_prefix] + [f.endswith(s) for s in drop_suffix]
    if drop:
        bad.append(f.isin(*drop))
    return long.where(~x.any_of(bad)) if bad else long


def widen(long: DataFrame, features: Sequence[str], roster: DataFrame | None = None, fill: dict[str, float] | None = None) -> DataFrame:
    """One row per entity, one column per listed feature."""
    out = keep(long, features).groupBy("entity").pivot("feature", list(features)).agg(F.max("value"))
    if roster is not None:
        out = roster.join(out, "entity", "left")
    return out.na.fill(fill) if fill else out


def spread(tall: DataFrame, level: str, levels: Sequence, values: Sequence[str], keys: Sequence[str] = ("entity",), prefix: str = "") -> DataFrame:
    """Tall (entity, level, values...) to columns <prefix><level>_<value>."""
    aggs = [F.max(v).alias(v) for v in values]
    out = tall.groupBy(*keys).pivot(level, list(levels)).agg(*aggs)
    if len(values) == 1:
        names = {str(lv): f"{prefix}{lv}_{values[0]}" for lv in levels}
        return out.select(*keys, *[F.col(f"`{c}`").alias(names[c]) for c in out.columns if c not in keys])
    return out.select(*keys, *[F.col(f"`{c}`").alias(prefix + c) for c in out.columns if c not in keys])


def fill_policy(df: DataFrame, rules: dict[str, Sequence[str]], sentinels: dict[str, float] | None = None) -> DataFrame:
    """Fill by the kind of a feature, given as metadata rather than read off its name.

    rules: zero -> columns where absence means 0, minus_one -> 'days since'
    columns, level -> measured values that stay NULL. Infinite values become
    0 in zero columns and NULL in level columns.
    """
    sentinels = {"zero": 0.0, "minus_one": -1.0, **(sentinels or {})}
    kind = {c: k for k, cols in rules.items() for c in cols}
    out = []
    for c, t in df.dtypes:
        if c not in kind:
            out.append(F.col(c))
            continue
        k = kind[c]
        v = F.col(c)
        if t in ("double", "float"):
            v = x.finite(v, None if k == "level" else sentinels[k])
        if k != "level":
            v = F.coalesce(v, F.lit(sentinels[k]).cast(t))
        out.append(v.alias(c))
    return df.select(*out)


def vectors(long: DataFrame, index: DataFrame, size: int, out: str = "features") -> DataFrame:
    """One ML vector per entity from long rows and a (feature, idx) table.

    Each entity gathers at most ``size`` pairs, the length of the vocabulary.
    """
    pairs = long.join(index, "feature").groupBy("entity", "idx").agg(F.max("value").alias("value"))
    got = pairs.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("idx", F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value")))).alias("_s"))
    # zeros up to each pair's place and its value; after the last pair zeros to the end
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    before = F.concat(F.array(F.lit(-1)), F.col("_s.idx"))
    dense = F.flatten(F.zip_with("_s", before, lambda s, b: F.when(s.isNull(), zeros(size - 1 - b)).otherwise(F.concat(zeros(s["idx"] - b - 1), F.array(s["value"])))))
    return got.select("entity", array_to_vector(dense).alias(out))


def feature_index(features: Sequence[str], spark) -> DataFrame:
    return literal_table(spark, [{"feature": f, "idx": i} for i, f in enumerate(features)], "feature string, idx int")


def parity(a: DataFrame, b: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Long rows on which two builds differ by more than ``tol`` (a missing row differs)."""
    j = a.select("entity", "feature", F.col("value").alias("va")).join(
        b.select("entity", "feature", F.col("value").alias("vb")), ["entity", "feature"], "full_outer"
    )
    same = F.coalesce(F.abs(F.col("va") - F.col("vb")) <= tol, F.col("va").isNull() & F.col("vb").isNull())
    return j.where(~same)
