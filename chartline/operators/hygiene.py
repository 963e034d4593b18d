"""Feature-matrix hygiene and selection.

Works on the long table (entity, feature, value), where one grouping by
feature answers for any number of features; a missing row is a missing value
unless a fill says otherwise. Feature lists that reach the driver are names
and one number each.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from .. import skew
from ..functions import scalar as x
from ..session import literal_table
from .sparse_correlation import label_correlation


# --- label encoding ---------------------------------------------------------
def fit_labels(df: DataFrame, c: str) -> DataFrame:
    """Alphabetical integer codes of the levels seen in training (one row per level)."""
    levels = df.where(F.col(c).isNotNull()).select(c).distinct().withColumn("_one", F.lit(1).cast("bigint"))
    text = dict(levels.dtypes)[c] == "string"
    nested = [F.substring(c, 1, 2), F.substring(c, 1, 6)] if text else skew.number_buckets(F.col(c))
    return skew.running_total(levels, [], c, ["_one"], nested).select(c, F.col("_one_before").alias("id"))


def apply_labels(df: DataFrame, fitted: DataFrame, c: str, out: str) -> DataFrame:
    """Codes by lookup; unseen levels become -1."""
    return df.join(fitted.select(c, F.col("id").alias(out)), c, "left").na.fill(-1, [out])


# --- profiles ---------------------------------------------------------------
def profile(ev: DataFrame, by: Sequence[str] = ("label",), cols: Sequence[str] = ("event_date", "category", "code", "value")) -> DataFrame:
    """Rows, entities, dates, halves, NULLs per column and months out of range, per label."""
    m = F.col("months_before")
    return ev.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("entity").alias("entities"), F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date"),
        x.count_where(F.col("time_window") == "A").alias("rows_A"), x.count_where(F.col("time_window") == "B").alias("rows_B"),
        x.count_where((m < 0) | (m > 60)).alias("months_out_of_range"), *[x.count_where(F.col(c).isNull()).alias(f"null_{c}") for c in cols])


def top_categories(ev: DataFrame, k: int = 10, by: str = "category") -> DataFrame:
    n = ev.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("entity").alias("entities"))
    return n.orderBy(F.desc("rows"), by).limit(k)


def prevalence(ev: DataFrame, spine: DataFrame, defs: dict[str, Column]) -> DataFrame:
    """Share of entities of each class with a matching event, their difference and ratio."""
    per = ev.groupBy("entity").agg(*[F.max(x.flag(F.coalesce(c, F.lit(False)))).alias(n) for n, c in defs.items()])
    full = spine.select("entity", "label").join(per, "entity", "left").na.fill(0, list(defs))
    agg = full.agg(*[F.avg(F.when(F.col("label") == y, F.col(n))).alias(f"{n}|{y}") for n in defs for y in (0, 1)])
    rows = F.array(*[F.struct(F.lit(n).alias("item"), F.col(f"{n}|1").alias("pos"), F.col(f"{n}|0").alias("neg")) for n in defs])
    t = agg.select(F.explode(rows).alias("r")).select("r.*")
    return t.select("item", (F.col("pos") * 100).alias("pct_pos"), (F.col("neg") * 100).alias("pct_neg"),
                    ((F.col("pos") - F.col("neg")) * 100).alias("diff"), F.try_divide(F.col("pos"), F.col("neg")).alias("ratio"))


# --- column quality ---------------------------------------------------------
def feature_stats(long: DataFrame, n_entities: int) -> DataFrame:
    """Per feature: NULL share, variance, share of the most frequent value.

    Distinct (feature, value) counts come first, so a constant feature is one row.
    """
    cells = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    v, n = F.col("value"), F.col("n")
    t = cells.groupBy("feature").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.sum(v * n).alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return t.select("feature", "n", (1.0 - F.col("n") / float(n_entities)).alias("null_share"), (F.col("top") / F.col("n")).alias("top_share"),
                    (F.col("s") / F.col("n")).alias("mean"), (F.col("lo") == F.col("hi")).alias("constant"))


def weak_features(long: DataFrame, n_entities: int, max_null: float = 0.95, max_top: float = 0.995, protect: Sequence[str] = ()) -> DataFrame:
    """Each feature with the reason it leaves: high_null, constant, near_constant, or 'keep'."""
    s = feature_stats(long, n_entities)
    safe = x.any_of([F.col("feature").startswith(p) for p in protect]) if protect else F.lit(False)
    why = (F.when(F.col("null_share") > max_null, "high_null").when(F.col("constant"), "constant")
           .when((F.col("top_share") > max_top) & ~safe, "near_constant").otherwise("keep"))
    return s.withColumn("verdict", why)


def drop_features(long: DataFrame, bad: DataFrame) -> DataFrame:
    return long.join(bad.select("feature"), "feature", "left_anti")


def duplicate_features(long: DataFrame) -> DataFrame:
    """Features equal to an alphabetically earlier one on every entity, exactly.

    Order-free fingerprints over all rows (two 64-bit hash sums, xor and
    count) find the candidates; candidates are then compared row by row.
    """
    h1 = F.xxhash64("entity", F.col("value").cast("double"))
    h2 = F.xxhash64(F.lit("b"), "entity", F.col("value").cast("double"))
    fp = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), F.sum(h1.cast("decimal(20,0)")).alias("s1"), F.sum(h2.cast("decimal(20,0)")).alias("s2"), F.bit_xor(h1).alias("x1"))
    key = ["n", "s1", "s2", "x1"]
    first = fp.groupBy(*key).agg(F.min("feature").alias("same_as"), F.count(F.lit(1)).alias("_k")).where(F.col("_k") > 1)
    cand = fp.join(first, key).where(F.col("feature") != F.col("same_as")).select("feature", "same_as")
    a = long.join(cand, "feature").select("feature", "same_as", "entity", F.col("value").alias("va"))
    b = long.select(F.col("feature").alias("same_as"), "entity", F.col("value").alias("vb"))
    diff = a.join(b, ["same_as", "entity"], "left").where(~F.col("va").eqNullSafe(F.col("vb"))).select("feature").distinct()
    return cand.join(diff, "feature", "left_anti")


def fit_fill(long: DataFrame, rules: dict[str, Sequence[str]]) -> DataFrame:
    """(feature, fill): training median for level features, 0 or -1 for the others."""
    level = long.where(F.col("feature").isin(*rules.get("median", ())))
    med = skew.quantiles(level, ["feature"], "value", {"fill": 0.5})
    fixed = [{"feature": f, "fill": v} for k, v in (("zero", 0.0), ("minus_one", -1.0)) for f in rules.get(k, ())]
    if not fixed:
        return med
    return med.unionByName(literal_table(long.sparkSession, fixed, "feature string, fill double"))


def typed_fill(long: DataFrame, roster: DataFrame, fills: DataFrame) -> DataFrame:
    """Dense long table: every (roster entity, fitted feature) with its value or the feature's fill; infinite values become 0.

    The grid is entities times the fitted features, which is the size of the
    dense matrix itself: the fitted features, a name and a number each, are a
    literal array exploded per entity.
    """
    rows = [r.asDict() for r in fills.select("feature", "fill").orderBy("feature").collect()]
    grid = F.from_json(F.lit(json.dumps(rows)), "array<struct<feature:string,fill:double>>")
    per = roster.select("entity", F.inline(grid))
    out = per.join(long, ["entity", "feature"], "left")
    return out.select("entity", "feature", x.finite(F.coalesce("value", "fill")).alias("value"))


def utilisation_confounds(long: DataFrame, spine: DataFrame, suffix: str = "_count", limit: float = 0.15) -> DataFrame:
    """Count features whose zero share is more than ``limit`` larger in cases, with all features of the same stem."""
    y = spine.select("entity", "label")
    tot = y.agg(x.count_where(F.col("label") == 1).alias("p"), x.count_where(F.col("label") == 0).alias("q")).first()
    nz = long.where(F.col("feature").endswith(suffix) & (F.col("value") != 0)).join(y, "entity").groupBy("feature").agg(
        x.count_where(F.col("label") == 1).alias("a"), x.count_where(F.col("label") == 0).alias("b"))
    diff = (1 - F.col("a") / float(tot["p"])) - (1 - F.col("b") / float(tot["q"]))
    bad = nz.withColumn("diff", diff).where(F.col("diff") > limit).withColumn("stem", F.expr(f"left(feature, length(feature) - {len(suffix)})"))
    names = long.select("feature").distinct().withColumn("stem", F.regexp_replace("feature", "_[^_]*$", ""))
    return names.join(bad.select("stem", "diff"), "stem").select("feature", "stem", "diff")


def select_families(long: DataFrame, drop: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Whole families out (or only some in) by regular expression on the feature name."""
    if drop:
        long = long.where(~F.col("feature").rlike("|".join(drop)))
    return long.where(F.col("feature").rlike("|".join(keep))) if keep else long


# --- correlation and separation ---------------------------------------------
def leakage_check(long: DataFrame, spine: DataFrame, drop: float = 0.5, review: float = 0.3, top: int = 30) -> DataFrame:
    """Features by absolute label correlation with verdict drop / review / ok and a top flag."""
    c = label_correlation(long, spine).withColumn("abs_corr", F.abs("corr"))
    verdict = F.when(F.col("abs_corr") > drop, "drop").when(F.col("abs_corr") > review, "review").otherwise("ok")
    r = skew.rank_all(c.withColumn("verdict", verdict), [F.round("abs_corr", 12).desc_nulls_last(), F.col("feature")], "_rank")
    return r.withColumn("in_top", x.flag(F.col("_rank") <= top)).drop("_rank")


BLOCK = 256  # features of a block


def correlated_pairs(mat: DataFrame, features: Sequence[str], limit: float, last: bool = False) -> DataFrame:
    """(i, j, corr) of positions i < j with absolute correlation above ``limit``, NULLs as missing rows left out.

    Columns are centred and scaled first, so sums of products do not cancel. Each task sums them block by block (256 by
    256 features); a pair of blocks is added up in one task, and only pairs above the limit leave it. Nothing of the
    size features x features meets anywhere. ``last``: pairs with the last feature are returned at any correlation.
    """
    k = len(features)
    cols = [F.col(f).cast("double") for f in features]
    rows = mat.select(F.array(*cols).alias("v")).where(~F.exists("v", lambda v: v.isNull() | F.isnan(v)))
    vec = array_to_vector("v")
    st = rows.agg(Summarizer.metrics("count", "mean", "std").summary(vec).alias("s")).first()["s"]
    n, mean, scale = st["count"], st["mean"].toArray(), st["std"].toArray()
    if not len(mean):
        mean, scale = np.zeros(k), np.zeros(k)
    scale = np.where(scale > 0, scale, np.inf)  # a constant column correlates with nothing

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield (batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, k) - mean) / scale

    return block_pairs(rows, matrices, k, limit, max(n - 1, 1), last)


def block_pairs(rows: DataFrame, matrices: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], k: int, limit: float, divisor: float = 1.0, last: bool = False) -> DataFrame:
    """(i, j, corr) of positions i < j whose sum of products, over ``divisor``, is beyond ``limit``. matrices: a task's batches as rows of
    k centred and scaled columns."""
    blocks = [(a, min(a + BLOCK, k)) for a in range(0, k, BLOCK)]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def out() -> pa.RecordBatch:
            at = sorted(held)
            batch = pa.RecordBatch.from_arrays([pa.array([a for a, _ in at], pa.int32()), pa.array([b for _, b in at], pa.int32()), pa.array([held[x].tobytes() for x in at], pa.binary())], names=["a", "b", "x"])
            held.clear()
            return batch

        for z in matrices(batches):
            for a, (a0, a1) in enumerate(blocks):
                for b, (b0, b1) in enumerate(blocks[a:], a):
                    got = z[:, a0:a1].T @ z[:, b0:b1]
                    held[a, b] = held[a, b] + got if (a, b) in held else got
                    if len(held) >= 64 and len(blocks) > 8:  # bounded memory on wide tables
                        yield out()
        yield out()

    def above(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = key[0].as_py(), key[1].as_py()
        shape = (blocks[a][1] - blocks[a][0], blocks[b][1] - blocks[b][0])
        total = np.zeros(shape)
        for batch in batches:
            for x in batch.column("x"):
                total += np.frombuffer(x.as_buffer(), float).reshape(shape)
        total /= divisor
        i, j = np.nonzero((np.abs(total) > limit) | (last & (np.arange(blocks[b][0], blocks[b][1]) == k - 1)[None, :]))
        c, i, j = total[i, j], i + blocks[a][0], j + blocks[b][0]
        ok = i < j
        yield pa.RecordBatch.from_arrays([pa.array(i[ok]), pa.array(j[ok]), pa.array(c[ok])], names=["i", "j", "corr"])

    sums = rows.mapInArrow(products, "a int, b int, x binary")
    return sums.groupBy("a", "b").applyInArrow(above, "i long, j long, corr double")


def correlated_drops(mat: DataFrame, features: Sequence[str], label: str = "label", limit: float = 0.98) -> list[str]:
    """Features to drop: of every pair above ``limit`` the one less correlated with the label.

    Only pairs above the limit, and one number per feature, reach the driver for the greedy choice.
    """
    k = len(features)
    own, pairs = [0.0] * k, []
    for r in correlated_pairs(mat, [*features, label], limit, last=True).orderBy("j", "i").collect():
        if r["j"] == k:
            own[r["i"]] = abs(r["corr"])
        else:
            pairs.append((r["i"], r["j"]))
    gone: set[int] = set()
    for i, j in pairs:
        if i not in gone and j not in gone:
            gone.add(i if own[j] >= own[i] else j)
    return [features[i] for i in sorted(gone)]


def drop_correlated(mat: DataFrame, features: Sequence[str], label: str = "label", limit: float = 0.98) -> DataFrame:
    return mat.drop(*correlated_drops(mat, features, label, limit))


def auc_table(df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label", bucket: Column | None = None) -> DataFrame:
    """Rank-sum AUROC per key with ties counted half, exact at any size.

    Rows reduce to distinct scores with class counts; ranks come from
    segment totals. No key is sorted in one task.
    """
    cells = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        x.count_where(F.col(label) == 1).alias("p"), x.count_where(F.col(label) == 0).alias("q"))
    r = skew.running_total(cells, keys, score, ["p", "q"], skew.number_buckets(F.col(score)) if bucket is None else bucket)
    u = F.sum(F.col("p") * (F.col("q_before") + F.col("q") / 2.0))
    return r.groupBy(*keys).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), u.alias("_u")).select(
        *keys, "n_pos", "n_neg", F.try_divide(F.col("_u"), F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0))).alias("auroc"))


def univariate_auc(long: DataFrame, spine: DataFrame, top: int = 50) -> DataFrame:
    """max(AUROC, 1 - AUROC) of each feature, absent rows as 0, with a signal band and rank.

    Absent rows are never built: their class counts are the class totals
    minus the stored ones and enter as one more cell with score 0.
    """
    y = spine.select("entity", "label")
    tot = y.agg(x.count_where(F.col("label") == 1).alias("p"), x.count_where(F.col("label") == 0).alias("q")).first()
    cells = long.join(y, "entity").groupBy("feature", "value").agg(x.count_where(F.col("label") == 1).alias("p"), x.count_where(F.col("label") == 0).alias("q"))
    seen = cells.groupBy("feature").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    rest = seen.select("feature", F.lit(0.0).alias("value"), (F.lit(tot["p"]) - F.col("p")).alias("p"), (F.lit(tot["q"]) - F.col("q")).alias("q"))
    cells = cells.unionByName(rest).groupBy("feature", "value").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    r = skew.running_total(cells, ["feature"], "value", ["p", "q"], skew.number_buckets(F.col("value")))
    u = r.groupBy("feature").agg(F.sum(F.col("p") * (F.col("q_before") + F.col("q") / 2.0)).alias("u"))
    a = F.col("u") / (float(tot["p"]) * float(tot["q"]))
    t = u.select("feature", F.greatest(a, 1.0 - a).alias("auc"))
    band = F.when(F.col("auc") > 0.55, "signal").when(F.col("auc") <= 0.52, "noise").otherwise("weak")
    return skew.rank_all(t.withColumn("band", band), [F.round("auc", 12).desc(), F.col("feature")]).withColumn("in_top", x.flag(F.col("rank") <= top))


def deconfound(mat: DataFrame, drop: Sequence[str], per_event: dict[str, tuple[str, str]], despite: dict[str, tuple[str, str]],
               signal: dict[str, float], burden: str) -> DataFrame:
    """Recording counts out, rates per event and comorbidity-adjusted signals in.

    per_event: name -> (count, total). despite: name -> (signal, comorbidity
    flag). signal: weights of the index, which is also divided by the burden.
    """
    rate = [(F.col(a) / F.greatest(F.col(b), F.lit(1))).alias(n) for n, (a, b) in per_event.items()]
    adj = [(F.coalesce(F.col(a), F.lit(0)) * F.col(b)).alias(n) for n, (a, b) in despite.items()]
    idx = x.total([F.coalesce(F.col(c), F.lit(0)) * w for c, w in signal.items()])
    out = mat.select("*", *rate, *adj, idx.alias("signal_index"))
    out = out.withColumn("signal_per_burden", F.col("signal_index") / F.greatest(F.col(burden), F.lit(1)))
    return out.drop(*drop)
