"""Mixing sources to target weights by entropy balancing.

Every word counts as one unit of mass. Among all document rates w within [0, cap] that give each source its
target of words (and, where asked for, keep the mean of given features), the balanced ones stay closest to 1
in relative entropy:

    minimise  sum_d size_d (w_d log w_d - w_d + 1)   subject to   sum_{d in s} size_d w_d = target_s,
              sum_d size_d w_d (z_dk - mean_k) = 0,  0 <= w_d <= cap

whose solution is exponentially tilted, w_d = min(cap, exp(lambda_s + sum_k mu_k (z_dk - mean_k))). The dual is
convex; Newton's method solves it, with shorter steps where a whole one would raise the dual. Each iteration is one aggregation over the corpus, reduced beforehand to
cells (source, size, features) with counts. The Hessian is an arrow: one number per source, and a small block
for the features, so the sources are eliminated in the table and only k + k^2 numbers reach the driver. Targets come before features: if no
rates meet both, the features are let go and w_d = target_s / size_s.

Rates are rounded to whole copies: floor(w) copies, and one more for the documents that come first in the
order of u / (w - floor(w)), u a hash of the id, until the source has its words (order sampling: a document's
chance is about its fraction, and a source misses its target by at most half of one document).

Sizes are words; a null text has none, a null source is a source of its own and the last one. Documents without
words take rate 1. Repeated rows are treated alike and all returned; an empty table gives an empty one.
Source order, targets and copies depend on nothing but the data. One row per source is assumed to fit a task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..skew import join_null_safe, number_buckets, running_total
from ..session import cut_lineage
from .common import n_words, stored

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
STEPS, TOLERANCE, LONGEST = 40, 1e-7, 2.0


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """(source, source_size) -> adds target: ``share`` of all words by weight, none above cap x its source's words.

    Targets are min(cap * size, c * weight): c is found from the sources in the order of size / weight, in which
    the capped ones come first.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    d = sizes.withColumn("_w", w).withColumn("_top", F.lit(cap) * F.col("source_size"))
    by = W.orderBy(F.col("_top") / F.col("_w"), F.col("source").asc_nulls_last())
    upto = by.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    d = d.withColumn("_capped", F.coalesce(F.sum("_top").over(upto), F.lit(0.0))).withColumn("_left", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(upto), F.lit(0.0)))
    # c if this source and all after it stay below their caps: right for the first source where it holds, less for later ones
    d = d.withColumn("_c", (F.lit(share) * F.sum("source_size").over(every) - F.col("_capped")) / F.col("_left"))
    c = F.max(F.when(F.col("_c") * F.col("_w") <= F.col("_top"), F.col("_c"))).over(every)
    return d.select("source", "source_size", F.least(F.col("_top"), F.coalesce(c, F.lit(float("inf"))) * F.col("_w")).alias("target"))


def tilt(cells: DataFrame, goal: DataFrame, features: Sequence[str] = (), cap: float = CAP) -> tuple[DataFrame, np.ndarray]:
    """Damped Newton on the dual. ``cells``: source, size, n and features (centred); ``goal``: source, target.

    Returns (source, lambda) and mu. Sources without words or with target 0 get lambda -inf (rate 0). Targets are hard,
    features are not: where both can't be met, or the steps don't settle, mu is 0 and lambda log(target / size), which
    meets the targets. Targets above cap times a source's words are an error.
    """
    k = len(features)
    mu, value, scale = np.zeros(k), None, 1.0
    live = goal.where("target > 0 and source_size > 0")
    state = start = live.select("source", "target", F.log(F.col("target") / F.col("source_size")).alias("lam"))
    for _ in range(STEPS):
        tilted = F.col("lam") + sum((F.lit(float(m)) * F.col(f) for m, f in zip(mu, features)), F.lit(0.0))
        raw = F.exp(F.least(tilted, F.lit(50.0)))
        d = join_null_safe(cells, state, ["source"]).withColumn("_w", F.least(raw, F.lit(cap))).withColumn("_m", F.col("size") * F.col("n"))
        mass, free = F.col("_m") * F.col("_w"), F.when(raw < cap, F.col("_m") * F.col("_w")).otherwise(0.0)
        conjugate = F.when(raw < cap, raw).otherwise(F.lit(cap) * (1 + tilted - F.lit(float(np.log(cap)))))
        per = d.groupBy("source", "target", "lam").agg(
            F.sum(mass).alias("m"), F.sum(free).alias("h"), F.sum("_m").alias("words"), F.sum(F.col("_m") * conjugate).alias("c"),
            *[F.sum(mass * F.col(f)).alias(f"g{i}") for i, f in enumerate(features)],
            *[F.sum(free * F.col(f)).alias(f"h{i}") for i, f in enumerate(features)],
            *[F.sum(free * F.col(features[i]) * F.col(features[j])).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)])
        per = cut_lineage(per)
        part = lambda i: F.col(f"h{i}") / F.greatest(F.col("h"), F.lit(1e-9))
        gap = F.col("target") - F.col("m")
        got = per.agg(F.max(F.abs(gap) / F.col("target")).alias("worst"), F.sum("words").alias("words"), F.sum(F.col("c") - F.col("target") * F.col("lam")).alias("dual"),
                      *[F.sum(-F.col(f"g{i}") - part(i) * gap).alias(f"r{i}") for i in range(k)], *[F.sum(F.abs(F.col(f"g{i}"))).alias(f"a{i}") for i in range(k)],
                      *[F.sum(F.col(f"g{i}")).alias(f"s{i}") for i in range(k)],
                      *[F.sum(F.col(f"h{i}_{j}") - part(i) * F.col(f"h{j}")).alias(f"q{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        if got["worst"] is None:  # no source with words
            break
        if got["worst"] < TOLERANCE and all(abs(got[f"s{i}"]) <= 1e-6 * max(1.0, got[f"a{i}"]) for i in range(k)):
            return per.select("source", "lam"), mu
        if value is None and got["worst"] >= TOLERANCE:
            raise ValueError(f"a target is above {cap} times its source's words")
        # no rates cost more than this, so by weak duality nothing meets all constraints
        if got["dual"] < -max(0.0, cap * (np.log(cap) - 1)) * got["words"] * (1 + 1e-9):
            break
        if value is not None and got["dual"] > value + 1e-10 * got["words"]:  # too far: half as long a step from the last good place
            scale /= 2
        else:
            at, value, scale, step = mu, got["dual"], 1.0, np.zeros(k)
            if k:
                q = np.array([[got[f"q{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                step = np.linalg.lstsq(q + 1e-9 * np.eye(k) * max(1.0, np.trace(q)), np.array([got[f"r{i}"] for i in range(k)]), rcond=None)[0]
                step = np.clip(step, -LONGEST, LONGEST)
            # near its cap a source has hardly any free mass left; a bounded step keeps it on the way, and it follows mu in full
            room = F.greatest(F.col("h"), 1e-6 * F.col("target"))
            follow = sum((F.col(f"h{i}") * F.lit(float(step[i])) for i in range(k)), F.lit(0.0)) / room
            good = per.withColumn("own", F.greatest(F.least(gap / room, F.lit(LONGEST)), F.lit(-LONGEST)) - follow)
        mu = at + scale * step
        state = good.select("source", "target", (F.col("lam") + F.lit(float(scale)) * F.col("own")).alias("lam"))
    return start.select("source", "lam"), np.zeros(k)


def rates(cells: DataFrame, goal: DataFrame, features: dict[str, Column], cap: float = CAP) -> tuple[DataFrame, Column]:
    """(source, lambda) and the rate of a row as a column over source's lambda, size and the features' columns."""
    names = list(features)
    if not names:
        lam, mu = tilt(cells, goal, (), cap)
        return lam, F.least(F.exp(F.col("lam")), F.lit(cap))
    mass = F.col("size") * F.col("n")
    mean = cells.agg(*[F.try_divide(F.sum(mass * c), F.sum(mass)).alias(x) for x, c in features.items()]).first()
    centred = {x: c - F.lit(float(mean[x] or 0.0)) for x, c in features.items()}
    lam, mu = tilt(cells.select("source", "size", "n", *[c.alias(f"_z_{x}") for x, c in centred.items()]), goal, [f"_z_{x}" for x in names], cap)
    tilted = F.col("lam") + sum((F.lit(float(m)) * centred[x] for m, x in zip(mu, names)), F.lit(0.0))
    return lam, F.least(F.exp(F.least(tilted, F.lit(50.0))), F.lit(cap))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP, features: dict[str, Column] | None = None, salt: str = "mix") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies. See the module's text."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    alike = stored(rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-rows")
    cells = stored(alike.groupBy("source", "size").agg(F.sum("n").alias("n")), "mix-cells")
    goal = stored(targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, cap), "mix-goal")
    lam, rate = rates(cells, goal, features or {}, cap)
    d = join_null_safe(join_null_safe(alike, goal, ["source"], "left"), lam, ["source"], "left")
    d = d.withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(F.coalesce(rate, F.lit(0.0))))
    # a rate within a millionth of a whole number is that number
    d = d.withColumn("rate", F.when(F.abs(F.col("rate") - F.round("rate")) < 1e-6, F.round("rate")).otherwise(F.col("rate")))
    d = d.withColumn("_floor", F.floor("rate")).withColumn("_part", F.col("rate") - F.col("_floor"))
    h = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("source"), F.col("size").cast("string"), F.lit(salt)))
    u = (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16 ** 13))
    d = d.withColumn("_key", F.when(F.col("_part") > 0, u / F.col("_part"))).withColumn("_order", F.struct("_key", F.lit(h).alias("h"), "doc_id"))
    d = stored(d.withColumn("_mass", F.col("size") * F.col("n")).withColumn("_whole", F.col("_mass") * F.col("_floor")), "mix-rates", "zstd")
    # rows with whole rates take no other copy: they need no order, only their sum
    whole = d.groupBy("source").agg(F.sum("_whole").alias("_whole_all"))
    run = running_total(d.where("_part > 0"), ["source"], "_order", ["_mass"], number_buckets(F.col("_key")))
    run = join_null_safe(run, whole, ["source"])
    d = run.select(*d.columns, (F.col("_mass_before") + F.col("_mass") / 2 < F.col("target") - F.col("_whole_all")).alias("_more")).unionByName(
        d.where("_part <= 0").withColumn("_more", F.lit(False)))
    more = F.col("_more")
    copies = (F.col("_floor") + more.cast("long")).cast("long")
    return d.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_i")).drop("_i")


def length_profile() -> dict[str, Column]:
    """The production feature: the mix keeps the corpus's mean of log2(1 + size) over words where the targets allow it."""
    return {"log_size": F.log2(1.0 + F.col("size"))}


def report(docs: DataFrame) -> DataFrame:
    """op7: per document its size, its source's size and target, the words taken, its rate and copies."""
    d = mixed(docs, features=length_profile())
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "rate", "copies")


def remix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as its copies say; repeated rows count one by one."""
    take = mixed(docs, features=length_profile()).groupBy("doc_id", "source", "size").agg(F.max("copies").alias("copies"))
    d = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", n_words(F.col("text")).alias("size"))
    joined = join_null_safe(d, take, ["doc_id", "source", "size"])
    return joined.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
