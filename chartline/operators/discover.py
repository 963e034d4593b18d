"""Code discovery and curation: which codes separate the classes.

Everything starts from distinct (entity, code) pairs, so counts per code are
plain sums, and all statistics are closed forms on one small row per code.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from .. import skew
from ..functions import scalar as x
from ..session import cut_lineage

# --- fixed values -----------------------------------------------------------
PROCESS_PATTERN = (
    r"biops|\breferr|mammog|screen|excis|histolog|cytolog|aspirat|\bFNA\b|ultrasound|\bMRI\b|\bCT scan|imaging|resection|operation|"
    r"surgery|2 ?week|fast.?track|colposcop|cystoscop|endoscop|radiothe|chemother|reconstruct|carcinoma|neoplasm|in situ|metastat"
)
LEAD_BINS = (("0-3", 0, 3), ("3-12", 3, 12), ("12-24", 12, 24), ("24-60", 24, 60), ("60+", 60, 99999))
ML_WEIGHTS = {"lr": 0.20, "rf": 0.25, "gb": 0.35, "mi": 0.20}
RANK_WEIGHTS = {"stat_score": 0.25, "chi2_score": 0.15, "mi_score": 0.15, "ml_importance": 0.45}
TIERS = ((-0.01, "very_low"), (0.2, "low"), (0.5, "medium"), (0.8, "high"))
FAMILY_PREFIXES = ("family history", "no family history", "no relevant family history", "no significant family history")
FAMILY_PARTS = ("family history of", "fh:")
# ----------------------------------------------------------------------------


def presence(ev: DataFrame, spine: DataFrame, by: str = "code") -> DataFrame:
    """Distinct (entity, code) with the entity's label."""
    return ev.where(F.col(by).isNotNull()).select("entity", by).distinct().join(spine.select("entity", "label"), "entity")


def class_totals(spine: DataFrame) -> tuple[int, int]:
    r = spine.agg(x.count_where(F.col("label") == 1).alias("p"), x.count_where(F.col("label") == 0).alias("q")).first()
    return r["p"], r["q"]


def code_counts(ev: DataFrame, spine: DataFrame, by: str = "code", term: str = "term") -> DataFrame:
    """Entities per code and class, the code's most common term, class totals."""
    p, q = class_totals(spine)
    n = presence(ev, spine, by).groupBy(by).agg(
        x.count_where(F.col("label") == 1).alias("n_pos"), x.count_where(F.col("label") == 0).alias("n_neg"))
    names = ev.where(F.col(by).isNotNull()).groupBy(by, F.col(term).alias("term")).agg(F.count(F.lit(1)).alias("c"))
    top = names.groupBy(by).agg(F.min(F.struct((-F.col("c")).alias("c"), "term"))["term"].alias("term"))
    return n.join(top, by).select("*", F.lit(p).cast("bigint").alias("total_pos"), F.lit(q).cast("bigint").alias("total_neg"))


def code_matrix(ev: DataFrame, spine: DataFrame, by: str = "code") -> DataFrame:
    """Long entity x code counts with the label."""
    return ev.groupBy("entity", by).agg(F.count(F.lit(1)).alias("event_count")).join(spine.select("entity", "label"), "entity")


def association(counts: DataFrame) -> DataFrame:
    """Prevalences, Haldane odds ratio, its log, standard error and 95 % interval."""
    p, q = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    tp, tn = F.col("total_pos"), F.col("total_neg")
    a, b, c, d = p + 0.5, tp - p + 0.5, q + 0.5, tn - q + 0.5
    orr = a * d / (b * c)
    se = F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return counts.select(
        "*", (p / tp).alias("prevalence_pos"), (q / tn).alias("prevalence_neg"), (p / tp - q / tn).alias("prevalence_diff"),
        F.when(q > 0, F.try_divide(p / tp, q / tn)).alias("prevalence_ratio"), orr.alias("odds_ratio"), F.log(orr).alias("log_odds_ratio"), se.alias("log_or_se"),
        F.exp(F.log(orr) - 1.96 * se).alias("or_ci_lower"), F.exp(F.log(orr) + 1.96 * se).alias("or_ci_upper"))


@F.pandas_udf(DoubleType())
def chi2_p(s: pd.Series) -> pd.Series:
    """Upper tail of chi-squared with one degree of freedom: erfc(sqrt(x / 2))."""
    return s.map(lambda v: None if v is None or math.isnan(v) else math.erfc(math.sqrt(max(v, 0.0) / 2.0)))


def chi2(counts: DataFrame) -> DataFrame:
    """Yates-corrected chi-squared of the 2x2 table, p-value, Bonferroni over the rows given."""
    p, q = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    b, d = F.col("total_pos") - p, F.col("total_neg") - q
    n = F.col("total_pos") + F.col("total_neg")
    det = F.abs(p * d - b * q)
    cut = F.greatest(det - F.least(det, n / 2.0), F.lit(0.0))
    stat = F.try_divide(n * cut * cut, F.nullif((p + b) * (q + d) * (p + q) * (b + d), F.lit(0.0)))
    t = counts.withColumn("chi_squared", stat).withColumn("p_value", chi2_p(F.col("chi_squared")))
    tests = counts.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    return t.withColumn("p_bonferroni", F.least(F.col("p_value") * float(max(tests, 1)), F.lit(1.0)))


def ranked(df: DataFrame, by: Column, id_col: str, name: str) -> DataFrame:
    """Position 1..n by a score, ties by id."""
    return skew.rank_all(df, [by.desc(), F.col(id_col)], name)


def filter_rank(stats: DataFrame, min_or: float = 1.2, max_p: float = 0.05, min_n: int = 10, id_col: str = "code") -> DataFrame:
    """Case-enriched, significant, frequent codes, ranked by odds ratio."""
    keep = (F.col("odds_ratio") > min_or) & (F.col("p_bonferroni") < max_p) & (F.col("n_pos") >= min_n)
    return ranked(stats.where(keep), F.round("odds_ratio", 12), id_col, "stat_rank")


def mutual_info(counts: DataFrame) -> DataFrame:
    """Mutual information (nats) of presence and label from the four cell counts."""
    p, q = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    tp, tn = F.col("total_pos").cast("double"), F.col("total_neg").cast("double")
    n = tp + tn

    def cell(k, row, col):
        return F.when(k > 0, k / n * F.log(F.try_divide(k * n, row * col))).otherwise(0.0)

    mi = cell(p, p + q, tp) + cell(q, p + q, tn) + cell(tp - p, n - p - q, tp) + cell(tn - q, n - p - q, tn)
    return counts.withColumn("mutual_info", F.greatest(mi, F.lit(0.0)))


def minmax(df: DataFrame, parts: dict[str, str]) -> list[Column]:
    """Scores scaled to 0..1 over all rows, under new names; missing counts as 0, all equal gives 0. Two numbers a score reach
    the driver."""
    value = {n: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for n, c in parts.items()}
    ends = df.agg(*[f(v).alias(f"{k}|{n}") for n, v in value.items() for k, f in (("lo", F.min), ("hi", F.max))]).first()
    out = []
    for n, v in value.items():
        lo, hi = ends[f"lo|{n}"], ends[f"hi|{n}"]
        out.append(((v - lo) / (hi - lo) if lo is not None and hi > lo else F.lit(0.0)).alias(n))
    return out


def combine_ranks(df: DataFrame, parts: dict[str, str], weights: dict[str, float], id_col: str = "code", top_n: int = 150,
                  rank_a: str = "stat_rank", rank_b: str = "ml_rank") -> DataFrame:
    """Weighted blend of min-max scaled scores with rank, tier and agreement flag.

    ``parts`` maps a score name of ``weights`` to a column. Runs on one row per code.
    """
    df = cut_lineage(df)
    t = df.select("*", *minmax(df, parts))
    score = x.total([F.col(n) * w for n, w in weights.items() if n in parts])
    t = ranked(t.withColumn("combined_score", score), F.round("combined_score", 12), id_col, "combined_rank")
    tier = F.lit(None).cast("string")
    for lo, name in TIERS:
        tier = F.when(F.col("combined_score") > lo, name).otherwise(tier)
    both = (F.col(rank_a) <= top_n) & (F.col(rank_b) > 0) & (F.col(rank_b) <= top_n)
    return t.withColumn("tier", tier).withColumn("both_agree", F.coalesce(both, F.lit(False)))


def curate(rank: DataFrame, curated: DataFrame, id_col: str = "code", high: int = 50, medium: int = 150, min_or: float = 1.2, max_p: float = 0.05) -> DataFrame:
    """Ranked list against the curated list: one suggested action per code, with notes."""
    j = rank.join(curated.select(id_col, "category").withColumn("in_curated", F.lit(True)), id_col, "full_outer")
    cur, rk = F.coalesce(F.col("in_curated"), F.lit(False)), F.col("combined_rank")
    sig = F.coalesce((F.col("odds_ratio") > min_or) & (F.col("p_bonferroni") < max_p), F.lit(False))
    action = (F.when(cur & rk.isNull(), "KEEP_BUT_RARE").when(cur & sig, "KEEP").when(cur, "KEEP_BUT_WEAK")
              .when(rk.isNull(), "IGNORE").when(rk <= high, "ADD_HIGH").when(rk <= medium, "ADD_MEDIUM").otherwise("IGNORE"))
    notes = F.concat_ws("; ", F.when(cur & rk.isNull(), F.lit("not in ranking")),
                        F.when(cur & (rk > medium), F.concat(F.lit("curated but rank "), rk.cast("string"), F.lit(f" > {medium}"))),
                        F.when(~cur & (F.col("odds_ratio") > 5), F.lit("high odds ratio")))
    return j.withColumn("in_curated", cur).withColumn("action", action).withColumn("notes", notes)


def classify_terms(terms: DataFrame, rules: Sequence[tuple[str, str, str]], categories: Sequence[tuple[str, str]] = (), term: str = "term") -> DataFrame:
    """Decision, reason and suggested category of distinct terms.

    ``rules`` are (needle, decision, reason) in order of priority; the needle
    'family-history' stands for the family-history test. The first rule that
    applies wins. ``categories`` are (category, regex) in order.
    """
    t = F.lower(F.trim(F.coalesce(F.col(term), F.lit(""))))
    family = x.any_of([t.startswith(p) for p in FAMILY_PREFIXES] + [t.contains(p) for p in FAMILY_PARTS])
    hits = [F.when(family if needle == "family-history" else t.contains(needle), F.lit(i)) for i, (needle, _, _) in enumerate(rules)]
    first = F.when(t == "", F.lit(-1)).otherwise(F.coalesce(*hits, F.lit(-2)))
    table = {-1: ("REMOVE_NOISE", "generic:empty term"), -2: ("KEEP", "valid signal")} | {i: (d, why) for i, (_, d, why) in enumerate(rules)}
    cat = F.coalesce(*[F.when(F.col(term).rlike("(?i)" + rx), F.lit(c)) for c, rx in categories], F.lit("")) if categories else F.lit("")
    return terms.withColumn("_i", first).select(
        *terms.columns, x.lookup(F.col("_i"), {k: d for k, (d, _) in table.items()}).alias("decision"),
        x.lookup(F.col("_i"), {k: w for k, (_, w) in table.items()}).alias("reason"), cat.alias("suggested_category"))


def leadtime(ev: DataFrame, spine: DataFrame, by: str = "code", process: str = PROCESS_PATTERN, min_pos: int = 50) -> DataFrame:
    """Smoothed lift of each code in bins of months before the anchor, and its class.

    Distinct (entity, code, bin) rows are reduced first; the rest is one row per code.
    """
    p, q = class_totals(spine)
    lab = x.band("months_before", [b[1] for b in LEAD_BINS] + [LEAD_BINS[-1][2]], [b[0] for b in LEAD_BINS])
    cells = ev.withColumn("bin", lab).where(F.col("bin").isNotNull()).select("entity", by, "bin").distinct().join(spine.select("entity", "label"), "entity")
    names = ev.groupBy(by, F.col("term").alias("term")).agg(F.count(F.lit(1)).alias("c")).groupBy(by).agg(
        F.min(F.struct((-F.col("c")).alias("c"), "term"))["term"].alias("term"))
    aggs = []
    for name, _, _ in LEAD_BINS:
        here = F.col("bin") == name
        aggs += [x.count_where(here & (F.col("label") == 1)).alias(f"p_{name}"), x.count_where(here & (F.col("label") == 0)).alias(f"q_{name}")]
    t = cells.groupBy(by).agg(*aggs)

    def lift(n):
        return ((F.col(f"p_{n}") + 0.5) / float(p)) / ((F.col(f"q_{n}") + 0.5) / float(q))

    t = t.select(by, F.greatest(*[F.col(f"p_{n}") for n, _, _ in LEAD_BINS]).alias("n_pos"), lift("0-3").alias("near"),
                 ((lift("12-24") + lift("24-60")) / 2).alias("mid"), lift("60+").alias("far")).join(names, by)
    near, mid, far = F.col("near"), F.col("mid"), F.col("far")
    spike = (near >= 3) & (mid < 1.5) & (far < 1.5)
    proc = F.coalesce(F.col("term").rlike("(?i)" + process), F.lit(False))
    cls = (F.when(F.col("n_pos") < min_pos, "rare").when(spike & proc, "REACTIVE-LEAK").when((mid >= 1.5) & (near >= mid * 1.6), "PRODROMAL")
           .when((far >= 1.4) & (mid >= 1.4), "LIFETIME").when((mid >= 1.4) | (far >= 1.4), "EARLY").when(spike, "near-dx-symptom").otherwise("weak"))
    return t.withColumn("process_term", proc).withColumn("class", cls)


# --- resampling -------------------------------------------------------------
POISSON_1 = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)


PACK = 21  # weights of three bits that a long holds


def digest(id_col: Column, draw: int, seed: str) -> Column:
    """The md5 of id, seed and draw: the same in every run and on every cluster."""
    return F.md5(F.concat_ws("|", id_col.cast("string"), F.lit(seed), F.lit(str(draw))))


def poisson(h: Column) -> Column:
    """Poisson(1) weight for the first seven digits of a digest, as a number in [0, 1): how many steps of the distribution function
    it passes. The steps are hex digits too, since hex text orders as its numbers do."""
    steps = [f"{math.ceil(t * 2**28):07x}" for t in POISSON_1]
    out = F.when(h < steps[0], 0)
    for k, t in enumerate(steps[1:], 1):
        out = out.when(h < t, k)
    return out.otherwise(len(steps)).cast("bigint")


def with_weights(df: DataFrame, draws: int, seed: str, keep: Sequence[str], id_col: str = "entity") -> DataFrame:
    """Columns w0.. of resampling weights, ``PACK`` draws in each (``weight`` reads one). The hashes are one projection, the weights
    the next, so each hash is computed once. Rows are spread over the tasks first: a small file is one task, its hashes are not small."""
    h = df.select(*dict.fromkeys([*keep, id_col])).repartition(id_col).select(*keep, *[digest(F.col(id_col), b, seed).alias(f"h{b}") for b in range(draws)])
    return h.select(*keep, *[x.total([F.shiftleft(poisson(F.col(f"h{b}")), 3 * (b - i)) for b in range(i, min(i + PACK, draws))]).alias(f"w{i // PACK}")
                             for i in range(0, draws, PACK)])


def weight(b: int) -> Column:
    """Weight of draw b out of the columns of ``with_weights``."""
    return F.shiftright(F.col(f"w{b // PACK}"), 3 * (b % PACK)).bitwiseAND(7)


def bootstrap_stability(pairs: DataFrame, spine: DataFrame, draws: int = 20, top_k: int = 150, by: str = "code", seed: str = "42", threshold: float = 0.8) -> DataFrame:
    """Share of entity resamples in which a code is among the top k by odds ratio.

    Each entity carries its ``draws`` weights in a few longs, made once. Pairs travel to their code that narrow, before the sums of
    all resamples widen a row; rows are not multiplied. A code's odds are kept, and only those that may be among a draw's first k are
    sorted.
    """
    w = cut_lineage(with_weights(spine, draws, seed, ["entity", "label"]))
    pos = F.col("label") == 1
    sums = [F.sum(F.when(pos, weight(b)).otherwise(0)).alias(f"p{b}") for b in range(draws)] + [
        F.sum(F.when(pos, 0).otherwise(weight(b))).alias(f"q{b}") for b in range(draws)]
    tot = w.agg(*sums).first()
    # a hot entity is split by the join, a hot code by the rebalancing; checkpointed weights look smaller than they are, so no broadcast
    laid = pairs.select("entity", by).join(w.hint("merge"), "entity").drop("entity").withColumn("_at", F.hash(by)).hint("rebalance", "_at")
    s = laid.groupBy(by).agg(*sums)

    def odds(b):
        p, q = F.col(f"p{b}") + 0.5, F.col(f"q{b}") + 0.5
        return (p * (tot[f"q{b}"] + 1.0 - q)) / ((tot[f"p{b}"] + 1.0 - p) * q)

    s = cut_lineage(s.select(by, F.array(*[odds(b) for b in range(draws)]).alias("odds")))
    per = skew.high_rows(s.select(by, F.posexplode("odds").alias("draw", "odds")), ["draw"], "odds", top_k, 1e-8)
    hit = skew.top_by(per, ["draw"], [F.round("odds", 9).desc(), F.col(by)], top_k, "_rn")
    n = hit.groupBy(by).agg((F.count(F.lit(1)) / float(draws)).alias("stability"))
    return s.select(by).join(n, by, "left").na.fill(0.0, ["stability"]).withColumn("stable", x.flag(F.col("stability") >= threshold))
