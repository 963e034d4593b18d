"""The wide feature flow as one plan: events to day cells to category rows to the matrix.

Events are grouped once by (entity, category, day); all aggregates of that
step have fixed-width buffers, so it runs as a hash aggregation without a
sort and combines before the shuffle. Category rows and the matrix roll up
from there: every algebraic family (counts, halves, recency, span, decay,
bins, value levels, first and last, slope) comes out of the same three
groupings. Only gaps between days need an ordering, over days.

Expressions are SQL text because there are hundreds of columns: one call per
column instead of dozens keeps planning short.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F


@dataclass(frozen=True)
class MatrixConfig:
    """Category vocabularies and windows; everything the columns depend on is fixed here, not read from the data."""

    categories: Sequence[str]
    lab_categories: Sequence[str] = ()
    symptom_categories: Sequence[str] = ()
    investigation_categories: Sequence[str] = ()
    clusters: dict[str, Sequence[str]] = field(default_factory=dict)
    bins: Sequence[int] = (0, 3, 6, 9, 12, 15)
    decay_rate: float = 0.1
    interactions: Sequence[tuple[str, str, str]] = ()


COUNT_COLS = ("count_A", "count_B", "count_total", "has_ever", "acceleration", "new_in_B", "decay", "visits", "span_days")
DAY_COLS = ("days_since_last",)
VALUE_COLS = ("value_mean", "value_min", "value_max", "value_std", "value_first", "value_last", "value_mean_A", "value_mean_B", "value_delta", "value_slope")


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in(cats: Sequence[str]) -> str:
    return f"category IN ({', '.join(map(_lit, cats))})"


def _exprs(named: dict[str, str]):
    return [F.expr(f"{e} AS `{n}`") for n, e in named.items()]


def day_cells(ev: DataFrame, cfg: MatrixConfig) -> DataFrame:
    """One row per (entity, category, day): counts and value moments. Days before the anchor and halves are functions of the day."""
    return ev.where(F.col("time_window").isNotNull() & F.col("category").isin(*cfg.categories)).groupBy("entity", "category", "event_date").agg(*_exprs({
        "n": "count(1)", "days": "min(days_before)", "months": "min(months_before)", "is_b": "min(int(time_window = 'B'))",
        "nv": "count(value)", "sv": "sum(value)", "svv": "sum(value * value)", "lo": "min(value)", "hi": "max(value)"}))


def category_rows(cells: DataFrame, cfg: MatrixConfig) -> DataFrame:
    """One row per (entity, category) with every algebraic family; slope and deviation from weighted sums."""
    f = {
        "count_A": "sum(if(is_b = 0, n, 0))", "count_B": "sum(if(is_b = 1, n, 0))", "count_total": "sum(n)", "visits": "count(1)",
        "decay": f"sum(n * exp(-{cfg.decay_rate}D * greatest(months, 0)))", "days_since_last": "min(days)", "span_days": "max(days) - min(days)",
        "value_min": "min(lo)", "value_max": "max(hi)", "value_first": "max_by(lo, days) FILTER (WHERE nv > 0)", "value_last": "min_by(hi, days) FILTER (WHERE nv > 0)",
        "nv": "sum(nv)", "sv": "sum(sv)", "svv": "sum(svv)", "nv_a": "sum(if(is_b = 0, nv, 0))", "nv_b": "sum(if(is_b = 1, nv, 0))",
        "sv_a": "sum(if(is_b = 0, sv, 0D))", "sv_b": "sum(if(is_b = 1, sv, 0D))",
        # x is minus the days before the anchor, so that later is larger
        "sx": "sum(-double(days) * nv)", "sxx": "sum(double(days) * days * nv)", "sxy": "sum(-double(days) * sv)",
    }
    for lo, hi in zip(cfg.bins, cfg.bins[1:]):
        f[f"bin_{lo}_{hi}"] = f"sum(if(months > {lo} AND months <= {hi}, n, 0))"
    t = cells.groupBy("entity", "category").agg(*_exprs(f))
    den = "(nv * sxx - sx * sx)"
    return t.select("*", *_exprs({
        "has_ever": "int(count_total > 0)", "acceleration": "int(count_B > count_A)", "new_in_B": "int(count_B > 0 AND count_A = 0)",
        "value_mean": "try_divide(sv, nv)", "value_std": "if(nv > 1, sqrt(greatest(try_divide(svv - try_divide(sv * sv, nv), nv - 1), 0D)), NULL)",
        "value_mean_A": "try_divide(sv_a, nv_a)", "value_mean_B": "try_divide(sv_b, nv_b)",
        "value_delta": "try_divide(sv_b, nv_b) - try_divide(sv_a, nv_a)", "value_slope": f"try_divide(nv * sxy - sx * sv, nullif({den}, 0D))"}))


def feature_names(cfg: MatrixConfig) -> list[str]:
    return [f"{c}_{f}" for c in cfg.categories for f in (*COUNT_COLS, *DAY_COLS)] + [f"{c}_{f}" for c in cfg.lab_categories for f in VALUE_COLS]


def entity_rows(tall: DataFrame, cfg: MatrixConfig, names: Sequence[str]) -> DataFrame:
    """Totals, diversity, bins, groups and the category columns of each entity: one grouping of a few rows per entity."""
    f = {
        "total_events": "sum(count_total)", "events_A": "sum(count_A)", "events_B": "sum(count_B)", "unique_categories": "count(1)",
        "categories_A": "count_if(count_A > 0)", "categories_B": "count_if(count_B > 0)", "new_categories": "count_if(new_in_B = 1)",
        "accelerating_categories": "count_if(acceleration = 1)", "decay_total": "sum(decay)", "_counts": "sort_array(collect_list(count_total))",
    }
    for lo, hi in zip(cfg.bins, cfg.bins[1:]):
        f[f"bin_{lo}_{hi}"] = f"sum(bin_{lo}_{hi})"
        f[f"bin_cats_{lo}_{hi}"] = f"count_if(bin_{lo}_{hi} > 0)"
    groups = {**{f"cluster_{k}": v for k, v in cfg.clusters.items()}, "symptom": cfg.symptom_categories, "investigation": cfg.investigation_categories}
    for name, cats in groups.items():
        if cats:
            f |= {f"{name}_count": f"sum(if({_in(cats)}, count_total, 0))", f"{name}_count_B": f"sum(if({_in(cats)}, count_B, 0))", f"{name}_breadth": f"count_if({_in(cats)})"}
    for n in names:
        cat = max((c for c in cfg.categories if n.startswith(c + "_")), key=len)
        f[n] = f"max(if(category = {_lit(cat)}, {n[len(cat) + 1:]}, NULL))"
    t = tall.groupBy("entity").agg(*_exprs(f))
    p = "transform(_counts, c -> c / total_events)"
    d = {
        "events_ratio": "events_B / greatest(events_A, 1)", "acute_onset": "int(new_categories >= 2)",
        "entropy": f"-aggregate({p}, 0D, (s, q) -> s + q * log2(q + 1e-10D))",
        "gini": "if(size(_counts) <= 1, 0D, 2 * aggregate(transform(_counts, (c, i) -> c * (i + 1D)), 0D, (s, q) -> s + q) / (size(_counts) * total_events) - (size(_counts) + 1) / size(_counts))",
    }
    if cfg.clusters:
        d["multi_system_count"] = " + ".join(f"int(cluster_{c}_count > 0)" for c in cfg.clusters)
    t = t.select("*", *_exprs(d)).drop("_counts")
    return t.select("*", *_exprs({"systems_3plus": "int(multi_system_count >= 3)"})) if cfg.clusters else t


def day_rows(ev: DataFrame) -> DataFrame:
    """Visits and gaps per entity, from one row per (entity, day); the scan reads three columns."""
    days = ev.where(F.col("time_window").isNotNull()).groupBy("entity", "event_date").agg(*_exprs({"n": "count(1)", "is_b": "min(int(time_window = 'B'))"}))
    st = days.select("*", F.expr("datediff(event_date, lag(event_date) OVER (PARTITION BY entity ORDER BY event_date)) AS gap"))
    return st.groupBy("entity").agg(*_exprs({"visits": "count(1)", "visits_A": "count_if(is_b = 0)", "visits_B": "count_if(is_b = 1)",
                                             "max_per_day": "max(n)", "max_gap": "max(gap)", "mean_day_gap": "avg(gap)"}))


def build(ev: DataFrame, spine: DataFrame, cfg: MatrixConfig, keep: Sequence[str] | None = None) -> DataFrame:
    """The matrix: one row per spine entity, fixed columns, absence filled by the kind of the feature.

    A keep list shortens the list of expressions before anything is computed.
    """
    names = [n for n in feature_names(cfg) if keep is None or n in keep]
    per = entity_rows(category_rows(day_cells(ev, cfg), cfg), cfg, names)
    out = spine.join(per, "entity", "left").join(day_rows(ev), "entity", "left")
    level = {f"{c}_{f}" for c in cfg.lab_categories for f in VALUE_COLS}
    days = {f"{c}_{f}" for c in cfg.categories for f in DAY_COLS} | {"max_gap", "mean_day_gap"}
    filled = [f"`{c}`" if c in spine.columns or c in level else f"coalesce(`{c}`, {-1 if c in days else 0}) AS `{c}`" for c in out.columns]
    pairs = [f"`{a}` * `{b}` AS `{n}`" for n, a, b in cfg.interactions if a in out.columns and b in out.columns]
    return out.selectExpr(*filled).selectExpr("*", *pairs)
