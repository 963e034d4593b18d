"""Disease-specific feature blocks as configuration.

A disease names groups of categories, term subtypes, laboratory series and
flags over them; the blocks (counts and halves, subtypes, latest and extreme
laboratory values, thresholds, multi-system activity, velocity, new onset,
age products, first onset, orderings, weighted burden, bursts) are the same
for all. Everything but the laboratory series and the burst comes from one
grouping by entity.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..operators import patterns


@dataclass(frozen=True)
class Disease:
    name: str
    groups: Mapping[str, Sequence[str]]  # group -> categories of events (observations and medications)
    subtypes: Mapping[str, tuple[str, str]] = field(default_factory=dict)  # name -> (group, term pattern)
    labs: Mapping[str, tuple[Sequence[str], str]] = field(default_factory=dict)  # name -> (categories or (), term pattern)
    lab_flags: Mapping[str, str] = field(default_factory=dict)  # name -> condition over <lab>_latest, _first, _max, _min, _tested
    flags: Mapping[str, str] = field(default_factory=dict)  # name -> condition over has_<group>, n_<group>, a_<group>, b_<group>, age, sex, earlier flags
    scores: Mapping[str, str] = field(default_factory=dict)  # name -> number over the same columns
    cuts: Mapping[str, str] = field(default_factory=dict)  # name -> condition over scores and all columns before them
    burden_products: Sequence[str] = ()  # columns, times the burden score
    systems: Mapping[str, Sequence[str]] = field(default_factory=dict)  # system -> groups, active in the recent half
    trends: Sequence[str] = ()  # groups with velocity, new onset, age products
    onsets: Sequence[str] = ()  # groups with months since the first event
    sequences: Sequence[tuple[str, str, int]] = ()  # (group x, group y, days)
    products: Mapping[str, Sequence[str]] = field(default_factory=dict)  # name -> columns, times age
    weights: Mapping[str, float] = field(default_factory=dict)  # category -> weight of the burden score
    symptoms: Sequence[str] = ()  # categories of the burst window
    peak_age: float = 75.0
    elderly: int = 70
    vocabularies: Mapping[str, Sequence[str]] = field(default_factory=dict)  # the disease's category lists by role

    def check(self) -> "Disease":
        """Every group that is referred to exists."""
        used = {g for gs in self.systems.values() for g in gs} | set(self.trends) | set(self.onsets)
        used |= {g for x_, y_, _ in self.sequences for g in (x_, y_)} | {g for g, _ in self.subtypes.values()}
        unknown = used - set(self.groups)
        if unknown:
            raise ValueError(f"{self.name}: unknown groups {sorted(unknown)}")
        return self


def _q(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in(cats: Sequence[str]) -> str:
    return f"category IN ({', '.join(map(_q, cats))})"


def _exprs(named: Mapping[str, str]):
    return [F.expr(f"{e} AS `{n}`") for n, e in named.items()]


def _levels(flags: Mapping[str, str]) -> list[dict[str, str]]:
    """Flags in batches, so that no flag reads another of its own batch."""
    out: list[dict[str, str]] = [{}]
    for n, c in flags.items():
        if set(re.findall(r"\w+", c)) & set(out[-1]):
            out.append({})
        out[-1][n] = c
    return out


def lab_rows(ev: DataFrame, d: Disease) -> DataFrame:
    """Latest, first, largest and smallest value of each laboratory series, and whether it was measured."""
    conds = {n: (f"{_in(cats)} AND " if cats else "") + f"term rlike {_q('(?i)' + rx)}" for n, (cats, rx) in d.labs.items()}
    # each condition is a column, tested once a row and not once an aggregate
    every = ev.where(F.col("value").isNotNull()).select("entity", "event_date", "value", *_exprs({f"_is_{n}": c for n, c in conds.items()}))
    rows = every.where(F.expr(" OR ".join(f"_is_{n}" for n in conds)))
    f = {}
    for n in conds:
        c = f"_is_{n}"
        pair = f"if({c}, struct(event_date, value), NULL)"
        f |= {f"{n}_latest": f"max({pair}).value", f"{n}_first": f"min({pair}).value", f"{n}_max": f"max(if({c}, value, NULL))",
              f"{n}_min": f"min(if({c}, value, NULL))", f"{n}_tested": f"int(count_if({c}) > 0)"}
    return rows.groupBy("entity").agg(*_exprs(f))


def features(ev: DataFrame, spine: DataFrame, d: Disease, burst_days: int = 30, age_deciles: bool = False) -> DataFrame:
    """One row per spine entity (entity, age, sex) with the disease's blocks; absent counts and flags are 0, laboratory levels stay NULL.

    ``age_deciles`` adds each entity's decile (0 to 9) of age within the spine.
    """
    d.check()
    ev = ev.where(F.col("time_window").isNotNull())
    f = {"events_A": "count_if(time_window = 'A')", "events_B": "count_if(time_window = 'B')", "n_categories": "count(DISTINCT category)", "_anchor": "max(anchor_date)"}
    for g, cats in d.groups.items():
        f |= {f"a_{g}": f"count_if({_in(cats)} AND time_window = 'A')", f"b_{g}": f"count_if({_in(cats)} AND time_window = 'B')",
              f"_f_{g}": f"min(if({_in(cats)}, event_date, NULL))"}
    for n, (g, rx) in d.subtypes.items():
        f[f"{n}_count"] = f"count_if({_in(d.groups[g])} AND term rlike {_q('(?i)' + rx)})"
    if d.weights:
        f["weighted_burden"] = " + ".join(f"{w}D * max(int({_in([c])}))" for c, w in d.weights.items())
    t = ev.groupBy("entity").agg(*_exprs(f))
    out = spine.select("entity", "age", "sex").join(t, "entity", "left")
    if d.labs:
        out = out.join(lab_rows(ev, d), "entity", "left")
    if d.symptoms:
        out = out.join(patterns.burst(ev.where(F.col("category").isin(*d.symptoms)), burst_days), "entity", "left")
    levels = {f"{n}_{s}" for n in d.labs for s in ("latest", "first", "max", "min")}
    keep = {"entity", "age", "sex", "_anchor", *levels} | {f"_f_{g}" for g in d.groups}
    out = out.selectExpr(*[f"`{c}`" if c in keep else f"coalesce(`{c}`, 0) AS `{c}`" for c in out.columns])

    base = {f"n_{g}": f"a_{g} + b_{g}" for g in d.groups} | {f"has_{g}": f"int(a_{g} + b_{g} > 0)" for g in d.groups}
    base |= {f"{n}_flag": f"int({n}_count > 0)" for n in d.subtypes}
    base |= {n: f"int(coalesce({c}, false))" for n, c in d.lab_flags.items()}
    out = out.selectExpr("*", *[f"{e} AS `{n}`" for n, e in base.items()])
    for level in _levels(d.flags):  # flags may build on earlier ones
        out = out.selectExpr("*", *[f"int(coalesce({c}, false)) AS `{n}`" for n, c in level.items()])
    if d.scores:
        out = out.selectExpr("*", *[f"double({e}) AS `{n}`" for n, e in d.scores.items()])
    if d.cuts:
        out = out.selectExpr("*", *[f"int(coalesce({c}, false)) AS `{n}`" for n, c in d.cuts.items()])

    last = {}
    active = {s: " OR ".join(f"b_{g} > 0" for g in gs) for s, gs in d.systems.items()}
    if active:
        n_sys = " + ".join(f"int({c})" for c in active.values())
        last |= {"systems_B": n_sys, "systems_pair_B": f"int({n_sys} >= 2)", "systems_trifecta_B": f"int({n_sys} >= 3)"}
    for g in d.trends:
        last |= {f"vel_{g}": f"greatest(b_{g} - a_{g}, 0)", f"new_{g}_B_only": f"int(b_{g} > 0 AND a_{g} = 0)", f"age_x_{g}_B": f"age * b_{g}",
                 f"age_x_vel_{g}": f"age * greatest(b_{g} - a_{g}, 0)", f"age_x_new_{g}": f"age * int(b_{g} > 0 AND a_{g} = 0)",
                 f"elderly_{g}": f"int(age >= {d.elderly} AND b_{g} > 0)"}
    for g in d.onsets:
        m = f"datediff(_anchor, _f_{g}) / 30.44D"
        last |= {f"first_{g}_months": f"coalesce({m}, -1D)", f"recent_{g}": f"int(coalesce({m} >= 0 AND {m} < 12, false))"}
    for a, b, days in d.sequences:
        last[f"seq_{a}_then_{b}_{days}d"] = f"int(coalesce(datediff(_f_{b}, _f_{a}) BETWEEN 0 AND {days}, false))"
        last[f"gap_{a}_to_{b}_days"] = f"coalesce(datediff(_f_{b}, _f_{a}), -1)"
    for n, cols in d.products.items():
        last[f"age_x_{n}"] = " * ".join(["age", *[f"coalesce({c}, 0)" for c in cols]])
    last |= {"age_peak_distance": f"abs(age - {d.peak_age}D)", "activity_velocity": "greatest(events_B - events_A, 0)",
             "activity_ratio": "least(events_B / if(events_A = 0, 1, events_A), 10D)", "age_x_categories": "age * n_categories", "many_categories": "int(n_categories >= 5)"}
    if d.weights:
        last |= {"weighted_burden_high": "int(weighted_burden >= 5)", "age_x_weighted_burden": "age * weighted_burden"}
        last |= {f"burden_x_{c}": f"weighted_burden * {c}" for c in d.burden_products}
    cols = [c for c in out.columns if not c.startswith("_")]
    out = out.selectExpr(*[f"`{c}`" for c in cols], *[f"{e} AS `{n}`" for n, e in last.items()])
    return patterns.deciles(out, "age", name="age_decile") if age_deciles else out
