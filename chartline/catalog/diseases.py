"""One query per disease configuration, on the orders' history with its part codes mapped to the disease's categories.

The SQL twin is written from the same configuration: its conditions are plain SQL for both engines, the blocks
around them are stated here a second time.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import disease
from ..plans.diseases import ALL
from ..session import cut_lineage
from .base import ANCH, query, r, with_

# Terms given to the part codes, so that laboratory series and subtypes find their words.
TERMS = (
    "White cell count", "Lymphocyte count", "Neutrophil count", "Haemoglobin", "Platelet count", "Blast cell", "LDH", "Beta 2 microglobulin", "ESR", "CRP", "INR",
    "Immunoglobulin G", "Paraprotein", "PSA", "Frank haematuria", "Urine culture", "CA125", "Serum creatinine", "Breast lump", "Abdominal pain")


def categories(d: disease.Disease) -> list[str]:
    every = {c for cs in d.groups.values() for c in cs} | {c for cs, _ in d.labs.values() for c in cs} | set(d.weights) | set(d.symptoms)
    return sorted(every)


def mapped(t, d: disease.Disease):
    cats = F.array(*[F.lit(c) for c in categories(d)])
    terms = F.array(*[F.lit(c) for c in TERMS])
    ev = cut_lineage(t.anch.select("entity", "event_date", "anchor_date", "time_window", "value", "code"))  # read for three groupings
    return ev.withColumns({"category": F.element_at(cats, (F.col("code") % F.size(cats) + 1).cast("int")), "term": F.element_at(terms, (F.col("code") % 7 * 3 % len(TERMS) + 1).cast("int"))})


def _array(words) -> str:
    return "ARRAY[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _isin(cats) -> str:
    return "category IN (" + ", ".join(f"'{c}'" for c in cats) + ")"


def _like(rx: str) -> str:
    return "regexp_matches(term, '(?i)" + rx.replace("'", "''") + "')"


def sql(d: disease.Disease, burst: int = 30) -> str:
    cats = categories(d)
    steps = [f"""wa AS (SELECT entity, event_date, anchor_date, time_window, value, ({_array(cats)})[code % {len(cats)} + 1] AS category, ({_array(TERMS)})[code % 7 * 3 % {len(TERMS)} + 1] AS term
  FROM anch WHERE time_window IS NOT NULL)"""]
    one = {"events_A": "count(*) FILTER (WHERE time_window = 'A')", "events_B": "count(*) FILTER (WHERE time_window = 'B')", "n_categories": "count(DISTINCT category)"}
    hidden = {"_anchor": "max(anchor_date)"}
    for g, cs in d.groups.items():
        for w in "AB":
            one[f"{w.lower()}_{g}"] = f"count(*) FILTER (WHERE {_isin(cs)} AND time_window = '{w}')"
        hidden[f"_f_{g}"] = f"min(event_date) FILTER (WHERE {_isin(cs)})"
    one |= {f"{n}_count": f"count(*) FILTER (WHERE {_isin(d.groups[g])} AND {_like(rx)})" for n, (g, rx) in d.subtypes.items()}
    if d.weights:
        one["weighted_burden"] = " + ".join(f"{w}::DOUBLE * max(CAST({_isin([c])} AS INTEGER))" for c, w in d.weights.items())
    steps.append(f"g AS (SELECT entity, {', '.join(f'{e} AS {n}' for n, e in (one | hidden).items())} FROM wa GROUP BY 1)")
    levels, tested = {}, {}
    for n, (cs, rx) in d.labs.items():
        c = f"value IS NOT NULL AND {_like(rx)}" + (f" AND {_isin(cs)}" if cs else "")
        pair = "{'d': event_date, 'v': value}"
        levels |= {f"{n}_latest": f"max({pair}) FILTER (WHERE {c}).v", f"{n}_first": f"min({pair}) FILTER (WHERE {c}).v", f"{n}_max": f"max(value) FILTER (WHERE {c})", f"{n}_min": f"min(value) FILTER (WHERE {c})"}
        tested[f"{n}_tested"] = f"CAST(count(*) FILTER (WHERE {c}) > 0 AS INTEGER)"
    keep = [f"g.{n}" for n in hidden] + [f"coalesce(g.{n}, 0) AS {n}" for n in one]
    joins = "FROM spine s LEFT JOIN g USING (entity)"
    if d.labs:
        steps.append(f"lb AS (SELECT entity, {', '.join(f'{e} AS {n}' for n, e in (levels | tested).items())} FROM wa GROUP BY 1)")
        keep += [f"lb.{n}" for n in levels] + [f"coalesce(lb.{n}, 0) AS {n}" for n in tested]
        joins += " LEFT JOIN lb USING (entity)"
    if d.symptoms:
        steps.append(f"dd AS (SELECT DISTINCT entity, event_date, category FROM wa WHERE {_isin(d.symptoms)})")
        steps.append(f"""bu AS (SELECT entity, CAST(max(k) AS INTEGER) AS k FROM (SELECT a.entity, a.event_date, count(DISTINCT b.category) AS k
  FROM dd a JOIN dd b ON a.entity = b.entity AND b.event_date BETWEEN a.event_date AND a.event_date + {burst} GROUP BY 1, 2) GROUP BY 1)""")
        keep += ["coalesce(bu.k, 0) AS max_in_window", "CAST(coalesce(bu.k, 0) >= 3 AS INTEGER) AS burst_3", "CAST(coalesce(bu.k, 0) >= 4 AS INTEGER) AS burst_4"]
        joins += " LEFT JOIN bu USING (entity)"
    flag = lambda c: f"CAST(coalesce({c}, false) AS INTEGER)"
    stages: list[dict[str, str]] = [
        {f"n_{g}": f"a_{g} + b_{g}" for g in d.groups} | {f"has_{g}": flag(f"a_{g} + b_{g} > 0") for g in d.groups} | {f"{n}_flag": flag(f"{n}_count > 0") for n in d.subtypes}
        | {n: flag(c) for n, c in d.lab_flags.items()}]
    stages += [{n: flag(c) for n, c in level.items()} for level in disease._levels(d.flags) if level]
    stages += [{n: f"CAST({e} AS DOUBLE)" for n, e in d.scores.items()}] if d.scores else []
    stages += [{n: flag(c) for n, c in d.cuts.items()}] if d.cuts else []
    last = {}
    if d.systems:
        n = " + ".join(flag(" OR ".join(f"b_{g} > 0" for g in gs)) for gs in d.systems.values())
        last |= {"systems_B": n, "systems_pair_B": flag(f"{n} >= 2"), "systems_trifecta_B": flag(f"{n} >= 3")}
    for g in d.trends:
        new, up = flag(f"b_{g} > 0 AND a_{g} = 0"), f"greatest(b_{g} - a_{g}, 0)"
        last |= {f"vel_{g}": up, f"new_{g}_B_only": new, f"age_x_{g}_B": f"age * b_{g}", f"age_x_vel_{g}": f"age * {up}", f"age_x_new_{g}": f"age * {new}",
                 f"elderly_{g}": flag(f"age >= {d.elderly} AND b_{g} > 0")}
    for g in d.onsets:
        m = f"(CAST(_anchor - _f_{g} AS INTEGER) / 30.44::DOUBLE)"
        last |= {f"first_{g}_months": f"coalesce({m}, -1::DOUBLE)", f"recent_{g}": flag(f"{m} >= 0 AND {m} < 12")}
    for a, b, days in d.sequences:
        gap = f"CAST(_f_{b} - _f_{a} AS INTEGER)"
        last |= {f"seq_{a}_then_{b}_{days}d": flag(f"{gap} BETWEEN 0 AND {days}"), f"gap_{a}_to_{b}_days": f"coalesce({gap}, -1)"}
    last |= {f"age_x_{n}": " * ".join(["age", *[f"coalesce({c}, 0)" for c in cols]]) for n, cols in d.products.items()}
    last |= {"age_peak_distance": f"abs(age - {d.peak_age}::DOUBLE)", "activity_velocity": "greatest(events_B - events_A, 0)",
             "activity_ratio": "least(events_B / (CASE WHEN events_A = 0 THEN 1 ELSE events_A END)::DOUBLE, 10::DOUBLE)", "age_x_categories": "age * n_categories",
             "many_categories": flag("n_categories >= 5")}
    if d.weights:
        last |= {"weighted_burden_high": flag("weighted_burden >= 5"), "age_x_weighted_burden": "age * weighted_burden", **{f"burden_x_{c}": f"weighted_burden * {c}" for c in d.burden_products}}
    steps.append(f"s0 AS (SELECT s.entity, s.age, s.sex, {', '.join(keep)} {joins})")
    for i, stage in enumerate([*stages, last]):
        steps.append(f"s{i + 1} AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in stage.items())} FROM s{i})")
    gone = ", ".join(hidden)
    return f"""{with_(ANCH, *steps)}, z AS (SELECT * EXCLUDE ({gone}) FROM s{len(stages) + 1})
SELECT * REPLACE ({', '.join(f'round({n}, 6) AS {n}' for n in doubles(d))}) FROM z"""


def doubles(d: disease.Disease) -> list[str]:
    """Columns of type double, which both sides round."""
    out = [f"{n}_{s}" for n in d.labs for s in ("latest", "first", "max", "min")] + [*d.scores] + [f"first_{g}_months" for g in d.onsets] + ["age_peak_distance", "activity_ratio"]
    out += [f"age_x_{n}" for n, cols in d.products.items() if any(c in d.scores or c.endswith(("_latest", "_first", "_max", "_min")) or c == "weighted_burden" for c in cols)]
    return out + (["weighted_burden", "age_x_weighted_burden", *[f"burden_x_{c}" for c in d.burden_products]] if d.weights else [])


def _register(name: str) -> None:
    @query(f"plan_disease_{name}", sql(ALL[name]))
    def _(t):
        out = disease.features(mapped(t, ALL[name]), t.spine, ALL[name])
        return out.select(*[r(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


for _name in ALL:
    _register(_name)
