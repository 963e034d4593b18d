"""Cohort extraction: cases, sampled controls, and their leak-free events.

The usable observations (admin codes, outcome codes, listed types and terms
removed) are defined once; eligibility counts and output rows are the same
window join, so a candidate's count is exactly the number of rows it gets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import scalar as x
from ..operators import cohort as c
from ..session import cut_lineage


@dataclass(frozen=True)
class CohortParams:
    """Window bounds and minima; literals in the plan, not a joined one-row table."""

    anchor_start: str
    anchor_end: str
    years_before: int = 100
    months_before: int = 12
    min_obs: int = 0
    min_med: int = 0
    min_age: int = 18
    ratio: float = 1.0
    strata: Sequence[str] = ("anchor_year",)
    salt: str = "ncsalt"
    excluded_types: Sequence[str] = ("Immunisation",)
    excluded_like: str | None = "%cancer%"
    admin_codes: Sequence[int] = c.ADMIN_CODES


OBS_COLS = ("event_date", "code", "term", "value")
MED_COLS = ("event_date", "code", "term", "duration")


def usable(obs: DataFrame, outcome: DataFrame, p: CohortParams) -> DataFrame:
    """Observations that may become evidence; the same for both classes."""
    o = obs.where(F.col("code").isNotNull())
    if p.admin_codes:
        o = o.where(~F.col("code").isin(*p.admin_codes))
    if p.excluded_types:
        o = o.where(~F.col("obs_type").isin(*p.excluded_types))
    if p.excluded_like:
        o = o.where(~F.lower("term").like(p.excluded_like))
    return c.drop_codes(o, outcome)


def rows_in_window(spine: DataFrame, ev: DataFrame, cols: Sequence[str], p: CohortParams) -> DataFrame:
    """Distinct rows of each spine entity in its half-open window."""
    j = spine.join(ev.select("entity", *cols), "entity").where(c.in_lookback(p.years_before, p.months_before))
    return j.select("entity", "anchor_date", *cols).distinct()


def candidates(obs: DataFrame, target: DataFrame, outcome: DataFrame, excluded: DataFrame, birth: DataFrame, p: CohortParams) -> tuple[DataFrame, DataFrame]:
    """Cases anchored at their first target event; controls without any outcome or exclusion code, anchored at a
    reproducibly random usable event. Both adult at the anchor and outside the excluded entities."""
    out = c.ever_has(obs, excluded)
    cases = c.exclude(c.first_event(obs, target, p.anchor_start, p.anchor_end, birth, p.min_age), out)
    free = c.negatives(obs, c.ever_has(obs, outcome), out)
    pool = usable(obs, outcome, p).join(free, "entity", "left_semi").join(birth, "entity")
    d = F.col("event_date")
    ok = (d >= F.lit(p.anchor_start).cast("date")) & (d < F.lit(p.anchor_end).cast("date")) & (x.year_age("event_date", "birth_date") >= p.min_age)
    return cases, c.sampled_anchor(pool, ok)


def extract(obs: DataFrame, med: DataFrame, target: DataFrame, outcome: DataFrame, excluded: DataFrame, birth: DataFrame, p: CohortParams) -> tuple[DataFrame, DataFrame]:
    """Spine (entity, anchor_date, target, label, anchor_year) and events of the balanced cohort.

    The candidate list and the final spine, one short row per entity, are
    written to the checkpoint folder as soon as they are known: everything
    after them starts from a table instead of repeating the searches.
    """
    good = usable(obs, outcome, p)
    cand = cut_lineage(c.unify(*candidates(obs, target, outcome, excluded, birth, p)))
    able = cand
    for ev, cols, n in ((good, OBS_COLS, p.min_obs), (med, MED_COLS, p.min_med)):
        if n > 0:
            enough = c.min_events(rows_in_window(cand.select("entity", "anchor_date"), ev, cols, p), n)
            able = able.join(enough.select("entity"), "entity", "left_semi")
    able = cut_lineage(able)
    cases, controls = able.where(F.col("label") == 1), able.where(F.col("label") == 0)
    spine = cut_lineage(cases.unionByName(c.ratio_sample(controls, cases, p.strata, p.ratio, p.salt)))
    s = spine.select("entity", "anchor_date")
    events = c.event_union(rows_in_window(s, good, OBS_COLS, p), rows_in_window(s, med, MED_COLS, p))
    info = spine.join(birth, "entity").select("entity", "label", "anchor_year", "birth_date")
    events = events.join(info, "entity").select(
        "entity", "label", "anchor_date", "anchor_year", "event_type", "event_date", "code", "term", "value", "duration",
        F.date_diff("anchor_date", "event_date").alias("days_before"), x.year_age("anchor_date", "birth_date").alias("age_at_anchor"),
        x.year_age("event_date", "birth_date").alias("event_age"))
    return spine, events
