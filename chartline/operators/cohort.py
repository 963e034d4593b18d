"""Cohort construction: snapshots, code sets, anchors, lookback windows, sampling.

Canonical columns: entity, event_date, event_type, code, term, category, value;
spine: entity, anchor_date, label. Entity sets are one-column DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalar as x
from ..skew import hash_rank, top_by

# --- fixed values: codes that never count as evidence (admin, attachments, calls)
ADMIN_CODES = (
    1572871000006101, 279991000000102, 428481002, 979851000000101, 887641000000105, 1958701000006105, 185317003,
    788007007, 283511000000105, 182836005, 182888003, 184103008, 498521000006103, 386472008,
)
PALLIATIVE_CODES = (1403151000000103,)
# ----------------------------------------------------------------------------


def _either(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


# --- snapshots and dictionaries ---------------------------------------------
def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest version per key: largest ``order`` values, which must break ties."""
    return top_by(df, keys, [F.col(c).desc_nulls_last() for c in order])


def not_deleted(df: DataFrame, c: str = "deleted") -> DataFrame:
    """Soft-deleted rows out; NULL means not deleted."""
    return df.where(~F.coalesce(F.col(c), F.lit(False)))


def exclude(df: DataFrame, *lists: DataFrame, on: str = "entity") -> DataFrame:
    """Rows whose entity is in none of the lists."""
    for one in lists:
        df = df.join(one.select(on).distinct(), on, "left_anti")
    return df


def union_ids(*lists: DataFrame, on: str = "entity") -> DataFrame:
    return reduce(DataFrame.unionByName, [d.select(on) for d in lists]).distinct()


def decode(
    obs: DataFrame, dictionary: DataFrame, problems: DataFrame, start: str, end: str,
    code_keys: Sequence[str] = ("site", "code_id"), problem_keys: Sequence[str] = ("entity", "site", "obs_id"),
) -> DataFrame:
    """Observations in [start, end) with dictionary and problem-list columns.

    Both sides are deduplicated snapshots. Code ids are compared as exact
    64-bit numbers, so text ids and numeric ids meet.
    """
    d = F.col("event_date")
    kept = obs.where((d >= F.lit(start).cast("date")) & (d < F.lit(end).cast("date")))
    kept = kept.withColumn("code_id", x.exact_long("code_id"))
    dictionary = dictionary.withColumn("code_id", x.exact_long("code_id"))
    return kept.join(dictionary, list(code_keys), "left").join(problems, list(problem_keys), "left")


def codes_like(dim: DataFrame, group: str, code: str, like: str | None = None, not_like: str | None = None) -> DataFrame:
    """Distinct codes whose group name matches."""
    g = F.lower(F.col(group))
    if like:
        dim = dim.where(g.like(like))
    if not_like:
        dim = dim.where(~g.like(not_like))
    return dim.select(F.col(code).alias("code")).distinct()


def concepts(dim: DataFrame, rules: Sequence[tuple[str, str, str]], vocabulary="vocabulary", code="code", text="display") -> DataFrame:
    """Concepts matched by (vocabulary, kind, pattern) rules; kind is code_regex, text_like or code_in."""
    def cond(vocab, kind, pattern):
        test = {
            "code_regex": lambda: F.col(code).rlike(pattern),
            "text_like": lambda: F.lower(F.col(text)).like(pattern),
            "code_in": lambda: F.col(code).isin(*pattern),
        }[kind]()
        return (F.col(vocabulary) == vocab) & test

    return dim.where(_either(cond(*r) for r in rules))


def restrict(ev: DataFrame, codes: DataFrame, on: str = "code") -> DataFrame:
    """Only events whose code is listed."""
    return ev.join(codes.select(on).distinct(), on, "left_semi")


def drop_codes(ev: DataFrame, codes: DataFrame, on: str = "code") -> DataFrame:
    """Events without post-outcome codes."""
    return ev.join(codes.select(on).distinct(), on, "left_anti")


def drop_terms(ev: DataFrame, patterns: Sequence[str], term: str = "term") -> DataFrame:
    """Events whose term matches none of the patterns; events without a term stay."""
    return ev.where(~F.coalesce(F.col(term).rlike("(?i)" + "|".join(patterns)), F.lit(False)))


# --- entity sets and anchors ------------------------------------------------
def ever_has(ev: DataFrame, codes: DataFrame, on: str = "code") -> DataFrame:
    return restrict(ev, codes, on).select("entity").distinct()


def first_event(
    ev: DataFrame, codes: DataFrame, start: str, end: str, birth: DataFrame | None = None, min_age: int = 0,
    tie: str = "code", on: str = "code",
) -> DataFrame:
    """Earliest listed event in [start, end) per entity: the case anchor."""
    d = F.col("event_date")
    hit = ev.where((d >= F.lit(start).cast("date")) & (d < F.lit(end).cast("date"))).join(codes, on)
    if birth is not None:
        hit = hit.join(birth, "entity").where(x.year_age("event_date", "birth_date") >= min_age)
    return hit.groupBy("entity").agg(
        F.min(F.struct(F.col("event_date"), F.col(tie))).alias("_m")
    ).select("entity", F.col("_m.event_date").alias("anchor_date"), F.col(f"_m.{tie}").alias("target"))


def negatives(ev: DataFrame, *exclusions: DataFrame) -> DataFrame:
    """Entities with events and in none of the exclusion sets."""
    return exclude(ev.select("entity").distinct(), *exclusions)


def sampled_anchor(ev: DataFrame, keep: Column, salt_cols: Sequence[str] = ("entity", "event_date", "code")) -> DataFrame:
    """One reproducibly random eligible event date per entity: the control anchor.

    The order is the md5 of the row's own columns. It is a plain ``min`` of
    (hash, date), so it combines before the shuffle.
    """
    h = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in salt_cols]))
    return ev.where(keep).groupBy("entity").agg(
        F.min(F.struct(h.alias("h"), F.col("event_date"))).alias("_m")
    ).select("entity", F.col("_m.event_date").alias("anchor_date"))


def last_anchor(ev: DataFrame) -> DataFrame:
    return ev.groupBy("entity").agg(F.max("event_date").alias("anchor_date"))


def derive_anchor(ev: DataFrame) -> DataFrame:
    """Own last event as anchor where the extract carries none.

    Joins the grouped maximum back instead of a window, so a hot entity's
    rows are not sorted in one task.
    """
    out = ev.join(last_anchor(ev), "entity")
    days = F.date_diff("anchor_date", "event_date")
    return out.withColumn("days_before", days).withColumn("months_before", x.months_before(days))


# --- windows ----------------------------------------------------------------
def in_lookback(years: int, months: int, date: str = "event_date", anchor: str = "anchor_date") -> Column:
    """Half-open window [anchor - years, anchor - months)."""
    return (F.col(date) >= F.add_months(anchor, -12 * years)) & (F.col(date) < F.add_months(anchor, -months))


def anchored(ev: DataFrame, spine: DataFrame, years: int, months: int, cols: Sequence[str] = ("label", "age", "sex", "segment"),
             divisor: float = 30.0, mid: float = 30) -> DataFrame:
    """Events inside the lookback window with days, months and A/B half."""
    s = spine.select("entity", "anchor_date", *[c for c in cols if c in spine.columns])
    days = F.date_diff("anchor_date", "event_date")
    return (
        ev.join(s, "entity").where(in_lookback(years, months))
        .withColumn("days_before", days)
        .withColumn("months_before", x.months_before(F.col("days_before"), divisor))
        .withColumn("time_window", x.window_ab("months_before", mid=mid))
    )


def lookback(
    spine: DataFrame, ev: DataFrame, years: int, months: int, exclude_codes: DataFrame | None = None,
    admin: Sequence[int] = ADMIN_CODES, not_types: Sequence[str] = (), not_like: str | None = None,
    distinct_on: Sequence[str] | None = None, birth: bool = False, clean: bool = False, type_col: str = "obs_type",
) -> DataFrame:
    """Distinct leak-free events of each spine entity in its lookback window.

    NULL types and NULL terms fall out with the NOT IN / NOT LIKE predicates,
    as they do in SQL. Medication rows join on the cleaned id (``clean``).
    """
    ev = ev.where(F.col("code").isNotNull())
    if admin:
        ev = ev.where(~F.col("code").isin(*admin))
    if not_types:
        ev = ev.where(~F.col(type_col).isin(*not_types))
    if not_like:
        ev = ev.where(~F.lower("term").like(not_like))
    if exclude_codes is not None:
        ev = drop_codes(ev, exclude_codes)
    if clean:
        key = x.clean_id("entity", upper=True)
        out = spine.withColumn("_k", key).join(ev.withColumn("_k", key).drop("entity"), "_k").drop("_k")
    else:
        out = spine.join(ev, "entity")
    out = out.where(in_lookback(years, months)).withColumn("days_before", F.date_diff("anchor_date", "event_date"))
    out = out.withColumn("anchor_year", F.year("anchor_date"))
    if birth:
        out = out.withColumn("age_at_anchor", x.year_age("anchor_date", "birth_date"))
        out = out.withColumn("event_age", x.year_age("event_date", "birth_date"))
    return (out.select(*distinct_on) if distinct_on else out).distinct()


def slice_lookback(ev: DataFrame, years: float, rule: str = "calendar") -> DataFrame:
    """A narrower window cut from the lifetime table."""
    if rule == "calendar":
        return ev.where(F.col("event_date") >= F.add_months("anchor_date", -int(12 * years)))
    return ev.where(F.date_diff("anchor_date", "event_date") <= years * 365.25)


def min_events(rows: DataFrame, n: int, by: Sequence[str] = ("entity",), distinct_on: Sequence[str] | None = None) -> DataFrame:
    """Entities with at least n (distinct) rows, with the count."""
    rows = rows.select(*distinct_on).distinct() if distinct_on else rows
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events")).where(F.col("n_events") >= n)


def min_rows(ev: DataFrame, n: int) -> DataFrame:
    """Final rows of entities that have at least n of them.

    Counted by a combining aggregate and semi-joined, not by a window over
    all rows of the entity.
    """
    return ev.join(min_events(ev, n), "entity", "left_semi")


def leak_guard(ev: DataFrame) -> DataFrame:
    """Events strictly before the anchor."""
    return ev.where(F.col("event_date") < F.col("anchor_date"))


def leak_counts(ev: DataFrame) -> DataFrame:
    """How many rows the guard removes."""
    return ev.agg(F.count(F.lit(1)).alias("n_rows"), x.count_where(F.col("event_date") >= F.col("anchor_date")).alias("n_leaky"))


def fanout(ev: DataFrame, gaps: Sequence[int], lookback_months: int, mid: int = 30) -> DataFrame:
    """One pass, one row per overlapping window the event falls in."""
    m = F.col("months_before")
    hit = F.filter(F.array(*[F.lit(g) for g in gaps]), lambda g: (m >= g) & (m < g + lookback_months))
    return ev.withColumn("gap", F.explode(hit)).withColumn(
        "time_window", x.window_ab(m - F.col("gap") + 1, mid=mid, lo=1, hi=lookback_months)
    )


# --- case/control assembly --------------------------------------------------
def unify(cases: DataFrame, controls: DataFrame) -> DataFrame:
    out = cases.withColumn("label", F.lit(1)).unionByName(controls.withColumn("label", F.lit(0)), allowMissingColumns=True)
    return out.withColumn("anchor_year", F.year("anchor_date"))


def ratio_sample(controls: DataFrame, cases: DataFrame, strata: Sequence[str], ratio: float, salt: str = "ncsalt") -> DataFrame:
    """ratio x case-count controls per stratum in hash order.

    Ranks come from 4096 hash parts per stratum, so a stratum with most of
    the pool is not sorted in one task.
    """
    need = cases.groupBy(*strata).agg((F.lit(ratio) * F.count(F.lit(1))).alias("_need"))
    ranked = hash_rank(controls, strata, ["entity"], salt)
    return ranked.join(need, list(strata)).where(F.col("rank") <= F.col("_need")).drop("rank", "rank_all", "_need")


def extend_ratio(split: DataFrame, pool: DataFrame, ratio: int, salt: str = "42", order=("train", "valid", "test")) -> DataFrame:
    """Every split filled with extra, disjoint controls up to 1:ratio.

    The pool is put in hash order once; each split takes the next range of
    ranks. Members of the 1:1 split stay where they are.
    """
    rows = split.groupBy("split").agg(
        x.count_where(F.col("label") == 1).alias("p"), x.count_where(F.col("label") == 0).alias("n")).collect()  # one row per split
    need = {r["split"]: max(ratio * r["p"] - r["n"], 0) for r in rows}
    extra = hash_rank(exclude(pool.select("entity").distinct(), split), [], ["entity"], salt)
    goes, hi = F.lit(None).cast("string"), sum(need.values())
    for name in reversed([s for s in order if s in need]):
        goes = F.when(F.col("rank") <= hi, F.lit(name)).otherwise(goes)
        hi -= need[name]
    extra = extra.withColumn("split", goes).where(F.col("split").isNotNull())
    return split.select("entity", "split", "label").unionByName(
        extra.select("entity", "split", F.lit(0).alias("label"))
    )


def fixed(spine: DataFrame, members: DataFrame) -> DataFrame:
    """Anchors recomputed, membership taken from an id list."""
    return spine.join(members.select("entity").distinct(), "entity", "left_semi")


def dispenses(records: DataFrame, issues: DataFrame, codes: DataFrame) -> DataFrame:
    """Drug records with their issues and drug codes; soft-deleted rows out.

    Each input is first reduced to its newest version per own key; issues by
    issue id, so a repeat prescription keeps all its issues.
    """
    out = records.join(issues.withColumnRenamed("deleted", "issue_deleted"), "record_id", "left").join(
        codes, ["code_id", "site"], "left"
    )
    off = F.coalesce(F.col("deleted"), F.lit(False)) | F.coalesce(F.col("issue_deleted"), F.lit(False))
    return out.where(~off).drop("deleted", "issue_deleted")


def event_union(obs: DataFrame, med: DataFrame) -> DataFrame:
    """Both streams in one table; columns of the other arm are typed NULLs."""
    return obs.withColumn("event_type", F.lit("observation")).unionByName(
        med.withColumn("event_type", F.lit("medication")), allowMissingColumns=True
    )


def lifetime_flags(spine: DataFrame, ev: DataFrame, groups: dict[str, Sequence], gap_months: int, on: str = "code",
                   other: Sequence = ()) -> DataFrame:
    """0/1 per code group for any event before anchor - gap; 'other_target' from its own list."""
    groups = {**groups, **({"other_target": other} if other else {})}
    wanted = sorted({c for codes in groups.values() for c in codes})
    hits = ev.where(F.col(on).isin(*wanted)).join(spine.select("entity", "anchor_date"), "entity").where(
        F.col("event_date") < F.add_months("anchor_date", -gap_months)
    )
    agg = hits.groupBy("entity").agg(*[F.max(x.flag(F.col(on).isin(*codes))).alias(g) for g, codes in groups.items()])
    return spine.select("entity").join(agg, "entity", "left").na.fill(0, list(groups))


# --- fixes on the assembled events ------------------------------------------
def fix_overlap(ev: DataFrame, mode: str = "keep_positive") -> DataFrame:
    """Entities in both classes: drop their negative rows, or all rows (mode 'drop')."""
    both = ev.groupBy("entity").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where(F.col("lo") < F.col("hi"))
    if mode == "drop":
        return exclude(ev, both)
    neg = exclude(ev.where(F.col("label") == 0), both)
    return ev.where(F.col("label") != 0).unionByName(neg)


def drop_side_only(obs: DataFrame, med: DataFrame) -> DataFrame:
    """Medication rows of entities that also have observations."""
    return med.join(obs.select("entity").distinct(), "entity", "left_semi")


def dedup(df: DataFrame, keys=("entity", "event_date", "code", "category", "label")) -> DataFrame:
    return df.dropDuplicates([k for k in keys if k in df.columns])


def eligible(ev: DataFrame, sex: str | None = None, min_age: int = 18) -> DataFrame:
    """Entities with any row of the wrong sex or under age leave with all rows."""
    wrong = F.col("age") < min_age
    if sex:
        wrong = wrong | F.coalesce(F.col("sex") != sex, F.lit(True))
    return exclude(ev, ev.where(wrong))


def master(ev: DataFrame, cols=("label", "sex", "age", "anchor_date")) -> DataFrame:
    """One row per entity: the row with the largest age, ties by the other columns."""
    order = F.struct(F.col("age"), *[F.col(c) for c in cols if c != "age"])
    m = ev.groupBy("entity").agg(F.max(order).alias("_m"))
    return m.select("entity", *[F.col(f"_m.{c}").alias(c) for c in cols])


def clamp(ev: DataFrame, bounds: Sequence[tuple[str, str, float, float]], value: str = "value") -> DataFrame:
    """Values outside the bounds of their (category, term) become NULL; the rows stay."""
    bad = _either(
        (F.col("category") == c) & (F.col("term") == t) & ~F.col(value).between(lo, hi) for c, t, lo, hi in bounds
    )
    return ev.withColumn(value, F.when(F.coalesce(bad, F.lit(False)), None).otherwise(F.col(value)))


def sparse_columns(df: DataFrame, cols: Sequence[str], limit: float = 0.95) -> list[str]:
    """Columns with more than ``limit`` NULLs; one pass, one row to the driver."""
    row = df.agg(*[F.avg(x.flag(F.col(c).isNull())).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] > limit]


def drop_sparse(df: DataFrame, cols: Sequence[str], limit: float = 0.95) -> DataFrame:
    return df.drop(*sparse_columns(df, cols, limit))


def pick_code() -> Column:
    """Code of an event that carries one column per arm."""
    return F.when(F.col("event_type").isin("observation", "obs"), F.col("obs_code")).otherwise(F.col("med_code"))


def categorize(ev: DataFrame, cmap: DataFrame, need_window: bool = True) -> DataFrame:
    """Events with the category of (event_type, code); unmapped and unwindowed rows out."""
    out = ev.join(cmap.select("event_type", "code", "category"), ["event_type", "code"])
    return out.where(F.col("time_window").isNotNull()) if need_window else out


def placeholders(spine: DataFrame, ev: DataFrame, mid: int = 30) -> DataFrame:
    """One stand-in event per entity without mapped events, in the middle of the window."""
    empty = exclude(spine, ev)
    return empty.select(
        "*", F.add_months("anchor_date", -mid).alias("event_date"), F.lit(mid).cast("bigint").alias("months_before"),
        F.lit("A").alias("time_window"), F.lit("observation").alias("event_type"),
        F.lit("__PLACEHOLDER__").alias("category"), F.lit(-1).cast("bigint").alias("code"),
        F.lit("__placeholder__").alias("term"),
    )


def align(roster: DataFrame, mat: DataFrame, zero: Sequence[str] = (), fill: dict[str, float] | None = None) -> DataFrame:
    """Every roster entity in the matrix; listed columns filled, the others stay NULL."""
    out = roster.join(mat, "entity", "left")
    if zero:
        out = out.na.fill(0, list(zero))
    return out.na.fill(fill) if fill else out


def cap_balanced(spine: DataFrame, n_pos: int, n_neg: int, salt: str) -> DataFrame:
    """At most n entities per class in hash order."""
    ranked = hash_rank(spine, ["label"], ["entity"], salt)
    keep = F.when(F.col("label") == 1, F.col("rank") <= n_pos).otherwise(F.col("rank") <= n_neg)
    return ranked.where(keep).drop("rank", "rank_all")


# --- text-derived events ----------------------------------------------------
def merge_text(ev: DataFrame, txt: DataFrame, keys=("entity", "code", "days_before"), tie=("term",)) -> DataFrame:
    """Structured events plus the text events that add a new (entity, code, day).

    Text duplicates collapse to the smallest row; positive ones (present or
    historical) that a structured row already covers are dropped, absent and
    family ones always stay.
    """
    keys = list(keys)
    rest = [c for c in txt.columns if c not in keys and c != "assertion"]
    one = txt.groupBy(*keys, "assertion").agg(
        F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in (*tie, *rest)])).alias("_r")
    ).select(*keys, "assertion", *[F.col(f"_r.{c}").alias(c) for c in rest])
    positive = F.col("assertion").isin("present", "historical")
    new = one.where(positive).join(ev.select(*keys).distinct(), keys, "left_anti")
    # present and historical may both be there on one day: keep one of them
    new = new.groupBy(*keys).agg(F.min(F.struct("assertion", *rest)).alias("_r")).select(
        *keys, "_r.assertion", *[F.col(f"_r.{c}").alias(c) for c in rest]
    )
    return ev.unionByName(new, allowMissingColumns=True).unionByName(one.where(~positive), allowMissingColumns=True)


def split_assertion(ev: DataFrame, c: str = "assertion") -> tuple[DataFrame, DataFrame]:
    """Base stream (structured, present, historical) and the absent/family stream."""
    side = F.col(c).isin("absent", "family")
    return ev.where(~F.coalesce(side, F.lit(False))), ev.where(side)


# --- joins of feature tables ------------------------------------------------
def merge_features(mats: Sequence[DataFrame], demo: DataFrame | None = None, demo_cols: Sequence[str] = ()) -> DataFrame:
    """Feature tables keyed by entity merged in one grouping instead of N outer joins.

    Demographics come from the first non-NULL value (smallest, so that the
    result does not depend on row order).
    """
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), mats)
    feats = [c for c in every.columns if c != "entity"]
    out = every.groupBy("entity").agg(*[F.max(c).alias(c) for c in feats])
    if demo is not None:
        d = demo.groupBy("entity").agg(*[F.min(c).alias(c) for c in demo_cols])
        out = out.join(d, "entity", "left")
    return out


def stamp(mat: DataFrame, split: DataFrame) -> DataFrame:
    """The stored split written onto the matrix; entities outside it stay NULL for the checks."""
    return mat.drop("split").join(split.select("entity", "split"), "entity", "left")


def stamp_problems(stamped: DataFrame, split: DataFrame) -> DataFrame:
    """Coverage and drift of a stamp as counts; all zero when sound."""
    both = stamped.select("entity", F.col("split").alias("s1")).join(
        split.select("entity", F.col("split").alias("s2")), "entity", "full_outer"
    )
    return both.agg(
        x.count_where(F.col("s1").isNull() & F.col("s2").isNull()).alias("n_uncovered"),
        x.count_where(F.col("s1").isNull() & F.col("s2").isNotNull()).alias("n_missing"),
        x.count_where(F.col("s1") != F.col("s2")).alias("n_drift"),
    )
