"""Column functions: ids, dates, values, windows, bands, text, probabilities.

All of them compile to built-in expressions, so they stay inside
whole-stage code generation and push down where Spark can push them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------
NULL_TOKENS = ("", "nan", "none", "null", "na")
DAYS_PER_UNIT = {"day": 1, "week": 7, "month": 30, "year": 365}
FREQUENCY_ORDINAL = {
    "daily": 3, "every day": 3, "constant": 3, "continuous": 3, "twice daily": 3, "twice a day": 3,
    "weekly": 2, "few times a week": 2, "couple times a week": 2,
    "intermittent": 1, "occasional": 1, "occasionally": 1, "sometimes": 1, "now and then": 1,
}
SEVERITY_ORDINAL = {"mild": 1, "slight": 1, "moderate": 2, "severe": 3, "++": 3, "+++": 3}
PROGRESSION_ORDINAL = {
    "getting worse": 3, "worsening": 3, "increasing": 3, "gain": 3, "worse": 3,
    "stable": 1, "improving": 0, "improved": 0, "decreasing": 0,
}
PROGRESSION_VALUE = {"getting worse": 1, "worsening": 1, "stable": 0, "improving": -1, "improved": -1}
# ----------------------------------------------------------------------------


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """Condition as 0/1; an unknown condition counts as 0."""
    return F.when(cond, 1).otherwise(0)


def count_where(cond: Column) -> Column:
    return F.count_if(cond)


def lookup(c: Column | str, table: Mapping) -> Column:
    """Value of a small fixed mapping, NULL for keys outside it."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(c))


# --- ids, dates, numbers ----------------------------------------------------
def clean_id(c: Column | str, upper: bool = False) -> Column:
    """Entity id without quotes, braces and outer space."""
    out = F.trim(F.regexp_replace(col(c).cast("string"), r"[{}\"']", ""))
    return F.upper(out) if upper else out


def date_from_path(c: Column | str) -> Column:
    """The yyyymmdd folder inside a file path as a date."""
    return F.try_to_date(F.regexp_extract(col(c), r"/([0-9]{8})/", 1), "yyyyMMdd")


def exact_long(c: Column | str) -> Column:
    """64-bit id from text without a trip through double; a trailing .0 is dropped."""
    return F.regexp_replace(F.trim(col(c).cast("string")), r"\.0$", "").try_cast("bigint")


def parse_value(c: Column | str) -> Column:
    """Measurement text as double; null-like words become NULL."""
    t = F.lower(F.trim(col(c).cast("string")))
    return F.when(t.isin(*NULL_TOKENS), None).otherwise(t.try_cast("double"))


def year_age(d: Column | str, birth: Column | str) -> Column:
    """Difference of calendar years (not of birthdays)."""
    return F.year(col(d)) - F.year(col(birth))


def months_before(days: Column | str, divisor: float = 30.0, mode: str = "floor") -> Column:
    """Days as months. mode: floor, round (one digit) or exact."""
    m = col(days) / F.lit(float(divisor))
    return {"floor": F.floor(m), "round": F.round(m, 1), "exact": m}[mode]


def window_ab(m: Column | str, mid: float = 30, lo: float = 1, hi: float | None = None) -> Column:
    """'B' for the recent part [lo, mid], 'A' for the part before it, else NULL."""
    m = col(m)
    older = m > mid if hi is None else (m > mid) & (m <= hi)
    return F.when((m >= lo) & (m <= mid), "B").when(older, "A")


def band(c: Column | str, edges: Sequence[float], labels: Sequence[str], right: bool = False) -> Column:
    """Label of the interval between neighbouring edges; right closes the upper edge."""
    c = col(c)
    out = None
    for lo, hi, name in zip(edges, edges[1:], labels):
        inside = (c > lo) & (c <= hi) if right else (c >= lo) & (c < hi)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def floor_band(c: Column | str, width: int) -> Column:
    return (F.floor(col(c) / width) * width).cast("int")


def one_hot(c: Column | str, levels: Sequence[str], prefix: str, unknown: str = "Unknown") -> list[Column]:
    """One 0/1 column per fixed level; anything else lights the unknown column."""
    c = col(c)
    cols = [flag(c == lv).cast("double").alias(f"{prefix}{lv}") for lv in levels]
    miss = flag(c.isNull() | ~c.isin(*levels)).cast("double").alias(f"{prefix}{unknown}")
    return cols + [miss]


# --- text -------------------------------------------------------------------
def tag_values(c: Column | str, tag: str = "value") -> Column:
    """Inner text of every <tag>, joined by a space and lower-cased; whole text when there is none."""
    c = col(c)
    found = F.regexp_extract_all(c, F.lit(rf"<{tag}[^>]*>([^<]+)</{tag}>"), F.lit(1))
    return F.lower(F.when(F.size(found) > 0, F.array_join(found, " ")).otherwise(F.coalesce(c, F.lit(""))))


def strip_boilerplate(c: Column | str, patterns: Sequence[str], min_len: int = 20) -> Column:
    """Text without boilerplate phrases; NULL if what is left is too short."""
    c = col(c)
    joined = "|".join(patterns)
    cleaned = F.trim(F.regexp_replace(c, joined, ""))
    return F.when(~c.rlike(joined), c).when(F.length(cleaned) > min_len, cleaned)


def first_words(c: Column | str, n: int = 400) -> Column:
    """At most n words, for encoders with a fixed input size; shorter text is returned as it is."""
    words = F.split(F.trim(col(c)), r"\s+")
    return F.when(F.size(words) > n, F.array_join(F.slice(words, 1, n), " ")).otherwise(col(c))


def parse_duration(c: Column | str) -> Column:
    """'3 weeks' as days."""
    t = F.lower(F.trim(col(c)))
    rx = r"^(\d+)\s*(day|week|month|year)"
    n = F.regexp_extract(t, rx, 1).try_cast("int")
    return n * lookup(F.regexp_extract(t, rx, 2), DAYS_PER_UNIT)


def parse_frequency(c: Column | str) -> Column:
    """Frequency phrase as an ordinal 1..3."""
    t = F.lower(F.trim(col(c)))
    return F.coalesce(lookup(t, FREQUENCY_ORDINAL), F.when(t.rlike(r"^(\d+)\s*(?:per|/|a)\s*day"), 3))


def concern(severity: Column | str, progression: Column | str) -> Column:
    """Larger of the severity and progression ordinals."""
    return F.greatest(
        lookup(F.lower(F.trim(col(severity))), SEVERITY_ORDINAL),
        lookup(F.lower(F.trim(col(progression))), PROGRESSION_ORDINAL),
    )


# --- numeric transforms -----------------------------------------------------
def numeric_transforms(c: str, peak: float | None = None) -> list[Column]:
    """log1p, square root, square and (given a peak) distance to it."""
    x = F.col(c).cast("double")
    pos = F.greatest(x, F.lit(0.0))
    out = [
        F.log1p(pos).alias(f"{c}_log1p"),
        F.sqrt(pos).alias(f"{c}_sqrt"),
        (x * x).alias(f"{c}_sq"),
        (x * x * x).alias(f"{c}_cube"),
    ]
    if peak is not None:
        out.append(F.abs(x - peak).alias(f"{c}_from_peak"))
    return out


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))
    return F.log(q / (1.0 - q))


def prior_shift(p: Column | str, tau: Column | float) -> Column:
    """Probability learnt at 1:1 moved to the real prevalence tau."""
    tau = F.lit(tau) if isinstance(tau, float) else tau
    return sigmoid(logit(col(p)) + logit(tau, 1e-9) - logit(F.lit(0.5)))


def ratio(b: Column | str, a: Column | str, mode: str = "clip", cap: float | None = None) -> Column:
    """B over A without division by zero.

    clip: denominator at least 1. plus_one: (b+1)/(a+1). denom_one: b/(a+1).
    only_b: 2.0 where A is empty and B is not, 0 where both are. null: NULL.
    """
    b, a = col(b).cast("double"), col(a).cast("double")
    out = {
        "clip": b / F.greatest(a, F.lit(1.0)),
        "plus_one": (b + 1.0) / (a + 1.0),
        "denom_one": b / (a + 1.0),
        "only_b": F.when(a > 0, F.try_divide(b, a)).when(b > 0, 2.0).otherwise(0.0),
        "null": F.try_divide(b, a),
    }[mode]
    return out if cap is None else F.least(out, F.lit(float(cap)))


def finite(c: Column | str, otherwise: float | None = 0.0) -> Column:
    """Infinite and NaN values replaced."""
    c = col(c)
    bad = F.isnan(c) | (F.abs(c) == float("inf"))
    return F.when(bad, F.lit(otherwise).cast("double")).otherwise(c)


def all_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x & y, conds)


def any_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x | y, conds)


def total(cols: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x + y, cols)


def _paired(y: Column | str, x: Column | str) -> tuple[Column, Column, Column]:
    """Both as doubles where both are known, and the aggregate condition that x is spread. The engine's variance of equal
    values isn't always 0 (partial means are merged by division), so extremes decide."""
    y, x = col(y).cast("double"), col(x).cast("double")
    both = y.isNotNull() & x.isNotNull()
    y, x = F.when(both, y), F.when(both, x)
    return y, x, F.min(x) < F.max(x)


def correlation(y: Column | str, x: Column | str) -> Column:
    """Aggregate: Pearson correlation of the rows where both are known; NULL without spread."""
    y, x, spread = _paired(y, x)
    return F.when(spread & (F.min(y) < F.max(y)), F.try_divide(F.covar_pop(y, x), F.nullif(F.stddev_pop(y) * F.stddev_pop(x), F.lit(0.0))))


def slope(y: Column | str, x: Column | str) -> Column:
    """Aggregate: OLS slope of the rows where both are known; NULL without spread in x, and 0 where the covariance is within
    the rounding of its sums, so that the sign of a flat series doesn't hang on the order of its rows."""
    y, x, spread = _paired(y, x)
    noise = 1e-12 * F.stddev_pop(y) * F.stddev_pop(x)
    return F.when(spread & (F.min(y) < F.max(y)) & (F.abs(F.covar_pop(y, x)) > noise), F.regr_slope(y, x)).when(spread, 0.0)


def deviation(c: Column | str) -> Column:
    """Aggregate: sample deviation, exactly 0 for equal values; NULL below two."""
    c = col(c)
    sd = F.stddev_samp(c)
    return F.when((F.min(c) < F.max(c)) | sd.isNull(), sd).otherwise(0.0)


def settled(z: Column | str) -> Column:
    """A z-score for comparison with a limit: without the last digits, which hang on the order of summed rows."""
    return F.round(col(z), 9)
