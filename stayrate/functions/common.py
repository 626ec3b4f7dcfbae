"""Small column expressions used by every operator. All of them stay inside Catalyst."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the column-name pattern of a weekly measure.
WEEKLY_PATTERN = re.compile(r"^(.*)_W([0-7])$")

_DAYS = {"day": 1, "week": 7}
_MONTHS = {"month": 1, "quarter": 3}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: Column | str, den: Column | str) -> Column:
    """Quotient as double; NULL when the divisor is zero or either side is NULL."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def nz(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0))


def finite(c: Column | str) -> Column:
    """NaN and the infinities become NULL."""
    d = col(c).cast("double")
    return F.when(F.abs(d) < F.lit(float("inf")), d)


def to_number(c: Column | str) -> Column:
    """Numeric coercion that yields NULL where the text is not a number."""
    return finite(col(c).try_cast("double"))


def to_day(c: Column | str) -> Column:
    """Date coercion that yields NULL where the value is not a date."""
    return col(c).try_cast("date")


def period_start(c: Column | str, period: str = "week") -> Column:
    """First day of the period; weeks start on Monday."""
    return F.date_trunc(period, col(c)).cast("date")


def shift_back(c: Column | str, steps: Column | int, period: str = "week") -> Column:
    """The date ``steps`` whole periods earlier."""
    n = steps if isinstance(steps, Column) else F.lit(int(steps))
    if period in _DAYS:
        return F.date_sub(col(c), n * F.lit(_DAYS[period]))
    return F.add_months(col(c), n * F.lit(-_MONTHS[period]))


def periods_between(later: Column | str, earlier: Column | str, period: str = "week") -> Column:
    """Whole periods from ``earlier`` to ``later``, rounded down."""
    if period in _DAYS:
        return F.floor(F.datediff(col(later), col(earlier)) / F.lit(_DAYS[period])).cast("int")
    return F.floor(F.months_between(col(later), col(earlier)) / F.lit(_MONTHS[period])).cast("int")


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(col(later), col(earlier)).cast("bigint")


def season(c: Column | str) -> Column:
    month = F.month(col(c))
    return (
        F.when(month.isin(12, 1, 2), F.lit("winter"))
        .when(month.isin(3, 4, 5), F.lit("spring"))
        .when(month.isin(6, 7, 8), F.lit("summer"))
        .otherwise(F.lit("autumn"))
    )


def segment_of(tenure_days: Column, newbie_days: int) -> Column:
    """An unknown tenure counts as active."""
    return F.when(tenure_days < F.lit(newbie_days), F.lit("newbie")).otherwise(F.lit("active"))


def slug(c: Column | str) -> Column:
    """Lower-cased name with every run of non-word characters turned into one underscore."""
    return F.regexp_replace(F.lower(col(c)), r"\W+", "_")


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    have = set(df.columns)
    return [n for n in names if n in have]


def first_present(df: DataFrame, candidates: Sequence[str], fallback: str) -> Column:
    """The first candidate column that exists, else the fallback as a literal."""
    hit = present(df, candidates)
    return F.col(hit[0]) if hit else F.lit(fallback)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if f.name not in skip and isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]


def weekly_families(columns: Iterable[str]) -> list[str]:
    """Names of measures that exist at two or more offsets; derived columns are left out."""
    offsets: dict[str, set[int]] = {}
    for name in columns:
        hit = WEEKLY_PATTERN.match(name)
        if hit is None:
            continue
        stem = hit.group(1)
        if "_delta_" in stem or "_trend_" in stem:
            continue
        offsets.setdefault(stem, set()).add(int(hit.group(2)))
    return sorted(stem for stem, found in offsets.items() if len(found) > 1)


def all_of(*conditions: Column | None) -> Column:
    """Conjunction of the conditions that are given."""
    out = F.lit(True)
    for c in conditions:
        if c is not None:
            out = out & c
    return out


def in_country(country: str | None, value: Column | str = "country_code") -> Column | None:
    return None if country is None else col(value) == F.lit(country)
