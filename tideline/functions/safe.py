"""Column helpers that keep missing values missing, as the panel rules need.

NaN and infinities become NULL at the source; afterwards NOT NULL means finite. A zero denominator gives NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """NULL for NaN and both infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def scrub(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns})


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def at_least(x: Column, low: float) -> Column:
    """Clip from below; greatest() alone would turn NULL into the bound."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def at_most(x: Column, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(x, F.lit(high)))


def holds(condition: Column) -> Column:
    """A comparison with a missing value is false."""
    return F.coalesce(condition, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def number(x: Column) -> Column:
    """Numeric coercion: text that is no finite number becomes NULL."""
    return finite(x.try_cast("double"))


def day(x: Column) -> Column:
    """Date coercion: text that is no date becomes NULL."""
    return F.to_date(F.try_to_timestamp(x))


def local_timestamp(date: Column, clock: str, zone: str) -> Column:
    """Wall clock of a day in a zone as an instant (session zone UTC)."""
    return F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", F.date_format(date, "yyyy-MM-dd"), F.lit(clock))), zone)


def local_day(instant: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def iso(instant: Column) -> Column:
    """UTC ISO text; empty for missing."""
    return F.coalesce(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit(""))


def correlation(x: Column, y: Column, over=None) -> Column:
    """Pearson over pairwise complete rows; NULL where either side is constant (corr() raises there)."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    wrap = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    return F.try_divide(wrap(F.covar_pop(a, b)), wrap(F.stddev_pop(a)) * wrap(F.stddev_pop(b)))
