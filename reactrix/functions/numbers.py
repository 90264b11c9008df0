"""Scalar helpers with the engine's null rules: NaN is never made, a zero divisor gives null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def long_or_zero(c) -> Column:
    """Counts from text: unreadable and missing values are 0; '1e3' is 1000."""
    return F.coalesce(col(c).try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def ratio(a, b) -> Column:
    """a / b, null where b is zero or null."""
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def rounded(c, places: int = 6) -> Column:
    return F.round(col(c).cast("double"), places)


def half_even(c, places: int) -> Column:
    """Rounds halves to the even neighbour."""
    return F.bround(col(c).cast("double"), places)


def ladder(value: Column, *steps: tuple[float, str], top: str) -> Column:
    """The name of the first step whose bound the value doesn't exceed, else top."""
    return reduce(lambda rest, s: F.when(value <= s[0], s[1]).otherwise(rest), reversed(steps), F.lit(top))


def ordinal(c, values: list[str]) -> Column:
    """Place of a value in a custom order; unknown values come last."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]), col(c))
    return F.when(at > 0, at.cast("int")).otherwise(len(values) + 1)
