"""Dates: epochs, lenient parsing, relative times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col

LOCAL = "Asia/Ho_Chi_Minh"


def local_time(seconds) -> Column:
    """Unix seconds as local wall-clock time."""
    return F.from_utc_timestamp(F.timestamp_seconds(col(seconds)), LOCAL)


def parsed_date(c) -> Column:
    """null where the text is no date."""
    return F.to_date(F.try_to_timestamp(col(c)))


def shifted_back(c, year: int = 2026, months: int = 24) -> Column:
    """Dates of one year shown so many months earlier, as text."""
    d = col(c)
    return F.date_format(F.when(F.year(d) == year, F.add_months(d, -months)).otherwise(d), "yyyy-MM-dd")


# Marks of a unit (any may occur anywhere in the text) and its seconds, in the order they are tried.
UNITS = [
    (("phút", "m", "min"), 60),
    (("giờ", "h", "hour"), 3600),
    (("ngày", "d", "day"), 86400),
    (("hôm qua", "yesterday"), None),
    (("tháng", "month"), 30 * 86400),
    (("năm", "year"), 365 * 86400),
]


def relative_time(c, now: Column) -> Column:
    """Unix seconds of '5 giờ', 'just now', '1700000000'; now where nothing is read.

    Marks are tried in order and one letter is enough, so '3 tháng' is read as hours: this order is kept on purpose.
    """
    text = F.lower(F.regexp_replace(col(c), r"(?U)^\s+|\s+$", ""))
    number = F.regexp_extract(text, r"(\d+)", 1).try_cast("bigint")
    has = lambda marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(text, m))
    out = F.when(text.isNull() | (text == ""), now).when(text.rlike(r"^\d+$"), text.try_cast("bigint")).when(has(("vừa xong", "just now")), now)
    for marks, seconds in UNITS:
        out = out.when(has(marks), now - 86400 if seconds is None else F.coalesce(now - number * seconds, now))
    return out.otherwise(now)


#: Fixed value: order of the week.
WEEK = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
