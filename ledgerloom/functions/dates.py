"""Dates: one ordered list of formats, UTC, a plausible window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats in the order in which they are tried (day first), and the plausible window.
FORMATS = ["yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy/MM/dd", "d MMM yyyy", "dd-MMM-yyyy", "yyyyMMdd"]
FIRST, LAST = "2015-01-01", "2035-01-01"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_date(text: Column | str) -> Column:
    """Ten or more digits are unix seconds (milliseconds above 1e12), else the first format that fits; null otherwise."""
    t = F.trim(_c(text))
    unix = t.try_cast("bigint")
    moment = F.to_date(F.timestamp_seconds(F.when(unix > 10**12, F.floor(unix / 1000)).otherwise(unix)))
    return F.when(F.regexp_like(t, F.lit(r"^\d{10,13}$")), moment).otherwise(F.coalesce(*(F.try_to_date(t, f) for f in FORMATS)))


def plausible(day: Column | str) -> Column:
    return _c(day).between(F.lit(FIRST).cast("date"), F.lit(LAST).cast("date"))


def date_level(a: Column | str, b: Column | str, window: int = 4) -> Column:
    """same_day, within_1, within_window or none; a missing date is none."""
    gap = F.abs(F.datediff(_c(a), _c(b)))
    return F.when(gap == 0, "same_day").when(gap <= 1, "within_1").when(gap <= window, "within_window").otherwise("none")


def day_of_month(day: Column | str) -> Column:
    return F.coalesce(F.dayofmonth(_c(day)), F.lit(99))


def date_score(a: Column | str, b: Column | str, window: int = 4) -> Column:
    """Linear decay from 1 on the same day to 0 beyond the window; 0 when a date is missing."""
    gap = F.abs(F.datediff(_c(a), _c(b)))
    return F.coalesce(F.greatest(F.lit(0.0), 1 - gap / F.lit(float(window + 1))), F.lit(0.0))


def short_date(text: Column | str, pivot: int = 70) -> Column:
    """YYMMDD with a century pivot: years below it are 20xx."""
    t = _c(text)
    year = F.substring(t, 1, 2).try_cast("int")
    full = F.when(year < pivot, year + 2000).otherwise(year + 1900)
    return F.try_to_date(F.concat(full.cast("string"), F.substring(t, 3, 4)), "yyyyMMdd")
