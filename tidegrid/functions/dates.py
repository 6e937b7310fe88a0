"""Dates and epoch milliseconds, in UTC throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _utc_midnight(day: Column) -> Column:
    """Epoch milliseconds of a date's start in UTC, whatever the session's time zone."""
    return F.unix_date(day).cast("bigint") * 86_400_000


def parse_date(text: Column | str, sep: str = "_") -> Column:
    """yyyy<sep>MM<sep>dd as epoch milliseconds; null for other text."""
    return _utc_midnight(F.try_to_timestamp(_col(text), F.lit(f"yyyy'{sep}'MM'{sep}'dd")).cast("date"))


def day_to_ms(year: Column | str, month: Column | str, day: Column | str) -> Column:
    return _utc_midnight(F.make_date(_col(year), _col(month), _col(day)))


def julian_to_ms(text: Column | str) -> Column:
    """yyyyDDD as epoch milliseconds; null where there is no such day."""
    text = _col(text)
    year, doy = F.substring(text, 1, 4).cast("int"), F.substring(text, 5, 3).cast("int")
    first = F.make_date(year, F.lit(1), F.lit(1))
    day = F.date_add(first, doy - 1)
    return F.when((doy >= 1) & (F.year(day) == year), _utc_midnight(day))


def ms_to_day(ms: Column | str) -> Column:
    return F.date_from_unix_date(F.floor(_col(ms) / 86_400_000).cast("int"))


def format_date(ms: Column | str, sep: str = "_") -> Column:
    return F.date_format(ms_to_day(ms), f"yyyy'{sep}'MM'{sep}'dd")


def day_of_year(ms: Column | str) -> Column:
    return F.dayofyear(ms_to_day(ms))
