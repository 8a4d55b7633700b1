"""Timestamp coercion and calendar expressions, all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.text import strip

_DAY_MICROS = 86_400_000_000
# A cast alone would read a bare time of day as a time today.
_STARTS_WITH_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"


def to_utc(value: Column, given: T.DataType) -> Column:
    """Coerce to a timestamp, with null for whatever is not one."""
    if isinstance(given, T.StringType):
        text = strip(value)
        # The cast cuts the common blanks by itself; only what it does not read as it is needs the costly cut.
        plain, other = (F.when(t.rlike(_STARTS_WITH_DATE), t).try_cast("timestamp") for t in (value, text))
        return F.coalesce(plain, other)
    return value.cast("timestamp")


def days_between(later: Column, earlier: Column) -> Column:
    """Difference in days with its fraction; negative when ``later`` comes first."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(_DAY_MICROS)


def day_of_week(value: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(value) - 1


def month_name(value: Column) -> Column:
    """English month, blank-padded to nine characters."""
    return F.rpad(F.date_format(value, "MMMM"), 9, " ")


def day_name(value: Column) -> Column:
    """English weekday, blank-padded to nine characters."""
    return F.rpad(F.date_format(value, "EEEE"), 9, " ")
