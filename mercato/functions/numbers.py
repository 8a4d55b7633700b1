"""Number coercion and exact decimal arithmetic."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.text import strip

# Spark casts '12f' and 'NaN' to numbers; only plain decimal notation is a number here.
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_NONZERO, _FAR = r"^[+-]?[0.]*[1-9]", r"[eE][+-]?0*[1-9][0-9]{3}"

#: What numbers in text and floating point are read as before they are judged, and its greatest and least values.
WIDE = "decimal(38,10)"
#: Whole numbers that are read at once.
_SHORT = "decimal(18,0)"
_GREATEST, _LEAST = Decimal("9" * 28 + "." + "9" * 10), Decimal("0.0000000001")


def _plain(value: Column, target: str, *others: str) -> Column:
    """The number in a text without exponent, nor any of ``others``: the cast alone cuts blanks and knows a number.

    Null says nothing, and zero only that it is zero or rounds to it: most texts need nothing else, which is costly.
    """
    odd = reduce(or_, [value.contains(sign) for sign in ("e", "E", *others)])
    return F.when(~odd, value).try_cast(target)


def to_number(value: Column, given: T.DataType, target: str) -> Column:
    """Coerce to a number, with null for whatever is not one.

    Text becomes ``target``. A source that is already numeric keeps its own type.
    """
    if isinstance(given, T.StringType):
        text = strip(value)
        return F.when(text.rlike(_NUMBER), text).try_cast(target)
    if isinstance(given, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value).try_cast(target)
    return value


def to_wide(value: Column, given: T.DataType) -> Column:
    """Coerce to ``WIDE`` so that a rule can judge the number that was given; null for whatever is not a number.

    A number beyond the type becomes the greatest one with its sign, and one that would round to zero the least: neither is
    taken for missing or for zero. A source that is already exact keeps its own type.
    """
    ends = [F.lit(n).cast(WIDE) for end in (_GREATEST, _LEAST) for n in (end, end.copy_negate())]

    def end(minus: Column, small: Column) -> Column:
        return F.element_at(F.array(*ends), 1 + minus.cast("int") + 2 * small.cast("int"))

    if isinstance(given, T.StringType):
        text = strip(value)
        # A long exponent is not cast: that would spell out its zeros.
        number = F.when(~text.rlike(_FAR), text).try_cast(WIDE)
        beyond = end(text.startswith("-"), F.abs(text.try_cast("double")) < 1)
        odd = F.when(text.rlike(_NUMBER), F.when(text.rlike(_NONZERO), beyond).otherwise(F.lit(Decimal(0)).cast(WIDE)))
        return F.coalesce(F.nullif(_plain(value, WIDE), F.lit(0)), F.nullif(number, F.lit(0)), odd)
    if isinstance(given, (T.DoubleType, T.FloatType)):
        beyond = F.when(value == 0, F.lit(Decimal(0)).cast(WIDE)).otherwise(end(value < 0, F.abs(value) < 1))
        return F.when(value.isNotNull() & ~F.isnan(value), F.coalesce(F.nullif(value.try_cast(WIDE), F.lit(0)), beyond))
    return value


def to_whole(value: Column, given: T.DataType, target: str = "int") -> Column:
    """Coerce to a whole number: '4.0' is 4, a fraction is null."""
    if isinstance(given, T.IntegralType):
        return value.try_cast(target)
    number = to_wide(value, given)
    whole = F.when(number % 1 == 0, number).try_cast(target)
    if isinstance(given, T.StringType):
        return F.coalesce(F.nullif(_plain(value, _SHORT, "."), F.lit(0)).try_cast(target), whole)
    return whole


def rounded_to_whole(value: Column, given: T.DataType, target: str = "int") -> Column:
    """Coerce to a whole number, halves away from zero, as storing into an integer column does."""
    if isinstance(given, T.IntegralType):
        return value.try_cast(target)
    return F.round(to_wide(value, given), 0).try_cast(target)


def exact_ratio(total: Column, count: Column) -> Column:
    """``total / count`` with 16 decimals, so that a later ``round`` rounds only once.

    ``avg`` of a decimal keeps four more digits than its input and has rounded already.
    """
    return total.cast("decimal(38,16)") / count


def exact_average(value: str | Column) -> Column:
    """Aggregate: mean of an exact numeric column, unrounded."""
    return exact_ratio(F.sum(value), F.count(value))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` as a percentage of ``whole``, null where ``whole`` is zero."""
    return F.round(exact_ratio(part * 100, F.nullif(whole, F.lit(0))), digits)
