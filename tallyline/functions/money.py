"""Exact sums, safe ratios and rounding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import WIDE_MONEY


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def exact(df: DataFrame, name: str) -> Column:
    """A measure in a form whose sums are exact. Decimals (also sums of earlier sums) and integers stay as they are.

    A number too large for the wide decimal is an error, also where casts give NULL for it.
    """
    value = F.col(name)
    if not isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return value
    message = F.concat(F.lit(f"{name} is too large to be summed exactly: "), value.cast("string"))
    return F.coalesce(value.try_cast(WIDE_MONEY), F.when(value.isNotNull(), F.raise_error(message).cast(WIDE_MONEY)))


def total(value: Column | str) -> Column:
    """Sum; an empty input sums to zero."""
    return F.coalesce(F.sum(_column(value)), F.lit(0))


def double(value: Column | str) -> Column:
    return _column(value).cast("double")


def rounded(value: Column | str, places: int = 2) -> Column:
    """Round first (on the decimal, where there is one), then leave the decimal world."""
    return F.round(_column(value), places).cast("double")


def ratio(part: Column | str, whole: Column | str) -> Column:
    """``part / whole`` as double; NULL when ``whole`` is zero or missing."""
    return F.try_divide(double(part), double(whole))


def mean(value: Column | str) -> Column:
    """Mean of the present values, from their sum."""
    return ratio(F.sum(_column(value)), F.count(_column(value)))
