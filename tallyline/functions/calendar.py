"""Calendar parts of an order date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MICROS_PER_DAY = 86_400_000_000


def month_key(moment: Column) -> Column:
    """``yyyy-MM``; sorts in time order."""
    return F.substring(moment.cast("date").cast("string"), 1, 7)


def quarter_key(moment: Column) -> Column:
    return F.concat(F.year(moment).cast("string"), F.lit("-Q"), F.quarter(moment).cast("string"))


def whole_days(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end``, rounded down also when the span is negative."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return ((micros - F.pmod(micros, F.lit(_MICROS_PER_DAY))) / F.lit(_MICROS_PER_DAY)).cast("int")
