"""Columns that name a band, a segment or a sign."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Discount bands, each from its lower edge up to (not including) the next.
# The labels are the published ones although they do not match the edges.
DISCOUNT_EDGES = ("0", "0.001", "0.1", "0.2", "0.3", "0.4", "0.5", "0.6", "0.8", "1.01")
DISCOUNT_LABELS = ("0%", "1-9%", "10-20%", "21-30%", "31-40%", "41-50%", "51-60%", "61-80%", ">80%")

# Lowest combined score of each customer segment, best first.
SEGMENT_FLOORS = (
    (11, "Champions"),
    (9, "Loyal Customers"),
    (7, "Potential Loyalists"),
    (5, "At Risk"),
)
LOWEST_SEGMENT = "Lost / Inactive"
SEGMENT_ORDER = (*(name for _, name in SEGMENT_FLOORS), LOWEST_SEGMENT)

# Percent margin from which a group counts as good, or as one to watch.
MARGIN_GOOD = 10
MARGIN_WATCH = 5


def discount_band_index(discount: Column) -> Column:
    """Position of the band, 0-based; NULL outside the edges."""
    edges = [F.lit(Decimal(edge)) for edge in DISCOUNT_EDGES]
    value = discount
    index = F.when((value < edges[0]) | (value >= edges[-1]) | value.isNull(), F.lit(None).cast("int"))
    for position, upper in enumerate(edges[1:]):
        index = index.when(value < upper, F.lit(position))
    return index


def discount_band(discount: Column) -> Column:
    labels = F.array(*[F.lit(label) for label in DISCOUNT_LABELS])
    return F.get(labels, discount_band_index(discount))


def customer_segment(score: Column) -> Column:
    (best, name), *lower = SEGMENT_FLOORS
    segment = F.when(score >= best, F.lit(name))
    for floor, name in lower:
        segment = segment.when(score >= floor, F.lit(name))
    return segment.otherwise(F.lit(LOWEST_SEGMENT))


def segment_position(segment: Column) -> Column:
    """Display order of a segment, best first."""
    return F.array_position(F.array(*[F.lit(name) for name in SEGMENT_ORDER]), segment).cast("int")


def margin_band(margin_pct: Column) -> Column:
    return (
        F.when(margin_pct >= MARGIN_GOOD, F.lit("good"))
        .when(margin_pct >= MARGIN_WATCH, F.lit("watch"))
        .otherwise(F.lit("poor"))
    )


def is_negative(value: Column) -> Column:
    """True for a loss; drives the two-colour charts."""
    return value < 0
