"""Row selection as the dashboard does it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FACETS = ("Year", "Region", "Category", "Segment")


def filter_orders(
    df: DataFrame,
    years: Sequence[int] = (),
    regions: Sequence[str] = (),
    categories: Sequence[str] = (),
    segments: Sequence[str] = (),
) -> DataFrame:
    """Keep lines matching every non-empty selection; an empty selection means all."""
    for column, wanted in zip(FACETS, (years, regions, categories, segments), strict=True):
        if wanted:
            df = df.filter(F.col(column).isin(list(wanted)))
    return df


def facet_values(df: DataFrame, columns: Sequence[str] = FACETS) -> DataFrame:
    """facet, value: what can be selected."""
    texts = df.select([F.col(c).cast("string").alias(c) for c in columns])
    return (
        texts.unpivot([], list(columns), "facet", "value")
        .filter(F.col("value").isNotNull())
        .distinct()
        .orderBy("facet", "value")
    )


def selected_rows(df: DataFrame) -> DataFrame:
    return df.groupBy().agg(F.count("*").alias("selected"))


def nothing_selected(df: DataFrame) -> bool:
    """True when no line is left; stops at the first line found."""
    return df.isEmpty()


def negative_margins(df: DataFrame, column: str = "Avg_Profit_Margin") -> DataFrame:
    return df.filter(F.col(column) < 0)
