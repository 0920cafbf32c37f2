"""Columns derived row by row. Existing columns are never changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import month_key, quarter_key, whole_days
from ..functions.money import ratio
from ..schema import require


def calendar_features(df: DataFrame) -> DataFrame:
    require(df, "Order_Date")
    ordered = F.col("Order_Date")
    columns = {
        "Year": F.year(ordered),
        "Month": F.month(ordered),
        "Quarter": F.quarter(ordered),
        "Month_Name": F.date_format(ordered, "MMM"),
        "Year_Month": month_key(ordered),
        "Year_Quarter": quarter_key(ordered),
    }
    if "Ship_Date" in df.columns:
        columns["Days_to_Ship"] = whole_days(ordered, F.col("Ship_Date"))
    return df.withColumns(columns)


def margin_features(df: DataFrame) -> DataFrame:
    """Per-line ratios; NULL where the divisor is zero."""
    require(df, "Sales", "Profit", "Quantity")
    return df.withColumns(
        {
            "Profit_Margin": ratio("Profit", "Sales"),
            "Sales_per_Unit": ratio("Sales", "Quantity"),
            "Profit_per_Unit": ratio("Profit", "Quantity"),
            "Is_Profitable": F.col("Profit") > 0,
        }
    )


def engineer_features(df: DataFrame) -> DataFrame:
    return margin_features(calendar_features(df))
