"""Sales and profitability by time, place and product.

Rows whose group key is missing take no part in a grouping. Sums are exact and leave as double.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import discount_band, discount_band_index, is_negative
from ..functions.money import double, exact, mean, ratio, rounded, total
from ..schema import known, require
from ..session import cut_lineage


def sales_summary(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Headline figures, over everything or per ``keys``."""
    require(df, "Order_ID", "Customer_ID", "Sales", "Profit", *keys)
    # One row per order and customer first: two distinct counts multiply their input rows, so these
    # should be the orders and not the lines.
    per_order = (
        known(df, *keys)
        .groupBy(*keys, "Order_ID", "Customer_ID")
        .agg(total(exact(df, "Sales")).alias("s"), total(exact(df, "Profit")).alias("p"))
    )
    sums = per_order.groupBy(*keys).agg(
        total("s").alias("sales"),
        total("p").alias("profit"),
        # The mean of the order totals is their sum over their number.
        total(F.when(F.col("Order_ID").isNotNull(), F.col("s"))).alias("sales_in_orders"),
        F.count_distinct("Order_ID").alias("total_orders"),
        F.count_distinct("Customer_ID").alias("unique_customers"),
    )
    margin = F.coalesce(ratio("profit", "sales"), F.lit(0.0))
    return sums.select(
        *keys,
        rounded("sales").alias("total_sales"),
        rounded("profit").alias("total_profit"),
        "total_orders",
        "unique_customers",
        F.round(ratio("sales_in_orders", "total_orders"), 2).alias("avg_order_value"),
        F.round(margin * 100, 2).alias("overall_profit_margin_pct"),
    )


def _totals(
    df: DataFrame,
    keys: Sequence[str],
    *,
    orders: bool = False,
    quantity: bool = False,
    margin: bool = False,
) -> DataFrame:
    require(df, "Sales", "Profit", *keys)
    sums = [total(exact(df, "Sales")).alias("s"), total(exact(df, "Profit")).alias("p")]
    if quantity:
        sums.append(total(exact(df, "Quantity")).alias("q"))
    if orders:
        sums.append(F.count_distinct("Order_ID").alias("Orders"))
    shown: list[Column | str] = [*keys, double("s").alias("Sales"), double("p").alias("Profit")]
    if quantity:
        shown.append(double("q").alias("Quantity"))
    if orders:
        shown.append("Orders")
    if margin:
        shown.append(ratio("p", "s").alias("Profit_Margin"))
    return known(df, *keys).groupBy(*keys).agg(*sums).select(*shown)


def grouped_sets(df: DataFrame, sets: dict[str, Sequence[str]]) -> dict[str, DataFrame]:
    """Sums per group for several sets of keys, from one pass over the lines and one shuffle of their partial sums.

    Each result has its keys, Sales, Profit, ``lines`` (their number), ``with_Sales`` and ``with_Profit`` (the number of
    lines that have the measure), and Quantity, the mean Profit_Margin and the last Order_Date where the lines have them. Sums of these sums are sums of the lines, and an order is one row in
    a set with Order_ID, so further results can start here.
    """
    columns = list(dict.fromkeys(c for keys in sets.values() for c in keys))
    measures = [total(exact(df, c)).alias(c) for c in ("Sales", "Profit", "Quantity") if c in df.columns]
    measures.append(F.count("*").alias("lines"))
    measures += [F.count(c).alias(f"with_{c}") for c in ("Sales", "Profit")]
    if "Profit_Margin" in df.columns:
        measures.append(F.avg("Profit_Margin").alias("Profit_Margin"))
    if "Order_Date" in df.columns:
        measures.append(F.max("Order_Date").alias("Order_Date"))
    grouped = df.groupingSets([[F.col(c) for c in keys] for keys in sets.values()], *columns)
    # Every result reads it: computed once.
    stored = cut_lineage(grouped.agg(F.grouping_id().alias("_set"), *measures))
    names = [c for c in stored.columns if c not in (*columns, "_set")]

    def of(keys: Sequence[str]) -> DataFrame:
        left_out = sum(1 << i for i, c in enumerate(reversed(columns)) if c not in keys)
        return stored.filter(F.col("_set") == left_out).select(*keys, *names)

    return {name: of(keys) for name, keys in sets.items()}


def sales_by_year(df: DataFrame) -> DataFrame:
    return _totals(df, ["Year"], orders=True).orderBy("Year")


def monthly_sales_trend(df: DataFrame) -> DataFrame:
    """In time order; months without sales stay absent."""
    return _totals(df, ["Year_Month"]).orderBy("Year_Month")


def quarterly_sales(df: DataFrame) -> DataFrame:
    return _totals(df, ["Year", "Quarter", "Year_Quarter"]).orderBy("Year", "Quarter")


def _largest_first(result: DataFrame, measure: str, keys: Sequence[str]) -> DataFrame:
    return result.orderBy(F.desc(measure), *keys)


def sales_by_category(df: DataFrame, keys: Sequence[str] = (), orders: bool = True) -> DataFrame:
    by = [*keys, "Category"]
    return _largest_first(_totals(df, by, orders=orders, margin=True), "Sales", by)


def sales_by_subcategory(df: DataFrame) -> DataFrame:
    by = ["Category", "Sub_Category"]
    return _largest_first(_totals(df, by, quantity=True, margin=True), "Sales", by)


def sales_by_region(df: DataFrame, keys: Sequence[str] = (), orders: bool = True) -> DataFrame:
    by = [*keys, "Region"]
    return _largest_first(_totals(df, by, orders=orders, margin=True), "Sales", by)


def sales_by_state(df: DataFrame) -> DataFrame:
    return _largest_first(_totals(df, ["State"], margin=True), "Sales", ["State"])


def profitability_by_subcategory(df: DataFrame) -> DataFrame:
    by = ["Category", "Sub_Category"]
    found = _totals(df, by, quantity=True, margin=True).withColumn("Is_Loss", is_negative(F.col("Profit")))
    return _largest_first(found, "Profit", by)


def with_bands(df: DataFrame) -> DataFrame:
    """The lines with their discount band, and its place in the order of bands."""
    require(df, "Discount")
    return df.withColumns(
        {"bin_idx": discount_band_index(F.col("Discount")), "Discount_Bin": discount_band(F.col("Discount"))}
    )


def discount_profit_analysis(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Averages per discount band, in band order; bands without lines are left out."""
    require(df, "Discount", "Sales", "Profit", *keys)
    margin = F.col("Profit_Margin") if "Profit_Margin" in df.columns else ratio("Profit", "Sales")
    banded = with_bands(df).select(
        *keys,
        exact(df, "Sales").alias("Sales"),
        exact(df, "Profit").alias("Profit"),
        margin.alias("Profit_Margin"),
        "bin_idx",
        "Discount_Bin",
    )
    return (
        known(banded, *keys, "bin_idx")
        .groupBy(*keys, "bin_idx", "Discount_Bin")
        .agg(
            F.avg("Profit_Margin").alias("Avg_Profit_Margin"),
            mean("Profit").alias("Avg_Profit"),
            mean("Sales").alias("Avg_Sales"),
            F.count("Sales").alias("Count"),
        )
        .orderBy(*keys, "bin_idx")
        .drop("bin_idx")
    )


def discounts_of_sums(bands: DataFrame) -> DataFrame:
    """The same from a grouped set with ``bin_idx`` and ``Discount_Bin``."""
    return (
        known(bands, "bin_idx")
        .orderBy("bin_idx")
        .select(
            "Discount_Bin",
            F.col("Profit_Margin").alias("Avg_Profit_Margin"),
            ratio("Profit", "with_Profit").alias("Avg_Profit"),
            ratio("Sales", "with_Sales").alias("Avg_Sales"),
            F.col("with_Sales").alias("Count"),
        )
    )
