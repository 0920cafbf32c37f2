"""A cube over the dashboard's facets, from which any selection's figures come without reading lines again.

Sums add up over cells, distinct counts do not: an order has lines in several categories, a customer orders in several
years. So a cell holds its orders and customers as bitmaps, and a selection's count is the size of their union, exact
whatever is selected. Ids are first numbered densely, neighbours in year, region and segment next to each other. An
order lies in few cells, so most blocks of 32,768 numbers occur in the cells of one neighbourhood and all bitmaps
together take little more than a bit per order and category.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import double, ratio, rounded
from ..functions.ranks import range_slices
from ..schema import known, require
from ..session import cut_lineage
from . import sales
from .filters import FACETS, filter_orders

_NEAR = ("Year", "Region", "Segment")


def _numbered(pairs: DataFrame, name: str) -> DataFrame:
    """Each id of column ``name`` with a number from 1 on, by the first place it occurs in."""
    near = F.min(F.struct(*_NEAR)).alias("near")
    sliced = range_slices(pairs.groupBy(name).agg(near), "near", [name])
    # One row per partition.
    sizes = sliced.groupBy("_slice").count()
    before = F.sum("count").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_slice", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("_slice").orderBy("near", name))
    return sliced.withColumn("place", place).join(starts, "_slice").select(name, (F.col("start") + F.col("place")).alias("number"))


def _bitmaps(lines: DataFrame, name: str) -> DataFrame:
    """Per cell and block of numbers the ids of column ``name`` that occur, as a bitmap of 4 KB."""
    pairs = cut_lineage(lines.where(F.col(name).isNotNull()).select(*FACETS, name).distinct())
    placed = pairs.join(_numbered(pairs, name), name).select(
        *FACETS, F.bitmap_bucket_number("number").alias("block"), F.bitmap_bit_position("number").alias("bit")
    )
    return cut_lineage(placed.groupBy(*FACETS, "block").agg(F.bitmap_construct_agg("bit").alias("bits")))


@dataclass
class Cube:
    """Sums per cell, alone and with a further key each, and the bitmaps of orders and customers.

    A cell is a combination of year, region, category and segment; lines that lack one are in a cell of their own,
    which a selection of that facet leaves out.
    """

    cells: DataFrame
    months: DataFrame
    subcategories: DataFrame
    states: DataFrame
    orders: DataFrame
    customers: DataFrame

    def select(
        self,
        years: Sequence[int] = (),
        regions: Sequence[str] = (),
        categories: Sequence[str] = (),
        segments: Sequence[str] = (),
    ) -> Cube:
        """The cube of the selected lines; an empty selection means all."""
        chosen = (years, regions, categories, segments)
        return Cube(**{part.name: filter_orders(getattr(self, part.name), *chosen) for part in fields(self)})

    def summary(self) -> DataFrame:
        """As ``sales.sales_summary`` of the selected lines."""
        found = self._with_counts((), ("orders", "customers"))
        return found.select(
            rounded("Sales").alias("total_sales"),
            rounded("Profit").alias("total_profit"),
            F.col("orders").alias("total_orders"),
            F.col("customers").alias("unique_customers"),
            F.round(ratio("in_orders", "orders"), 2).alias("avg_order_value"),
            F.round(F.coalesce(ratio("Profit", "Sales"), F.lit(0.0)) * 100, 2).alias("overall_profit_margin_pct"),
        )

    def by_year(self) -> DataFrame:
        return self._by("Year").orderBy("Year")

    def by_category(self) -> DataFrame:
        return self._by("Category", margin=True).orderBy(F.desc("Sales"), "Category")

    def by_region(self) -> DataFrame:
        return self._by("Region", margin=True).orderBy(F.desc("Sales"), "Region")

    def monthly(self) -> DataFrame:
        return sales.monthly_sales_trend(self.months)

    def quarterly(self) -> DataFrame:
        return sales.quarterly_sales(self.months)

    def by_subcategory(self) -> DataFrame:
        return sales.sales_by_subcategory(self.subcategories)

    def by_state(self) -> DataFrame:
        return sales.sales_by_state(self.states)

    def selected_rows(self) -> DataFrame:
        """The number of selected lines."""
        return self.cells.groupBy().agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("selected"))

    def _by(self, key: str, margin: bool = False) -> DataFrame:
        found = self._with_counts((key,), ("orders",))
        shown = [key, double("Sales").alias("Sales"), double("Profit").alias("Profit"), F.col("orders").alias("Orders")]
        if margin:
            shown.append(ratio("Profit", "Sales").alias("Profit_Margin"))
        return found.select(*shown)

    def _with_counts(self, keys: Sequence[str], counted: Sequence[str]) -> DataFrame:
        """Sums and distinct counts per ``keys``, brought together by one grouping of a few rows."""
        measures = ("Sales", "Profit", "in_orders", *counted)
        in_orders = F.when(F.col("Has_Order"), F.col("Sales"))
        parts = known(self.cells, *keys).select(*keys, "Sales", "Profit", in_orders.alias("in_orders"))
        for name in counted:
            blocks = known(getattr(self, name), *keys).groupBy(*keys, "block").agg(F.bitmap_or_agg("bits").alias("bits"))
            parts = parts.unionByName(blocks.select(*keys, F.bitmap_count("bits").alias(name)), allowMissingColumns=True)
        return parts.groupBy(*keys).agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures])


def selection_cube(lines: DataFrame) -> Cube:
    """The cube of ``lines``, which are read once for the sums and once for each kind of bitmap."""
    require(lines, *FACETS, "Order_ID", "Customer_ID", "Sales", "Profit")
    sets = sales.grouped_sets(
        lines.withColumn("Has_Order", F.col("Order_ID").isNotNull()),
        {
            "cells": (*FACETS, "Has_Order"),
            "months": (*FACETS, "Quarter", "Year_Quarter", "Year_Month"),
            "subcategories": (*FACETS, "Sub_Category"),
            "states": (*FACETS, "State"),
        },
    )
    return Cube(**sets, orders=_bitmaps(lines, "Order_ID"), customers=_bitmaps(lines, "Customer_ID"))
