"""The business reports as Spark SQL over the published relation.

Unlike the DataFrame operators, SQL keeps the group of a missing key. Ties at a limit go to the first key.
Filters and orders on a result use its rounded figures.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.relation import RELATION
from .running import run_reports


def _sum(column: str, presummed: bool) -> str:
    return f"SUM({column})" if presummed else f"SUM(CAST({column} AS DECIMAL(38,10)))"


def _figures(presummed: bool = False) -> dict[str, str]:
    """SQL of the shared figures, over the lines or over sums per order and customer."""
    sales, profit = _sum("Sales", presummed), _sum("Profit", presummed)
    return {
        "sales": f"CAST(ROUND({sales}, 2) AS DOUBLE)",
        "profit": f"CAST(ROUND({profit}, 2) AS DOUBLE)",
        "margin": f"ROUND(TRY_DIVIDE(CAST({profit} AS DOUBLE), CAST({sales} AS DOUBLE)) * 100, 2)",
        "orders": "COUNT(DISTINCT Order_ID)",
        "customers": "COUNT(DISTINCT Customer_ID)",
    }


AVG_DISCOUNT = f"ROUND(TRY_DIVIDE(CAST({_sum('Discount', False)} AS DOUBLE), COUNT(Discount)) * 100, 2)"


def report_sql(
    keys: Sequence[str] | dict[str, str],
    figures: dict[str, str],
    *,
    keep: str | None = None,
    order: str,
    limit: int | None = None,
    hide: Sequence[str] = (),
    per_order: bool = False,
    relation: str = RELATION,
) -> str:
    """SQL text of one report: group by ``keys`` (names, or name to expression), compute ``figures``.

    ``per_order`` sums per order and customer first, for reports that count both: two distinct counts
    multiply their input rows, so these should be the orders and not the lines.
    """
    named = keys if isinstance(keys, dict) else {key: key for key in keys}
    if per_order:
        grouped = [f"{expression} AS {name}" for name, expression in named.items()]
        sums = [f"{_sum(c, False)} AS {c}" for c in ("Sales", "Profit")]
        relation = (
            f"(\n  SELECT {', '.join([*grouped, 'Order_ID', 'Customer_ID', *sums])}\n  FROM {relation}\n"
            f"  GROUP BY {', '.join([*named.values(), 'Order_ID', 'Customer_ID'])}\n) AS per_order"
        )
        named = {name: name for name in named}
    columns = [f"{expression} AS {name}" for name, expression in {**named, **figures}.items()]
    lines = [
        "SELECT " + ",\n       ".join(columns),
        f"FROM {relation}",
        "GROUP BY " + ", ".join(named.values()),
    ]
    text = "\n".join(lines)
    if keep or hide:
        shown = [name for name in {**named, **figures} if name not in hide]
        inner = text.replace("\n", "\n  ")
        text = f"SELECT {', '.join(shown)}\nFROM (\n  {inner}\n) AS report"
        if keep:
            text += f"\nWHERE {keep}"
    ties = [name for name in named if name not in order.split() and name not in hide]
    text += f"\nORDER BY {', '.join([order, *ties])}"
    return text + (f"\nLIMIT {limit}" if limit else "")


_LINE, _ORDER = _figures(), _figures(presummed=True)
_SALES_PROFIT = {"Total_Sales": _LINE["sales"], "Total_Profit": _LINE["profit"]}
_ORDER_SALES_PROFIT = {"Total_Sales": _ORDER["sales"], "Total_Profit": _ORDER["profit"]}
_PRODUCT_GROUP = ["Category", "Sub_Category"]

# The names of the reports.
BUSINESS_QUERIES = {
    "total_sales_profit_by_category": report_sql(
        ["Category"],
        {**_SALES_PROFIT, "Order_Count": _LINE["orders"], "Profit_Margin_Pct": _LINE["margin"]},
        order="Total_Sales DESC",
    ),
    "monthly_sales": report_sql(
        ["Year_Month"], {"Monthly_Sales": _LINE["sales"], "Monthly_Profit": _LINE["profit"]}, order="Year_Month"
    ),
    "regional_performance": report_sql(
        ["Region"],
        {
            **_ORDER_SALES_PROFIT,
            "Orders": _ORDER["orders"],
            "Customers": _ORDER["customers"],
            "Profit_Margin_Pct": _ORDER["margin"],
        },
        order="Total_Sales DESC",
        per_order=True,
    ),
    "top_10_customers_by_revenue": report_sql(
        ["Customer_ID", "Customer_Name", "Segment"],
        {**_SALES_PROFIT, "Orders": _LINE["orders"]},
        order="Total_Sales DESC",
        limit=10,
    ),
    "top_10_products_by_profit": report_sql(
        ["Product_ID", "Product_Name", *_PRODUCT_GROUP],
        {**_SALES_PROFIT, "Profit_Margin_Pct": _LINE["margin"]},
        order="Total_Profit DESC",
        limit=10,
    ),
    "loss_making_subcategories": report_sql(
        _PRODUCT_GROUP,
        {**_SALES_PROFIT, "Profit_Margin_Pct": _LINE["margin"]},
        keep="Total_Profit < 0",
        order="Total_Profit ASC",
    ),
    "avg_discount_by_category": report_sql(
        ["Category"], {"Avg_Discount_Pct": AVG_DISCOUNT, **_SALES_PROFIT}, order="Avg_Discount_Pct DESC"
    ),
    "sales_profit_by_segment": report_sql(
        ["Segment"],
        {
            **_ORDER_SALES_PROFIT,
            "Customers": _ORDER["customers"],
            "Orders": _ORDER["orders"],
            "Profit_Margin_Pct": _ORDER["margin"],
        },
        order="Total_Sales DESC",
        per_order=True,
    ),
    "high_sales_low_profit_products": report_sql(
        ["Product_Name", *_PRODUCT_GROUP],
        {**_SALES_PROFIT, "Profit_Margin_Pct": _LINE["margin"]},
        keep="Total_Sales > 1000 AND Profit_Margin_Pct < 5",
        order="Total_Sales DESC",
        limit=20,
    ),
    # The year is text here, unlike in the DataFrame operators.
    "yearly_performance": report_sql(
        {"Year": "CAST(Year AS STRING)"},
        {**_ORDER_SALES_PROFIT, "Orders": _ORDER["orders"], "Customers": _ORDER["customers"]},
        order="Year",
        per_order=True,
    ),
    "ship_mode_analysis": report_sql(
        ["Ship_Mode"],
        {"Orders": _LINE["orders"], "Total_Sales": _LINE["sales"], "Avg_Days_to_Ship": "ROUND(AVG(Days_to_Ship), 1)"},
        order="Orders DESC",
    ),
    "state_profitability": report_sql(
        ["State", "Region"], {**_SALES_PROFIT, "Profit_Margin_Pct": _LINE["margin"]}, order="Total_Sales DESC", limit=15
    ),
    "top_10_customers_without_id": report_sql(
        ["Customer_ID", "Customer_Name", "Segment"],
        {**_SALES_PROFIT, "Orders": _LINE["orders"]},
        order="Total_Sales DESC",
        limit=10,
        hide=["Customer_ID"],
    ),
}


def reading(sql: str, relation: str) -> str:
    """A report's text over another relation than the usual one."""
    return re.sub(rf"\bFROM {RELATION}\b", f"FROM {relation}", sql)


def result_order(sql: str) -> str | None:
    """What a report's rows are ordered by at the end, if its text says so without calls."""
    found = re.search(r"\bORDER\s+BY\s+([^()]+?)(\s+LIMIT\s+\d+)?\s*$", sql, re.IGNORECASE)
    return found.group(1) if found else None


def _sort_term(term: str) -> Column:
    name, _, way = term.strip().partition(" ")
    return F.desc(name) if way.strip().upper().startswith("DESC") else F.asc(name)


def _in_order(result: DataFrame, sql: str) -> DataFrame:
    """A written result in its report's order again; files don't keep one."""
    order = result_order(sql)
    if order is None:
        return result
    try:
        return result.orderBy(*[_sort_term(term) for term in order.split(",")])
    except AnalysisException:  # ordered by something that the result doesn't show
        return result


def run_all_business_queries(
    spark: SparkSession,
    queries: dict[str, str] | None = None,
    relation: str = RELATION,
    place: str | None = None,
    seconds: float | None = None,
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Results by name, and the message of each query that could not be planned or failed while it ran.

    The reports read the published relation ``relation``; they run side by side (``running.run_reports``) and their
    results are read back from ``place``.
    """
    if not spark.catalog.tableExists(relation):
        raise LookupError(f"relation {relation} does not exist; publish the order lines first")
    texts = {name: reading(sql, relation) for name, sql in (queries or BUSINESS_QUERIES).items()}
    outcomes = run_reports(spark, texts, place, seconds=seconds)
    results = {name: _in_order(o.result, texts[name]) for name, o in outcomes.items() if o.error is None}
    return results, {name: o.error for name, o in outcomes.items() if o.error is not None}
