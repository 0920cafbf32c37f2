"""Bundles of operators over one input, and the whole run from raw table to report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import ratio
from ..operators import customers as cust
from ..operators import forecasting as fc
from ..operators import insights, products, profiling, sales
from ..operators.cleaning import audit_of_counted, clean_of_counted, counted_rows
from ..operators.features import engineer_features
from ..schema import CUSTOMER
from ..session import cut_lineage
from ..sources.files import load_processed, load_raw_orders, save_processed, save_report
from ..sources.relation import RELATION, publish
from .catalogue import run_all_business_queries

_SUBCATEGORY = ("Category", "Sub_Category")
_MONTH = ("Year", "Quarter", "Year_Quarter", "Year_Month")
_BAND = ("bin_idx", "Discount_Bin")


def sales_sets(lines: DataFrame) -> dict[str, DataFrame]:
    """The groupings that all sales results start from, in one pass over the lines.

    Three of them keep the order, for the distinct counts; the others have as many rows as there are months,
    sub-categories, states and bands.
    """
    return sales.grouped_sets(
        sales.with_bands(lines),
        {
            "months": _MONTH,
            "subcategories": _SUBCATEGORY,
            "states": ("State",),
            "bands": _BAND,
            "orders": ("Order_ID", "Customer_ID", "Year"),
            "category_orders": ("Category", "Order_ID"),
            "region_orders": ("Region", "Order_ID"),
        },
    )


def run_all_eda(lines: DataFrame) -> dict[str, DataFrame]:
    """All sales results from one pass over the lines."""
    needed = ("Order_ID", "Customer_ID", *_MONTH, *_SUBCATEGORY, "State", "Region", "Discount", "Sales", "Profit",
              "Quantity", "Profit_Margin")
    sets = sales_sets(lines.select(*needed))
    return {
        "kpis": sales.sales_summary(sets["orders"]),
        "sales_by_year": sales.sales_by_year(sets["orders"]),
        "monthly_trend": sales.monthly_sales_trend(sets["months"]),
        "quarterly_sales": sales.quarterly_sales(sets["months"]),
        "sales_by_category": sales.sales_by_category(sets["category_orders"]),
        "sales_by_subcategory": sales.sales_by_subcategory(sets["subcategories"]),
        "sales_by_region": sales.sales_by_region(sets["region_orders"]),
        "sales_by_state": sales.sales_by_state(sets["states"]),
        "profitability_by_subcategory": sales.profitability_by_subcategory(sets["subcategories"]),
        "discount_profit": sales.discounts_of_sums(sets["bands"]),
    }


def run_customer_analysis(lines: DataFrame) -> dict[str, DataFrame]:
    """The customer table and the segmentation, both from one table per customer."""
    needed = (*CUSTOMER, "Order_ID", "Order_Date", "Sales", "Profit", "Quantity")
    customers = cust.per_customer(lines.select(*needed))
    return {"customer_table": cust.revenue_of(customers), "rfm": cust.rfm_of(cust.rfm_base_of(customers))}


def run_forecasting(
    lines: DataFrame, test_months: int = fc.TEST_MONTHS, keys: Sequence[str] = (), forest: bool = True
) -> dict[str, DataFrame]:
    """Series, split, predictions, metrics and best model. Always give it the unfiltered lines.

    The forest takes one series, so with ``keys`` there are the two closed-form models only.
    """
    monthly = cut_lineage(fc.prepare_monthly_series(lines, keys))
    flagged = fc.flag_test_months(monthly, test_months, keys)
    predicted = fc.linear_trend(fc.naive_baseline(flagged, keys), keys)
    if forest and not keys:
        predicted = cut_lineage(fc.random_forest(predicted))
    metrics = fc.evaluate(predicted, keys)
    return {
        "monthly": monthly,
        "train": flagged.filter("NOT is_test").drop("is_test"),
        "test": fc.test_predictions(predicted),
        "predicted": predicted,
        "metrics": fc.ranked_models(metrics, keys),
        "best_model": fc.best_model(metrics, keys),
    }


def insight_context(lines: DataFrame, forest: bool = True) -> DataFrame:
    """The record of figures straight from the lines, which one pass reduces to what its parts start from."""
    margin = F.col("Profit_Margin") if "Profit_Margin" in lines.columns else ratio("Profit", "Sales")
    needed = (*CUSTOMER, "Order_ID", "Order_Date", "Year_Month", "Category", "Region", "Discount", "Sales", "Profit")
    sets = sales.grouped_sets(
        sales.with_bands(lines.select(*needed, margin.alias("Profit_Margin"))),
        {
            "months": ("Year_Month",),
            "categories": ("Category",),
            "regions": ("Region",),
            "bands": _BAND,
            "orders": (*CUSTOMER, "Order_ID"),
        },
    )
    return insights.build_insight_context(
        sales.sales_summary(sets["orders"]),
        sales.sales_by_category(sets["categories"], orders=False),
        sales.sales_by_region(sets["regions"], orders=False),
        cust.compute_rfm(sets["orders"]),
        run_forecasting(sets["months"], forest=forest)["metrics"],
        sales.discounts_of_sums(sets["bands"]),
    )


def insight_context_by(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One record per key value from the same grouped aggregates; forecasts need a long enough series each.

    Segment counts are of customers, so they are there when the keys are customer attributes.
    """
    of_customers = set(keys) <= set(CUSTOMER)
    return insights.build_insight_context(
        sales.sales_summary(lines, keys),
        sales.sales_by_category(lines, keys),
        sales.sales_by_region(lines, keys),
        cust.compute_rfm(lines) if of_customers else None,
        run_forecasting(lines, keys=keys, forest=False)["metrics"],
        sales.discount_profit_analysis(lines, keys),
        keys,
    )


@dataclass
class RunResult:
    """Everything a full run leaves behind; tables are read lazily."""

    quality: DataFrame
    audit: DataFrame
    lines: DataFrame
    eda: dict[str, DataFrame]
    customers: dict[str, DataFrame]
    queries: dict[str, DataFrame]
    failed_queries: dict[str, str]
    forecast: dict[str, DataFrame]
    report: DataFrame
    extras: dict[str, DataFrame] = field(default_factory=dict)


def run_all(
    spark: SparkSession,
    raw: DataFrame | str | None,
    processed_path: str,
    report_path: str | None = None,
    forest: bool = True,
    date_formats: Sequence[str] | None = None,
    relation: str = RELATION,
) -> RunResult:
    """Raw table to report.

    The raw rows are grouped once, for the clean rows and the audit. The processed lines are written once and every
    later step reads them back.
    """
    source = raw if isinstance(raw, DataFrame) else load_raw_orders(spark, raw)
    counted = cut_lineage(counted_rows(source, date_formats))
    save_processed(engineer_features(clean_of_counted(counted)), processed_path)
    lines = load_processed(spark, processed_path)
    eda = run_all_eda(lines)
    customers = run_customer_analysis(lines)
    publish(lines, relation)
    queries, failed = run_all_business_queries(spark, relation=relation)
    forecast = run_forecasting(lines, forest=forest)
    context = insights.build_insight_context(
        eda["kpis"],
        eda["sales_by_category"],
        eda["sales_by_region"],
        customers["rfm"],
        forecast["metrics"],
        eda["discount_profit"],
    )
    report = insights.generate_insights(context)
    if report_path:
        save_report(report, report_path)
    return RunResult(
        quality=profiling.quality_report(source),
        audit=audit_of_counted(counted),
        lines=lines,
        eda=eda,
        customers=customers,
        queries=queries,
        failed_queries=failed,
        forecast=forecast,
        report=report,
        extras={"region_chart": products.region_chart(eda["sales_by_region"])},
    )
