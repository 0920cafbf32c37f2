from __future__ import annotations

import json
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyline.functions import labels, text
from tallyline.operators import customers, filters, products, sales
from tallyline.plans import jobs
from tallyline.plans.catalogue import BUSINESS_QUERIES, run_all_business_queries
from tallyline.sources.relation import publish, run_query

from .lines import pandas_of, table


@pytest.fixture(scope="module")
def skewed(spark):
    """One order, customer and product own a third of the lines; some keys are missing."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(600):
        hot = i % 3 == 0
        price = f"{rng.integers(1, 90000) / 100:.2f}"
        rows.append(
            {
                "Order_ID": "hot" if hot else f"o{rng.integers(0, 120)}",
                "Customer_ID": "hot" if hot else f"c{rng.integers(0, 40)}",
                "Customer_Name": "H" if hot else "N",
                "Product_ID": "hot" if hot else f"p{rng.integers(0, 30)}",
                "Category": None if i % 50 == 1 else ["A", "B", "C"][i % 3],
                "Sub_Category": f"s{rng.integers(0, 5)}",
                "Region": None if i % 60 == 2 else ["West", "East"][i % 2],
                "State": f"S{rng.integers(0, 6)}",
                "Order_Date": datetime(2022 + int(rng.integers(0, 3)), int(rng.integers(1, 13)), int(rng.integers(1, 28))),
                "Sales": "0" if i % 97 == 0 else price,
                "Profit": f"{rng.integers(-30000, 50000) / 100:.2f}",
                "Quantity": str(rng.integers(1, 9)),
                "Discount": None if i % 41 == 0 else f"{rng.integers(0, 11) / 10:.1f}",
            }
        )
    return table(spark, rows)


@pytest.fixture(scope="module")
def brute(skewed):
    pdf = pandas_of(skewed)
    for c in ("Sales", "Profit", "Quantity", "Discount"):
        pdf[c] = pdf[c].astype(float)
    return pdf


def test_grouped_results_match_brute_force(skewed, brute):
    expected = brute.groupby("Category").agg(
        Sales=("Sales", "sum"), Profit=("Profit", "sum"), Orders=("Order_ID", "nunique")
    )
    expected["Profit_Margin"] = expected.Profit / expected.Sales
    got = pandas_of(sales.sales_by_category(skewed)).set_index("Category").loc[expected.index]
    pd.testing.assert_frame_equal(got, expected, check_dtype=False, atol=1e-9)
    assert list(pandas_of(sales.sales_by_category(skewed)).Sales) == sorted(expected.Sales, reverse=True)


def test_summary_matches_brute_force(skewed, brute):
    got = sales.sales_summary(skewed).first()
    assert got["total_sales"] == round(brute.Sales.sum(), 2)
    assert got["total_orders"] == brute.Order_ID.nunique()
    assert got["avg_order_value"] == round(brute.groupby("Order_ID").Sales.sum().mean(), 2)
    assert got["overall_profit_margin_pct"] == round(brute.Profit.sum() / brute.Sales.sum() * 100, 2)


def test_summary_of_nothing(skewed):
    got = sales.sales_summary(skewed.filter("false")).first()
    assert (got["total_sales"], got["total_orders"], got["avg_order_value"]) == (0.0, 0, None)
    assert got["overall_profit_margin_pct"] == 0.0


def test_discount_bands_match_cut(skewed, brute):
    bins = [float(e) for e in labels.DISCOUNT_EDGES]
    band = pd.cut(brute.Discount, bins=bins, labels=list(labels.DISCOUNT_LABELS), right=False)
    expected = brute.groupby(band, observed=True).agg(
        Avg_Profit_Margin=("Profit_Margin", "mean"), Avg_Profit=("Profit", "mean"), Count=("Sales", "count")
    )
    got = pandas_of(sales.discount_profit_analysis(skewed))
    assert got.Discount_Bin.tolist() == expected.index.tolist()
    np.testing.assert_allclose(got.Avg_Profit_Margin.astype(float), expected.Avg_Profit_Margin)
    np.testing.assert_allclose(got.Avg_Profit.astype(float), expected.Avg_Profit)
    assert got.Count.tolist() == expected.Count.tolist()


@pytest.mark.parametrize(
    "value,label",
    [("-0.01", None), ("0", "0%"), ("0.0009", "0%"), ("0.001", "1-9%"), ("0.0999", "1-9%"), ("0.1", "10-20%"),
     ("0.2", "21-30%"), ("0.3", "31-40%"), ("0.4", "41-50%"), ("0.5", "51-60%"), ("0.6", "61-80%"), ("0.7999", "61-80%"),
     ("0.8", ">80%"), ("1", ">80%"), ("1.0099", ">80%"), ("1.01", None), (None, None)],
)
def test_every_discount_edge(spark, value, label):
    df = spark.createDataFrame([(value,)], "d string").select(labels.discount_band(F.col("d").cast("decimal(18,4)")))
    assert df.first()[0] == label


def test_one_pass_gives_the_same_results(skewed):
    found = jobs.run_all_eda(skewed)
    for name, operator in {
        "kpis": sales.sales_summary,
        "sales_by_year": sales.sales_by_year,
        "monthly_trend": sales.monthly_sales_trend,
        "quarterly_sales": sales.quarterly_sales,
        "sales_by_category": sales.sales_by_category,
        "sales_by_subcategory": sales.sales_by_subcategory,
        "sales_by_region": sales.sales_by_region,
        "sales_by_state": sales.sales_by_state,
        "profitability_by_subcategory": sales.profitability_by_subcategory,
    }.items():
        assert found[name].collect() == operator(skewed).collect(), name
    got, expected = (df.collect() for df in (found["discount_profit"], sales.discount_profit_analysis(skewed)))
    assert [r["Discount_Bin"] for r in got] == [r["Discount_Bin"] for r in expected]
    assert [r["Count"] for r in got] == [r["Count"] for r in expected]


def test_sql_and_dataframe_dialects_agree(spark, skewed):
    publish(skewed)
    results, failures = run_all_business_queries(spark)
    assert not failures and set(results) == set(BUSINESS_QUERIES)
    by_category = {r["Category"]: r for r in sales.sales_by_category(skewed).collect()}
    for row in results["total_sales_profit_by_category"].collect():
        if row["Category"] is None:  # only SQL keeps the group of the missing key
            assert None not in by_category
            continue
        found = by_category[row["Category"]]
        assert row["Total_Sales"] == round(found["Sales"], 2)
        assert row["Order_Count"] == found["Orders"]
    months = {r["Year_Month"]: r["Sales"] for r in sales.monthly_sales_trend(skewed).collect()}
    for row in results["monthly_sales"].collect():
        assert row["Monthly_Sales"] == round(months[row["Year_Month"]], 2)
    years = {str(r["Year"]): r for r in sales.sales_by_year(skewed).collect()}
    for row in results["yearly_performance"].collect():
        assert row["Orders"] == years[row["Year"]]["Orders"]
    assert None in {r["Region"] for r in results["regional_performance"].collect()}


def test_failing_query_is_skipped(spark, skewed):
    publish(skewed)
    wanted = {"bad": "SELECT nothing FROM orders", "good": BUSINESS_QUERIES["monthly_sales"]}
    results, failures = run_all_business_queries(spark, wanted)
    assert list(results) == ["good"] and "nothing" in failures["bad"]


def test_query_before_publishing(spark):
    with pytest.raises(LookupError, match="publish"):
        run_query(spark, "SELECT 1", relation="never_published")


def test_customer_table_matches_brute_force(skewed, brute):
    expected = brute.groupby(["Customer_ID", "Customer_Name", "Segment"]).agg(
        Total_Sales=("Sales", "sum"), Total_Orders=("Order_ID", "nunique"), Total_Quantity=("Quantity", "sum")
    )
    got = pandas_of(customers.customer_revenue_table(skewed)).set_index(["Customer_ID", "Customer_Name", "Segment"])
    got = got.loc[expected.index]
    np.testing.assert_allclose(got.Total_Sales, expected.Total_Sales)
    assert got.Total_Orders.tolist() == expected.Total_Orders.tolist()
    np.testing.assert_allclose(got.Avg_Order_Value, expected.Total_Sales / expected.Total_Orders)


def test_snapshot_counts_lines_without_customer(spark):
    df = table(
        spark,
        [
            {"Customer_ID": "a", "Order_Date": datetime(2024, 1, 1)},
            {"Customer_ID": "b", "Order_Date": datetime(2024, 1, 3)},
            {"Customer_ID": None, "Order_Date": datetime(2024, 1, 9)},
        ],
    )
    assert {r["Customer_ID"]: r["Recency"] for r in customers.rfm_base(df).collect()} == {"a": 9, "b": 7}


def test_segments_add_up(skewed):
    rfm = customers.compute_rfm(skewed)
    n = rfm.count()
    counts = customers.segment_counts(rfm).collect()
    assert sum(r["Count"] for r in counts) == n
    order = [labels.SEGMENT_ORDER.index(r["Segment"]) for r in counts]
    assert order == sorted(order)
    assert rfm.filter("RFM_Score < 3 OR RFM_Score > 12").count() == 0
    total = customers.segment_revenue(rfm).agg(F.sum("Monetary")).first()[0]
    assert total == pytest.approx(rfm.agg(F.sum("Monetary")).first()[0])


def test_filters(skewed, brute):
    got = filters.filter_orders(skewed, years=[2022, 2024], categories=["A"])
    expected = brute[brute.Year.isin([2022, 2024]) & (brute.Category == "A")]
    assert filters.selected_rows(got).first()[0] == len(expected)
    assert filters.selected_rows(filters.filter_orders(skewed)).first()[0] == len(brute)
    assert filters.nothing_selected(filters.filter_orders(skewed, regions=["nowhere"]))
    assert not filters.nothing_selected(skewed)


def test_top_and_worst_prefers_first_name_on_ties(spark):
    df = table(spark, [{"Category": c, "Region": r} for c in ("B", "A") for r in ("Z", "Y")])
    got = products.top_and_worst(sales.sales_by_category(df), sales.sales_by_region(df)).collect()
    assert [(r["top_name"], r["worst_name"]) for r in got] == [("A", "A"), ("Y", "Y")]


@pytest.mark.parametrize(
    "value,shown",
    [(2326534.0, "$2.33M"), (-1500000.0, "$-1.50M"), (1234.0, "$1.2K"), (999.6, "$1,000"), (999999.0, "$1000.0K"),
     (12.3, "$12"), (0.0, "$0"), (-45.6, "$-46")],
)
def test_short_currency_like_python(spark, value, shown):
    df = spark.createDataFrame([(value,)], "v double").select(text.short_currency(F.col("v")))
    assert df.first()[0] == shown


def test_formatted_report(spark):
    df = spark.createDataFrame([("x", 1234.5, 12.345, 7)], "Name string, Total_Sales double, Profit_Margin_Pct double, n int")
    assert tuple(text.format_report(df).first()) == ("x", "$1,234.50", "12.35%", 7)


def test_year_filter_prunes_partitions(spark, skewed, tmp_path):
    from tallyline.sources.files import load_processed

    path = str(tmp_path / "processed")
    stored = load_processed(spark, path, lambda: skewed)
    plan = filters.filter_orders(stored, years=[2023]).select("Sales")._jdf.queryExecution().executedPlan().toString()
    assert "Year#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    schema = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert schema.startswith("Sales:") and "Profit" not in schema
    assert json.loads(spark.read.parquet(path).schema.json())["fields"]
