from __future__ import annotations

from datetime import datetime

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tallyline.operators import forecasting as fc
from tallyline.operators import insights
from tallyline.plans import jobs

from .lines import table


def months(n: int, **extra) -> list[dict]:
    rng = np.random.default_rng(n)
    return [
        {"Order_Date": datetime(2020 + i // 12, i % 12 + 1, 5), "Sales": f"{100 + 3 * i + rng.integers(0, 20)}", **extra}
        for i in range(n)
        for _ in range(2)
    ]


def test_missing_month_leaves_no_gap(spark):
    rows = [{"Order_Date": datetime(2024, m, 1)} for m in (1, 2, 5)]
    got = fc.prepare_monthly_series(table(spark, rows)).orderBy("time_idx").collect()
    assert [(r["Year_Month"], r["time_idx"]) for r in got] == [("2024-01", 0), ("2024-02", 1), ("2024-05", 2)]


def test_short_series_is_an_error(spark):
    with pytest.raises(PySparkException, match="only 17 months"):
        fc.flag_test_months(fc.prepare_monthly_series(table(spark, months(17)))).collect()
    train, test = fc.train_test_split_time(fc.prepare_monthly_series(table(spark, months(18))))
    assert (train.count(), test.count()) == (6, 12)


def test_models_match_numpy(spark):
    df = table(spark, months(40))
    found = jobs.run_forecasting(df)
    series = [r["Sales"] for r in found["monthly"].orderBy("time_idx").collect()]
    train, test = np.array(series[:28]), np.array(series[28:])
    slope, intercept = np.polyfit(np.arange(28), train, 1)
    line = intercept + slope * np.arange(28, 40)
    got = found["test"].orderBy("time_idx").collect()
    np.testing.assert_allclose([r["Pred_LR"] for r in got], line)
    assert {r["Pred_Naive"] for r in got} == {train[-1]}
    forest = np.array([r["Pred_RF"] for r in got])
    assert forest.min() >= train.min() and forest.max() <= train.max()
    metrics = {r["model"]: r for r in found["metrics"].collect()}
    for name, guess in (("Naive Baseline", np.full(12, train[-1])), ("Linear Regression", line), ("Random Forest", forest)):
        error = test - guess
        assert metrics[name]["MAE"] == pytest.approx(np.abs(error).mean(), abs=0.006)
        assert metrics[name]["RMSE"] == pytest.approx(np.sqrt((error**2).mean()), abs=0.006)
        assert metrics[name]["R2"] == pytest.approx(1 - (error**2).sum() / ((test - test.mean()) ** 2).sum(), abs=6e-5)
    best = found["best_model"].first()
    assert best["RMSE"] == min(m["RMSE"] for m in metrics.values())
    assert found["metrics"].first()["model"] == best["model"]


def test_forest_is_repeatable(spark):
    monthly = fc.flag_test_months(fc.prepare_monthly_series(table(spark, months(24)))).orderBy("time_idx").coalesce(1)
    once, again = (fc.random_forest(monthly).orderBy("time_idx").collect() for _ in range(2))
    assert once == again


def test_constant_test_series_has_no_r2(spark):
    rows = [{"Order_Date": datetime(2020 + i // 12, i % 12 + 1, 5), "Sales": "50"} for i in range(20)]
    flagged = fc.flag_test_months(fc.prepare_monthly_series(table(spark, rows)))
    assert fc.evaluate(fc.naive_baseline(flagged)).first()["R2"] is None


def test_series_per_key_equal_single_series(spark):
    both = months(20, Region="West") + months(30, Region="East")
    keyed = jobs.run_forecasting(table(spark, both), keys=["Region"], forest=False)
    for region, n in (("West", 20), ("East", 30)):
        alone = jobs.run_forecasting(table(spark, months(n)), forest=False)
        got = keyed["metrics"].filter(f"Region = '{region}'").drop("Region").collect()
        assert got == alone["metrics"].collect()


def test_a_short_series_leaves_the_others_alone(spark):
    both = months(20, Region="West") + months(9, Region="East")
    keyed = jobs.run_forecasting(table(spark, both), keys=["Region"])
    assert {r["Region"] for r in keyed["metrics"].collect()} == {"West"}
    flags = keyed["predicted"].filter("Region = 'East'").select("is_test", "Pred_Naive", "Pred_LR").distinct().collect()
    assert flags == [(None, None, None)]


CONTEXT = {
    "total_sales": 2326534.35, "total_profit": 292296.81, "total_orders": 5111, "unique_customers": 804,
    "avg_order_value": 455.2, "overall_margin_pct": 12.56, "top_category_by_sales": "Technology",
    "top_category_sales": 839893.2, "worst_margin_category": "Furniture", "worst_margin_pct": 2.61,
    "top_region": "West", "top_region_sales": 739813.61, "worst_margin_region": "Central",
    "worst_margin_region_pct": 7.92, "champions_count": 93, "at_risk_count": 201,
    "best_forecast_model": "Linear Regression", "best_forecast_rmse": 23845.8, "best_forecast_r2": 0.1661,
    "worst_discount_bin": ">80%", "worst_discount_margin": -182.41,
}


def context_row(spark, **changes):
    values = {**CONTEXT, **changes}
    kinds = {
        k: "string" if isinstance(CONTEXT[k], str) else "bigint" if isinstance(CONTEXT[k], int) else "double" for k in values
    }
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[k]}" for k in values))


def test_report_with_published_figures(spark):
    row = insights.generate_insights(context_row(spark)).first()
    report = row["report"]
    assert row["mode"] == "template"
    for part in (
        "**$2,326,534** in total sales across **5,111 orders** from **804 unique customers**",
        "overall profit margin of **12.6%**.",
        "The **Technology** category leads in revenue at **$839,893**. The **Furniture** category",
        "lowest profit margin at **2.6%**",
        "The **West** region contributes the highest sales (**$739,814**). The **Central** region",
        "profit margin at **7.9%**",
        "discounts in the **>80%** range show an average profit margin of **-182.4%**",
        "**93** Champions and **201** At-Risk customers.",
        "**Linear Regression** (RMSE = $23,846, R² = 0.166), indicating a limited fit",
    ):
        assert part in report
    assert report.split("\n")[0] == "## AI-Generated Business Insights"
    assert "\n\n---\n\n### Business Implications\n\n" in report
    assert report.endswith("hallucinated by an AI model.")


def test_report_leaves_out_absent_findings(spark):
    missing = dict.fromkeys(("worst_discount_bin", "worst_discount_margin", "champions_count", "best_forecast_model"))
    report = insights.report_text(context_row(spark, **missing)).first()["report"]
    for heading in ("Discount Impact", "Customer Segmentation", "Sales Forecasting"):
        assert heading not in report
    assert "Regional Performance" in report and "\n\n\n" not in report


def test_report_names_a_good_fit(spark):
    report = insights.report_text(context_row(spark, best_forecast_r2=0.51)).first()["report"]
    assert "a reasonably good fit" in report


def test_context_with_empty_parts(spark):
    from tallyline.operators import sales

    df = table(spark, [{}])
    context = insights.build_insight_context(
        sales.sales_summary(df), sales.sales_by_category(df.filter("false")), discounts=sales.discount_profit_analysis(df)
    )
    row = context.first()
    assert row["total_orders"] == 1 and row["top_category_by_sales"] is None
    assert row["worst_discount_bin"] is None and row["rfm_segments"] is None
    assert "**N/A** category leads" in insights.report_text(context).first()["report"]
