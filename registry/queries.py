"""One entry per operator: (spark, folder) -> DataFrame over the whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.functions import labels, text
from tallyline.operators import cleaning, cube, customers, features, filters, insights, products, profiling, sales
from tallyline.operators import forecasting as fc
from tallyline.plans import jobs
from tallyline.plans.catalogue import BUSINESS_QUERIES, run_all_business_queries
from tallyline.schema import CUSTOMER
from tallyline.session import cut_lineage
from tallyline.sources import files, relation
from tallyline.sources.star import order_lines

from .inputs import (
    dirty_orders,
    discount_stress,
    labelled_documents,
    lines,
    missing_measures,
    null_keys,
    scratch_path,
    written_dates,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

_MONEY = ("Sales", "Profit")
_KPI = ("Order_ID", "Customer_ID", *_MONEY)
_CUSTOMERS = (*CUSTOMER, "Order_ID", *_MONEY, "Quantity")
_RFM = (*CUSTOMER, "Order_ID", "Order_Date", "Sales")
_CATEGORY = ("Order_ID", "Category", *_MONEY)
_REGION = ("Order_ID", "Region", *_MONEY)
_SUBCATEGORY = ("Category", "Sub_Category", *_MONEY, "Quantity")
_MONTHLY = ("Order_Date", "Sales")
_INSIGHT = (*_RFM, "Profit", "Category", "Region", "Discount")
_EDA = (*_KPI, "Order_Date", "Category", "Sub_Category", "Region", "State", "Discount", "Quantity")
_FACETS = ("Order_ID", "Customer_ID", "Order_Date", "Region", "Category", "Segment", *_MONEY)


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def _plain(df: DataFrame) -> DataFrame:
    """Dates as text and decimals as double, so that any engine's result compares by value."""
    shown = []
    for name, kind in df.dtypes:
        if kind.startswith("timestamp"):
            shown.append(F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name))
        elif kind.startswith("decimal"):
            shown.append(F.col(name).cast("double").alias(name))
        else:
            shown.append(F.col(f"`{name}`"))
    return df.select(shown)


def _rounded(df: DataFrame, places: int, *names: str) -> DataFrame:
    """Sums of doubles depend on the row order in their last digits."""
    return df.withColumns({name: F.round(F.col(name), places) for name in names})


# --- sources and sinks ---------------------------------------------------------------------------


@query("j1_order_lines")
def j1(spark, folder):
    return _plain(order_lines(spark, folder))


@query("s1_load_raw_orders")
def s1(spark, folder):
    return _plain(files.load_raw_orders(spark, f"{folder}/lineitem.parquet"))


@query("s2_load_returns")
def s2(spark, folder):
    returned = spark.read.parquet(f"{folder}/lineitem.parquet").filter("l_returnflag = 'R'")
    table = returned.select(F.lit("Yes").alias("Returned"), F.col("l_orderkey").cast("string").alias("Order ID"))
    path = scratch_path(spark, "returns")
    table.distinct().write.mode("overwrite").parquet(path)
    return files.load_returns(spark, path)


@query("s3_save_processed")
def s3(spark, folder):
    path = scratch_path(spark, "saved")
    files.save_processed(lines(spark, folder, "Order_ID", "Order_Date", *_MONEY, "Quantity"), path)
    return _plain(files.load_processed(spark, path))


@query("s4_load_processed")
def s4(spark, folder):
    path = f"{scratch_path(spark, 'processed')}-{uuid.uuid4().hex}"
    built = files.load_processed(spark, path, lambda: lines(spark, folder, *_KPI, "Order_Date"))
    return sales.sales_summary(built, ["Year"])


@query("s5_published_rows")
def s5(spark, folder):
    return relation.row_count(relation.publish(lines(spark, folder, "Order_ID")))


@query("s5_lookups")
def s5_lookups(spark, folder):
    """Lines of an order, of customers and of the first day, from the clustered relation."""
    every = lines(spark, folder, *_KPI, "Order_Date")
    stored = relation.publish_clustered(every, scratch_path(spark, "clustered"), "s5_orders")
    first = stored.agg(F.min("Order_Date")).first()[0]
    asked = {"order": {"orders": [7]}, "customers": {"customers": [7, 40, 100]}, "day": {"dates": [first]}}
    parts = [relation.lookup(stored, **a).select(F.lit(n).alias("lookup"), *_KPI, "Order_Date") for n, a in asked.items()]
    return _plain(reduce(DataFrame.unionByName, parts))


@query("s6_run_query")
def s6(spark, folder):
    relation.publish(lines(spark, folder, "Segment", "Order_Date", "Sales"))
    return relation.run_query(
        spark,
        """SELECT Segment, strftime('%Y-%m', Order_Date) AS Period, COUNT(*) AS n,
                  CAST(ROUND(SUM(Sales), 2) AS DOUBLE) AS Sales
           FROM orders GROUP BY Segment, strftime('%Y-%m', Order_Date)""",
    )


def _digest(results: dict[str, DataFrame], name: str, measures: dict[str, str]) -> DataFrame:
    """Rows of each result, and the sum of one of its columns."""
    parts = []
    for key, df in results.items():
        measure = F.sum(F.col(measures[key]).cast("decimal(38,10)")) if key in measures else F.lit(None).cast("double")
        parts.append(
            df.groupBy().agg(F.lit(key).alias(name), F.count("*").alias("n_rows"), F.round(measure, 2).cast("double").alias("total"))
        )
    return reduce(DataFrame.unionByName, parts)


_QUERY_MEASURES = {
    "total_sales_profit_by_category": "Total_Sales",
    "monthly_sales": "Monthly_Profit",
    "regional_performance": "Customers",
    "top_10_customers_by_revenue": "Total_Sales",
    "top_10_products_by_profit": "Total_Profit",
    "loss_making_subcategories": "Total_Profit",
    "avg_discount_by_category": "Avg_Discount_Pct",
    "sales_profit_by_segment": "Orders",
    "high_sales_low_profit_products": "Total_Sales",
    "yearly_performance": "Total_Profit",
    "ship_mode_analysis": "Avg_Days_to_Ship",
    "state_profitability": "Profit_Margin_Pct",
    "top_10_customers_without_id": "Total_Profit",
}
_EDA_MEASURES = {
    "kpis": "avg_order_value",
    "sales_by_year": "Orders",
    "monthly_trend": "Sales",
    "quarterly_sales": "Profit",
    "sales_by_category": "Orders",
    "sales_by_subcategory": "Quantity",
    "sales_by_region": "Orders",
    "sales_by_state": "Profit",
    "profitability_by_subcategory": "Profit",
    "discount_profit": "Avg_Sales",
}
_CUSTOMER_MEASURES = {"customer_table": "Total_Profit", "rfm": "RFM_Score"}


@query("s7_catalogue_results")
def s7(spark, folder):
    """Every report, one that can't be planned, and one that fails while it runs; both leave the others alone."""
    stored = cut_lineage(lines(spark, folder), f"{scratch_path(spark, 's7_orders')}-{uuid.uuid4().hex}")
    relation.publish(stored, "s7_orders")
    broken = {
        "broken": "SELECT no_such_column FROM orders",
        "broken_while_running": "SELECT Category, 1 DIV (SUM(Quantity) - SUM(Quantity)) AS x FROM orders GROUP BY Category",
    }
    results, failed = run_all_business_queries(spark, {**broken, **BUSINESS_QUERIES}, "s7_orders")
    shown = _digest(results, "query", _QUERY_MEASURES).withColumn("failed", F.lit(False))
    lost = spark.createDataFrame(
        [(name, None, None, True) for name in failed], "query string, n_rows long, total double, failed boolean"
    )
    return shown.unionByName(lost)


@query("s8_saved_report")
def s8(spark, folder):
    path = scratch_path(spark, "report")
    context = jobs.insight_context_by(lines(spark, folder, *_FACETS, "Discount"), ["Region"])
    files.save_report(insights.report_text(context, ["Region"]), path)
    return spark.read.text(path)


# --- cleaning ------------------------------------------------------------------------------------


@query("c1_canonical_names")
def c1(spark, folder):
    return cleaning.canonical_names(dirty_orders(spark, folder))


@query("c2_parse_dates")
def c2(spark, folder):
    parsed = cleaning.parse_dates(cleaning.canonical_names(dirty_orders(spark, folder)))
    return _plain(parsed.select("Order_ID", "Order_Date", "Ship_Date"))


@query("c2_date_layouts")
def c2_layouts(spark, folder):
    """Every line's order date and time, written in one of thirteen ways and read back."""
    return _plain(cleaning.parse_dates(written_dates(spark, folder)))


@query("c3_strip_text")
def c3(spark, folder):
    stripped = cleaning.strip_text(cleaning.canonical_names(dirty_orders(spark, folder)))
    return stripped.select("Order_ID", "Category", "Sales", "Channel")


@query("c4_coerce_measures")
def c4(spark, folder):
    typed = cleaning.typed_orders(dirty_orders(spark, folder))
    return _plain(typed.select("Order_ID", "Sales", "Quantity", "Discount", "Profit"))


@query("c5_drop_missing")
def c5(spark, folder):
    return _plain(cleaning.drop_missing(cleaning.typed_orders(dirty_orders(spark, folder))))


@query("c6_drop_duplicates")
def c6(spark, folder):
    typed = cleaning.typed_orders(dirty_orders(spark, folder))
    return _plain(cleaning.drop_duplicates(cleaning.drop_missing(typed)))


@query("c7_clean_orders")
def c7(spark, folder):
    return _plain(cleaning.clean_orders(dirty_orders(spark, folder)))


@query("c8_range_flags")
def c8(spark, folder):
    typed = cleaning.typed_orders(dirty_orders(spark, folder))
    return cleaning.range_flags(cleaning.drop_duplicates(cleaning.drop_missing(typed)))


@query("c9_cleaning_audit")
def c9(spark, folder):
    return cleaning.cleaning_audit(dirty_orders(spark, folder))


# --- features and formats ------------------------------------------------------------------------


@query("f1_f7_calendar")
def f1(spark, folder):
    return _plain(features.calendar_features(order_lines(spark, folder, ["Order_ID", "Order_Date", "Ship_Date"])))


@query("f8_f11_margins")
def f8(spark, folder):
    return _plain(features.margin_features(order_lines(spark, folder, ["Order_ID", *_MONEY, "Quantity"])))


@query("f8_f11_margins_dirty")
def f8_dirty(spark, folder):
    clean = cleaning.clean_orders(dirty_orders(spark, folder))
    found = features.margin_features(clean.select("Order_ID", "Product_ID", *_MONEY, "Quantity"))
    return _plain(found)


@query("f12_discount_bin")
def f12(spark, folder):
    df = discount_stress(spark, folder, "Order_ID")
    band = labels.discount_band(F.col("Discount")).alias("Discount_Bin")
    return _plain(df.select("Order_ID", "Discount", band))


def _rfm(spark, folder):
    return customers.compute_rfm(lines(spark, folder, *_RFM))


@query("f13_rfm_segment")
def f13(spark, folder):
    return _rfm(spark, folder).select("Customer_ID", "RFM_Score", "RFM_Segment")


@query("f14_is_loss")
def f14(spark, folder):
    found = sales.profitability_by_subcategory(lines(spark, folder, *_SUBCATEGORY))
    return found.groupBy("Category", "Is_Loss").agg(F.count("*").alias("n"))


@query("f17_short_currency")
def f17(spark, folder):
    table = customers.customer_revenue_table(lines(spark, folder, *_CUSTOMERS))
    shown = {name: text.short_currency(F.col(name)) for name in ("Total_Sales", "Total_Profit")}
    return table.select("Customer_ID", *[column.alias(name) for name, column in shown.items()])


@query("f18_percent")
def f18(spark, folder):
    table = sales.sales_by_state(lines(spark, folder, "State", *_MONEY))
    margin = F.col("Profit_Margin") * 100
    return table.select("State", text.percent(margin).alias("one"), text.percent(margin, 2).alias("two"))


@query("f20_formatted_report")
def f20(spark, folder):
    relation.publish(lines(spark, folder, *_CATEGORY))
    return text.format_report(relation.run_query(spark, BUSINESS_QUERIES["total_sales_profit_by_category"]))


@query("f21_thousands")
def f21(spark, folder):
    return products.in_thousands(sales.monthly_sales_trend(lines(spark, folder, "Order_Date", *_MONEY)))


@query("f22_strftime")
def f22(spark, folder):
    relation.publish(lines(spark, folder, "Order_ID", "Order_Date"))
    return relation.run_query(
        spark,
        """SELECT strftime('%Y', Order_Date) AS y, strftime('%Y-%m', Order_Date) AS ym,
                  strftime('%Y-%m-%d', Order_Date) AS ymd, COUNT(*) AS n FROM orders GROUP BY 1, 2, 3""",
    )


@query("f22_strftime_codes")
def f22_codes(spark, folder):
    """Every code beside literal text, over the order dates with a time made of the order number."""
    df = order_lines(spark, folder, ["Order_ID", "Order_Date"])
    key = F.col("Order_ID")
    timed = F.col("Order_Date") + F.make_dt_interval(F.lit(0), (key % 24).cast("int"), (key % 60).cast("int"), key % 59)
    relation.publish(df.select("Order_ID", timed.alias("Order_Date")), "f22_orders")
    codes = {
        "quarterly": "Q%m", "short_year": "%y", "day_of_year": "%j", "weeks": "%U/%W/%V", "weekdays": "%w %u %a %A", "iso_year": "%G-W%V",
        "clock": "%H:%M:%S", "halves": "%I o'clock %p", "names": "%d %b (%B)", "percent": "100%% of %Y", "seconds": "%s", "long": "%F %T %R %D",
    }
    chosen = ", ".join(f'strftime("{text}", Order_Date) AS {name}' for name, text in codes.items())
    return relation.run_query(spark, f"SELECT Order_ID, {chosen} FROM f22_orders", "f22_orders")


@query("f23_round")
def f23(spark, folder):
    relation.publish(order_lines(spark, folder, ["Order_ID", "Sales"]))
    return relation.run_query(
        spark,
        """SELECT Order_ID, CAST(ROUND(SUM(Sales), 2) AS DOUBLE) AS r2, CAST(ROUND(SUM(Sales), 1) AS DOUBLE) AS r1
           FROM orders GROUP BY Order_ID""",
    )


# --- profiling -----------------------------------------------------------------------------------


@query("p1_shape")
def p1(spark, folder):
    return profiling.shape(order_lines(spark, folder))


@query("p2_column_types")
def p2(spark, folder):
    return profiling.column_types(labelled_documents(spark, folder))


@query("p3_p4_missing_values")
def p3(spark, folder):
    return profiling.missing_values(labelled_documents(spark, folder))


@query("p3_p4_missing_values_typed_orders")
def p3_orders(spark, folder):
    return profiling.missing_values(cleaning.typed_orders(dirty_orders(spark, folder)))


@query("p5_duplicate_rows")
def p5(spark, folder):
    return profiling.duplicate_rows(dirty_orders(spark, folder))


@query("p6_describe_numeric")
def p6(spark, folder):
    df = order_lines(spark, folder, ["Sales", "Quantity", "Discount", "Profit"])
    return _rounded(profiling.describe_numeric(df), 4, "mean", "std", "p25", "p50", "p75")


@query("p6_describe_sketched")
def p6_sketched(spark, folder):
    """The rest is exact; the sketched quartiles' ranks among all values lie within the stated error."""
    df = cut_lineage(order_lines(spark, folder, ["Sales", "Quantity", "Profit"]))
    found = profiling.describe_numeric(df, sketch=profiling.SKETCH_K)
    long = df.select([F.col(c).cast("double").alias(c) for c in df.columns]).unpivot([], df.columns, "metric", "x")
    quartiles = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    # A value that occurs often covers a span of ranks.
    upto = [F.count(F.when(F.col("x") <= F.col(q), 1)) for q in quartiles]
    below = [F.count(F.when(F.col("x") < F.col(q), 1)) for q in quartiles]
    near = F.lit(True)
    error = profiling.rank_error(profiling.SKETCH_K)
    for p, low, high in zip(quartiles.values(), below, upto, strict=True):
        near = near & (low <= (p + error) * F.count("x")) & (high >= (p - error) * F.count("x"))
    checked = long.join(found, "metric").groupBy("metric", "n", "mean", "min", "max").agg(near.alias("within_bound"))
    return _rounded(checked, 4, "mean")


@query("p7_columns_with_missing")
def p7(spark, folder):
    return profiling.columns_with_missing(labelled_documents(spark, folder))


@query("p8_date_ranges")
def p8(spark, folder):
    return _plain(profiling.date_ranges(order_lines(spark, folder, ["Order_Date", "Ship_Date"])))


@query("p9_distinct_values")
def p9(spark, folder):
    names = ["Category", "Sub_Category", "Segment", "Region", "Ship_Mode"]
    return profiling.distinct_values(order_lines(spark, folder, names), names)


@query("p10_describe_rounded")
def p10(spark, folder):
    names = ["Sales", "Quantity", "Discount", "Profit"]
    return profiling.describe_rounded(order_lines(spark, folder, names), names)


for _column, _bins in (("Sales", 60), ("Profit", 60), ("Discount", 20)):

    def _histogram(spark, folder, column=_column, bins=_bins):
        found = profiling.histogram(order_lines(spark, folder, [column]), column, bins)
        return _rounded(found, 6, "lower", "upper")

    QUERIES[f"p11_histogram_{_column.lower()}"] = _histogram


# --- filters -------------------------------------------------------------------------------------


def _filtered(spark, folder):
    return filters.filter_orders(
        lines(spark, folder, *_FACETS), years=[1996, 1998], regions=["ASIA", "EUROPE"], segments=["FURNITURE"]
    )


@query("w1_filtered_kpis")
def w1(spark, folder):
    return sales.sales_summary(_filtered(spark, folder))


@query("w1_empty_selection")
def w1_all(spark, folder):
    return sales.sales_summary(filters.filter_orders(lines(spark, folder, *_FACETS)))


_SELECTIONS = {
    "all": {},
    "years": {"years": [1996, 1998]},
    "place_and_segment": {"years": [1996, 1998], "regions": ["ASIA", "EUROPE"], "segments": ["FURNITURE"]},
    "categories": {"categories": ["PROMO", "ECONOMY"], "regions": ["ASIA", "AFRICA", "AMERICA"]},
    "nothing": {"regions": ["NOWHERE"]},
}


@query("w1_cube_kpis")
def w1_cube(spark, folder):
    """Headline figures of several selections, all from one cube."""
    whole = cube.selection_cube(lines(spark, folder, *_EDA, "Segment"))
    parts = [whole.select(**chosen).summary().withColumn("selection", F.lit(name)) for name, chosen in _SELECTIONS.items()]
    return reduce(DataFrame.unionByName, parts)


@query("w1_cube_groups")
def w1_cube_groups(spark, folder):
    """The groupings of several selections, all from one cube."""
    whole = cube.selection_cube(lines(spark, folder, *_EDA, "Segment"))
    parts = []
    for name, chosen in _SELECTIONS.items():
        part = whole.select(**chosen)
        found = {"Year": part.by_year(), "Category": part.by_category(), "Region": part.by_region()}
        found |= {"Year_Month": part.monthly(), "Year_Quarter": part.quarterly(), "State": part.by_state()}
        found["Sub_Category"] = part.by_subcategory().groupBy("Sub_Category").agg(F.sum("Sales").alias("Sales"), F.sum("Profit").alias("Profit"))
        for key, df in found.items():
            orders = F.col("Orders") if "Orders" in df.columns else F.lit(None).cast("long")
            shown = (F.col(key).cast("string").alias("value"), "Sales", "Profit", orders.alias("Orders"))
            parts.append(df.select(F.lit(name).alias("selection"), F.lit(key).alias("grouping"), *shown))
    return reduce(DataFrame.unionByName, parts)


@query("w2_facets")
def w2(spark, folder):
    return filters.facet_values(lines(spark, folder, "Order_Date", "Region", "Category", "Segment"))


@query("w3_selected_rows")
def w3(spark, folder):
    return filters.selected_rows(_filtered(spark, folder))


@query("w4_empty_guard")
def w4(spark, folder):
    """Whether a selection is empty, for one that is and one that isn't."""
    every = lines(spark, folder, *_FACETS)
    chosen = {"nowhere": ["NOWHERE"], "asia": ["ASIA"]}
    found = [(name, filters.nothing_selected(filters.filter_orders(every, regions=r))) for name, r in chosen.items()]
    selected = filters.selected_rows(filters.filter_orders(every, regions=["ASIA"])).select("selected")
    flags = spark.createDataFrame(found, "selection string, is_empty boolean")
    return flags.withColumn("selected", F.when(F.col("selection") == "asia", selected.scalar()).otherwise(F.lit(0)))


@query("w5_negative_margins")
def w5(spark, folder):
    bands = sales.discount_profit_analysis(discount_stress(spark, folder, *_MONEY))
    return _rounded(filters.negative_margins(bands), 6, "Avg_Profit_Margin")


# --- sales ---------------------------------------------------------------------------------------


@query("a1_kpis")
def a1(spark, folder):
    return sales.sales_summary(lines(spark, folder, *_KPI))


@query("a1_kpis_by_state")
def a1_by_state(spark, folder):
    return sales.sales_summary(lines(spark, folder, *_KPI, "State"), ["State"])


@query("a2_sales_by_year")
def a2(spark, folder):
    return sales.sales_by_year(lines(spark, folder, "Order_ID", "Order_Date", *_MONEY))


@query("a3_monthly_trend")
def a3(spark, folder):
    return sales.monthly_sales_trend(lines(spark, folder, "Order_Date", *_MONEY))


@query("a4_quarterly_sales")
def a4(spark, folder):
    return sales.quarterly_sales(lines(spark, folder, "Order_Date", *_MONEY))


@query("a5_sales_by_category")
def a5(spark, folder):
    return sales.sales_by_category(lines(spark, folder, *_CATEGORY))


@query("a5_sales_by_category_null_keys")
def a5_null(spark, folder):
    return sales.sales_by_category(null_keys(spark, folder, *_MONEY))


@query("a6_sales_by_subcategory")
def a6(spark, folder):
    return sales.sales_by_subcategory(lines(spark, folder, *_SUBCATEGORY))


@query("a7_sales_by_region")
def a7(spark, folder):
    return sales.sales_by_region(lines(spark, folder, *_REGION))


@query("a8_sales_by_state")
def a8(spark, folder):
    return sales.sales_by_state(lines(spark, folder, "State", *_MONEY))


@query("a9_profitability_by_subcategory")
def a9(spark, folder):
    return sales.profitability_by_subcategory(lines(spark, folder, *_SUBCATEGORY))


@query("a10_discount_bins")
def a10(spark, folder):
    df = lines(spark, folder, "Discount", *_MONEY, "Quantity")
    return _rounded(sales.discount_profit_analysis(df), 6, "Avg_Profit_Margin")


@query("a10_discount_bins_stress")
def a10_stress(spark, folder):
    df = discount_stress(spark, folder, *_MONEY)
    return _rounded(sales.discount_profit_analysis(df), 6, "Avg_Profit_Margin")


@query("a11_run_all_eda")
def a11(spark, folder):
    return _digest(jobs.run_all_eda(lines(spark, folder, *_EDA)), "result", _EDA_MEASURES)


@query("a11_subcategories_from_sets")
def a11_sets(spark, folder):
    return jobs.run_all_eda(lines(spark, folder, *_EDA))["profitability_by_subcategory"]


@query("a11_discounts_from_sets")
def a11_discounts(spark, folder):
    return _rounded(jobs.run_all_eda(lines(spark, folder, *_EDA))["discount_profit"], 6, "Avg_Profit_Margin")


@query("a11_discounts_missing_measures")
def a11_missing(spark, folder):
    """Both ways to the band averages, on lines of which some lack a measure."""
    df = missing_measures(spark, folder, *_EDA)
    ways = {"lines": sales.discount_profit_analysis(df), "sets": jobs.run_all_eda(df)["discount_profit"]}
    shown = [_rounded(found, 6, "Avg_Profit_Margin").withColumn("way", F.lit(way)) for way, found in ways.items()]
    return shown[0].unionByName(shown[1])


# --- SQL catalogue -------------------------------------------------------------------------------

# Report names; with the columns each reads.
_REPORTS = {
    "q1_sales_profit_by_category": ("total_sales_profit_by_category", _CATEGORY),
    "q2_monthly_sales": ("monthly_sales", ("Order_Date", *_MONEY)),
    "q3_regional_performance": ("regional_performance", (*_REGION, "Customer_ID")),
    "q4_top_customers": ("top_10_customers_by_revenue", (*CUSTOMER, "Order_ID", *_MONEY)),
    "q4b_top_customers_without_id": ("top_10_customers_without_id", (*CUSTOMER, "Order_ID", *_MONEY)),
    "q5_top_products": (
        "top_10_products_by_profit", ("Product_ID", "Product_Name", "Category", "Sub_Category", *_MONEY),
    ),
    "q6_loss_making_subcategories": ("loss_making_subcategories", ("Category", "Sub_Category", *_MONEY)),
    "q7_avg_discount": ("avg_discount_by_category", ("Category", "Discount", *_MONEY)),
    "q8_segments": ("sales_profit_by_segment", (*_KPI, "Segment")),
    "q9_high_sales_low_profit": (
        "high_sales_low_profit_products", ("Product_Name", "Category", "Sub_Category", *_MONEY),
    ),
    "q10_yearly": ("yearly_performance", (*_KPI, "Order_Date")),
    "q11_ship_modes": ("ship_mode_analysis", ("Order_ID", "Ship_Mode", "Order_Date", "Ship_Date", "Sales")),
    "q12_states": ("state_profitability", ("State", "Region", *_MONEY)),
}

for _name, (_report, _columns) in _REPORTS.items():

    def _run_report(spark, folder, report=_report, columns=_columns):
        relation.publish(lines(spark, folder, *columns))
        return relation.run_query(spark, BUSINESS_QUERIES[report])

    QUERIES[_name] = _run_report


@query("q3_regional_performance_null_keys")
def q3_null(spark, folder):
    relation.publish(null_keys(spark, folder, "Customer_ID", *_MONEY))
    return relation.run_query(spark, BUSINESS_QUERIES["regional_performance"])


# --- customers -----------------------------------------------------------------------------------


@query("k1_customer_table")
def k1(spark, folder):
    return customers.customer_revenue_table(lines(spark, folder, *_CUSTOMERS))


@query("k2_k3_rfm_base")
def k2(spark, folder):
    return customers.rfm_base(lines(spark, folder, *_RFM))


@query("k4_k6_rfm")
def k6(spark, folder):
    return _rfm(spark, folder)


@query("k5_rfm_tied")
def k5(spark, folder):
    base = customers.rfm_base(lines(spark, folder, *_RFM))
    few = F.least(F.col("Frequency"), F.lit(9).cast("long"))
    months = (F.col("Recency") / 400).cast("int")
    return customers.score_rfm(base.withColumns({"Frequency": few, "Recency": months}))


@query("k7_segment_counts")
def k7(spark, folder):
    return customers.segment_counts(_rfm(spark, folder))


@query("k8_segment_revenue")
def k8(spark, folder):
    return _rounded(customers.segment_revenue(_rfm(spark, folder)), 2, "Monetary")


@query("k9_top_customers")
def k9(spark, folder):
    return customers.top_customers(customers.customer_revenue_table(lines(spark, folder, *_CUSTOMERS)), 20)


@query("k9_top_rfm")
def k9_rfm(spark, folder):
    return customers.top_customers(_rfm(spark, folder), 25, by="Monetary")


@query("k10_customer_kpis")
def k10(spark, folder):
    found = jobs.run_customer_analysis(lines(spark, folder, *_CUSTOMERS, "Order_Date"))
    found = customers.customer_kpis(found["customer_table"], found["rfm"])
    return _rounded(found, 2, "avg_revenue", "avg_orders")


@query("k11_revenue_histogram")
def k11(spark, folder):
    table = customers.customer_revenue_table(lines(spark, folder, *_CUSTOMERS))
    return _rounded(customers.revenue_histogram(table), 6, "lower", "upper")


@query("k11_score_histogram")
def k11_scores(spark, folder):
    return customers.score_histogram(_rfm(spark, folder))


@query("k12_scatter_feed")
def k12(spark, folder):
    return customers.scatter_feed(_rfm(spark, folder))


# --- products ------------------------------------------------------------------------------------


def _subcategories(spark, folder):
    return sales.sales_by_subcategory(lines(spark, folder, *_SUBCATEGORY))


@query("d1_product_kpis")
def d1(spark, folder):
    return products.product_kpis_of_lines(lines(spark, folder, "Category", "Sub_Category", *_MONEY))


@query("d2_median_subcategory_sales")
def d2(spark, folder):
    return _rounded(products.median_subcategory_sales(_subcategories(spark, folder)), 4, "median_sales")


@query("d3_subcategory_table")
def d3(spark, folder):
    return products.subcategory_table(_subcategories(spark, folder))


@query("d3_subcategory_table_text")
def d3_text(spark, folder):
    return products.subcategory_table_text(_subcategories(spark, folder))


@query("d4_f16_f19_discount_chart")
def d4(spark, folder):
    bands = sales.discount_profit_analysis(discount_stress(spark, folder, *_MONEY))
    return _rounded(products.discount_chart(bands), 6, "Avg_Profit_Margin", "Avg_Margin_Pct")


@query("d5_f15_region_chart")
def d5(spark, folder):
    return products.region_chart(sales.sales_by_region(lines(spark, folder, *_REGION)))


@query("f15_margin_band")
def f15(spark, folder):
    table = customers.customer_revenue_table(lines(spark, folder, *_CUSTOMERS))
    return table.select("Customer_ID", labels.margin_band(F.col("Profit_Margin") * 100).alias("Margin_Band"))


@query("d6_top_and_worst")
def d6(spark, folder):
    return products.top_and_worst_of_lines(lines(spark, folder, "Category", "Region", *_MONEY))


@query("d7_profit_chart")
def d7(spark, folder):
    return products.profit_chart(_subcategories(spark, folder))


# --- forecasting ---------------------------------------------------------------------------------


def _simple(spark, folder, *keys):
    """Both closed-form models, without the forest."""
    monthly = fc.prepare_monthly_series(lines(spark, folder, *_MONTHLY, *keys), keys)
    flagged = fc.flag_test_months(monthly, keys=keys)
    return fc.linear_trend(fc.naive_baseline(flagged, keys), keys)


@query("t1_monthly_series")
def t1(spark, folder):
    return fc.prepare_monthly_series(lines(spark, folder, *_MONTHLY))


@query("t1_monthly_series_by_state")
def t1_by_state(spark, folder):
    return fc.prepare_monthly_series(lines(spark, folder, *_MONTHLY, "State"), ["State"])


@query("t2_test_months")
def t2(spark, folder):
    return fc.flag_test_months(fc.prepare_monthly_series(lines(spark, folder, *_MONTHLY)))


@query("t3_naive_baseline")
def t3(spark, folder):
    flagged = fc.flag_test_months(fc.prepare_monthly_series(lines(spark, folder, *_MONTHLY)))
    return fc.test_predictions(fc.naive_baseline(flagged))


@query("t4_linear_trend")
def t4(spark, folder):
    return _rounded(fc.test_predictions(_simple(spark, folder)), 2, "Pred_LR")


@query("t4_trend_by_region")
def t4_by_region(spark, folder):
    return _rounded(fc.test_predictions(_simple(spark, folder, "Region")), 2, "Pred_LR")


def _forest_fits(predicted: DataFrame) -> DataFrame:
    """The test months, with whether the forest stays within the sales that it was trained on."""
    sold = F.when(~F.col("is_test"), F.col("Sales"))
    seen = predicted.agg(F.struct(F.min(sold).alias("low"), F.max(sold).alias("high")).alias("r")).scalar()
    within = F.col("Pred_RF").between(seen["low"], seen["high"])
    return fc.test_predictions(predicted.withColumn("RF_in_range", within)).drop("Pred_RF")


@query("t5_random_forest")
def t5(spark, folder):
    flagged = fc.flag_test_months(fc.prepare_monthly_series(lines(spark, folder, *_MONTHLY)))
    return _forest_fits(fc.random_forest(flagged))


@query("t6_metrics")
def t6(spark, folder):
    return fc.evaluate(_simple(spark, folder))


@query("t6_metrics_by_region")
def t6_by_region(spark, folder):
    return fc.evaluate(_simple(spark, folder, "Region"), ["Region"])


@query("t7_best_model")
def t7(spark, folder):
    return fc.best_model(fc.evaluate(_simple(spark, folder)))


@query("t8_all_predictions")
def t8(spark, folder):
    return _rounded(_forest_fits(jobs.run_forecasting(lines(spark, folder, *_MONTHLY))["predicted"]), 2, "Pred_LR")


@query("t9_plot_feed")
def t9(spark, folder):
    return _rounded(fc.plot_feed(_simple(spark, folder)), 2, "Pred_LR")


@query("t11_run_forecasting")
def t11(spark, folder):
    """Figures of the closed-form models by value; of the forest, whose figures are its own, what must hold."""
    metrics = jobs.run_forecasting(lines(spark, folder, *_MONTHLY))["metrics"]
    closed = F.col("model") != "Random Forest"
    figures = [F.when(closed, F.col(c)).alias(c) for c in ("MAE", "RMSE", "R2")]
    lower = Window.orderBy("RMSE")
    ordered = F.coalesce(F.lag("RMSE").over(lower) <= F.col("RMSE"), F.lit(True))
    return metrics.select("model", *figures, (F.col("RMSE") >= F.col("MAE")).alias("consistent"), ordered.alias("ordered"))


# --- insights and bundles ------------------------------------------------------------------------


def _flat(context: DataFrame) -> DataFrame:
    """The segment map as text, for comparison by value."""
    entries = F.array_sort(F.map_entries("rfm_segments"))
    shown = F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return context.withColumn("rfm_segments", F.array_join(shown, "; "))


@query("i1_context")
def i1(spark, folder):
    return _flat(jobs.insight_context(lines(spark, folder, *_INSIGHT), forest=False))


@query("i1_context_by_state")
def i1_by_state(spark, folder):
    df = lines(spark, folder, *_FACETS, "State", "Discount")
    return jobs.insight_context_by(df, ["State"]).drop("rfm_segments")


@query("i1_context_by_segment")
def i1_by_segment(spark, folder):
    return _flat(jobs.insight_context_by(lines(spark, folder, *_INSIGHT), ["Segment"]))


@query("i2_i3_insights")
def i2(spark, folder):
    return insights.generate_insights(jobs.insight_context(lines(spark, folder, *_INSIGHT), forest=False))


@query("i2_report")
def i2_report(spark, folder):
    """Without the forest, so that the text can be checked word by word."""
    return insights.report_text(jobs.insight_context(lines(spark, folder, *_INSIGHT), forest=False))


@query("i2_report_by_state")
def i2_by_state(spark, folder):
    context = jobs.insight_context_by(lines(spark, folder, *_FACETS, "State", "Discount"), ["State"])
    return insights.report_text(context, ["State"])


@query("o1_run_all")
def o1(spark, folder):
    """Every step of the whole run: its rows, and the sum of one of its columns."""
    done = jobs.run_all(spark, dirty_orders(spark, folder, whole=True), scratch_path(spark, "run"), forest=False, relation="o1_orders")
    audit = done.audit.unpivot([], done.audit.columns, "figure", "value")
    steps = {
        "quality": done.quality,
        "audit": audit,
        "lines": done.lines,
        "monthly": done.forecast["monthly"],
        "metrics": done.forecast["metrics"],
        "report": done.report,
        "by_category": done.eda["sales_by_category"],
        "by_region": done.eda["sales_by_region"],
        "discounts": done.eda["discount_profit"],
        "categories_sql": done.queries["total_sales_profit_by_category"],
    }
    measures = {
        "quality": "missing_count",
        "audit": "value",
        "lines": "Profit",
        "monthly": "time_idx",
        "by_category": "Profit",
        "by_region": "Orders",
        "discounts": "Count",
        "categories_sql": "Total_Profit",
    }
    return _digest(steps, "step", measures)


@query("o2_customer_analysis")
def o2(spark, folder):
    found = jobs.run_customer_analysis(lines(spark, folder, *_CUSTOMERS, "Order_Date"))
    return _digest(found, "result", _CUSTOMER_MEASURES)
