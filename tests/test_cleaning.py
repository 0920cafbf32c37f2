from __future__ import annotations

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyline.operators import cleaning, features, profiling

RAW = (
    "`Order ID` string, `Order Date` string, Category string, Sales string, Quantity string, Discount string, "
    "Profit string, Extra string"
)


@pytest.fixture(scope="module")
def raw(spark):
    rows = [
        (" a ", "2024-01-05", "\tTables\n", "10.5", "2", "0.2", "1", "x"),
        ("a", "2024-01-05", "Tables", "10.5", "2", "0.2", "1", "x"),  # a copy once stripped
        ("b", "not a date", "Tables", "10", "2", "0.2", "1", "x"),
        ("c", "2024-01-06", "Tables", "n/a", "2", "0.2", "1", "x"),
        ("d", "2024-01-07", None, "0", "0", "-0.1", "-3", "x"),
        ("e", "2024-01-08", "Chairs", "-5", "1", "1.5", "2", None),
        ("f", "2024-01-09", "Chairs", "5", "1", None, "2", None),
        ("f", "2024-01-09", "Chairs", "5", "1", None, "2", None),  # missing equals missing
        ("g", "2024-01-09", "Chairs", "5", None, "0", "2", None),
    ]
    return spark.createDataFrame(rows, RAW)


def test_clean(raw):
    clean = cleaning.clean_orders(raw)
    assert clean.columns == ["Order_ID", "Order_Date", "Category", "Sales", "Quantity", "Discount", "Profit", "Extra"]
    found = {row["Order_ID"]: row for row in clean.collect()}
    assert sorted(found) == ["a", "d", "e", "f"]
    assert clean.count() == 4
    assert found["a"]["Category"] == "Tables"
    assert found["d"]["Category"] is None
    assert float(found["d"]["Discount"]) == 0
    assert float(found["e"]["Discount"]) == 1
    assert found["f"]["Discount"] is None
    assert clean.schema["Order_Date"].dataType.simpleString() == "timestamp_ntz"
    assert clean.schema["Sales"].dataType.simpleString() == "double"


def test_clean_twice_changes_nothing(raw):
    once = cleaning.clean_orders(raw)
    assert sorted(map(str, cleaning.clean_orders(once).collect())) == sorted(map(str, once.collect()))


def test_audit(raw):
    assert cleaning.cleaning_audit(raw).first().asDict() == {
        "rows_in": 9,
        "dropped_missing": 3,
        "dropped_duplicates": 2,
        "clipped_discounts": 2,
        "quantity_below_one": 1,
        "negative_sales": 1,
        "rows_out": 4,
    }


def test_flags_agree_with_audit(raw):
    kept = cleaning.drop_duplicates(cleaning.drop_missing(cleaning.typed_orders(raw)))
    audit = cleaning.cleaning_audit(raw).first()
    flags = cleaning.range_flags(kept).first()
    assert flags["discounts_out_of_range"] == audit["clipped_discounts"]
    assert flags["quantity_below_one"] == audit["quantity_below_one"]
    assert flags["negative_sales"] == audit["negative_sales"]


def test_strip_matches_python(spark):
    texts = [" x ", "\x1cx\x1f", "\v\f x y \r\n", "", "  ", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, Category string")
    got = {row["i"]: row["Category"] for row in cleaning.strip_text(df).collect()}
    assert got == {i: t.strip() for i, t in enumerate(texts)}


def test_other_date_layouts(spark):
    df = spark.createDataFrame([("1/31/2024",), ("2024-02-01",), ("?",)], "Order_Date string")
    got = [row[0] for row in cleaning.parse_dates(df, ["M/d/yyyy"]).collect()]
    assert [d and d.strftime("%Y-%m-%d") for d in got] == ["2024-01-31", "2024-02-01", None]


def test_undefined_ratios_are_missing(raw):
    df = features.engineer_features(cleaning.clean_orders(raw).filter("Order_ID = 'd'"))
    row = df.first()
    assert row["Profit_Margin"] is None and row["Sales_per_Unit"] is None and row["Profit_per_Unit"] is None
    assert row["Is_Profitable"] is False


def test_days_to_ship_round_down(spark):
    df = spark.sql(
        """SELECT TIMESTAMP_NTZ'2024-01-02 12:00:00' AS Order_Date, TIMESTAMP_NTZ'2024-01-02 00:00:00' AS Ship_Date
           UNION ALL SELECT TIMESTAMP_NTZ'2024-01-02 12:00:00', TIMESTAMP_NTZ'2024-01-04 11:59:59'
           UNION ALL SELECT TIMESTAMP_NTZ'2024-01-02 12:00:00', NULL"""
    )
    pdf = pd.DataFrame(
        {"o": pd.to_datetime(["2024-01-02 12:00:00"] * 3),
         "s": pd.to_datetime(["2024-01-02 00:00:00", "2024-01-04 11:59:59", None])}
    )
    expected = [None if math.isnan(d) else int(d) for d in (pdf.s - pdf.o).dt.days]
    assert [row["Days_to_Ship"] for row in features.calendar_features(df).collect()] == expected


def test_calendar_matches_pandas(spark):
    days = pd.date_range("2023-12-30", "2024-12-31", freq="9D")
    df = spark.createDataFrame([(d.to_pydatetime(),) for d in days], "Order_Date timestamp_ntz")
    got = [tuple(r)[1:] for r in features.calendar_features(df).collect()]
    expected = [
        (d.year, d.month, d.quarter, d.strftime("%b"), d.strftime("%Y-%m"), f"{d.year}-Q{d.quarter}") for d in days
    ]
    assert got == expected


def test_quality_report(raw):
    report = {r["column_name"]: r for r in profiling.quality_report(cleaning.typed_orders(raw)).collect()}
    assert report["Order_Date"]["missing_count"] == 1
    assert report["Order_Date"]["missing_pct"] == round(1 / 9 * 100, 2)
    assert report["Order_Date"]["has_missing"] and not report["Order_ID"]["has_missing"]
    assert report["Sales"]["dtype"] == "double"


def test_duplicate_rows_match_pandas(spark):
    rows = [(i % 5, None if i % 3 else "x") for i in range(60)] + [(99, "only")]
    df = spark.createDataFrame(rows, "a int, b string")
    assert profiling.duplicate_rows(df).first()[0] == int(pd.DataFrame(rows).duplicated().sum())
    assert profiling.duplicate_rows(df.filter("a = 99")).first()[0] == 0


def test_unknown_columns_pass_through(raw):
    assert cleaning.clean_orders(raw).filter(F.col("Extra") == "x").count() == 2


def text_rows(spark, **columns):
    n = len(next(iter(columns.values())))
    names = {"Order ID": "o", "Order Date": "2020-01-05", "Sales": "1", "Quantity": "1", "Profit": "1", "Discount": "0"}
    rows = [tuple(columns.get(c, [v] * n)[i] for c, v in names.items()) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in names))


def test_dates_in_other_layouts(spark):
    texts = ["2016-11-08", "11/8/2016", " 11/08/2016 ", "Nov 8, 2016", "8 November 2016", "2016/11/8", "8-Nov-2016", "20161108"]
    found = cleaning.parse_dates(cleaning.canonical_names(text_rows(spark, **{"Order Date": texts})))
    assert {str(r["Order_Date"]) for r in found.collect()} == {"2016-11-08 00:00:00"}
    other = cleaning.typed_orders(text_rows(spark, **{"Order Date": ["8.11.2016"]}), ["d.M.yyyy"])
    assert str(other.first()["Order_Date"]) == "2016-11-08 00:00:00"


def test_numbers_keep_their_precision(spark):
    texts = ["5.12341", "5.12342", "1000000000000000", "nan", "1e3"]
    clean = cleaning.clean_orders(text_rows(spark, Sales=texts))
    assert sorted(r["Sales"] for r in clean.collect()) == [5.12341, 5.12342, 1000.0, 1e15]


def test_sums_are_exact_or_fail(spark):
    from tallyline.operators.sales import sales_by_category

    rows = [("a", 1e15, 0.0, 1.0)] * 3 + [("a", 0.1, 0.0, 1.0)] * 10
    df = spark.createDataFrame(rows, "Category string, Sales double, Profit double, Order_ID double")
    assert sales_by_category(df).first()["Sales"] == 3000000000000001.0
    with pytest.raises(Exception, match="too large"):
        sales_by_category(df.replace(0.1, 1e30)).collect()


def test_copies_of_half_the_table(spark):
    from tallyline.operators.profiling import duplicate_rows

    rows = text_rows(spark, Sales=["7"] * 500 + [str(i) for i in range(500)])
    assert duplicate_rows(rows).first()[0] == 500
    assert cleaning.cleaning_audit(rows).first()["dropped_duplicates"] == 500
    assert cleaning.clean_orders(rows).count() == 500


def test_offsets_and_halves_of_the_day(spark):
    texts = {
        "2024-05-06T07:08:09+02:00": "2024-05-06 05:08:09",
        "2024-05-06 07:08:09-0530": "2024-05-06 12:38:09",
        "2024-05-06T07:08:09Z": "2024-05-06 07:08:09",
        "05/06/2024 7:08 PM": "2024-05-06 19:08:00",
        "5/6/2024 12:08 am": "2024-05-06 00:08:00",
        "5/6/2024 12:08:09 PM": "2024-05-06 12:08:09",
        "5/6/2024 13:08 PM": None,
        "8 November 2016 07:08": "2016-11-08 07:08:00",
        "november 8, 2016 7 pm": "2016-11-08 19:00:00",
        "2024/5/6 7:08:09": "2024-05-06 07:08:09",
        "20240506 23:59": "2024-05-06 23:59:00",
        "1-12-1995 15:39:28": "1995-01-12 15:39:28",
        "June 2, 1995 5:05:27 AM": "1995-06-02 05:05:27",
        "Foo 8, 2016": None,
        "13/13/2024": None,
        "5/6/24": None,
        "//": None,
        "": None,
        "2024-02-30": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "Order_Date string").withColumn("text", F.col("Order_Date"))
    got = {r["text"]: r["Order_Date"] and str(r["Order_Date"]) for r in cleaning.parse_dates(df).collect()}
    assert got == texts
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        again = {r["text"]: r["Order_Date"] and str(r["Order_Date"]) for r in cleaning.parse_dates(df).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert again == texts
