"""Order lines from the given tables, and variants of them that reach the rarely used branches."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.operators.features import calendar_features, margin_features
from tallyline.schema import CANONICAL_NAMES
from tallyline.session import shared_folder
from tallyline.sources.star import ALL_COLUMNS, order_lines


def _featured(df: DataFrame) -> DataFrame:
    if "Order_Date" in df.columns:
        df = calendar_features(df)
    if {"Sales", "Profit", "Quantity"} <= set(df.columns):
        df = margin_features(df)
    return df


def lines(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Order lines with the features that the chosen columns allow."""
    return _featured(order_lines(spark, folder, columns or ALL_COLUMNS))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder for a table that a query writes and reads back.

    A session has one place per name, so that a query run again writes over its earlier table.
    """
    return f"{shared_folder(spark).rstrip('/')}/tallyline/{spark.sparkContext.applicationId}/{name}"


def discount_stress(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Every line with its discount, with ten times its discount (every band occurs), and with slightly less than that."""
    df = order_lines(spark, folder, ("Discount", *columns))
    tenfold = (F.col("Discount") * 10).cast("decimal(18,8)")
    below = (tenfold - F.lit(Decimal("0.00004"))).cast("decimal(18,8)")
    return df.withColumn("Discount", F.explode(F.array(F.col("Discount").cast("decimal(18,8)"), tenfold, below)))


def null_keys(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Lines of which some have no category or region."""
    df = lines(spark, folder, "Order_ID", "Category", "Region", *columns)
    return df.withColumns(
        {
            "Category": F.when(F.col("Order_ID") % 13 != 0, F.col("Category")),
            "Region": F.when(F.col("Order_ID") % 17 != 0, F.col("Region")),
        }
    )


def missing_measures(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Lines of which some have no sales, some no profit, and so no margin."""
    df = order_lines(spark, folder, list(dict.fromkeys(("Order_ID", "Sales", "Profit", *columns))))
    key = F.col("Order_ID")
    return _featured(df.withColumns({"Sales": F.when(key % 11 != 0, F.col("Sales")), "Profit": F.when(key % 7 != 0, F.col("Profit"))}))


def dirty_orders(spark: SparkSession, folder: str, whole: bool = False) -> DataFrame:
    """Every line as text under its raw name, with defects on fixed remainders of the order number.

    ``whole`` adds the text columns without defects, which a whole run needs.
    """
    df = order_lines(spark, folder)
    key = F.col("Order_ID")

    def text(name: str):
        return F.col(name).cast("string")

    def day(name: str):
        return F.date_format(name, "yyyy-MM-dd")

    def every(n: int, value, otherwise):
        return F.when(key % n == 0, value).otherwise(otherwise)

    # Large, long and nearly equal numbers, and discounts just below an edge.
    odd_sales = (
        F.when(key % 29 == 1, F.lit("1000000000000000.5"))
        .when(key % 23 == 1, F.concat(text("Sales"), F.lit("1234")))
        .when(key % 50 == 10, F.concat(text("Sales"), (F.col("copy") + 1).cast("string")))
        .otherwise(text("Sales"))
    )
    odd_discount = every(31, F.lit("0.19996"), every(37, F.lit("0.0999999"), text("Discount")))
    raw = {
        "Order ID": every(7, F.concat(F.lit("  "), text("Order_ID"), F.lit("\t")), text("Order_ID")),
        "Order Date": every(
            101,
            F.lit("not-a-date"),
            F.when(key % 5 == 1, F.date_format("Order_Date", "M/d/yyyy"))
            .when(key % 5 == 2, F.date_format("Order_Date", "MMM d, yyyy"))
            .otherwise(day("Order_Date")),
        ),
        "Ship Date": every(103, F.lit("unknown"), day("Ship_Date")),
        "Customer ID": text("Customer_ID"),
        "Region": F.col("Region"),
        "Category": every(53, F.lit(None).cast("string"), every(11, F.concat("Category", F.lit(" \n")), F.col("Category"))),
        "Sub-Category": F.col("Sub_Category"),
        "Product ID": text("Product_ID"),
        "Sales": every(97, F.lit("n/a"), every(89, F.lit("0"), every(83, F.lit(" -5.25 "), odd_sales))),
        "Quantity": every(79, F.lit("0"), text("Quantity")),
        "Discount": every(
            61, F.lit("-0.1"), every(59, F.lit("1.5"), every(67, F.lit(None).cast("string"), odd_discount))
        ),
        "Profit": text("Profit"),
        "Channel": every(2, F.lit("web"), F.lit("store")),
    }
    if whole:
        raw |= {"State/Province": F.col("State"), "Segment": F.col("Segment"), "Customer Name": F.col("Customer_Name")}
        raw |= {"Ship Mode": F.col("Ship_Mode"), "Product Name": F.col("Product_Name")}
    copies = F.explode(F.sequence(F.lit(0), every(10, F.lit(1), F.lit(0)))).alias("copy")
    return df.select("*", copies).select([column.alias(name) for name, column in raw.items()])


#: Ways of writing a moment; a key chooses one by its remainder.
WRITTEN_DATES = (
    "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'+02:00'", "yyyy-MM-dd HH:mm:ss'Z'", "yyyy/M/d HH:mm", "M/d/yyyy",
    "MM/dd/yyyy h:mm a", "M-d-yyyy HH:mm:ss", "yyyyMMdd", "d-MMM-yyyy", "d MMMM yyyy HH:mm", "MMM d, yyyy", "MMMM d, yyyy h:mm:ss a",
)


def written_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Every line's order date, with a time made of the order number, as text in one of many layouts."""
    df = order_lines(spark, folder, ("Order_ID", "Order_Date"))
    key = F.col("Order_ID")
    moment = F.col("Order_Date") + F.make_dt_interval(F.lit(0), (key % 24).cast("int"), (key % 60).cast("int"), key % 59)
    text = F.lit(None).cast("string")
    for i, layout in enumerate(WRITTEN_DATES):
        text = F.when(key % len(WRITTEN_DATES) == i, F.date_format(moment, layout)).otherwise(text)
    return df.select("Order_ID", text.alias("Order_Date"))


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Every line with all its columns under their raw names."""
    df = order_lines(spark, folder)
    raw = {canonical: name for name, canonical in CANONICAL_NAMES.items()}
    return df.select([F.col(c).alias(raw.get(c, c)) for c in df.columns])


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the labels some of them have: a table with missing values."""
    documents = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "source", "n_chars")
    return documents.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id", "left")
