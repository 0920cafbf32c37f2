"""Names and types of the order-line table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Money is summed exactly, so that the result does not depend on the order of the rows.
MONEY = T.DecimalType(18, 4)
# For sums of floating-point numbers: exact to ten places, and wide enough for any amount.
WIDE_MONEY = T.DecimalType(38, 10)

# Raw export names and their canonical names.
CANONICAL_NAMES = {
    "Row ID": "Row_ID",
    "Order ID": "Order_ID",
    "Order Date": "Order_Date",
    "Ship Date": "Ship_Date",
    "Ship Mode": "Ship_Mode",
    "Customer ID": "Customer_ID",
    "Customer Name": "Customer_Name",
    "Country/Region": "Country",
    "State/Province": "State",
    "Postal Code": "Postal_Code",
    "Product ID": "Product_ID",
    "Product Name": "Product_Name",
    "Sub-Category": "Sub_Category",
}

DATES = ("Order_Date", "Ship_Date")
MEASURES = ("Sales", "Quantity", "Discount", "Profit")
CORE = ("Sales", "Quantity", "Profit", "Order_Date")
CUSTOMER = ("Customer_ID", "Customer_Name", "Segment")

# The columns of the raw export.
_RAW_NAMES = (
    "Row ID", "Order ID", "Order Date", "Ship Date", "Ship Mode", "Customer ID", "Customer Name",
    "Segment", "Country/Region", "State/Province", "Postal Code", "Region", "Product ID", "Category",
    "Sub-Category", "Product Name", "Sales", "Quantity", "Discount", "Profit",
)

# Text formats are read as strings; cleaning gives them their types.
RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in _RAW_NAMES])
RETURNS_SCHEMA = T.StructType([T.StructField("Returned", T.StringType()), T.StructField("Order ID", T.StringType())])


def require(df: DataFrame, *columns: str) -> None:
    """Fail before any job starts when a needed column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"order lines lack {', '.join(missing)}")


def known(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a value in every one of these columns."""
    for name in columns:
        df = df.filter(F.col(name).isNotNull())
    return df
