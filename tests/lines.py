"""Small order-line tables made in code."""

from __future__ import annotations

from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

COLUMNS = (
    "Order_ID string, Order_Date timestamp_ntz, Ship_Date timestamp_ntz, Customer_ID string, Customer_Name string, "
    "Segment string, State string, Region string, Category string, Sub_Category string, Product_ID string, "
    "Product_Name string, Ship_Mode string, Sales decimal(18,4), Quantity decimal(18,4), Discount decimal(18,4), "
    "Profit decimal(18,4)"
)
_DEFAULTS = {
    "Order_ID": "o1", "Order_Date": datetime(2024, 1, 1), "Ship_Date": datetime(2024, 1, 3), "Customer_ID": "c1",
    "Customer_Name": "Ann", "Segment": "Home", "State": "S", "Region": "West", "Category": "Chairs",
    "Sub_Category": "Stools", "Product_ID": "p1", "Product_Name": "stool", "Ship_Mode": "slow", "Sales": "10",
    "Quantity": "1", "Discount": "0", "Profit": "1",
}


def table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows given by the columns that matter; the others take defaults."""
    from tallyline.operators.features import engineer_features

    text = COLUMNS.replace("decimal(18,4)", "string")
    names = [part.split()[0] for part in COLUMNS.split(", ")]
    values = [tuple({**_DEFAULTS, **row}[name] for name in names) for row in rows]
    typed = ["CAST({0} AS DECIMAL(18,4)) AS {0}".format(n) if n in ("Sales", "Quantity", "Discount", "Profit") else n
             for n in names]
    return engineer_features(spark.createDataFrame(values, text).selectExpr(*typed))


def pandas_of(df: DataFrame) -> pd.DataFrame:
    return pd.DataFrame([row.asDict() for row in df.collect()], columns=df.columns)
