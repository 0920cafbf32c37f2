"""The order-line table from a star schema (lines, orders, customers, places, parts)."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MONEY
from ..session import split_hot_keys

# Declared, so that no job reads file footers just to learn them.
_SCHEMAS = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, "
    "l_shipdate TIMESTAMP_NTZ",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_retailprice DOUBLE",
}

# Columns each lookup brings in. A lookup that brings nothing asked for is left out of the plan:
# every lookup keeps all lines and finds at most one row, so leaving it out changes nothing.
_FROM_ORDERS = {"Order_Date", "Ship_Mode"}
_FROM_CUSTOMER = {"Customer_Name", "Segment"}
_FROM_NATION = {"State"}
_FROM_REGION = {"Region"}
_FROM_PART = {"Category", "Sub_Category", "Product_Name", "Profit"}

ALL_COLUMNS = (
    "Order_ID", "Order_Date", "Ship_Date", "Ship_Mode", "Customer_ID", "Customer_Name", "Segment", "State",
    "Region", "Category", "Sub_Category", "Product_ID", "Product_Name", "Sales", "Quantity", "Discount", "Profit",
)


def order_lines(spark: SparkSession, folder: str, columns: Iterable[str] = ALL_COLUMNS) -> DataFrame:
    """One row per order line with the asked-for canonical columns.

    A line whose order, customer, place or part is missing stays, with NULL in the columns that come from there.

    No side is broadcast by hint: Spark broadcasts a lookup when its size allows and otherwise
    shuffles both sides, splitting hot keys at run time.
    """
    split_hot_keys(spark)
    columns = list(columns)
    asked = set(columns)
    unknown = asked - set(ALL_COLUMNS)
    if unknown:
        raise ValueError(f"unknown order-line columns: {', '.join(sorted(unknown))}")

    def table(name: str) -> DataFrame:
        return spark.read.schema(_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")

    lines = table("lineitem")
    # Parts before orders: dealt by order last, an order's lines are together for sums and distinct counts per order.
    if asked & _FROM_PART:
        parts = table("part").withColumn("list_cents", _whole("p_retailprice", 100))
        lines = lines.join(parts, lines.l_partkey == parts.p_partkey, "left")
    by_place = asked & (_FROM_NATION | _FROM_REGION)
    by_customer = by_place or asked & _FROM_CUSTOMER
    if by_customer or asked & (_FROM_ORDERS | {"Customer_ID"}):
        orders = table("orders")
        if by_customer:
            customers = table("customer")
            if by_place:
                customers = _with_place(customers, table("nation"), table("region") if "Region" in asked else None)
            # The customer lookup happens at order grain, before the lines multiply it.
            orders = orders.join(customers, orders.o_custkey == customers.c_custkey, "left")
        lines = lines.join(orders, lines.l_orderkey == orders.o_orderkey, "left")

    # Prices and discounts have two decimals (anything else is an error): whole cents times whole percents are
    # exact, and cheaper than decimals until the last step.
    sales = _whole("l_extendedprice", 100) * (F.lit(100) - _whole("l_discount", 100))
    cost = F.lit(2) * F.col("list_cents") * _whole("l_quantity") * F.lit(100)
    definitions = {
        "Order_ID": lambda: F.col("l_orderkey"),
        "Order_Date": lambda: F.col("o_orderdate"),
        "Ship_Date": lambda: F.col("l_shipdate"),
        "Ship_Mode": lambda: F.col("o_orderpriority"),
        "Customer_ID": lambda: F.col("o_custkey"),
        "Customer_Name": lambda: F.col("c_name"),
        "Segment": lambda: F.col("c_mktsegment"),
        "State": lambda: F.col("n_name"),
        "Region": lambda: F.col("r_name"),
        "Category": lambda: F.col("p_type"),
        "Sub_Category": lambda: F.col("p_brand"),
        "Product_ID": lambda: F.col("l_partkey"),
        "Product_Name": lambda: F.col("p_name"),
        "Sales": lambda: _from_ten_thousandths(sales),
        "Quantity": lambda: _whole("l_quantity"),
        "Discount": lambda: F.col("l_discount").cast("decimal(4,2)"),
        # Cost is not in the star schema; twice the list price makes profit straddle zero.
        "Profit": lambda: _from_ten_thousandths(sales - cost),
    }
    return lines.select([definitions[c]().alias(c) for c in columns])


def _whole(name: str, units: int = 1) -> Column:
    """A number as a count of units (1: whole, 100: hundredths). One that is not a whole count is an error."""
    count = F.rint(F.col(name) * units)
    message = F.concat(F.lit(f"{name} has more decimals than expected: "), F.col(name).cast("string"))
    return F.when(count / units == F.col(name), count.cast("bigint")).when(
        F.col(name).isNotNull(), F.raise_error(message).cast("bigint")
    )


def _from_ten_thousandths(units: Column) -> Column:
    return (units.cast("decimal(18,0)") * F.lit(Decimal("0.0001"))).cast(MONEY)


def _with_place(customers: DataFrame, nations: DataFrame, regions: DataFrame | None) -> DataFrame:
    if regions is not None:
        nations = nations.join(regions, nations.n_regionkey == regions.r_regionkey, "left")
    return customers.join(nations, customers.c_nationkey == nations.n_nationkey, "left")
