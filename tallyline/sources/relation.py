"""Publishing the order lines for SQL and running SQL over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import strftime

RELATION = "orders"
#: Columns by which lines are looked up.
LOOKUPS = ("Order_ID", "Customer_ID", "Order_Date")
DAY = "Order_Day"


def publish(df: DataFrame, name: str = RELATION) -> DataFrame:
    """Make ``df`` the relation ``name``, replacing an older one, and return it as that relation."""
    df.createOrReplaceTempView(name)
    strftime.register(df.sparkSession)
    return df.sparkSession.table(name)


def publish_table(df: DataFrame, name: str = RELATION, buckets: int | None = None) -> DataFrame:
    """Store the relation as a table.

    Bucketing by order lets later per-order work skip its shuffle. A bucket is read by one task, so leave
    ``buckets`` out where a single order may hold a large share of the lines.
    """
    writer = df.write.mode("overwrite").format("parquet")
    if buckets:
        writer = writer.bucketBy(buckets, "Order_ID").sortBy("Order_ID")
    writer.saveAsTable(name)
    strftime.register(df.sparkSession)
    return df.sparkSession.table(name)


def publish_clustered(df: DataFrame, path: str, name: str = RELATION, row_group_bytes: int | None = None) -> DataFrame:
    """Store the relation below ``path`` so that lookups by order, customer or date read few row groups.

    Lines are sorted by date, and an order's are neighbours, so minima and maxima tell which row groups hold a day;
    Bloom filters tell it for orders and customers. The ranges are drawn over whole rows, so a date or an order with
    a large share of the lines is split. The day is a further column, as Spark's Parquet scan skips nothing by
    timestamps without a time zone.
    """
    order = ["Order_Date", "Order_ID"]
    df = df.withColumn(DAY, F.to_date("Order_Date"))
    dealt = df.repartitionByRange(*order, F.xxhash64(*df.columns)).sortWithinPartitions(*order)
    writer = dealt.write.mode("overwrite").format("parquet").option("path", path)
    for column in ("Order_ID", "Customer_ID"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", str(row_group_bytes))
    writer.saveAsTable(name)
    strftime.register(df.sparkSession)
    return df.sparkSession.table(name)


def lookup(df: DataFrame, orders: Sequence = (), customers: Sequence = (), dates: Sequence = ()) -> DataFrame:
    """The lines of given orders, customers and dates; an empty choice means all."""
    for column, wanted in zip(LOOKUPS, (orders, customers, dates), strict=True):
        if wanted:
            df = df.filter(F.col(column).isin(list(wanted)))
    if dates and DAY in df.columns:
        df = df.filter(F.col(DAY).isin([F.lit(d).cast("date") for d in dates]))
    return df


def row_count(df: DataFrame) -> DataFrame:
    """One row with the number of published lines."""
    return df.groupBy().count().withColumnRenamed("count", "n")


def run_query(spark: SparkSession, sql: str, relation: str = RELATION) -> DataFrame:
    """Run ad-hoc SQL over the published relation."""
    if not spark.catalog.tableExists(relation):
        raise LookupError(f"relation {relation} does not exist; publish the order lines first")
    return spark.sql(sql)
