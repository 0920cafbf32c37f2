"""Lookups in the clustered relation read few row groups."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyline.operators.features import calendar_features
from tallyline.sources import relation
from tallyline.sources.star import order_lines


def _rows_scanned(df):
    """The rows that reach the filter: those of the row groups that were not skipped."""
    found = df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return found, scan.metrics().get("numOutputRows").get().value()


@pytest.fixture(scope="module")
def clustered(spark, folder, tmp_path_factory):
    lines = calendar_features(order_lines(spark, folder, ["Order_ID", "Order_Date", "Customer_ID", "Sales"]))
    path = str(tmp_path_factory.mktemp("clustered") / "t")
    return relation.publish_clustered(lines, path, "clustered_orders", row_group_bytes=16 << 10)


def test_lookups_skip_row_groups(clustered):
    every = clustered.select("Order_ID", "Customer_ID", "Order_Date").collect()
    some = every[len(every) // 2]
    for column, chosen in (("Order_ID", {"orders": [some[0]]}), ("Order_Date", {"dates": [some[2]]})):
        found, scanned = _rows_scanned(relation.lookup(clustered, **chosen))
        assert len(found) == sum(r[column] == some[column] for r in every) > 0
        assert scanned < len(every) / 2, column
    found, _ = _rows_scanned(relation.lookup(clustered, customers=[some[1]]))
    assert len(found) == sum(r["Customer_ID"] == some[1] for r in every)


def test_an_absent_order_reads_nothing(clustered):
    """It lies between smallest and largest, so only a Bloom filter or a dictionary can tell."""
    known = {r[0] for r in clustered.select("Order_ID").distinct().collect()}
    absent = next(i for i in range(min(known), max(known)) if i not in known)
    found, scanned = _rows_scanned(relation.lookup(clustered, orders=[absent]))
    assert found == [] and scanned == 0


def test_a_hot_order_is_split(spark, folder, tmp_path):
    lines = order_lines(spark, folder, ["Order_ID", "Order_Date", "Customer_ID", "Sales", "Product_ID"])
    first = lines.agg(F.min("Order_Date")).first()[0]
    hot = lines.withColumns({"Order_ID": F.lit(1).cast("bigint"), "Order_Date": F.lit(first)})
    # Small neighbouring partitions would be merged again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = relation.publish_clustered(hot, str(tmp_path / "hot"), "hot_orders")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert stored.select(F.input_file_name()).distinct().count() > 1
