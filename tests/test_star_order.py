"""Lines are dealt by order last, so that an order's lines are together for what is summed per order."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tallyline.sources.star import order_lines


def test_an_orders_lines_are_together(spark, tmp_path):
    day = datetime(2024, 1, 1)
    rows = {
        "lineitem": ([(o, (o * 7 + n) % 40, 1.0, 2.0, 0.0, day) for o in range(50) for n in range(4)],
                     "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz"),
        "orders": ([(o, o, day, "1") for o in range(50)], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string"),
        "part": ([(p, "n", "b", "t", 1.0) for p in range(40)], "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double"),
    }
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = order_lines(spark, str(tmp_path), ["Order_ID", "Order_Date", "Category"]).withColumn("at", F.spark_partition_id())
        places = lines.groupBy("Order_ID").agg(F.count_distinct("at").alias("places"), F.count("*").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(places) == 50 and {(r["places"], r["n"]) for r in places} == {(1, 4)}
