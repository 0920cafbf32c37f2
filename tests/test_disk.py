"""What steps leave on disk."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tallyline.plans.running import run_reports
from tallyline.session import cut_lineage


def shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    found = manager.getAllFiles()
    return {str(found.apply(i).getName()) for i in range(found.size()) if str(found.apply(i).getName()).startswith("shuffle_")}


def test_cut_lineage_leaves_no_shuffle_files(spark, tmp_path):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
    before = shuffle_files(spark)
    kept, stored = cut_lineage(df), cut_lineage(df, str(tmp_path / "kept"))
    assert not shuffle_files(spark) - before
    assert sorted(kept.collect()) == sorted(stored.collect()) == sorted(df.collect())


def test_kept_columns_have_their_types(spark, tmp_path):
    row = (1, "x", datetime(2024, 1, 1), None)
    df = spark.createDataFrame([row], "a long, `b.c` string, d timestamp_ntz, e decimal(18,4)")
    stored = cut_lineage(df, str(tmp_path / "kept"))
    assert stored.dtypes == df.dtypes and [tuple(r) for r in stored.collect()] == [row]


def test_reports_leave_no_shuffle_files(spark, tmp_path):
    before = shuffle_files(spark)
    outcome = run_reports(spark, {"r": "SELECT id % 3 AS k, COUNT(*) AS n FROM range(100) GROUP BY id % 3"}, str(tmp_path))["r"]
    assert not shuffle_files(spark) - before
    assert outcome.error is None and outcome.result.count() == 3
