from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyline.operators.cleaning import clean_orders
from tallyline.plans import jobs
from tallyline.sources import files, relation
from tallyline.sources.star import ALL_COLUMNS, order_lines
from registry.inputs import raw_orders

from .lines import table


@pytest.fixture(scope="module")
def raw_rows(spark, folder):
    return raw_orders(spark, folder).limit(50).cache()


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_load_raw(spark, raw_rows, tmp_path, kind):
    path = str(tmp_path / f"orders.{kind}")
    writer = raw_rows.write.option("header", True)
    getattr(writer, kind)(path)
    loaded = files.load_raw_orders(spark, path)
    assert set(raw_rows.columns) <= set(loaded.columns)
    expected = clean_orders(raw_rows).select("Order_ID", "Sales", "Order_Date").collect()
    got = clean_orders(loaded).select("Order_ID", "Sales", "Order_Date").collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == sorted((str(r[0]), r[1], r[2]) for r in expected)


def test_first_existing_location_wins(spark, raw_rows, tmp_path):
    here = str(tmp_path / "b.parquet")
    raw_rows.write.parquet(here)
    found = files.load_raw_orders(spark, locations=[str(tmp_path / "a.parquet"), here])
    assert found.count() == raw_rows.count()


def test_missing_data_lists_what_was_searched(spark, tmp_path):
    with pytest.raises(FileNotFoundError) as error:
        files.load_raw_orders(spark, locations=[str(tmp_path / "x.parquet"), str(tmp_path / "y.csv")])
    assert "x.parquet" in str(error.value) and "y.csv" in str(error.value)
    assert len(files.RAW_LOCATIONS) == 6


def test_missing_returns_are_empty(spark, tmp_path):
    found = files.load_returns(spark, str(tmp_path / "none.parquet"))
    assert found.columns == ["Returned", "Order ID"] and found.count() == 0


def test_processed_is_built_once(spark, tmp_path):
    path = str(tmp_path / "processed")
    calls = []

    def build():
        calls.append(1)
        return table(spark, [{}, {"Order_ID": "o2"}])

    assert files.load_processed(spark, path, build).count() == 2
    assert files.load_processed(spark, path, build).count() == 2
    assert len(calls) == 1


def test_published_table_is_bucketed(spark, tmp_path):
    stored = relation.publish_table(table(spark, [{"Order_ID": f"o{i}"} for i in range(9)]), "stored_orders", buckets=2)
    assert relation.row_count(stored).first()["n"] == 9
    plan = stored.groupBy("Order_ID").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("DROP TABLE stored_orders")


def test_order_lines_keep_every_line(spark, folder):
    n = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    assert order_lines(spark, folder).count() == n
    assert order_lines(spark, folder, ["State", "Sales"]).columns == ["State", "Sales"]
    with pytest.raises(ValueError, match="unknown"):
        order_lines(spark, folder, ["Colour"])


def test_lookups_not_asked_for_are_not_read(spark, folder):
    plan = order_lines(spark, folder, ["Sales", "Category"])._jdf.queryExecution().executedPlan().toString()
    assert "part.parquet" in plan and "orders.parquet" not in plan and "customer.parquet" not in plan
    assert len(ALL_COLUMNS) == 17


def test_whole_run(spark, folder, tmp_path):
    result = jobs.run_all(spark, raw_orders(spark, folder), str(tmp_path / "p"), str(tmp_path / "report"))
    assert not result.failed_queries
    assert result.audit.first()["rows_out"] == result.lines.count()
    written = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "report")).collect())
    row = result.report.first()
    assert row["mode"] == "template"
    assert sorted(written.split("\n")) == sorted(row["report"].split("\n"))


def test_json_keeps_every_column(spark, tmp_path):
    lines = ['{"Order ID": "a", "Sales": 5.5, "Extra": 7}', '{"Order ID": "b", "Sales": 6, "Extra": 8}']
    (tmp_path / "orders.json").write_text("\n".join(lines))
    found = files.load_raw_orders(spark, str(tmp_path / "orders.json"))
    assert {(r["Order ID"], r["Sales"], r["Extra"]) for r in found.collect()} == {("a", "5.5", "7"), ("b", "6", "8")}
    (tmp_path / "returns.json").write_text('{"Returned": "Yes", "Order ID": "a", "Reason": "torn"}')
    returned = files.load_returns(spark, str(tmp_path / "returns.json"))
    assert returned.first().asDict() == {"Returned": "Yes", "Order ID": "a", "Reason": "torn"}


def test_half_written_table_is_built_again(spark, tmp_path):
    path = tmp_path / "processed"
    table(spark, [{}]).write.parquet(str(path))
    (path / "_SUCCESS").unlink()
    assert files.load_processed(spark, str(path), lambda: table(spark, [{}, {"Order_ID": "o2"}])).count() == 2


def test_lines_without_an_order_stay(spark, folder, tmp_path):
    for name in ("orders", "customer", "nation", "region", "part"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").limit(3)
    orphan = lines.limit(1).withColumns({"l_orderkey": F.lit(-1).cast("bigint"), "l_partkey": F.lit(-1).cast("bigint")})
    lines.unionByName(orphan).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = order_lines(spark, str(tmp_path)).filter("Order_ID = -1").collect()
    assert len(found) == 1 and found[0]["Sales"] is not None
    assert found[0]["Order_Date"] is None and found[0]["Category"] is None and found[0]["Profit"] is None


def test_prices_with_more_decimals_are_an_error(spark, folder, tmp_path):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").limit(1).withColumn("l_extendedprice", F.lit(1.234))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    with pytest.raises(Exception, match="more decimals"):
        order_lines(spark, str(tmp_path), ["Sales"]).collect()


def test_whole_run_with_other_dates_and_relation(spark, folder, tmp_path):
    rows = raw_orders(spark, folder).withColumn("Order Date", F.date_format("Order Date", "d.M.yyyy"))
    result = jobs.run_all(spark, rows, str(tmp_path / "p"), forest=False, date_formats=["d.M.yyyy"], relation="elsewhere")
    assert result.lines.count() == rows.count() and not result.failed_queries
    assert spark.catalog.tableExists("elsewhere")


def test_tables_are_read_once(spark, folder):
    from registry.queries import QUERIES

    # Duplicates take two readings: fingerprints first, then only repeated rows whole.
    for name in ("d1_product_kpis", "d6_top_and_worst", "p11_histogram_profit"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("l_orderkey#") + plan.count("l_extendedprice#") > 0
        assert plan.count("Relation [l_orderkey") == 1, name
