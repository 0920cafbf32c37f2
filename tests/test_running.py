"""Reports side by side: what fails, and what the others then have."""

from __future__ import annotations

import pytest

from tallyline.plans import catalogue
from tallyline.plans.running import run_reports
from tallyline.sources import relation

from .lines import table

GOOD = "SELECT Category, SUM(Quantity) AS n FROM some_orders GROUP BY Category ORDER BY n DESC, Category"


@pytest.fixture(scope="module")
def published(spark):
    rows = [{"Order_ID": f"o{i}", "Category": f"c{i % 3}", "Quantity": i} for i in range(12)]
    return relation.publish(table(spark, rows), "some_orders")


def test_failures_leave_the_others_alone(spark, published, tmp_path):
    reports = {
        "first": GOOD,
        "unplanned": "SELECT nothing FROM some_orders",
        "while_running": "SELECT 1 DIV (SUM(Quantity) - SUM(Quantity)) AS x FROM some_orders",
        "raised": "SELECT raise_error(concat('row ', Order_ID)) AS x FROM some_orders",
        "last": "SELECT COUNT(*) AS n FROM some_orders",
    }
    found = run_reports(spark, reports, str(tmp_path / "r"), at_once=3)
    assert list(found) == list(reports)
    assert {n for n, o in found.items() if o.error} == {"unplanned", "while_running", "raised"}
    assert "DIVIDE_BY_ZERO" in found["while_running"].error and "nothing" in found["unplanned"].error
    assert "row o" in found["raised"].error
    assert found["last"].result.first()["n"] == 12
    assert all(found[n].result is None for n in ("unplanned", "while_running", "raised"))
    assert not (tmp_path / "r" / "2" / "_SUCCESS").exists()


def test_a_report_that_takes_too_long_is_cancelled(spark, published, tmp_path):
    reports = {"endless": "SELECT SUM(a.id % 7) AS n FROM range(0, 1000000000000000, 1, 2) a", "short": GOOD}
    found = run_reports(spark, reports, str(tmp_path / "r"), seconds=20)
    assert "20 seconds" in found["endless"].error and found["endless"].seconds < 60
    assert found["short"].result.count() == 3
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_one_at_a_time_and_none(spark, published, tmp_path):
    assert run_reports(spark, {}, str(tmp_path / "none")) == {}
    found = run_reports(spark, {"a": GOOD, "b": GOOD}, str(tmp_path / "r"), at_once=1)
    assert [o.result.count() for o in found.values()] == [3, 3]


def test_results_keep_their_order(spark, published):
    results, failed = catalogue.run_all_business_queries(spark, {"sums": GOOD}, "some_orders")
    assert not failed and [r["Category"] for r in results["sums"].collect()] == ["c2", "c1", "c0"]
    assert catalogue.result_order(catalogue.BUSINESS_QUERIES["state_profitability"]) == "Total_Sales DESC, State, Region"


def test_relation_has_to_be_there(spark):
    with pytest.raises(LookupError):
        catalogue.run_all_business_queries(spark, relation="not_published")
