"""Figures of any selection from the cube are those of the selected lines."""

from __future__ import annotations

from datetime import datetime
from itertools import product

import pytest

from tallyline.operators import sales
from tallyline.operators.cube import selection_cube
from tallyline.operators.filters import filter_orders, selected_rows

from .lines import table

_WAYS = {
    "summary": sales.sales_summary,
    "by_year": sales.sales_by_year,
    "by_category": sales.sales_by_category,
    "by_region": sales.sales_by_region,
    "monthly": sales.monthly_sales_trend,
    "quarterly": sales.quarterly_sales,
    "by_subcategory": sales.sales_by_subcategory,
    "by_state": sales.sales_by_state,
    "selected_rows": selected_rows,
}


@pytest.fixture(scope="module")
def lines(spark):
    """Orders over several categories, customers over several years, a hot order, missing ids and facets."""
    rows = []
    for i in range(240):
        rows.append(
            {
                "Order_ID": None if i % 29 == 0 else "hot" if i % 3 == 0 else f"o{i // 4}",
                "Customer_ID": None if i % 31 == 0 else f"c{i % 17}",
                "Order_Date": datetime(2022 + i % 3, 1 + i % 12, 1),
                "Region": None if i % 23 == 0 else ("West", "East")[i % 2],
                "Category": ("Chairs", "Desks", None)[i % 5 % 3],
                "Segment": ("Home", "Office")[i // 7 % 2],
                "Sub_Category": f"s{i % 6}",
                "State": f"t{i % 4}",
                "Sales": None if i % 13 == 0 else str(i),
                "Profit": str(i % 9 - 4),
            }
        )
    return table(spark, rows).cache()


@pytest.fixture(scope="module")
def cube(lines):
    return selection_cube(lines)


_CHOICES = list(product([(), (2022,), (2022, 2024)], [(), ("West",)], [(), ("Chairs", "Desks")], [(), ("Home",)]))


@pytest.mark.parametrize("chosen", [*_CHOICES[::5], ((1999,), (), (), ())])
def test_every_selection(lines, cube, chosen):
    part, direct = cube.select(*chosen), filter_orders(lines, *chosen)
    for name, way in _WAYS.items():
        assert [tuple(r) for r in getattr(part, name)().collect()] == [tuple(r) for r in way(direct).collect()], name


def test_no_lines(lines):
    empty = selection_cube(lines.limit(0))
    assert empty.summary().collect() == sales.sales_summary(lines.limit(0)).collect()
    assert empty.by_year().count() == 0


def test_numbers_are_dense(cube):
    """One block of numbers holds all ids of a small table."""
    assert cube.orders.select("block").distinct().count() == 1
