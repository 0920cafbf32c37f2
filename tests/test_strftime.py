"""Date codes in SQL, beside the C library's."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from tallyline.sources import strftime

MOMENTS = [datetime(2019, 12, 28, 23, 59, 58) + timedelta(days=i, hours=7 * i) for i in range(0, 800, 13)] + [
    datetime(2021, 1, 3), datetime(2024, 2, 29, 12), datetime(2023, 1, 1, 0, 30), datetime(2024, 12, 30, 11, 1, 1)
]


@pytest.fixture(scope="module")
def moments(spark):
    strftime.register(spark)
    spark.createDataFrame([(m,) for m in MOMENTS] + [(None,)], "m timestamp_ntz").createOrReplaceTempView("moments")
    return spark


def texts(spark, codes):
    given = codes.replace("\\", "\\\\").replace("'", "\\'")
    return [r[0] for r in spark.sql(f"SELECT strftime('{given}', m) FROM moments").collect()]


@pytest.mark.parametrize(
    "codes",
    ["%Y-%m", "Q%m", "%y", "%j", "%W", "%U", "%V", "%G", "%g", "%u", "%w", "%a %A", "%b %B", "%I:%M %p", "%H%M%S", "%F %T", "%R", "%D", "%e|%k|%l",
     "plain", "it's %d o'clock", "''%d''", "%%%d%%", "%d%%x%%%%", "[%Y] {%m} #%d", "%Y\n%m", "\\%Y", "é%m中", "%Y'%W'%%"],
)
def test_like_the_c_library(moments, codes):
    assert texts(moments, codes) == [m.strftime(codes) for m in MOMENTS] + [None]


def test_other_codes(moments):
    assert texts(moments, "%s")[0] == str(int((MOMENTS[0] - datetime(1970, 1, 1)).total_seconds()))
    assert texts(moments, "%f")[0] == "58.000"
    assert texts(moments, "%P")[:1] == ["pm"]
    days = 2440587.5 + (MOMENTS[0] - datetime(1970, 1, 1)) / timedelta(days=1)
    assert abs(float(texts(moments, "%J")[0]) - days) < 1e-6


@pytest.mark.parametrize("codes", ["%", "%Q", "%Y%", "%W%Q", "%_"])
def test_unknown_codes_are_null(moments, codes):
    assert set(texts(moments, codes)) == {None}


def test_empty_format_and_codes_from_a_column(moments):
    assert texts(moments, "") == [""] * len(MOMENTS) + [None]
    got = moments.sql("SELECT strftime(c, m) FROM moments JOIN VALUES ('%Y'), ('week %W') AS t(c)").collect()
    assert len(got) == 2 * (len(MOMENTS) + 1) and {r[0] for r in got} >= {MOMENTS[0].strftime("week %W"), MOMENTS[0].strftime("%Y")}


def test_a_constant_format_is_one_pattern(moments):
    plan = moments.sql("SELECT strftime('Q%m of %Y', m) FROM moments")._jdf.queryExecution().optimizedPlan().toString()
    assert "date_format" in plan and "transform" not in plan and "regexp" not in plan
