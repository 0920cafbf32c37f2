"""Quartile scores and order statistics against pandas and numpy on random inputs."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tallyline.functions.ranks import exact_quantiles
from tallyline.operators import customers, profiling
from tallyline.schema import CUSTOMER


def expected_scores(values: pd.Series) -> pd.Series:
    try:
        return pd.qcut(values, q=4, labels=[1, 2, 3, 4]).astype(int)
    except ValueError:
        return pd.qcut(values.rank(method="first"), q=4, labels=[1, 2, 3, 4]).astype(int)


def base_of(spark, recency, frequency, monetary):
    n = len(recency)
    names = [f"c{i:04d}" for i in range(n)]
    rows = [
        (names[i], f"name {i % 7}", "s", int(recency[i]), int(frequency[i]), float(monetary[i])) for i in range(n)
    ]
    order = np.random.default_rng(n).permutation(n)
    schema = "Customer_ID string, Customer_Name string, Segment string, Recency int, Frequency bigint, Monetary double"
    return spark.createDataFrame([rows[i] for i in order], schema)


def check(spark, recency, frequency, monetary):
    base = base_of(spark, recency, frequency, monetary)
    got = customers.score_rfm(base).orderBy(*CUSTOMER).collect()
    r = expected_scores(pd.Series(recency))
    assert [g["R_Score"] for g in got] == (5 - r).tolist()
    assert [g["F_Score"] for g in got] == expected_scores(pd.Series(frequency)).tolist()
    assert [g["M_Score"] for g in got] == expected_scores(pd.Series(monetary)).tolist()


@pytest.mark.parametrize("n", [2, 3, 5, 6, 41, 250])
def test_scores_match_qcut(spark, n):
    rng = np.random.default_rng(n)
    check(
        spark,
        rng.integers(1, 400, n),
        rng.integers(1, 4, n),  # few values: edges coincide and ranks decide
        np.round(rng.lognormal(5, 1, n), 2),
    )


def test_third_of_customers_share_one_value(spark):
    rng = np.random.default_rng(7)
    n = 300
    recency = np.where(np.arange(n) % 3 == 0, 30, rng.integers(1, 500, n))
    monetary = np.where(np.arange(n) % 3 == 0, 99.5, np.round(rng.normal(100, 30, n), 2))
    check(spark, recency, np.ones(n, dtype=int), monetary)


def test_one_customer_cannot_be_scored(spark):
    with pytest.raises(ValueError, match="at least two"):
        customers.score_rfm(base_of(spark, [1], [1], [1.0]))


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(3)
    a = np.where(rng.random(500) < 0.34, 5.0, np.round(rng.normal(0, 10, 500), 1))
    b = rng.random(500)
    rows = [(float(x), float(y) if i % 4 else None) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double")
    got = {r["metric"]: r for r in exact_quantiles(df, ["a", "b"], (0, 0.1, 0.25, 0.5, 0.75, 1)).collect()}
    present = np.array([y for _, y in rows if y is not None])
    for name, values in (("a", a), ("b", present)):
        assert got[name]["n"] == len(values)
        np.testing.assert_allclose(got[name]["quantiles"], np.quantile(values, [0, 0.1, 0.25, 0.5, 0.75, 1]), rtol=1e-12)


def test_describe_matches_pandas(spark):
    pdf = pd.DataFrame({"x": [1.0, 2.0, 2.0, None, 10.0], "y": [3, 3, 3, 3, 3], "z": [None] * 5})
    rows = [(None if pd.isna(x) else x, int(y), None) for x, y, _ in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "x double, y int, z double")
    got = {r["metric"]: r for r in profiling.describe_numeric(df).collect()}
    for name in ("x", "y"):
        d = pdf[name].describe()
        found = [got[name][k] for k in ("n", "mean", "std", "min", "p25", "p50", "p75", "max")]
        np.testing.assert_allclose(found, d.to_numpy(), rtol=1e-12)
    assert got["z"]["n"] == 0 and got["z"]["mean"] is None and got["z"]["p50"] is None


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(5)
    for values in (rng.normal(0, 3, 400), np.arange(0, 1.01, 0.05), np.array([0.1, 0.2, 0.3, 0.7, 0.7]), np.full(9, 4.0)):
        for bins in (1, 7, 20):
            df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
            got = profiling.histogram(df, "v", bins).orderBy("bin").collect()
            counts, edges = np.histogram(values, bins=bins)
            assert [g["count"] for g in got] == counts.tolist()
            np.testing.assert_allclose([g["lower"] for g in got], edges[:-1], atol=1e-12)
            np.testing.assert_allclose([g["upper"] for g in got], edges[1:], atol=1e-12)
