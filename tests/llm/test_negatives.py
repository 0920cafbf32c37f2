from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, anchor int"


def brute(rows, every=3, positives=5, most=10):
    usable = [
        (i, [min(max(math.floor(256 * float(np.float32(x))), -negatives.LIMIT), negatives.LIMIT) for x in v], label)
        for i, v, label, *_ in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for at, (i, v, label) in enumerate(usable):
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, other) for k, (j, w, other) in enumerate(usable) if k != at)
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            window = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:most]
            out += [(i, pid, rank, nid, -p, -s) for rank, (s, nid, _) in enumerate(window, 1)]
    return sorted(out)


def found(spark, rows, every=3):
    df = spark.createDataFrame(rows, SCHEMA)
    got = negatives.hard_negatives(df, F.col("vec_id") % every == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def drawn(seed, n, dims=12, labels=3):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(labels, dims))
    return [
        (i, [float(x) for x in (centres[i % labels] * 0.4 + draw.normal(size=dims) * 0.5).astype(np.float32)], i % labels, "x", 1)
        for i in range(n)
    ]


@pytest.fixture
def small(monkeypatch):
    """Several blocks and groups on a small table."""
    for name, value in (("BLOCK_ROWS", 16), ("ANCHORS", 8), ("BLOCKS", 2), ("STEP", 3)):
        monkeypatch.setattr(negatives, name, value)


def test_against_brute_force(spark):
    rows = drawn(1, 150)
    assert found(spark, rows) == brute(rows)


def test_many_groups(spark, small):
    rows = drawn(2, 130)
    assert found(spark, rows) == brute(rows)


def test_awkward_rows(spark, small):
    rows = drawn(3, 40, dims=4)
    rows += [(100, None, 1, "", 0), (101, [0.1, None], 1, "", 0), (102, [float("nan")], 1, "", 0), (103, [float("inf")], 0, "", 0)]
    rows += [(105, [0.5] * 4, None, "", 0), (None, [0.5] * 4, 1, "", 0), (108, [], 1, "", 0), (111, [0.7], 2, "", 0), (114, [1e30, -1e30], 2, "", 0)]
    assert found(spark, rows) == brute(rows)


def test_ties_and_repeated_rows(spark, small):
    rows = [(i, [1.0, 0.5], i % 2, "", 0) for i in range(12)] + [(3, [1.0, 0.5], 1, "", 0)] * 3 + [(6, [0.7, 0.1], 0, "", 0)] * 2
    rows += [(20 + i, [0.6, 0.2], i % 2, "", 0) for i in range(14)]
    assert found(spark, rows) == brute(rows)


def test_one_label_holds_most_rows(spark, small):
    rows = [(i, v, 0 if i % 10 else 1, a, b) for i, v, _, a, b in drawn(5, 120, dims=6)]
    assert found(spark, rows) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1, "", 0)]) == []


def test_bounds_shrink_the_candidates():
    """With a few large components, most rows leave before the last column."""
    rows = drawn(4, 600, dims=40)
    columns = np.array([r[1] for r in rows]) * 256 * (0.8 ** np.arange(40))
    labels = np.zeros(len(rows), np.int64)
    ids = np.arange(len(rows), dtype=np.int64)
    block = negatives.Block(
        {"uids": ids.tobytes(), "ids": ids.tobytes(), "labels": labels.tobytes(), "scores": b"",
         "columns": np.ascontiguousarray(columns.T, np.int32).tobytes()}
    )
    anchor = negatives.Anchor(block, 0, [(-(1 << 62), 1 << 62)], 5)
    kept, left = anchor._possible, []

    def counted(*bounds):
        keep = kept(*bounds)
        left.append(int(keep.sum()))
        return keep

    anchor._possible = counted
    anchor.look(block, True)
    assert left[-1] == 5 and left[1] < 100 and sorted(left, reverse=True) == left
    del left[:]
    anchor.look(block, True)
    assert left[0] < 300
