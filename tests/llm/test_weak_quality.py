from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tallyline.llm import weak_quality

from .rows import AWKWARD, clashing, documents


def test_label_model_recovers_accuracies():
    draw = np.random.Generator(np.random.PCG64(3))
    truth = (draw.random(20_000) < 0.8).astype(int)
    right, spoken = np.array([0.95, 0.85, 0.75, 0.9]), np.array([0.9, 0.8, 0.9, 0.5])
    votes = np.where(draw.random((20_000, 4)) < right, truth[:, None], 1 - truth[:, None])
    votes = np.where(draw.random((20_000, 4)) < spoken, votes, weak_quality.NOTHING)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = weak_quality.fit_label_model(patterns, counts.astype(float), rounds=500)
    assert np.abs(model.accuracies() - right).max() < 0.03
    assert abs(model.prior[weak_quality.GOOD] - 0.8) < 0.02


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    # No label is used in the fit.
    got = weak_quality.score(docs, weak_quality.fit(docs)).join(labels, "doc_id")
    n = {(r["quality"], r["kept"]): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    good, bad = n.get((1, True), 0) + n.get((1, False), 0), n.get((0, True), 0) + n.get((0, False), 0)
    assert n.get((1, True), 0) / good > 0.97 and n.get((0, False), 0) / bad > 0.75


def test_sample_is_bounded_and_stable(spark):
    rows = [(i, f"Some words of text number {i} and more of it.", "en") for i in range(300)]
    docs = documents(spark, rows)
    one = weak_quality.fit(docs.coalesce(1), sample_rows=50)
    two = weak_quality.fit(docs.repartition(6), sample_rows=50)
    assert np.allclose(one.weights, two.weights) and np.allclose(one.labels.chances, two.labels.chances)


def test_scorer_learns_soft_targets():
    draw = random.Random(5)
    keys = [np.array([draw.choice([1, 2]) if i % 2 else draw.choice([3, 4]), 9]) for i in range(400)]
    weights = weak_quality.fit_scorer(keys, [np.array([1.0, 1.0])] * 400, np.array([0.9 if i % 2 else 0.1 for i in range(400)]))
    good = 1 / (1 + np.exp(-(weights[1] + weights[9] + weights[-1])))
    assert 0.8 < good < 0.95


def test_awkward_and_empty(spark):
    docs = clashing(documents(spark), "kept", "votes", "score")
    got = weak_quality.score(docs, weak_quality.fit(docs)).collect()
    assert len(got) == len(AWKWARD)
    assert all(r["score"] == 0 and not r["kept"] for r in got if not (r["text"] or "").strip())
    empty = documents(spark, [])
    assert weak_quality.score(empty, weak_quality.fit(empty)).agg(F.count("*")).first()[0] == 0
