from __future__ import annotations

import random
import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from tallyline.llm import minhash
from tallyline.session import FREED

from .rows import AWKWARD, clashing, documents, prose


def brute(rows, size, percent):
    sets = {}
    for i, text in rows:
        sets.setdefault(i, []).append(minhash.shingles(minhash.words(text), size))
    at = {i: i for i in sets}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            for x in sets[a]:
                for y in sets[b]:
                    if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                        p, q = sorted((root(a), root(b)))
                        at[q] = p
    return {i: root(i) for i in ids}


def near_copies():
    """A graded group: copies of one text, each with more or fewer words changed, besides unrelated ones."""
    draw = random.Random(11)
    rows = [(i, t) for i, t in enumerate(prose(3, 30))]
    base = rows[4][1].split()
    for i in range(60):
        copy = list(base)
        for _ in range(draw.randint(0, 9)):
            copy[draw.randrange(len(copy))] = f"new{draw.random()}"
        rows.append((100 + i, " ".join(copy)))
    for i in range(25):
        rows.append((300 + i, rows[7][1].upper()))
    return rows


def test_components_are_brute_forces(spark):
    rows = near_copies()
    for size in (2, 5):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, size=size).collect()}
        expected = brute(rows, size, 80)
        assert {i: r["component_id"] for i, r in got.items()} == expected
        assert all(r["kept"] == (i == expected[i]) for i, r in got.items())
        assert all(r["n_shingles"] == len(minhash.shingles(minhash.words(dict(rows)[i]), size)) for i, r in got.items())


def test_estimate_is_close(spark):
    draw = np.random.Generator(np.random.PCG64(1))
    rows = []
    for share in (0.2, 0.5, 0.8, 1.0):
        for _ in range(20):
            n = int(400 * share)
            common = draw.integers(0, 1 << 63, n, dtype=np.uint64)
            sides = [np.concatenate([common, draw.integers(0, 1 << 63, (400 - n) // 2, dtype=np.uint64)]) for _ in range(2)]
            rows.append((share, *(minhash.packed(minhash.minima(s)).tolist() for s in sides)))
    table = spark.createDataFrame(rows, "share double, a array<long>, b array<long>")
    got = table.groupBy("share").agg(
        F.avg(minhash.estimate(F.col("a"), F.col("b"))).alias("mean"),
        F.max(F.abs(minhash.estimate(F.col("a"), F.col("b")) - F.col("share"))).alias("worst"),
    )
    for r in got.collect():
        assert abs(r["mean"] - r["share"]) < 0.03 and r["worst"] < minhash.MARGIN


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (3, 1)]
    got = {r["id"]: r["component"] for r in minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(2, 41)) and all(got[i] == 100 for i in range(101, 130))


def test_awkward_rows(spark):
    docs = clashing(documents(spark), "kept", "sig", "id")
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(AWKWARD)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[6]["component_id"] == 1 and by_id[1]["kept"] and not by_id[6]["kept"]
    assert by_id[2]["n_shingles"] == 0 and by_id[2]["component_id"] == 2 and by_id[2]["kept"]
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert by_id[8]["n_shingles"] == 1
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def near_miss_group(n, words=120, own=18):
    """Copies that differ from each other in their own words: similar, but all below the threshold."""
    draw = random.Random(11)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for at in draw.sample(range(words // own), own // 3):
            text[at * own : at * own + 1] = [f"own{i}x{at}"]
        for at in draw.sample(range(words), 3):
            text[at] = f"own{i}y{at}"
        rows.append((i, " ".join(text)))
    return rows


def test_a_group_of_near_misses_makes_few_pairs(spark):
    made = {}
    for n in (100, 200):
        docs = spark.createDataFrame(near_miss_group(n), "id long, text string").withColumn("component", F.col("id"))
        pairs = {tuple(r) for r in minhash.meeting(docs, 2, 80).collect()}
        texts = {r["id"]: minhash.shingles(minhash.words(r["text"]), 2) for r in docs.collect()}
        linked = {(a, b) for a in texts for b in texts if a < b and 100 * len(texts[a] & texts[b]) >= 80 * len(texts[a] | texts[b])}
        assert linked <= pairs
        made[n] = len(pairs) - len(linked)
    assert made[200] <= 4 * 200


def test_meeting_is_complete(spark):
    draw = random.Random(12)
    stock = [f"s{i}" for i in range(60)]
    bases = [[draw.choice(stock) for _ in range(draw.randint(3, 60))] for _ in range(12)]
    rows = []
    for i in range(160):
        text = list(draw.choice(bases))
        for _ in range(draw.randint(0, 4)):
            text[draw.randrange(len(text))] = draw.choice([*stock, f"own{i}"])
        rows.append((i, " ".join(text[: draw.randint(max(1, len(text) - 4), len(text))]), i % 7 if i % 3 else i + 100))
    docs = spark.createDataFrame(rows, "id long, text string, component long")
    pairs = {tuple(r) for r in minhash.meeting(docs, 2, 80).collect()}
    sets = {i: (minhash.shingles(minhash.words(t), 2), c) for i, t, c in rows}
    linked = {
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a][1] != sets[b][1] and 100 * len(sets[a][0] & sets[b][0]) >= 80 * len(sets[a][0] | sets[b][0])
    }
    assert linked and linked <= pairs


def test_repeated_ids_are_judged_by_their_texts(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (2, "another text of a few words only here")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, size=2).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (2, 2, True)]


def test_steps_leave_no_shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    folders = [Path(d.getPath()) for d in env.blockManager().diskBlockManager().localDirs()]

    def files():
        return {f.name for d in folders for f in d.rglob("shuffle_*.data")}

    rows = spark.createDataFrame(near_copies(), "doc_id long, text string").repartition(3)
    setting, before = spark.conf.get(FREED, None), files()
    found = minhash.near_duplicates(rows, size=2)
    until = time.time() + 20
    while files() - before and time.time() < until:  # they go in the background
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(FREED, None) == setting
    # The result itself can be carried out again.
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, found.collect()))


def test_links_that_join_nothing_cost_no_rounds(spark):
    context = spark.sparkContext
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "id long, component long")

    def stages(name, links):
        context.setJobGroup(name, name)
        try:
            got = minhash.joined(labels, spark.createDataFrame(links, "a long, b long"))
        finally:
            context._jsc.clearJobGroup()
        tracker = context.statusTracker()
        # Jobs are heard of in the background.
        context._jsc.sc().listenerBus().waitUntilEmpty()
        made = sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(name))
        return made, {tuple(r) for r in got.collect()}

    none, same = stages("links within a component", [(1, 1)])
    some, changed = stages("one link", [(1, 3)])
    assert same == {(1, 1), (2, 1), (3, 3)} and changed == {(1, 1), (2, 1), (3, 1)}
    assert none <= 3 < some
