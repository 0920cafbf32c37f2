from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from tallyline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
NAMES = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes):
    """The root of nodes and each node's path of (siblings) with sides."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for i, place in enumerate(at):
            other = place ^ 1
            paths[i].append((("L" if place & 1 else "R") + level[other]) if other < len(level) else "-")
        level = [H(*level[k : k + 2]) for k in range(0, len(level), 2)]
        at = [p // 2 for p in at]
    return level[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r[0]))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = climb([x[2] for x in groups[g]])
    if not order:
        return []
    root, tops = climb([trees[g][0] for g in order])
    return sorted(
        (str(x[3]), str(g), x[2], trees[g][0], root, path + tops[k])
        for k, g in enumerate(order)
        for x, path in zip(groups[g], trees[g][1])
    )


def found(spark, rows, **given):
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), **given).withColumn("again", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert all(r["again"] == r["root"] and r["altered_leaf"] is None for r in got)
    return sorted((str(r["id"]), str(r["grp"]), r["leaf"], r["subroot"], r["root"], list(r["proof"])) for r in got)


def rows_of(n, langs=("en", "de", None, "é", "z"), seed=1):
    draw = random.Random(seed)
    ids = draw.sample(range(-3 * n, 100 * n), n)
    return [(i, draw.choice(["a", None, ""]), draw.choice(langs), draw.choice([None, 5]), draw.choice([None, "", "text é"])) for i in ids]


def test_against_brute_force(spark):
    rows = rows_of(300)
    assert found(spark, rows) == brute(rows)


def test_one_group_of_several_arrays(spark):
    rows = rows_of(2100, ("en",))
    assert found(spark, rows) == brute(rows)


def test_many_rounds(spark):
    rows = rows_of(150, ("en", "de", "fr", None, "es", "it", "nl"))
    assert found(spark, rows, n_levels=2) == brute(rows)


def test_repeated_ids_and_rows(spark):
    rows = rows_of(60) + [(7, "a", "en", 1, f"text {i % 9}") for i in range(40)] + [(8, "a", "en", 1, "same")] * 25
    rows += [(None, None, None, None, None)] * 3 + [(None, "x", "en", 2, "y"), (None, "x", "en", 3, "y"), (-(1 << 63), "", "en", 0, ""), ((1 << 63) - 1, "", "en", 0, "")]
    assert found(spark, rows) == brute(rows)


def test_every_id_in_one_group_but_few(spark):
    rows = [(i, "s", "en" if i % 10 else f"l{i}", 1, "t") for i in range(200)]
    assert found(spark, rows) == brute(rows)


def test_single_leaf_and_empty(spark):
    one = [(3, "a", "en", 1, "t")]
    assert found(spark, one) == [("3", "en", leaf(one[0]), leaf(one[0]), leaf(one[0]), [])]
    assert found(spark, []) == []


def test_long_text_and_clashing_columns(spark):
    rows = [(1, "a", "en", 1, "x" * 3_000_000), (2, "a", "en", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("mine") for c in ("grp", "id", "leaf", "place", "size", "node", "tag")})
    got = merkle.manifest(docs).collect()
    assert sorted(r["leaf"] for r in got) == sorted(map(leaf, rows))


def test_altered_row_does_not_fold_to_the_root(spark):
    rows = rows_of(20, ("en", "de"))
    later = [F.col("doc_id"), F.col("source"), F.col("lang"), F.when(F.col("doc_id") == rows[0][0], F.lit(77)).otherwise(F.col("n_chars")), F.col("text")]
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA), altered=later)
    got = made.select("id", (merkle.folded(F.col("altered_leaf"), F.col("proof")) == F.col("root")).alias("ok")).collect()
    assert {r["id"] for r in got if not r["ok"]} == {rows[0][0]}


def test_places_need_no_sorted_input(spark):
    rows = rows_of(500, ("en",), seed=4)
    leaves = spark.createDataFrame([("en", r[0], leaf(r), 1) for r in rows], "grp string, id long, leaf string, copies long")
    got = {r["id"]: r["place"] for r in merkle.places(leaves).collect()}
    assert got == {i: k for k, i in enumerate(sorted(got))}
