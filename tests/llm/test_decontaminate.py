from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tallyline.llm import decontaminate

from .rows import AWKWARD, clashing, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, size=13):
    w = words(text)
    hit, found = set(), set()
    for item, item_text in items:
        iw = words(item_text)
        grams = [iw[i : i + size] for i in range(max(1, len(iw) - size + 1))] if iw else []
        for g in grams:
            for i in range(len(w) - len(g) + 1):
                if w[i : i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), sorted(found)


def case():
    draw = random.Random(4)
    stock = ["alpha", "Beta", "gamma", "é", "straße", "x1", "中文", "is", "the"]
    item = lambda n: " ".join(draw.choice(stock) for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate([20, 13, 12, 1, 40, 3])] + [(6, ""), (7, None), (None, item(5)), (10, "Zebra-crossing")]
    rows = list(AWKWARD)
    for i in range(60):
        pick = draw.choice(items)[1] or ""
        w = words(pick)
        cut = w[draw.randint(0, len(w) // 2) :] if w else []
        rows.append((100 + i, item(draw.randint(0, 30)) + ", " + " / ".join(cut).upper() + "... " + item(9), "en"))
    return rows, items


def test_against_brute_force(spark):
    rows, items = case()
    got = decontaminate.scan(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    rows_out = got.collect()
    assert len(rows_out) == len(rows)
    for r in rows_out:
        assert (r["n_words"], r["n_hit"], r["items"]) == brute(r["text"], items)
        for hit in r["hits"]:
            assert len(words(r["text"][hit["start"] : hit["end"]])) == hit["words"]


def test_blocks_of_items_give_the_same(spark):
    rows, items = case()
    table = spark.createDataFrame(items, "item_id long, text string")
    one = decontaminate.scan(documents(spark, rows), table).orderBy("doc_id", "text").collect()
    many = decontaminate.scan(documents(spark, rows), table, most=60).orderBy("doc_id", "text").collect()
    assert one == many


def test_threshold(spark):
    rows = spark.createDataFrame([(0, 10), (1, 20), (1, 21), (0, 0)], "n_hit long, n_words long")
    got = [r[0] for r in rows.select(decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))).collect()]
    assert got == [False, True, False, False]


def test_empty_tables_and_clashes(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.scan(clashing(documents(spark), "items", "n_hit", "HITS"), items)
    assert got.agg(F.sum("n_hit")).first()[0] == 0 and len(got.columns) == 7
    assert decontaminate.scan(documents(spark, []), items).count() == 0
