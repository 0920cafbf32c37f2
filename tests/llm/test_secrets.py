from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from tallyline.llm import secrets

from .rows import AWKWARD, clashing, documents

BASE = {
    "assign": (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 1, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def brute(text):
    found = [
        (m.start(), order, kind, m.end())
        for order, (kind, (pattern, group, least)) in enumerate(BASE.items())
        for m in pattern.finditer(text or "")
        if len(m[group]) >= least
    ]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def case():
    draw = random.Random(2)
    parts = ["password", "Token", "api_key", "APIKEY", " = ", ":", "'", '"', "é😀", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "\n", "abc", "=", " "]
    rows = [(1000 + i, "".join(draw.choice(parts) for _ in range(draw.randint(1, 25))), "en") for i in range(300)]
    rows.append((2000, "token=token: abcdefg ; " + "0123456789abcdef01234567 " * 700, "en"))
    return AWKWARD + rows


def test_base_spans_are_brute_forces(spark):
    rows = case()
    got = secrets.scan(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "random"] == brute(r["text"])
        assert r["spans"] == sorted(r["spans"])


def test_random_tokens_are_found_and_names_are_not(spark):
    draw = random.Random(9)
    key = lambda n: "".join(draw.choice(secrets.ALPHABETS["base64"]) for _ in range(n))
    rows = [(i, f"key {key(60)} end", "en") for i in range(200)]
    rows += [(1000 + i, f"see thisIsAnOrdinaryLongIdentifierNameOfAClassVersion{i % 10} end", "en") for i in range(200)]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.scan(documents(spark, rows)).collect()}
    assert sum(got[i] == ["random"] for i in range(200)) > 150
    assert not any(got[1000 + i] for i in range(200))


def test_p_values_of_random_tokens_are_spread(spark):
    draw = random.Random(3)
    rows = [(i, "".join(draw.choice(secrets.ALPHABETS["hex"].upper()) for _ in range(64)), "en") for i in range(400)]
    cells = [t["cell"] for r in documents(spark, rows).select(secrets.tokens(F.col("text")).alias("t")).collect() for t in r["t"]]
    assert len(cells) > 390 and 0.35 < sum(c >= secrets.CELLS // 2 for c in cells) / len(cells) < 0.65


def test_redaction(spark):
    docs = documents(spark, [(1, "é a token = 'abcdef123' b AKIA" + "A" * 20 + " c", "en"), (2, None, "en"), (3, "plain", "en")])
    got = {r["doc_id"]: r["text"] for r in secrets.redact(secrets.scan(docs)).collect()}
    assert got == {1: "é a [SECRET]' b [SECRET] c", 2: None, 3: "plain"}


def test_overlaps_are_one_mark(spark):
    text = "x token=" + "0123456789abcdef" * 2 + " y"
    row = secrets.redact(secrets.scan(documents(spark, [(1, text, "en")]))).first()
    assert row["text"] == "x [SECRET] y" and [s["kind"] for s in row["spans"]] == ["assign", "hex"]


def test_empty_and_clashing(spark):
    assert secrets.scan(documents(spark, [])).count() == 0
    got = secrets.scan(clashing(documents(spark), "spans", "tokens"))
    assert got.columns.count("spans") == 1 and got.count() == len(AWKWARD)


def test_only_built_in_expressions(spark):
    plan = secrets.scan(documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def cells(spark, rows):
    """Thresholds by group from rows of group, cell, hash and how often the token occurs."""
    made = spark.createDataFrame(rows, "group string, cell int, hash long, n int")
    each = made.select(F.array_repeat(F.struct("group", "cell", "hash"), F.col("n")).alias("tokens"))
    return dict(secrets.thresholds(each).select("group", "lowest").collect())


def test_copies_of_a_token_do_not_move_the_threshold(spark):
    spread = [(group, i % secrets.CELLS, i, 1) for group in ("low", "mid") for i in range(1000)]
    names = [("high", 0, i, 1) for i in range(500)]
    hot = [("low", 10, 5000, 3000), ("mid", 24, 5000, 3000), ("high", 40, 5000, 3000)]
    got = cells(spark, spread + names + hot)
    assert got["low"] == got["mid"] == 0
    assert got["high"] > 0


def test_every_copy_is_reported(spark):
    draw = random.Random(4)
    keys = ["".join(draw.choice(secrets.ALPHABETS["base64"]) for _ in range(60)) for _ in range(100)]
    hot = next(k for k in keys if "/" in k)
    rows = [(i, f"key {k} end", "en") for i, k in enumerate(keys)] + [(1000, f"key {hot} and {hot} end", "en")] * 50
    got = secrets.scan(documents(spark, rows)).collect()
    single = {r["text"]: len(r["spans"]) for r in got if r["doc_id"] < 1000}
    assert {len(r["spans"]) for r in got if r["doc_id"] == 1000} == {2 * single[f"key {hot} end"]}


def test_small_groups_keep_random_tokens_and_no_names(spark):
    draw = random.Random(6)
    rows = [(f"{n}-{j}", draw.randrange(1, secrets.CELLS), i, 1) for n in (1, 2, 5, 10, 20) for j in range(100) for i in range(n)]
    rows += [(f"names-{n}", 0, i, 1) for n in (1, 2, 5) for i in range(n)]
    rows += [("many-names", i % 8, i, 1) for i in range(500)]
    got = cells(spark, rows)
    lost = sum(cell < got[group] for group, cell, _, _ in rows if group[0].isdigit())
    assert lost <= 0.01 * sum(group[0].isdigit() for group, *_ in rows)
    assert all(got[f"names-{n}"] > 0 for n in (1, 2, 5)) and got["many-names"] > 7


def test_a_single_bare_key_is_found(spark):
    """A key with its p above the lowest cell and below one half, alone in its encoding and length."""
    draw, keys = random.Random(8), {}
    for name, letters in secrets.ALPHABETS.items():
        drawn = ["".join(draw.choice(letters) for _ in range(40)) for _ in range(400)]
        made = spark.createDataFrame([(k,) for k in drawn], "key string").select("key", secrets.tokens(F.col("key")).alias("t"))
        held = [(r["key"], t) for r in made.collect() for t in r["t"]]
        keys[name] = next(k for k, t in held if t["group"] == f"{name}/2" and 1 <= t["cell"] < secrets.CELLS // 2)
    rows = [(i, f"see {k} end", name) for i, (name, k) in enumerate(keys.items())]
    rows.append((100, "see thisIsAnOrdinaryLongIdentifierNameOfAClassVersion1 end", None))
    got = {r["lang"]: [s["kind"] for s in r["spans"]] for r in secrets.scan(documents(spark, rows)).collect()}
    assert all("random" in got[name] or "hex" in got[name] for name in keys) and got[None] == []
