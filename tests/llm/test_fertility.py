from __future__ import annotations

import random
import re
from collections import Counter

from tallyline.llm import fertility

from .rows import AWKWARD, clashing, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(hit))


def test_counts_are_brute_forces(spark):
    extra = [(20, "a b c a b c d a b c\na b\n a b\na b ###", "en"), (21, "a a a a", "en"), (22, "é|ü\x0bß\x0c<>", "fr")]
    got = fertility.judge(documents(spark, AWKWARD + extra)).collect()
    assert len(got) == len(AWKWARD) + len(extra)
    for row in got:
        expected = brute(row["text"])
        assert tuple(row[c] for c in fertility.COUNTS) == expected
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        assert row["base_failed"] == failed
        assert not (failed and row["kept"])


def test_given_files(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = fertility.judge_ids(docs).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(tuple(r[c] for c in fertility.COUNTS) == brute(texts[r["doc_id"]]) for r in rows)


def test_measures_of_known_words(spark):
    row = fertility.measure(documents(spark, [(1, "the the 中\U0001f9ff", "en")])).first()
    assert row["chars_per_token"] <= 8 / 3 and 0 < row["byte_share"] < 1 and 0 < row["token_entropy"] <= 1
    empty = fertility.measure(documents(spark, [(1, None, "en")])).first()
    assert empty["chars_per_token"] is None and empty["token_entropy"] is None


def test_outliers_of_a_language_are_rejected(spark):
    rows = [(i, text, "en") for i, text in enumerate(prose(1, 60))]
    odd = " ".join("\U0001f9ff\U0001f9fa" + chr(0x1F300 + i) for i in range(60))
    got = {r["doc_id"]: r for r in fertility.judge(documents(spark, [*rows, (100, odd, "EN")])).collect()}
    assert got[100]["out_of_band"] and not got[100]["kept"]
    assert all(got[i]["kept"] for i in range(60))


def test_bands_do_not_depend_on_partitions(spark):
    rows = [(i, text, "en") for i, text in enumerate(prose(2, 80))]
    one = fertility.bands(fertility.measure(documents(spark, rows).coalesce(1)).withColumnRenamed("lang", "band_key")).collect()
    many = fertility.bands(fertility.measure(documents(spark, rows).repartition(7)).withColumnRenamed("lang", "band_key")).collect()
    assert one == many


def test_unknown_languages_fall_to_their_script(spark):
    docs = documents(spark, [(1, "Привет", None), (2, "hello", "not a code"), (3, "12", ""), (4, "x", "DE"), (5, None, None)])
    keys = docs.select("doc_id", fertility.language_key("lang", "text").alias("k")).collect()
    assert {r["doc_id"]: r["k"] for r in keys}[1] == "Cyrillic"
    assert {r["doc_id"]: r["k"] for r in keys} == {1: "Cyrillic", 2: "Latin", 3: "other", 4: "de", 5: "other"}


def test_empty_and_clashing(spark):
    assert fertility.judge(documents(spark, [])).count() == 0
    got = fertility.judge(clashing(documents(spark), "kept", "n_words", "Band_Key"))
    assert [c.lower() for c in got.columns].count("kept") == 1 and got.count() == len(AWKWARD)


def worded(seed: int, n: int, letters: str, words=(60, 400)) -> list[str]:
    """Plain texts of a language made of these letters."""
    draw = random.Random(seed)
    stock = ["".join(draw.choice(letters) for _ in range(draw.randint(2, 8))) for _ in range(300)]
    return [" ".join(draw.choice(stock) for _ in range(draw.randint(*words))) for _ in range(n)]


LANGUAGES = {"en": "etaoinshrdlu", "fr": "esaitnrulodé", "ru": "оеаинтсрвлкм"}


def test_noise_is_rejected_and_plain_text_is_not(spark):
    draw, rows, noisy = random.Random(5), [], {}
    for k, (lang, letters) in enumerate(LANGUAGES.items()):
        texts = worded(k, 200, letters)
        rows += [(1000 * k + i, t, lang) for i, t in enumerate(texts)]
        for i, t in enumerate(texts[:8]):
            noisy[1000 * k + 900 + i] = (" ".join(w + draw.choice(["###", "***", "|<>"]) for w in t.split()), lang)
            noisy[1000 * k + 910 + i] = ("".join(w if w == " " else draw.choice("aé中\U0001f9ff") for w in t), lang)
            # A token never seen twice, and few words over and over in a changing order.
            noisy[1000 * k + 920 + i] = (" ".join(draw.choice(t.split()[:3]) for _ in range(200)), lang)
    rows += [(i, *row) for i, row in noisy.items()]
    got = {r["doc_id"]: r for r in fertility.judge(documents(spark, rows)).collect()}
    assert not [i for i in noisy if i % 1000 < 920 and not got[i]["out_of_band"]]
    assert all("token_entropy" in got[i]["out_of_band"] for i in noisy if i % 1000 >= 920)
    plain = [r["kept"] for i, r in got.items() if i not in noisy]
    assert sum(plain) >= 0.99 * len(plain)


def test_a_few_missing_characters_are_no_noise(spark):
    texts = worded(7, 100, LANGUAGES["en"])
    one, many = (texts[0] + " \U0001f9ff" * n for n in (1, 40))
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(200, one, "en"), (201, many, "en")]
    got = {r["doc_id"]: r["out_of_band"] for r in fertility.judge(documents(spark, rows)).collect()}
    assert "byte_share" not in got[200] and "byte_share" in got[201]


def test_copies_of_a_bad_text_do_not_widen_a_band(spark):
    texts = worded(11, 100, LANGUAGES["en"])
    bad = " ".join(w + "###" for w in texts[0].split())
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(1000 + i, bad, "en") for i in range(60)]
    got = fertility.judge(documents(spark, rows)).collect()
    assert not any(r["kept"] for r in got if r["doc_id"] >= 1000)
    assert sum(r["kept"] for r in got if r["doc_id"] < 1000) >= 98


def test_rare_keys_take_the_band_of_their_script(spark):
    rows = [(i, t, "en") for i, t in enumerate(worded(12, 100, LANGUAGES["en"]))]
    good, other = worded(13, 2, LANGUAGES["en"])
    cyrillic = worded(14, 60, LANGUAGES["ru"])
    rows += [(100 + i, t, "ru") for i, t in enumerate(cyrillic[:-1])]
    bad = " ".join(w + "###" for w in good.split())
    rows += [(200, good, "zz"), (201, bad, "qq"), (202, bad, "qq"), (203, cyrillic[-1], "uk"), (204, other, "xx")]
    got = {r["doc_id"]: r["kept"] for r in fertility.judge_ids(documents(spark, rows)).collect()}
    assert [got[i] for i in range(200, 205)] == [True, False, False, True, True]
