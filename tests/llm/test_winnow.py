from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tallyline.llm import winnow

from .rows import AWKWARD, clashing, documents, prose


def brute(text):
    """Kept (hash, position) of a text, window by window."""
    points = [ord(c) for c in text or ""]
    size = min(winnow.GRAM, len(points))
    if not size:
        return []
    hashes = []
    for i in range(len(points) - size + 1):
        value = 0
        for c in points[i : i + size]:
            value = (value * winnow.BASE + c) % winnow.PRIME
        hashes.append(value)
    width = min(winnow.WINDOW, len(hashes))
    chosen = {
        max((j for j in range(i, i + width) if hashes[j] == min(hashes[i : i + width])))
        for i in range(len(hashes) - width + 1)
    }
    return [(hashes[j], j) for j in sorted(chosen)]


def ours(text):
    return list(zip(*(x.tolist() for x in winnow.kept(winnow.code_points(text)))))


@pytest.mark.parametrize("text", ["", None, "a", "abc" * 5, "x" * 16, "x" * 500, "ab" * 300, "é中😀" * 90, prose(1, 1, 150)[0]])
def test_kept_against_brute_force(text):
    assert ours(text) == brute(text)


def test_blocks_join(monkeypatch):
    text = prose(2, 1, 700)[0] + "z" * 300
    whole = ours(text)
    monkeypatch.setattr(winnow, "BLOCK", 100)
    assert ours(text) == whole == brute(text)


def test_shared_run_is_found_at_its_place():
    draw = random.Random(3)
    for _ in range(50):
        shared = "".join(draw.choice("abcdef ") for _ in range(winnow.GRAM + winnow.WINDOW - 1))
        a, b = ("".join(draw.choice("uvwxyz") for _ in range(draw.randint(0, 300))) for _ in range(2))
        in_a, in_b = dict(ours(a + shared + b)), dict(ours(b + shared))
        inside = [h for h in in_a.keys() & in_b.keys() if len(a) <= in_a[h] < len(a) + winnow.WINDOW]
        assert any(in_a[h] - len(a) == in_b[h] - len(b) for h in inside)


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(rows):
    import xxhash

    key = lambda r: (r[0] is None, -(r[0] or 0), xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42))
    signed = lambda k: (*k[:2], k[2] - (1 << 64) if k[2] >> 63 else k[2])
    order = sorted(rows, key=lambda r: signed(key(r)))
    out = []
    for i, r in enumerate(order):
        text, other = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        mine, its = ours(text), ours(edited)
        out.append((str(r[0]), len(text), edited, mine, its, likeness(mine, its), likeness(mine, ours(other))))
    return sorted(out)


def compared(docs, parts):
    got = winnow.compare_edits(docs, parts=parts).collect()
    return sorted(
        (str(r["id"]), r["n_chars"], r["edited"], list(zip(r["hashes"], r["positions"])), list(zip(r["edited_hashes"], r["edited_positions"])), r["near_edited"], r["near_next"])
        for r in got
    )


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_edits_of_awkward_rows(spark, parts):
    assert compared(clashing(documents(spark), "id", "slot", "hash", "edited", "borrowed"), parts) == expected(AWKWARD)


def test_edits_of_scattered_ids(spark):
    draw = random.Random(5)
    rows = [(draw.randrange(-(10**12), 10**12), t, "en") for t in prose(6, 90, 30)]
    assert compared(documents(spark, rows).repartition(5), 7) == expected(rows)


def test_an_id_that_fills_several_ranges(spark):
    rows = [(7, t, "en") for t in prose(7, 60, 20)] + [(i, t, "en") for i, t in enumerate(prose(8, 25, 20))]
    got = compared(documents(spark, rows), 8)
    assert got == expected(rows)
    slots = {r["slot"] for r in winnow.dealt(documents(spark, rows).selectExpr("doc_id AS id", "text"), 8).where("id = 7 AND NOT borrowed").collect()}
    assert len(slots) > 3


def test_one_row_and_none(spark):
    one = [(5, "some text of one document", "en")]
    assert compared(documents(spark, one), 4) == expected(one)
    assert compared(documents(spark, []), 4) == []


def test_equal_texts_have_equal_fingerprints(spark):
    docs = winnow.fingerprints(clashing(documents(spark), "hashes"))
    by_text = {}
    for r in docs.collect():
        by_text.setdefault(r["text"] or "", set()).add((tuple(r["hashes"]), tuple(r["positions"])))
    assert all(len(v) == 1 for v in by_text.values())


def test_digest_of_listed(spark):
    text = prose(9, 1, 80)[0]
    got = winnow.fingerprints(documents(spark, [(1, text, "en")])).select(winnow.listed("hashes", "positions").alias("f")).first()["f"]
    assert hashlib.sha256(got.encode()).digest() == hashlib.sha256(",".join(f"{h}:{p}" for h, p in brute(text)).encode()).digest()
    assert np.array_equal(sorted(p for _, p in brute(text)), [p for _, p in brute(text)])
