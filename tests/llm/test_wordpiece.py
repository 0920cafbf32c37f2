from __future__ import annotations

import random

from tallyline.llm import wordpiece
from tallyline.llm.common import vocabulary

from .rows import AWKWARD, clashing, documents


def greedy(symbols, pieces):
    left, n = tuple(symbols), 0
    while left:
        k = next((k for k in range(len(left), 0, -1) if left[:k] in pieces), 0)
        if not k:
            return None
        left, n = left[k:], n + 1
    return n


def test_small_alphabets():
    draw = random.Random(8)
    for _ in range(300):
        pieces = {tuple(draw.choice("abc") for _ in range(draw.randint(1, 5))) for _ in range(draw.randint(1, 12))}
        automaton = wordpiece.LongestMatch(pieces)
        for _ in range(30):
            word = [draw.choice("abc") for _ in range(draw.randint(0, 14))]
            assert automaton.count(word) == greedy(word, pieces)


def test_documents(spark):
    pieces = set(wordpiece.vocabulary_pieces(vocabulary(wordpiece.PIECES)))
    got = wordpiece.token_counts(documents(spark)).collect()
    assert len(got) == len(AWKWARD)
    for r in got:
        found = wordpiece.words(wordpiece.normal(r["text"] or ""))
        if len(found) < 200:
            counts = [greedy([*w.encode(), wordpiece.END], pieces) for w in found if len(w) < 1000]
            if all(len(w) < 1000 for w in found):
                assert r["n_tokens"] == sum(1 if c is None else c for c in counts)
        assert r["n_words"] == len(found)


def test_words():
    assert wordpiece.words("it's 42 ''s don't-stop é中!!") == ["it", "'s", "4", "2", "''", "s", "don", "'t", "-", "stop", "é中", "!!"]
    assert wordpiece.words("") == [] and wordpiece.words(" \n") == []


def test_empty_and_clashing(spark):
    assert wordpiece.token_counts(documents(spark, [])).count() == 0
    got = wordpiece.token_counts(clashing(documents(spark), "n_tokens"))
    assert dict(got.dtypes)["n_tokens"] == "bigint"
