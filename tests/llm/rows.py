"""Small awkward tables."""

from __future__ import annotations

import random

LONG = "lorem ipsum dolor sit amet consectetur " * 8000
AWKWARD = [
    (1, "The quick brown fox jumps over the lazy dog. " * 4, "en"),
    (2, None, "en"),
    (3, "", None),
    (4, " \t\n ", "fr"),
    (5, LONG, "en"),
    (6, "The quick brown fox jumps over the lazy dog. " * 4, "en"),
    (6, "The quick brown fox jumps over the lazy dog. " * 4, "en"),
    (None, "A row without an id, é 中 😀 \x00\x1c\x85", None),
    (7, "Été à la plage; Straße, naïve — ça va?\r\n\r\nline\nline\nline", "fr"),
    (8, "x" * 70_000, "de"),
]


def documents(spark, rows=AWKWARD):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def clashing(docs, *names):
    """``docs`` with further columns of these names."""
    from pyspark.sql import functions as F

    return docs.withColumns({n: F.lit("mine") for n in names})


def prose(seed: int, n: int, words: int = 120) -> list[str]:
    draw = random.Random(seed)
    stock = ["".join(draw.choice("aeioustrnl") for _ in range(draw.randint(2, 8))) for _ in range(400)]
    return [" ".join(draw.choice(stock) for _ in range(words)) for _ in range(n)]
