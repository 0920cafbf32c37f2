"""Quality rules from tokeniser fertility.

Two public vocabularies encode each word of a text by itself. Three measures follow: characters per token (both
vocabularies), the share of tokens that stand for single bytes of characters missing from the vocabulary, and the
entropy of the token distribution relative to its maximum. Per language (or script, where the language is unknown)
the quartiles over all different texts give a band; a document outside a band is rejected. Entropy falls with length,
so it has a band for each length class (powers of two of the number of words). A key with few different texts takes
the band of its script, and this the one over all texts; a class with few texts takes a wider key's band of that
class, then the bands over all lengths. Plain counts (words, symbols, repeated lines and words) come along, with two
base rules.

Null and empty texts have zero counts, null measures and fail the base rules; null measures lie in every band.
Quartiles are read from counts on a fixed grid, so ties and the order of rows don't matter; a repeated text counts
once per key, and near copies each. An empty table gives an empty result. Input columns named like a result are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.common import Memo, add_columns, held, ranks, vocabulary, without
from tallyline.session import cut_lineage

RANKS, PIECES = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"
MOST_WORDS = 150_000
#: Measures with the width of a cell of the grid that quartiles are read from.
MEASURES = {"chars_per_token": 0.01, "chars_per_piece": 0.01, "byte_share": 0.001, "token_entropy": 0.002}
#: A band reaches this many interquartile ranges beyond the quartiles, and one cell where these are equal.
REACH, LEAST_CELLS = 5.0, 1
#: Single bytes that any text may have beyond its band (five characters): a share of a short text says no more.
LOOSE_BYTES = 20
#: Measures that have a band for each length class.
BY_LENGTH = ("token_entropy",)
#: Different texts that a key or length class needs for a band of its own.
LEAST_TEXTS = 20
#: Columns that go with the measures to the bands: the text's script, and a hash of the text.
SCRIPT, COPY = "_band_script", "_band_copy"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _vocabularies(ranks_path: str, pieces_path: str) -> Memo:
    return held("fertility", (ranks_path, pieces_path), lambda: _make_vocabularies(ranks_path, pieces_path))


def _make_vocabularies(ranks_path: str, pieces_path: str) -> Memo:
    """For a word: tokens of the byte vocabulary, ids of the piece vocabulary, and how many of those are bytes."""
    import sentencepiece
    import tiktoken
    from public_tokenizers import PATTERN

    table = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(ranks_path), special_tokens={})
    model = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
    single = {i for i in range(model.get_piece_size()) if model.is_byte(i)}

    def encode(word: bytes) -> tuple[int, tuple[int, ...], int]:
        text = word.decode()
        ids = tuple(model.encode(text))
        return len(table.encode_ordinary(text)), ids, sum(i in single for i in ids)

    return Memo(encode, MOST_WORDS)


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    grams = list(zip(*(words[i:] for i in range(size))))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    found = covered = 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            found += i + size - max(i, covered)
            covered = i + size
    return found


def plain_counts(text: str) -> tuple[list[bytes], tuple[int, ...]]:
    """The words of a text (runs without ASCII white space) and its counts as in ``COUNTS``."""
    data = text.encode()
    words = data.split()
    blanks = len(data) - len(data.translate(None, b" \t\n\r\x0b\x0c"))
    symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return words, (len(words), len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated_words(words))


def _measures(words: list[bytes], n_chars: int, known: Memo) -> tuple[float | None, ...]:
    if not words:
        return (None,) * len(MEASURES)
    found = [known[w] for w in words]
    tokens = sum(f[0] for f in found)
    ids = np.fromiter(chain.from_iterable(f[1] for f in found), np.int64)
    each = np.unique(ids, return_counts=True)[1] / len(ids)
    most = math.log(len(ids))
    entropy = float(-(each * np.log(each)).sum()) / most if most else None
    return n_chars / tokens, n_chars / len(ids), sum(f[2] for f in found) / len(ids), entropy


def measure(
    docs: DataFrame, text: str = "text", ranks_path: str | None = None, pieces_path: str | None = None
) -> DataFrame:
    """``docs`` with the plain counts and the measures of ``text``."""
    ranks_path, pieces_path = ranks_path or vocabulary(RANKS), pieces_path or vocabulary(PIECES)

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        known = _vocabularies(ranks_path, pieces_path)
        counts, measures = [], []
        for value in part.column(text).to_pylist():
            words, row = plain_counts(value or "")
            counts.append(row)
            measures.append(_measures(words, row[1], known))
        return [
            *(pa.array([row[i] for row in counts], pa.int64()) for i in range(len(COUNTS))),
            *(pa.array([row[i] for row in measures], pa.float64()) for i in range(len(MEASURES))),
        ]

    fields = [T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(m, T.DoubleType()) for m in MEASURES]
    return add_columns(docs, text, fields, make)


def language_key(lang: str | None, text: str) -> Column:
    """A language code of two or three letters, else the script of the first letter: a few thousand keys at most."""
    letter = F.regexp_extract(F.col(text), r"(\p{L})", 1)
    script = F.lit("other")
    for name in ("Latin", "Greek", "Cyrillic", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Hangul", "Thai"):
        script = F.when(letter.rlike(rf"^\p{{Is{name}}}"), F.lit(name)).otherwise(script)
    if lang is None:
        return script
    code = F.lower(F.col(lang))
    return F.when(code.rlike("^[a-z]{2,3}$"), code).otherwise(script)


def length_class() -> Column:
    """The power of two of the number of words."""
    return F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int")


def bands(measured: DataFrame, key: str = "band_key", reach: float = REACH) -> DataFrame:
    """One row per key, script and length class: the lowest and highest admissible value of each measure.

    Every different text with enough words counts. A hash and the cells of each are shuffled; then values are counted
    per key, class and grid cell, which is bounded by keys times classes times cells. Without the columns ``SCRIPT``
    and ``COPY`` there is one script, and texts with the same counts and measures are one.
    """
    cells = [
        F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) / width).cast("long").alias("cell"))
        for m, width in MEASURES.items()
    ]
    script = F.col(SCRIPT) if SCRIPT in measured.columns else F.lit("other")
    copy = F.col(COPY) if COPY in measured.columns else F.xxhash64(*COUNTS, *MEASURES)
    texts = measured.where(F.col("n_words") >= MIN_WORDS).select(
        F.col(key).alias("key"),
        script.alias("script"),
        length_class().alias("length"),
        copy.alias("copy"),
        *(c["cell"].alias(m) for m, c in zip(MEASURES, cells)),
    )

    def counted(level: str, columns: list[str]) -> DataFrame:
        """Different texts by key, length class and cell of each measure."""
        each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("cell")) for m in MEASURES)))
        rows = texts.select(*columns, "length", "copy", *MEASURES).distinct().select(*columns, "length", each.alias("c"))
        name = F.col(columns[0]) if columns else F.lit("")
        return (
            rows.where(F.col("c.cell").isNotNull())
            .groupBy(F.lit(level).alias("level"), name.alias("name"), "length", "c.measure", "c.cell")
            .agg(F.count("*").alias("n"))
        )

    # The class -1 is all lengths.
    levels = counted("key", ["key"]).union(counted("script", ["script"])).union(counted("all", []))
    levels = levels.withColumn("length", F.explode(F.array("length", F.lit(-1))))
    by_level = levels.groupBy("level", "name", "length", "measure", "cell").agg(F.sum("n").alias("n"))
    by_level = by_level.groupBy("level", "name", "length", "measure").agg(
        F.sort_array(F.collect_list(F.struct("cell", "n"))).alias("cells"), F.sum("n").alias("total")
    )

    def quartile(share: float) -> Column:
        state = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("cell"))
        found = F.aggregate(
            "cells",
            state,
            lambda a, x: F.struct(
                (a["seen"] + x["n"]).alias("seen"),
                F.coalesce(a["cell"], F.when(a["seen"] + x["n"] >= F.col("total") * share, x["cell"])).alias("cell"),
            ),
        )
        return found["cell"]

    widths = F.create_map(*(F.lit(x) for pair in MEASURES.items() for x in pair))
    width = F.element_at(widths, F.col("measure"))
    edges = by_level.withColumns({"low": quartile(0.25), "high": quartile(0.75)})
    margin = F.greatest((F.col("high") - F.col("low")) * reach, F.lit(LEAST_CELLS))
    limits = F.struct(((F.col("low") - margin) * width).alias("low"), ((F.col("high") + 1 + margin) * width).alias("high"))
    edges = edges.select("level", "name", "length", "measure", "total", limits.alias("limits"))
    found = texts.select("key", "script", "length").distinct()
    found = found.withColumn("measure", F.explode(F.array(*map(F.lit, MEASURES))))
    # From the nearest band to the widest; entropy looks for its length first.
    chain = [(level, own) for own in (True, False) for level in ("key", "script", "all")]
    for i, (level, own) in enumerate(chain):
        enough = (F.col("level") == level) & ((F.col("length") >= 0) if own else (F.col("length") == -1))
        if own:
            enough &= F.col("measure").isin(*BY_LENGTH)
        if (level, own) != chain[-1]:
            enough &= F.col("total") >= LEAST_TEXTS
        on = ["measure", *(["length"] if own else []), *([level] if level != "all" else [])]
        names = {"name": level} if level != "all" else {}
        part = edges.where(enough).withColumnsRenamed({**names, "limits": f"l{i}"}).select(*on, f"l{i}")
        found = found.join(F.broadcast(part), on, "left")
    found = found.withColumn("limits", F.coalesce(*(f"l{i}" for i in range(len(chain)))))
    pick = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(f"limits.{c}"))).alias(f"{m}_{c}")
    made = found.groupBy(F.col("key").alias(key), F.col("script").alias(SCRIPT), "length").agg(
        *(pick(m, c) for m in MEASURES for c in ("low", "high"))
    )
    return made.orderBy(key, SCRIPT, "length")


def outside(measure: str) -> Column:
    """Whether a measure of a row lies outside its limits."""
    value, low, high = (F.col(c) for c in (measure, f"{measure}_low", f"{measure}_high"))
    if measure == "byte_share":
        pieces = F.col("word_chars") / F.col("chars_per_piece")
        return (value < low) | ((value > high) & ((value - high) * pieces > LOOSE_BYTES))
    return (value < low) | (value > high)


def verdicts(measured: DataFrame, reach: float = REACH) -> DataFrame:
    """``measured`` (with ``band_key``, computed once) with ``base_failed``, ``out_of_band`` and ``kept``."""
    # At most a few thousand language and script keys (language_key) times scripts and some twenty lengths.
    limits = F.broadcast(bands(measured, reach=reach).withColumnRenamed("length", "_length"))
    found = [F.when(outside(m), F.lit(m)) for m in MEASURES]
    repeated = 100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    kept = [f"`{c}`" for c in without(measured, [SCRIPT, COPY])]
    if SCRIPT not in measured.columns:
        measured = measured.withColumn(SCRIPT, F.lit("other"))
    return (
        measured.withColumn("_length", length_class())
        .join(limits, ["band_key", SCRIPT, "_length"], "left")
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | repeated)
        .withColumn("out_of_band", F.filter(F.array(*found), lambda x: x.isNotNull()))
        .withColumn("kept", ~F.col("base_failed") & (F.size("out_of_band") == 0))
        .select(*kept, "base_failed", "out_of_band", "kept")
    )


RESULTS = (*COUNTS, *MEASURES, "band_key", "base_failed", "out_of_band", "kept")


def judge(docs: DataFrame, text: str = "text", lang: str | None = "lang", reach: float = REACH, **paths: str) -> DataFrame:
    """``docs`` with counts, measures, ``base_failed``, the measures out of band (``out_of_band``) and ``kept``.

    The texts are encoded once. What comes of it is written to the shared folder, because the bands need all of it
    before the first verdict; select the columns that are needed before.
    """
    keyed = docs.withColumns({"_key": language_key(lang, text), SCRIPT: language_key(None, text), COPY: F.xxhash64(text)})
    kept = [f"`{c}`" for c in without(docs, [*RESULTS, SCRIPT, COPY])]
    measured = measure(keyed.select(*kept, F.col("_key").alias("band_key"), SCRIPT, COPY), text, **paths)
    return verdicts(cut_lineage(measured), reach)


def judge_ids(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str | None = "lang", reach: float = REACH, **paths: str) -> DataFrame:
    """As ``judge``, but of the input only the id is returned, so no text is written."""
    docs = docs.select(
        F.col(id).alias("_id"),
        F.col(text).alias("_text"),
        language_key(lang, text).alias("band_key"),
        language_key(None, text).alias(SCRIPT),
        F.xxhash64(text).alias(COPY),
    )
    measured = cut_lineage(measure(docs, "_text", **paths).drop("_text"))
    return verdicts(measured, reach).withColumnRenamed("_id", id)
