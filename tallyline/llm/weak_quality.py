"""A quality classifier from weak labels.

Ten heuristics vote good, bad or nothing on each document. Expectation-maximisation over the counts of vote patterns
(at most 3^10 rows, counted over all documents) estimates how often each heuristic votes what for good and for bad
documents, and so the probability of good behind each pattern. These probabilities are the targets of a linear
scorer over hashed words and word shapes, fitted on a bounded sample of ``sample_rows`` documents; the scorer then
judges every document.

Null and empty texts score 0 and are not kept. The sample is drawn by a hash of id and text, so repeated rows fall
in or out together, and neither order nor partitioning matters. An empty table gives an empty result. Input columns
named like a result are replaced.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.common import Memo, add_columns, list_array, worker_path

GOOD, BAD, NOTHING = 1, 0, 2
HEURISTICS = 10
#: Documents (about) that the scorer is fitted on.
SAMPLE_ROWS = 8_000
BUCKETS = 1 << 15
MOST_WORDS = 100_000
#: Frequent words of four languages.
STOPWORDS = {
    "en": "the of and to in is that for it with as on by are from was this be an at",
    "fr": "le la les de des du et en un une que qui dans pour par est au sur avec ou",
    "de": "der die und in den von zu das mit ist sich des auf für nicht ein eine als auch es",
    "es": "de la que el en y a los se del las un por con una para su no es al",
}


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _vote(bad: Column, good: Column | None = None) -> Column:
    found = F.when(bad, BAD)
    return (found if good is None else found.when(good, GOOD)).otherwise(NOTHING).cast("tinyint")


def _without(text: Column, characters: str) -> Column:
    """How many of the characters a text has."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def votes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``votes``: what each heuristic says."""
    value = F.coalesce(F.col(text), F.lit(""))
    stop = sorted({w for words in STOPWORDS.values() for w in words.split()})
    words = F.filter(F.split(value, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(value, "\n"), lambda x: F.trim(x) != "")
    of_words = lambda test: F.size(F.filter("_words", test))
    again = F.zip_with("_words", F.slice("_words", F.lit(2), F.size("_words")), lambda a, b: F.coalesce(a == b, F.lit(False)))
    counts = {
        "_n": F.size("_words"),
        "_chars": F.length(value),
        "_upper": _without(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "_symbols": _without(value, "#*$%&|<>"),
        "_shouts": _without(value, "!"),
        "_marked": of_words(lambda w: F.translate(w, "#*$%&|<>", "") != w),
        "_loud": of_words(lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1)),
        "_shouted": of_words(lambda w: w.contains("!!")),
        "_kinds": F.size(F.array_distinct("_words")),
        "_again": F.size(F.filter(again, lambda x: x)),
        "_stops": of_words(lambda w: F.lower(w).isin(stop)),
        "_lines": F.size(lines),
        "_line_kinds": F.size(F.array_distinct(lines)),
    }
    found = docs.withColumn("_words", words).withColumns(counts)
    n, chars = F.col("_n"), F.col("_chars")
    of = lambda c, total=n: _share(F.col(c), total)
    plain = (of("_symbols", chars) < 0.002) & (of("_upper", chars) < 0.1) & (of("_shouts", chars) < 0.003)
    each = [
        _vote(of("_symbols", chars) > 0.02),
        _vote(of("_marked") > 0.2),
        _vote(of("_upper", chars) > 0.3),
        _vote(of("_loud") > 0.5),
        _vote(of("_shouts", chars) > 0.02),
        _vote(of("_shouted") > 0.3),
        _vote((of("_kinds") < 0.2) & (n >= 10) & (n < 5000)),
        _vote(of("_again") > 0.2),
        _vote(_share(F.col("_lines") - F.col("_line_kinds"), F.col("_lines")) > 0.3),
        _vote(n == 0, plain & (of("_stops") > 0.1)),
    ]
    return found.withColumn("votes", F.array(*each)).drop("_words", *counts)


@dataclass
class LabelModel:
    """The share of good documents, and for each heuristic the chances of its votes by class."""

    prior: np.ndarray  # class
    chances: np.ndarray  # heuristic, class, vote

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """The probability of good for each row of votes."""
        logs = np.log(self.prior)[None, :] + sum(
            np.log(self.chances[j][:, patterns[:, j]]).T for j in range(patterns.shape[1])
        )
        logs -= logs.max(axis=1, keepdims=True)
        each = np.exp(logs)
        return each[:, GOOD] / each.sum(axis=1)

    def accuracies(self) -> np.ndarray:
        """How often each heuristic is right when it votes."""
        right = self.prior[GOOD] * self.chances[:, GOOD, GOOD] + self.prior[BAD] * self.chances[:, BAD, BAD]
        spoken = (self.prior[None, :, None] * self.chances[:, :, :2]).sum(axis=(1, 2))
        return right / spoken


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, smooth: float = 1.0) -> LabelModel:
    """Expectation-maximisation, from heuristics that find three bad documents in ten and are seldom wrong.

    A document's votes are taken as independent given its class; a vote withheld counts as a vote of its own.
    """
    n = patterns.shape[1]
    start = np.array([[0.3, 0.05, 0.65], [0.02, 0.28, 0.7]])
    model = LabelModel(np.array([0.15, 0.85]), np.repeat(start[None], n, axis=0))
    before = None
    for _ in range(rounds if len(patterns) else 0):
        good = model.posterior(patterns)
        weights = np.stack([(1 - good) * counts, good * counts])
        prior = (weights.sum(axis=1) + smooth) / (counts.sum() + 2 * smooth)
        chances = np.empty_like(model.chances)
        for j in range(n):
            for c in (BAD, GOOD):
                seen = np.bincount(patterns[:, j], weights[c], 3) + smooth
                chances[j, c] = seen / seen.sum()
        model = LabelModel(prior, chances)
        if before is not None and np.abs(good - before).max() < 1e-9:
            break
        before = good
    return model


def shape(word: bytes) -> bytes:
    """A word's kinds of characters, repetitions left out."""
    return _REPEATED.sub(rb"\1", word.translate(_SHAPES))


_REPEATED = re.compile(rb"(.)\1+", re.DOTALL)
_SHAPES = bytes(
    65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256)
)


def buckets(word: bytes) -> tuple[int, int]:
    """The hashed features of a word: itself in lower case, and its shape."""
    return (
        xxhash.xxh3_64_intdigest(word.lower()) % BUCKETS,
        xxhash.xxh3_64_intdigest(b"shape " + shape(word)) % BUCKETS,
    )


def _features(docs: DataFrame, text: str) -> DataFrame:
    """Hashed features of each text with their shares of the words."""

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        known = Memo(buckets, MOST_WORDS)
        keys, shares = [], []
        for value in part.column(text).to_pylist():
            words = (value or "").encode().split()
            found = np.array([known[w] for w in words], np.int64).reshape(-1)
            key, n = np.unique(found, return_counts=True)
            keys.append(key)
            shares.append(n)
        return [list_array(keys, pa.int32()), list_array(shares, pa.int32()), pa.array([len(k) for k in keys])]

    fields = [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("keys", "times")]
    return add_columns(docs, text, [*fields, T.StructField("n_keys", T.LongType())], make)


def fit_scorer(
    keys: list[np.ndarray], shares: list[np.ndarray], targets: np.ndarray, rounds: int = 30, rate: float = 0.5, decay: float = 1e-6
) -> np.ndarray:
    """Logistic regression on soft targets by adaptive gradient steps; the last weight is the constant."""
    weights, seen = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-8)
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(rounds if len(targets) else 0):
        for rows in np.array_split(order.permutation(len(targets)), max(1, len(targets) // 64)):
            at = np.concatenate([keys[i] for i in rows])
            value = np.concatenate([shares[i] for i in rows])
            row = np.repeat(np.arange(len(rows)), [len(keys[i]) for i in rows])
            score = np.bincount(row, weights[at] * value, len(rows)) + weights[-1]
            error = 1 / (1 + np.exp(-score)) - targets[rows]
            slope = np.bincount(at, error[row] * value, BUCKETS + 1) + decay * weights
            slope[-1] = error.mean()
            seen += slope * slope
            weights -= rate * slope / np.sqrt(seen)
    return weights


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """The label model from all documents, and the scorer from the sample."""
    counted = votes(docs.select(F.col(text).alias("text"))).groupBy("votes").agg(F.count("*").alias("n")).collect()
    patterns = np.array([r["votes"] for r in counted], np.int64).reshape(-1, HEURISTICS)
    counts = np.array([r["n"] for r in counted], float)
    labels = fit_label_model(patterns, counts)
    share = min(1.0, sample_rows / max(1.0, counts.sum()))
    place = (F.xxhash64(F.col(id), F.col(text)).bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)
    sample = docs.where(place < share).select(F.col(id).alias("id"), F.col(text).alias("text"))
    rows = _features(votes(sample), "text").select("id", "votes", "keys", "times").collect()
    rows.sort(key=lambda r: (r["id"] is None, r["id"], r["keys"]))
    targets = labels.posterior(np.array([r["votes"] for r in rows], np.int64).reshape(-1, HEURISTICS))
    keys = [np.array(r["keys"], np.int64) for r in rows]
    # Two features a word: shares add up to two.
    shares = [2 * np.array(r["times"], float) / max(1, sum(r["times"])) for r in rows]
    return QualityModel(labels, fit_scorer(keys, shares, targets))


#: A worker's word scores by the name of their model; one at a time.
_SCORES: dict[str, tuple[Memo, float]] = {}


def _word_scores(name: str, held: Broadcast) -> tuple[Memo, float]:
    """The sum of a word's two weights, remembered, and the constant."""
    if name not in _SCORES:
        weights = held.value.tolist()

        def total(word: bytes) -> float:
            plain, shaped = buckets(word)
            return weights[plain] + weights[shaped]

        _SCORES.clear()
        _SCORES[name] = Memo(total, MOST_WORDS), weights[-1]
    return _SCORES[name]


def score(docs: DataFrame, model: QualityModel, text: str = "text", least: float = 0.3) -> DataFrame:
    """``docs`` with ``score``, the probability of good, and ``kept``, whether it reaches ``least``."""
    worker_path(docs)
    # A fixed number of weights.
    held, name = docs.sparkSession.sparkContext.broadcast(model.weights), uuid.uuid4().hex

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        known, constant = _word_scores(name, held)
        scores = []
        for value in part.column(text).to_pylist():
            words = (value or "").encode().split()
            total = sum(map(known.__getitem__, words)) / len(words) + constant if words else -np.inf
            scores.append(float(1 / (1 + np.exp(-total))))
        return [pa.array(scores, pa.float64()), pa.array([s >= least for s in scores], pa.bool_())]

    return add_columns(docs, text, [T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())], make)
