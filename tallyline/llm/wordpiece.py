"""Token counts by a linear longest-match automaton.

A vocabulary trie gets a failure link and a count for each node: following the link from a node means that so many
pieces are finished, and the rest of what was read stands at the link's target. Counting the greedy longest-match
pieces of a word is then one walk over its bytes, without building pieces or going back.

Words are the letters' runs, single numbers, other runs and contractions of the lower-cased, composed text (as the
vocabulary's own splitter has them); white space is dropped. A word whose bytes the vocabulary can't cover counts
as one (unknown) token. Null and empty texts count 0. Rows are independent, so ties and repeated rows need no rule;
an empty table stays empty, and input columns named like a result are replaced.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyline.llm.common import (
    LETTER,
    NUMBER,
    SPACE,
    Memo,
    add_columns,
    blocks,
    character_classes,
    vocabulary,
)

PIECES = "word_bpe_49k.json"
WORD_END = "</w>"
MOST_WORDS = 250_000
#: The symbol behind a word's last byte.
END = 256


class LongestMatch:
    """The automaton of a set of pieces, each a tuple of symbols (bytes, and ``END`` behind a word)."""

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            node = 0
            for symbol in piece:
                if symbol not in self.next[node]:
                    self.next[node][symbol] = len(self.next)
                    self.next.append({})
                    final.append(False)
                node = self.next[node][symbol]
            final[node] = node > 0
        # Level by level: a node's link extends its parent's. -1: no way on.
        self.link, self.done = [-1] * len(self.next), [0] * len(self.next)
        queue = [0]
        for node in queue:
            for symbol, child in self.next[node].items():
                queue.append(child)
                if final[child]:
                    self.link[child], self.done[child] = 0, 1
                    continue
                at, done = self.link[node], self.done[node]
                while at >= 0 and symbol not in self.next[at]:
                    done += self.done[at]
                    at = self.link[at]
                if at >= 0:
                    self.link[child], self.done[child] = self.next[at][symbol], done

    def count(self, symbols: Iterable[int]) -> int | None:
        """The number of greedy longest-match pieces, or None if some symbol can't be covered."""
        node = total = 0
        for symbol in symbols:
            while symbol not in self.next[node]:
                if self.link[node] < 0:
                    return None
                total += self.done[node]
                node = self.link[node]
            node = self.next[node][symbol]
        while node:
            if self.link[node] < 0:
                return None
            total += self.done[node]
            node = self.link[node]
        return total


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes: themselves if printable, else from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def vocabulary_pieces(path: str) -> list[tuple[int, ...]]:
    """The pieces of a vocabulary file with word ends, as symbols."""
    letters = byte_alphabet()
    with open(path, encoding="utf-8") as file:
        words = json.load(file)["model"]["vocab"]
    out = []
    for word in words:
        ends = word.endswith(WORD_END)
        body = word[: -len(WORD_END)] if ends else word
        out.append(tuple(letters[c] for c in body) + ((END,) if ends else ()))
    return out


def words(text: str) -> list[str]:
    """The words of a text that is in lower case."""
    if not text:
        return []
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = character_classes()[codes]
    begins = np.empty(len(codes) + 1, bool)
    begins[0] = begins[-1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=begins[1:-1])
    begins[:-1] |= kinds == NUMBER
    quotes = np.flatnonzero(codes[:-1] == 0x27)
    for i in quotes[begins[quotes] & (kinds[quotes + 1] == LETTER)].tolist():
        two = text[i + 1 : i + 3]
        n = 2 if two[:1] in ("s", "t", "m", "d") else 3 if two in ("re", "ve", "ll") else 0
        if n:
            begins[i + 1 : i + n] = False
            begins[i + n] = True
    cuts = np.flatnonzero(begins)
    kept = np.flatnonzero(kinds[cuts[:-1]] != SPACE)
    return [text[a:b] for a, b in zip(cuts[kept].tolist(), cuts[kept + 1].tolist())]


def normal(text: str) -> str:
    """Composed and in lower case."""
    return unicodedata.normalize("NFC", text).lower()


@lru_cache(maxsize=2)
def counter(path: str) -> Memo:
    """Token counts of words, remembered."""
    automaton = LongestMatch(vocabulary_pieces(path))

    def count(word: str) -> int:
        found = automaton.count([*word.encode(), END])
        return 1 if found is None else found

    return Memo(count, MOST_WORDS)


def token_counts(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``n_words`` and ``n_tokens`` of ``text``."""
    path = path or vocabulary(PIECES)

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        known = counter(path)
        n_words, n_tokens = [], []
        for value in part.column(text).to_pylist():
            found = [w for block in blocks(value or "") for w in words(normal(block))]
            n_words.append(len(found))
            n_tokens.append(sum(map(known.__getitem__, found)))
        return [pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())]

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return add_columns(docs, text, fields, make)
