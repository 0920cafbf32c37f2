"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of all benchmark items (13 words; an item of fewer is one window) are the automaton's patterns. A
document is normalised (ASCII letters to lower case, other ASCII characters than letters and digits to blanks) and
scanned once; each match is mapped to words and, through their offsets, to spans of the original text.

Null and empty texts have no words and no matches; items without words have no window; items without an id mark
words but are not listed. Repeated items count once per id, repeated documents each. Empty tables give empty
results (documents) or no matches (items). Input columns named like a result are replaced.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.common import add_columns

WINDOW = 13
#: Benchmark text that one automaton holds; more is scanned by further automata, one after the other.
AUTOMATON_CHARS = 16_000_000
_KEPT = {c for c in range(256) if chr(c).isalnum() and c < 128 or c >= 128}
_NORMAL = bytes(ord(chr(c).lower()) if c < 128 and c in _KEPT else c if c in _KEPT else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")

_SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "first_word", "words")])
RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hits", T.ArrayType(_SPAN)),
]
_ARROW_SPAN = pa.struct([(n, pa.int64()) for n in _SPAN.names])


def normalise(text: str) -> bytes:
    """The text's bytes with one blank for each separator, so that offsets stay."""
    return text.encode().translate(_NORMAL)


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """The windows of an item."""
    if not words:
        return []
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class Scanner:
    """An automaton over the windows of some items."""

    def __init__(self, items: list[tuple[str | None, str]], size: int = WINDOW):
        import ahocorasick

        patterns: dict[bytes, set[str | None]] = {}
        for item, text in items:
            for window in windows(normalise(text).split(), size):
                patterns.setdefault(window, set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for window, ids in patterns.items():
            # Blanks around make words whole; bytes as Latin letters keep offsets equal to bytes.
            self.automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, ids))
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words (first, behind the last), and the items found."""
        if self.empty or not words:
            return [], set()
        joined = f" {b' '.join(words).decode('latin-1')} "
        matches = list(self.automaton.iter(joined))
        if not matches:
            return [], set()
        blanks = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        # A match ends at the blank behind its last word.
        for last, (_, (count, ids)) in zip(np.searchsorted(blanks, [m[0] for m in matches]).tolist(), matches):
            runs.append((last - count, last))
            items.update(i for i in ids if i is not None)
        return joined_runs(runs), items


def joined_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping runs of words as one."""
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a < out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def spans(text: str, data: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Runs of words with their offsets (code points, end exclusive) in the original text."""
    if not runs:
        return []
    places = [m.span() for m in _WORD.finditer(data)]
    # Code points before each byte: the bytes that don't continue a character.
    raw = np.frombuffer(text.encode(), np.uint8)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [
        {
            "start": int(points[places[a][0]]),
            "end": int(points[places[b - 1][1]]),
            "first_word": a,
            "words": b - a,
        }
        for a, b in runs
    ]


def item_blocks(items: DataFrame, item: str, text: str, most: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of at most ``most`` characters (a larger item is a block of its own)."""
    block: list[tuple[str | None, str]] = []
    held = 0
    for row in items.select(F.col(item).cast("string"), F.coalesce(F.col(text), F.lit(""))).toLocalIterator():
        if block and held + len(row[1]) > most:
            yield block
            block, held = [], 0
        block.append((row[0], row[1]))
        held += len(row[1])
    yield block


#: The automata of a worker by the name of their block; one at a time.
_BUILT: dict[str, Scanner] = {}


def _scanner(name: str, block: Broadcast, size: int) -> Scanner:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Scanner(block.value, size)
    return _BUILT[name]


def _scan_block(docs: DataFrame, text: str, block: Broadcast, size: int, more: bool) -> DataFrame:
    name = uuid.uuid4().hex

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        scanner = _scanner(name, block, size)
        found = part.column("items").to_pylist() if more else [[]] * len(part)
        hits = part.column("hits").to_pylist() if more else [[]] * len(part)
        rows = []
        for value, items, before in zip(part.column(text).to_pylist(), found, hits):
            data = normalise(value or "")
            words = data.split()
            runs, new = scanner.scan(words)
            runs = joined_runs(runs + [(h["first_word"], h["first_word"] + h["words"]) for h in before])
            rows.append((len(words), sum(b - a for a, b in runs), sorted(new | set(items)), spans(value, data, runs)))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(_ARROW_SPAN))
        return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]

    return add_columns(docs, text, RESULT, make)


def scan(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    most: int = AUTOMATON_CHARS,
) -> DataFrame:
    """``docs`` with their words, hit words, sorted ids of the items found, and the hit spans of the original text.

    An automaton's windows are broadcast, ``most`` characters of items at a time; a larger benchmark takes a pass
    over the documents for each such block, within the same stage and without a shuffle.
    """
    context = docs.sparkSession.sparkContext
    for i, block in enumerate(item_blocks(items, item, item_text, most)):
        docs = _scan_block(docs, text, context.broadcast(block), size, more=i > 0)
    return docs


def contaminated(n_hit: Column, n_words: Column, per: int = 20) -> Column:
    """Whether at least one word in ``per`` is hit."""
    return (n_hit > 0) & (per * n_hit >= n_words)
