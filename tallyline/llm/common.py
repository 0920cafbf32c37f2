"""Shared pieces: columns added batch by batch, vocabulary files, and the public piece pattern."""

from __future__ import annotations

import base64
import gc
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Text handed to a batch function at a time, so that memory follows one slice and not one Arrow batch.
SLICE_BYTES = 4 << 20


def worker_path(df: DataFrame) -> None:
    """Let Python workers import this package when it is not installed (a shared or local checkout)."""
    root = str(Path(__file__).resolve().parents[2])
    env = df.sparkSession.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def without(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of ``df`` except those (in any case) that a result replaces."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``SLICE_BYTES`` of ``column``; one huge value is a run of its own."""
    values = batch.column(column)
    lists = pa.types.is_list(values.type)
    sizes = pc.multiply(pc.list_value_length(values), 4) if lists else pc.binary_length(values)
    sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n) + 16
    if start < len(sizes):
        yield batch.slice(start)


def add_columns(
    df: DataFrame,
    column: str,
    fields: list[T.StructField],
    make: Callable[[pa.RecordBatch], list[pa.Array]],
    drop: list[str] | None = None,
) -> DataFrame:
    """``df`` with the columns that ``make`` computes from each run of rows; a column of the same name is replaced.

    ``column`` is the text column by which runs are cut. Columns to ``drop`` are read and not given out.
    """
    worker_path(df)
    kept = without(df, [*(f.name for f in fields), *(drop or [])])
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    names = [*kept, *(f.name for f in fields)]

    def run(batches):
        for batch in batches:
            for part in slices(batch, column):
                gc.disable()  # the workers' tables hold many objects and no cycles
                try:
                    made = make(part)
                finally:
                    gc.enable()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], names)

    return df.mapInArrow(run, schema)


def vocabulary(name: str) -> str:
    """The place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, as a rank file has them."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


OTHER, LETTER, NUMBER, SPACE = range(4)


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    """For each code point: a letter, a number, white space, or something else.

    The classes are asked of the tokeniser library's own pattern engine (an encoding of single bytes keeps just
    what its pattern matches), because engines follow different versions of Unicode.
    """
    import tiktoken

    table = np.zeros(0x110000, np.uint8)
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    for kind, members in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        engine = tiktoken.Encoding(members, pat_str=members, mergeable_ranks=single, special_tokens={})
        found = bytes(engine.encode_ordinary(points)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return table


def piece_starts(text: str) -> np.ndarray:
    """Where the matches of the public piece pattern begin in a text that is not empty.

    The pattern's matches cover the text. They are the runs of one character class, except that a blank before a
    run joins it, white space before something else is cut in front of its last character, and a contraction
    (an apostrophe that begins a match, with one of seven endings) is a match of its own.
    """
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = character_classes()[codes]
    begins = np.empty(len(codes) + 1, bool)
    begins[0] = begins[-1] = True
    np.not_equal(kinds[1:], kinds[:-1], out=begins[1:-1])
    # The last white space before another class: a blank joins what follows, others stand alone.
    last = np.flatnonzero((kinds[:-1] == SPACE) & begins[1:-1])
    begins[last] = True
    begins[last[codes[last] == 0x20] + 1] = False
    quotes = np.flatnonzero(codes[:-1] == 0x27)
    if len(quotes):
        quotes = quotes[begins[quotes] & (kinds[quotes + 1] == LETTER)]
        for i in quotes.tolist():
            two = text[i + 1 : i + 3]
            n = 2 if two[:1] in ("s", "t", "m", "d") else 3 if two in ("re", "ve", "ll") else 0
            if n and begins[i]:
                begins[i + 1 : i + n] = False
                begins[i + n] = True
    return np.flatnonzero(begins)


def pieces(text: str) -> list[str]:
    """All matches of the public piece pattern, in order."""
    if not text:
        return []
    cuts = piece_starts(text).tolist()
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


#: Characters of a text that are cut into pieces at a time.
BLOCK_CHARS = 1 << 20


def blocks(text: str) -> Iterator[str]:
    """A text in runs of about ``BLOCK_CHARS``, each beginning where every piece pattern begins a match.

    That is at a blank after something that is not white space; without such a place the run goes on.
    """
    start = 0
    while len(text) - start > BLOCK_CHARS:
        found = BLOCK_START.search(text, start + BLOCK_CHARS)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


BLOCK_START = re.compile(r"(?<=[!-~]) ")


_HELD: dict = {"by": None, "tables": {}}


def held(by: str, key: tuple, make: Callable[[], object]) -> object:
    """A worker's heavy tables, made once; those of one operator (``by``) at a time.

    A worker process serves many stages. When it turns to another operator it drops the tables of the one before, so its
    memory is that of the largest operator and not of all.
    """
    if _HELD["by"] != by:
        _HELD.update(by=by, tables={})
        ranks.cache_clear()
        gc.collect()  # memories refer to their owners
        pa.default_memory_pool().release_unused()
    if key not in _HELD["tables"]:
        _HELD["tables"][key] = make()
    return _HELD["tables"][key]


def list_array(rows: list[list[int]], kind: pa.DataType) -> pa.ListArray:
    """Rows of integers as one list column."""
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    flat = np.fromiter(chain.from_iterable(rows), np.int64, int(ends[-1]))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat).cast(kind))


class Memo(dict):
    """A bounded memory of a function of one value.

    When ``most`` values are held they become the older half, which lasts until the next time; what is asked for
    again moves to the younger half, so frequent values stay.
    """

    def __init__(self, make: Callable, most: int, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.older = make, most, longest, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value
