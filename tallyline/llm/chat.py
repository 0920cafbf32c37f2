"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, each turn as ``<|im_start|>role<|im_sep|>text<|im_end|>``, and encoded once with
offsets; a token is under the loss mask where its span meets an assistant text's span, found by binary search in
the sorted spans of the turns. The three control strings are single tokens, so no token crosses a turn's edge.

Inside roles and texts every ``<``, any backslashes and ``|`` in a row get one backslash more, so no control string
can stand in them; taking one away gives the text back.

Null roles and texts are empty; a null turn comes first, and rows of one turn are ordered by role and text. Repeated
rows are turns of their own. Rows without a conversation id make one conversation. An empty table gives no
conversation. Only the four named columns are read, so others can't clash. A conversation has to fit a task, as
the whole of it is one text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.common import list_array, vocabulary, worker_path

VOCABULARY = "byte_bpe_50k.json"
START, SEPARATOR, END = CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
ASSISTANT = "assistant"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(f"{re.escape(START)}(.*?){re.escape(SEPARATOR)}(.*?){re.escape(END)}", re.DOTALL)
#: Conversations encoded at a time.
CHUNK = 256
LISTS = ("ids", "starts", "ends", "loss_mask", "turn_starts", "turn_ends")
RESULT = "formatted string, " + ", ".join(f"{c} array<int>" for c in LISTS)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the assistant's texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEPARATOR}", escape(text)
        if role == ASSISTANT and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts back from a formatted conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def under_mask(formatted: str, starts: list[int], ends: list[int], mask: list[int]) -> list[str]:
    """The unescaped runs of text under a mask; tokens that share a character or touch are one run."""
    runs: list[list[int]] = []
    for a, b, on in zip(starts, ends, mask):
        if on and b > a:
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
    return [unescape(formatted[a:b]) for a, b in runs]


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer, pre_tokenizers

    made = Tokenizer.from_file(path)
    # Offsets keep the blanks that tokens begin with.
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False)
    made.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROLS])
    return made


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for tokens that meet one of the sorted, disjoint spans."""
    if not spans:
        return np.zeros(len(starts), np.int64)
    begins, stops = (np.array(x) for x in zip(*spans))
    # The only span that can hold a token's first character is the last that begins before the token's end.
    at = np.searchsorted(begins, ends, side="left") - 1
    return ((at >= 0) & (starts < stops[np.maximum(at, 0)])).astype(np.int64)


def format_conversations(conversations: DataFrame, path: str | None = None) -> DataFrame:
    """One row per conversation: conv_id and its formatted text, ids, token spans, loss mask and assistant spans."""
    worker_path(conversations)
    path = path or vocabulary(VOCABULARY)
    turn = F.struct(
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = whole.select(F.col("conv_id").cast("long").alias("conv_id"), F.expr("turns.role AS roles"), F.expr("turns.text AS texts"))

    def run(batches):
        coder = tokenizer(path)
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.slice(at, CHUNK)
                rendered = [
                    render(list(zip(roles, texts)))
                    for roles, texts in zip(part.column("roles").to_pylist(), part.column("texts").to_pylist())
                ]
                columns: list[list] = [[] for _ in range(6)]
                found = coder.encode_batch([r[0] for r in rendered], add_special_tokens=False)
                for encoding, (_, spans) in zip(found, rendered):
                    offsets = np.array(encoding.offsets, np.int64).reshape(-1, 2)
                    starts, ends = offsets[:, 0], offsets[:, 1]
                    mask = loss_mask(starts, ends, spans)
                    row = (encoding.ids, starts, ends, mask, [s[0] for s in spans], [s[1] for s in spans])
                    for column, value in zip(columns, row):
                        column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), pa.array([r[0] for r in rendered], pa.string())]
                    + [list_array(c, pa.int32()) for c in columns],
                    ["conv_id", "formatted", *LISTS],
                )

    return whole.mapInArrow(run, f"conv_id long, {RESULT}")

