from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import bpe
from tallyline.llm.common import blocks, pieces, ranks, vocabulary

from .rows import AWKWARD, clashing, documents

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def library():
    from public_tokenizers import PATTERN

    table = ranks(vocabulary(bpe.RANKS))
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def test_ids_are_the_librarys(spark, library):
    got = bpe.encode(documents(spark)).select("text", "ids").collect()
    assert len(got) == len(AWKWARD)
    assert all(r["ids"] == (library.encode_ordinary(r["text"]) if r["text"] else []) for r in got)


def test_random_texts(library):
    machine, draw = bpe.transducer(vocabulary(bpe.RANKS)), random.Random(5)
    tokens, known = list(machine.ranks), bpe.token_bytes(vocabulary(bpe.RANKS))
    for i in range(600):
        if i % 3 == 0:
            text = b"".join(draw.choice(tokens) for _ in range(draw.randint(1, 12))).decode("utf-8", "ignore")
        elif i % 3 == 1:
            text = "".join(draw.choice("aeinst ehr'\n1!") for _ in range(draw.randint(1, 80)))
        else:
            text = "".join(chr(draw.choice([draw.randint(32, 0x17F), draw.randint(0x4E00, 0x9FFF), 0x1F600])) for _ in range(40))
        ids = machine.encode(text)
        assert ids == library.encode_ordinary(text)
        assert bpe.decode_ids(known, np.array(ids, int), chunk=draw.randint(1, 5)) == text


def test_long_pieces_are_given_out_early(library):
    machine, draw = bpe.transducer(vocabulary(bpe.RANKS)), random.Random(6)
    for letters in ("etaoinshr", "a", "ab", "-=", "é中"):
        text = "".join(draw.choice(letters) for _ in range(9 * bpe.LOOKAHEAD))
        assert machine.encode(text) == library.encode_ordinary(text)


def test_every_other_vocabulary(library):
    # The plain vocabulary has other merges.
    from public_tokenizers import PATTERN

    path = vocabulary("byte_bpe_50k.tiktoken")
    other = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})
    for text in ("It's 2024, they'll say: naïve façade.\n\n  Done", "aaaaaaaaaaaaaaaa bbbb'''s"):
        assert bpe.transducer(path).encode(text) == other.encode_ordinary(text)


def test_stream_survives_any_cut():
    data = "é中😀".encode() + b"\xff\xe4\xb8" + b"z\xf0\x9f"
    for size in range(1, 6):
        stream = bpe.Utf8Stream()
        out = "".join(stream.feed(data[i : i + size]) for i in range(0, len(data), size)) + stream.end()
        assert out == data.decode("utf-8", "replace")


def test_blocks_are_piecewise(monkeypatch):
    monkeypatch.setattr("tallyline.llm.common.BLOCK_CHARS", 50)
    text = "It's a test,  with\n\n blanks 12 34 " * 30
    assert [p for b in blocks(text) for p in pieces(b)] == pieces(text)
    assert len(list(blocks(text))) > 5


def test_decoding_gives_the_text_back(spark):
    docs = clashing(documents(spark), "ids", "decoded")
    got = bpe.decode(bpe.encode(docs))
    assert got.columns.count("ids") == 1
    assert got.where(F.col("decoded") != F.coalesce("text", F.lit(""))).count() == 0


def test_round_trip_is_decode_of_encode(spark):
    docs = clashing(documents(spark), "ids", "decoded")
    once, twice = bpe.round_trip(docs), bpe.decode(bpe.encode(docs))
    assert sorted(once.columns) == sorted(twice.columns)
    assert once.exceptAll(twice.select(once.columns)).isEmpty() and once.count() == twice.count()
    assert "text" not in bpe.round_trip(docs, keep_text=False).columns
    assert bpe.round_trip(documents(spark, [])).isEmpty()


def test_long_pieces_outlast_forgotten_states(library):
    machine = bpe.Transducer(ranks(vocabulary(bpe.RANKS)), most_states=50, most_pieces=10)
    draw = random.Random(7)
    for n in (20, 400, 5 * bpe.LOOKAHEAD):
        text = "".join(draw.choice("etaoinshr") for _ in range(n))
        assert machine.encode(text) == library.encode_ordinary(text)


def test_unknown_and_null_ids(spark):
    got = bpe.decode(spark.createDataFrame([([5_000_000],), (None,), ([],)], "ids array<int>")).collect()
    assert [r["decoded"] for r in got] == ["\ufffd", "", ""]


def test_empty_table(spark):
    assert bpe.decode(bpe.encode(documents(spark, []))).count() == 0
