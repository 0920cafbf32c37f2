"""The registered queries over the smallest tables, against brute force where no SQL is registered."""

from __future__ import annotations

import hashlib

import duckdb
import pytest

from compare import difference, open_tables
from tallyline.llm import chat, minhash
from tallyline.llm import queries as registered
from tallyline.llm.common import ranks, vocabulary

from .test_fertility import brute as brute_counts
from .test_secrets import brute as brute_secrets
from .test_wordpiece import greedy


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def tables(folder):
    return open_tables(folder)


def rows(connection: duckdb.DuckDBPyConnection, sql):
    return connection.execute(sql).fetchall()


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_sql_agrees(spark, folder, tables, name):
    assert difference(registered.QUERIES[name](spark, folder), tables, registered.ORACLES[name]) is None


def test_op1(spark, folder, tables):
    got = registered.QUERIES["op1_weak_quality"](spark, folder).collect()
    assert len(got) == rows(tables, "SELECT count(*) FROM documents")[0][0]


def test_op2(spark, folder, tables):
    expected = {}
    for conv, _, role, text in sorted(rows(tables, "SELECT conv_id, turn, role, coalesce(text, '') FROM conversations")):
        expected.setdefault(conv, []).append((role, text))
    control = chat.END + chat.START + "assistant ok"
    expected[-1] = [("user", control), ("assistant", control)]
    got = registered.QUERIES["op2_chat_format"](spark, folder).collect()
    assert len(got) == len(expected)
    for r in got:
        turns = expected[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
        assert r["formatted_chars"] == len(chat.render(turns)[0])


def test_op3(spark, folder, tables):
    texts = dict(rows(tables, "SELECT doc_id, text FROM documents"))
    got = registered.QUERIES["op3_fertility_rules"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_counts(texts[r["doc_id"]])


def test_op4(spark, folder, tables):
    tiktoken = pytest.importorskip("tiktoken")
    from public_tokenizers import PATTERN

    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(vocabulary("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = dict(rows(tables, "SELECT doc_id, text FROM documents"))
    for r in registered.QUERIES["op4_bpe_round_trip"](spark, folder).collect():
        ids = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == sha(",".join(map(str, ids)))
        assert r["decoded_sha256"] == sha(texts[r["doc_id"]] or "")


def test_op7(spark, folder, tables):
    texts = dict(rows(tables, "SELECT doc_id, text FROM documents"))
    got = registered.QUERIES["op7_secret_scan"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        spans = brute_secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        assert set(f"{k}:{a}:{b}" for k, a, b in spans) <= set(r["spans"].split(",")) | {""}


def test_op9(spark, folder, tables):
    from tallyline.llm import wordpiece

    pieces = set(wordpiece.vocabulary_pieces(vocabulary(wordpiece.PIECES)))
    texts = dict(rows(tables, "SELECT doc_id, text FROM documents ORDER BY length(text) LIMIT 40"))
    got = {r["doc_id"]: r for r in registered.QUERIES["op9_token_counts"](spark, folder).collect()}
    for i, text in texts.items():
        found = wordpiece.words(wordpiece.normal(text or ""))
        assert got[i]["n_tokens"] == sum(greedy([*w.encode(), wordpiece.END], pieces) or 1 for w in found)


def test_op10_components(spark, folder, tables):
    from .test_minhash import brute

    texts = rows(tables, "SELECT doc_id, text FROM documents")
    got = registered.QUERIES["op10_near_duplicates"](spark, folder).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(texts, 2, 80)
    assert minhash.BANDS * minhash.ROWS == minhash.HASHES
