"""The pipeline against its stages carried out one by one in plain Python."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from tallyline.llm import decontaminate, fertility, minhash
from tallyline.llm.bpe import transducer
from tallyline.llm.common import vocabulary

from .rows import AWKWARD
from .test_decontaminate import brute as brute_hits
from .test_minhash import brute as brute_components
from .test_secrets import brute as brute_secrets


def stage_names():
    return [name for name, _ in corpus_pipeline.STAGES]


def marked(text):
    runs = []
    for _, a, b in sorted(brute_secrets(text), key=lambda s: (s[1], s[2])):
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    out, at = [], 0
    for a, b in runs:
        out += [text[at:a], "[SECRET]"]
        at = b
    return "".join([*out, text[at:]])


def test_run_is_the_stages_by_hand(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    kept = [r["doc_id"] for r in fertility.judge_ids(docs).where("kept").collect()]
    part = brute_components([(i, texts[i]) for i in kept], 5, 80)
    kept = [i for i in kept if part[i] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hits = {i: brute_hits(texts[i], items) for i in kept}
    kept = [i for i in kept if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])]
    machine = transducer(vocabulary("byte_bpe_multi_50k.tiktoken"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(got) == set(kept) and len(stage_names()) == 5
    assert all(got[i]["ids"] == machine.encode(marked(texts[i])) and got[i]["round_trip"] for i in kept)


def test_stages_keep_columns_and_awkward_rows(spark, folder):
    rows = [(i, t, lang, "src", len(t or "")) for i, t, lang in AWKWARD]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("mine") for c in ("n_words", "kept", "spans", "row", "n_hit", "items", "votes")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.where("n_words <> 'mine' OR kept <> 'mine'").count() == 0
        assert stage(spark, docs.limit(0), folder).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.count() == len(rows) and last.where("NOT round_trip").count() == 0


def test_decisions_take_effect(spark, folder):
    items = spark.read.parquet(f"{folder}/benchmark.parquet").where("length(text) > 100").limit(1).collect()
    good = " ".join(f"word{i}x" for i in range(200))
    rows = [
        (1, items[0]["text"], "en", "s", 1),
        (2, good, "en", "s", 1),
        (3, good + " more", "en", "s", 1),
        (4, good.replace("x", "y") + " token=abcdefgh1", "en", "s", 1),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ids = lambda f: sorted(r["doc_id"] for r in f(spark, docs, folder).collect())
    assert ids(corpus_pipeline.near_duplicates) == [1, 2, 4]
    assert ids(corpus_pipeline.benchmark_decontamination) == [2, 3, 4]
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.secret_scan(spark, docs, folder).collect()}
    assert text[4][0].endswith(" [SECRET]") and text[4][1] == len(text[4][0]) and text[2] == (good, 1)
    assert decontaminate.WINDOW == 13 and minhash.MARGIN > 4 * 0.03


def test_repeated_ids_keep_one_copy_and_the_other_text(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (1, text), (2, text), (2, "quite another text with words of its own"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_shingles", F.lit("mine"))
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == ["doc_id", "text", "n_shingles"]
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == sorted(
        [("1", text), ("2", "quite another text with words of its own"), ("None", text)]
    )
