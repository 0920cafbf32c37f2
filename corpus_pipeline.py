"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.

An empty table passes every stage. Further columns of ``docs`` pass through all stages, also those named like an
operator's own result, which is computed under another name or left out. Nulls: a document without text fails the
quality rules; rows without an id are never near duplicates. Rows that share an id are judged each by its own text; of
rows that share id and text one stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import bpe, decontaminate, fertility, minhash, secrets
from tallyline.session import cut_lineage, shared_folder


def _packed(docs: DataFrame) -> DataFrame:
    """The text, and a struct ``row`` of all other columns, so that results can't clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")


def _unpacked(packed: DataFrame, names: list[str]) -> DataFrame:
    return packed.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's fertility bands."""
    judged = fertility.judge(_packed(docs), lang="row.lang")
    return _unpacked(judged.where("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents (five-word shingles, similarity 0.8)."""
    key = ["doc_id", "_text_hash"]
    found = cut_lineage(minhash.near_duplicates(docs, size=5, percent=80).withColumnRenamed("text_hash", key[1]))
    dropped = found.where("NOT kept").select(*key).distinct()
    left = docs.withColumn(key[1], F.md5(F.coalesce("text", F.lit("")))).join(dropped, key, "left_anti")
    # Whole repeated rows of what is kept: one of each.
    repeated = found.where("kept AND n_shingles > 0").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    if not repeated.isEmpty():
        once = left.join(repeated, key, "left_semi").dropDuplicates(key)
        left = left.join(repeated, key, "left_anti").unionByName(once)
    return left.select(*[f"`{c}`" for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a considerable share of benchmark text."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    scanned = decontaminate.scan(_packed(docs), items)
    return _unpacked(scanned.where(~decontaminate.contaminated(F.col("n_hit"), F.col("n_words"))), docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret; ``n_chars`` follows the text."""
    found = secrets.redact(secrets.scan(_packed(docs)))
    length = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))
    return _unpacked(found.withColumn("row", F.col("row").withField("n_chars", length)), docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left, and whether they decode to its text."""
    # Workers that have carried out the other stages have less memory left than in a job of this stage alone.
    rows = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), most_states=100_000, most_pieces=60_000)
    return rows.select(
        "doc_id",
        "lang",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("bpe_encoding", encode),
]

#: The quality rules ask tokenisers, which SQL can't express; tests compare the run with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read again."""
    place = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{place}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
