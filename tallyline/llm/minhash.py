"""Near-duplicate documents by b-bit MinHash.

Each document's word shingles give 192 minima. Groups of six minima are band keys; of each minimum the four low
bits are kept, sixteen to a long. Documents that share a band key are candidates; counting the equal groups of
bits and correcting for chance agreement estimates their similarity, and what may reach the threshold is confirmed
on the full shingle sets.

Only components are wanted, so a bucket's pairs are never all made:

1. Documents with the same word sequence are one class, stood for by its smallest id.
2. Each class is compared with the smallest one of its buckets that may reach the threshold, then, where their components
   still differ, with the smallest ones of its other buckets. So a close copy costs one pair of texts and not one per bucket.
3. In buckets that still hold several components, each class is compared with two others drawn for the bucket, if
   their components differ.
4. Classes of buckets that still hold several components are the rest. They are compared by their rarest shingles: two
   sets of given sizes reach the threshold only if they share one of their first shingles in a common order, early
   enough in both. So only such pairs are made, which copies that are similar, but all below the threshold, do not have: their first
   shingles are their own. Shingles of one component only are left out, and of the others the classes
   outside the shingle's largest component are compared with the rest. This is exact: nothing is capped.

A pair at the threshold shares no band with a probability of 6e-5; an estimate has a standard deviation of 0.03,
and the filter leaves a margin of 0.13.

Nulls and texts without words have no shingles, are linked with nothing and kept. Rows without an id are linked
with nothing, and kept. Rows that share an id are judged each by its own text, which ``text_hash`` tells apart; texts
whose smallest id is the same are linked by it. An empty table gives an empty result. Only the id and
text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from contextlib import contextmanager
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.common import Memo, add_columns, held, worker_path
from tallyline.session import cut_lineage, shared_folder, shuffles_freed

HASHES, ROWS, BITS = 192, 6, 4
BANDS, PER_LONG = HASHES // ROWS, 64 // BITS
#: How far below the threshold an estimate may lie.
MARGIN = 0.13
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Hashes of words that a worker remembers.
MOST_WORDS = 40_000
#: Cells of the sketch of shingle frequencies, and the step between size classes, in the exact rest.
CELLS, CLASS_STEP = 1 << 18, 1.03


def words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, ASCII letters in lower case."""
    return (text or "").encode().translate(_LOWER).split()


def shingles(found: list[bytes], size: int) -> set:
    """The distinct shingles; a shorter text is one shingle."""
    if len(found) < size:
        return {tuple(found)} if found else set()
    return set(zip(*(found[i:] for i in range(size))))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def hashed_shingles(found: list[bytes], size: int) -> np.ndarray:
    """Distinct 64-bit values of the shingles."""
    known = held("minhash", ("words",), lambda: Memo(xxhash.xxh3_64_intdigest, MOST_WORDS))
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(size, len(h)), np.uint64)
    for i in range(min(size, len(h))):
        out = _mixed(out * _MIX + h[i : i + n])
    return np.unique(out)


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(20_240_601))
    return (
        draw.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1),
        draw.integers(0, 1 << 32, HASHES, dtype=np.uint32),
        draw.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1),
    )


def minima(values: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function, over blocks of shingles that fit the cache."""
    a, b, _ = _functions()
    x = (values >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 256):
        np.minimum(low, (x[i : i + 256, None] * a + b).min(axis=0), out=low)
    return low


def packed(low: np.ndarray) -> np.ndarray:
    """The low bits of the minima, sixteen to a long."""
    bits = ((low ^ (low >> np.uint32(15))) & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, PER_LONG)
    return (bits << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    """One key per band, different between bands."""
    _, _, factors = _functions()
    rows = low.astype(np.uint64).reshape(BANDS, ROWS)
    mixed = _mixed(rows + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None] * _MIX)
    return _mixed((mixed * factors).sum(axis=1, dtype=np.uint64)).view(np.int64)


def signatures(docs: DataFrame, text: str = "text", size: int = 5) -> DataFrame:
    """``docs`` with ``n_shingles``, ``sequence`` (a digest of the words), ``sig`` and ``bands`` (null without words)."""

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        counts, sequences, sigs, bands = [], [], [], []
        for value in part.column(text).to_pylist():
            found = words(value)
            if not found:
                counts.append(0)
                sequences.append(None)
                sigs.append(None)
                bands.append(None)
                continue
            hashed = hashed_shingles(found, size)
            low = minima(hashed)
            counts.append(len(hashed))
            sequences.append(hashlib.blake2b(b" ".join(found), digest_size=20).digest())
            sigs.append(packed(low))
            bands.append(band_keys(low))
        longs = pa.list_(pa.int64())
        return [
            pa.array(counts, pa.int64()),
            pa.array(sequences, pa.binary()),
            pa.array(sigs, longs),
            pa.array(bands, longs),
        ]

    longs = T.ArrayType(T.LongType())
    fields = [
        T.StructField("n_shingles", T.LongType()),
        T.StructField("sequence", T.BinaryType()),
        T.StructField("sig", longs),
        T.StructField("bands", longs),
    ]
    return add_columns(docs, text, fields, make)


def estimate(left: Column, right: Column) -> Column:
    """Similarity from two packed signatures: the share of equal groups of bits, less what chance makes equal."""
    ones = F.lit(int("1" * PER_LONG, 16))
    unequal = []
    for i in range(HASHES // PER_LONG):
        x = left[i].bitwiseXOR(right[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        unequal.append(F.bit_count(x.bitwiseAND(ones)))
    chance = 1 / (1 << BITS)
    return ((1 - reduce(lambda a, b: a + b, unequal) / HASHES) - chance) / (1 - chance)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b, and further columns of longs) whose full shingle sets reach ``percent``."""
    worker_path(pairs)
    columns = pairs.columns
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(
        texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a"
    )

    def run(batches):
        held, held_text = set(), None
        for batch in batches:
            out = []
            for i, (text_a, text_b) in enumerate(zip(batch.column("text_a"), batch.column("text_b"))):
                # One pair of texts at a time leaves Arrow's memory.
                if held_text is None or text_a != held_text:
                    held, held_text = shingles(words(text_a.as_py()), size), text_a
                other = shingles(words(text_b.as_py()), size)
                common = len(held & other)
                if 100 * common >= percent * (len(held) + len(other) - common):
                    out.append(i)
            yield batch.select(columns).take(pa.array(out, pa.int64()))

    return both.select(*columns, "text_a", "text_b").mapInArrow(run, ", ".join(f"{c} long" for c in columns))


def _least_common(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """How many shingles sets of these sizes have to share."""
    return -(-percent * (a + b) // (100 + percent))


def shingle_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How often shingles occur in the documents, by cells of their hashes: a sketch of fixed size."""
    worker_path(texts)

    def run(batches):
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                found = words(text.as_py())
                if found:
                    counts += np.bincount((hashed_shingles(found, size) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], ["cell", "n"])

    # At most ``CELLS`` rows.
    rows = texts.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CELLS, np.int64)
    for cell, n in rows:
        counts[cell] = n
    return counts


def first_shingles(texts: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """The shingles by which documents (``id``, ``text``, ``component``) can meet, rarest first.

    shingle, class (of sizes), asks (this row looks for smaller or equal sets; else it is found by them), id, component, n (shingles), place.
    """
    worker_path(texts)
    width = math.log(CLASS_STEP)

    def class_of(n: int) -> int:
        return int(math.log(n) / width + 1e-9)

    def of(n: int) -> tuple[list[np.ndarray], list[int], list[bool]]:
        # Found by sets of the same size or larger ones: least of all by its own size.
        places, classes, asks = [np.arange(n - _least_common(n, n, percent) + 1)], [class_of(n)], [False]
        least = -(-percent * n // 100)
        for c in range(class_of(least), class_of(n) + 1):
            low = max(least, math.ceil(CLASS_STEP**c - 1e-6) - 1)
            places.append(np.arange(max(0, n - _least_common(n, low, percent) + 1)))
            classes.append(c)
            asks.append(True)
        return places, classes, asks

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                made = []
                for id_, component, text in zip(part.column("id").to_pylist(), part.column("component").to_pylist(), part.column("text")):
                    hashed = hashed_shingles(words(text.as_py()), size)
                    n = len(hashed)
                    ordered = hashed[np.lexsort((hashed, counts[(hashed % np.uint64(CELLS)).astype(np.int64)]))].view(np.int64)
                    places, classes, asks = of(n)
                    sizes = [len(p) for p in places]
                    at = np.concatenate(places)
                    every = len(at)
                    made.append((ordered[at], np.repeat(classes, sizes), np.repeat(asks, sizes), np.full(every, id_), np.full(every, component), np.full(every, n), at))
                columns = [np.concatenate(c) for c in zip(*made)]
                kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    names = ["shingle", "class", "asks", "id", "component", "n", "place"]
    return texts.select("id", "component", "text").mapInArrow(
        run, "shingle long, class long, asks boolean, id long, component long, n long, place long"
    )


def meeting(rest: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of documents (``id``, ``component``, ``text``) of different components that may reach ``percent``."""
    return _meeting(rest, size, percent).select("a", "b")


def _meeting(rest: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs of ``meeting`` with their components (of_a, of_b)."""
    rows = first_shingles(rest, shingle_counts(rest, size), size, percent)
    key = ["shingle", "class"]
    sizes = rows.groupBy(*key, "component").agg(F.count("*").alias("size"), F.max("asks").alias("asked"), F.min("asks").alias("all_ask"))
    mixed = (
        sizes.groupBy(*key)
        .agg(F.max(F.struct("size", "component"))["component"].alias("largest"), F.count("*").alias("parts"), F.max("asked").alias("asked"), F.min("all_ask").alias("all_ask"))
        .where("parts > 1 AND asked AND NOT all_ask")
        .drop("parts", "asked", "all_ask")
    )
    shared = cut_lineage(rows.join(mixed, key))
    some = shared.where("component <> largest").select(*key, *(F.col(c).alias(f"its_{c}") for c in ("asks", "id", "component", "n", "place")))
    larger, smaller = (F.when(F.col("asks"), F.col(x)).otherwise(F.col(y)) for x, y in (("n", "its_n"), ("its_n", "n")))
    left = F.least(F.col("n") - F.col("place"), F.col("its_n") - F.col("its_place"))
    enough = (100 + percent) * left >= percent * (F.col("n") + F.col("its_n"))
    return (
        some.join(shared, key)
        .where((F.col("asks") != F.col("its_asks")) & (F.col("component") != F.col("its_component")) & (larger >= smaller) & enough)
        .where("component = largest OR asks")
        .select(_pair("its_id", "its_component", "id", "component"))
        .select("pair.*")
        .distinct()
    )


def _pair(id: str, component: str, other: str, its: str) -> Column:
    """Two documents as ``pair``: a, of_a (its component), b and of_b; a is the smaller."""
    ends = F.array_sort(F.array(F.struct(F.col(id).alias("id"), F.col(component).alias("of")), F.struct(F.col(other).alias("id"), F.col(its).alias("of"))))
    return F.struct(ends[0]["id"].alias("a"), ends[0]["of"].alias("of_a"), ends[1]["id"].alias("b"), ends[1]["of"].alias("of_b")).alias("pair")


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The different edges (u, v), kept, and their state: how many they are, and a sum of their hashes."""
    seen = Observation()
    edges = edges.where("u <> v").distinct()
    kept = cut_lineage(edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("hash")))
    return kept, (seen.get["n"], seen.get["hash"])


def _edges(links: DataFrame) -> tuple[DataFrame, tuple]:
    """Links (a, b) as edges from the larger to the smaller vertex, and their state."""
    return _counted(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))


def _stars(edges: DataFrame, state: tuple) -> DataFrame:
    """The edges turned into one star per component: (id, component), for vertices but the smallest.

    Alternating large-star and small-star steps; each keeps a vertex's neighbours as rows, so a vertex of any
    degree is spread over tasks. Stars stay as they are, so the steps end when the edges do.
    """
    before = None
    while state != before and state[0]:
        # Large star: a vertex's larger neighbours are joined to the smallest one.
        around = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = edges.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v"))
        # Small star: a vertex and its smaller neighbours are joined to the smallest one.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))))
        before = state
        edges, state = _counted(small.select(F.col("v").alias("u"), F.col("m").alias("v")))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))


def components(links: DataFrame) -> DataFrame:
    """The smallest vertex that each vertex of the links (a, b) reaches: (id, component), for linked vertices."""
    return _stars(*_edges(links))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (id, component) after further links (a, b) of components: only the components that the links join are worked on."""
    edges, state = _edges(links)
    if not state[0]:
        return labels
    new = _stars(edges, state).select(F.col("id").alias("component"), F.col("component").alias("smallest"))
    return cut_lineage(
        labels.join(new, "component", "left").select("id", F.coalesce("smallest", "component").alias("component"))
    )


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose components (of_a, of_b) differ."""
    ends = [labels.select(F.col("id").alias(x), F.col("component").alias(f"of_{x}")) for x in "ba"]
    return pairs.join(ends[0], "b").join(ends[1], "a").where("of_a <> of_b").select("a", "of_a", "b", "of_b")


@contextmanager
def stored(df: DataFrame):
    """``df`` as a table in the shared folder, for as long as the block lasts: smaller than a checkpoint, and gone after it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/texts-{uuid.uuid4().hex}"
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``id``, ``n_shingles``, ``component_id``, ``kept`` (it is its component's smallest id), ``text_hash``."""
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    with shuffles_freed(docs.sparkSession):
        signed, classes, labels = _labelled(docs, size, percent)
    of_class = (
        classes.join(labels, "id", "left").select("sequence", F.coalesce("component", "id").alias("component_id"))
    )
    return (
        signed.join(of_class, "sequence", "left")
        .select(
            F.col("id").alias("doc_id"),
            "n_shingles",
            F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
            "text_hash",
        )
        .withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id", "kept", "text_hash")
    )


def _labelled(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row (id, n_shingles, sequence, text_hash), the classes (sequence, id) and the components of those that share a bucket (id, component)."""
    signed = cut_lineage(signatures(docs, "text", size).withColumn("text_hash", F.md5(F.coalesce("text", F.lit("")))).drop("text"))
    classes = cut_lineage(
        signed.where("id IS NOT NULL AND n_shingles > 0")
        .groupBy("sequence")
        .agg(F.min(F.struct("id", "sig", "bands")).alias("c"))
        .select("sequence", "c.id", "c.sig", "c.bands")
    )
    every = classes.select("id", F.explode("bands").alias("key"))
    shared = every.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1")
    members = cut_lineage(every.join(shared, "key"))
    needed = members.select("id").distinct()
    sigs = cut_lineage(classes.select("id", "sig").join(needed, "id", "left_semi"))
    least = percent / 100 - MARGIN

    def likely(pairs: DataFrame) -> DataFrame:
        """The pairs whose estimate may reach the threshold."""
        return (
            pairs.distinct()
            .join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
            .join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
            .where(estimate(F.col("sig_a"), F.col("sig_b")) >= least)
            .select(*pairs.columns)
        )

    # Buckets with classes, besides the compared one, of several components.
    def divided(labels: DataFrame) -> DataFrame:
        found = members.join(labels, "id")
        mixed = (
            found.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
        )
        return found.join(mixed.select("key"), "key", "left_semi")

    def drawn(seed: int) -> Column:
        return F.min(F.struct(F.xxhash64(F.lit(seed), "id", "key").alias("order"), "id", "component")).alias(f"d{seed}")

    with stored(docs.join(needed, "id", "left_semi")) as texts:

        def linked(labels: DataFrame, pairs: DataFrame) -> DataFrame:
            found = confirmed(pairs, texts, size, percent)
            return joined(labels, found.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))

        labels = needed.withColumn("component", F.col("id"))
        first = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b"))
        near = cut_lineage(likely(first))
        one = near.groupBy("b").agg(F.min("a").alias("a"))
        labels = linked(labels, one.select("a", F.col("a").alias("of_a"), "b", F.col("b").alias("of_b")))
        others = near.join(one.withColumnRenamed("a", "compared"), "b").where("a <> compared").drop("compared")
        labels = linked(labels, _apart(others, labels))

        left = cut_lineage(divided(labels))
        hubs = left.where("n > 2").groupBy("key").agg(drawn(1), drawn(2))
        second = (
            left.join(hubs, "key")
            .select("id", "component", F.explode(F.array("d1", "d2")).alias("d"))
            .where("component <> d.component")
            .select(_pair("id", "component", "d.id", "d.component"))
            .select("pair.*")
        )
        labels = linked(labels, likely(second.join(first, ["a", "b"], "left_anti")))

        rest = divided(labels).where("n > 2").select("id", "component").distinct()
        with stored(rest.join(texts, "id")) as rest:
            labels = linked(labels, likely(_meeting(rest, size, percent)))
    return signed.select("id", "n_shingles", "sequence", "text_hash"), classes.select("sequence", "id"), labels
