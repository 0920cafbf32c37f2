"""Document fingerprints by winnowing.

Every run of ``GRAM`` code points has a rolling hash: a polynomial modulo 2^31 - 1, built by doubling the run's length. Of
every ``WINDOW`` consecutive hashes the smallest is kept, of equal ones the rightmost, with its position. So two texts
that share a run of ``GRAM + WINDOW - 1`` code points share a kept hash, and a kept position tells where.
A text with fewer hashes than a window is one window; one that is shorter than a run is one run. An empty text or a
null has no hash. Case, blanks and all other characters count as they are, so positions are those of the text.

``likeness`` of two fingerprints is the share of their different hashes that both have: 1 for equal ones, also for two
empty ones.

``compare_edits`` takes each document with the next one in descending order of ids. Documents are dealt into ranges of
ids, each sorted in its task, and the first document of a range is also sent to the range before it: the texts are
shuffled once. Only the ranges' ends, one for each partition, are known to the driver. An id that fills several ranges
is dealt over them by a hash of the text.

Nulls: a null text is empty; rows without an id come after all others. Rows that share an id are documents of their own, in
the order of a hash of their text. A single document is its own next one. An empty table gives an empty result. Only the
named columns are read, so other columns can't clash (``fingerprints`` replaces columns named like its results).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.common import add_columns, worker_path

GRAM, WINDOW = 16, 64
PRIME, BASE = (1 << 31) - 1, 1_000_003
#: Hashes that are computed at a time.
BLOCK = 1 << 15
#: Characters of texts that are sent back at a time.
SENT = 1 << 20

_LOW = np.uint64((1 << 32) - 1)


def _modulo(x: np.ndarray) -> np.ndarray:
    """``x`` below 2^62 modulo the prime."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x >= PRIME, x - PRIME, x)


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """The hash of every run of ``GRAM`` (a power of two) code points; of a shorter text, the hash of the whole."""
    if len(codes) < GRAM:
        value = 0
        for c in codes.tolist():
            value = (value * BASE + c) % PRIME
        return np.array([value] if len(codes) else [], np.int64)
    hashes, length = codes.astype(np.int64), 1
    while length < GRAM:
        hashes = _modulo(hashes[:-length] * pow(BASE, length, PRIME) + hashes[length:])
        length *= 2
    return hashes


def kept(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes and positions that winnowing keeps, in order of position."""
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = max(len(codes) - GRAM + 1, 1)
    width = min(WINDOW, n)
    hashes, positions, last = [], [], -1
    # Windows that begin in a block; their last hashes lie behind it.
    for start in range(0, n - width + 1, BLOCK):
        end = min(start + BLOCK, n - width + 1) + width - 1
        values = gram_hashes(codes[start : end + GRAM - 1])
        # Smaller hashes first, of equal ones the later position.
        keys = (values.astype(np.uint64) << np.uint64(32)) | (_LOW - np.arange(start, end, dtype=np.uint64))
        have = 1
        while have < width:
            step = min(have, width - have)
            keys = np.minimum(keys[:-step], keys[step:])
            have += step
        found = (_LOW - (keys & _LOW)).astype(np.int64)
        first = np.append(found[:1] != last, found[1:] != found[:-1])
        hashes.append((keys[first] >> np.uint64(32)).astype(np.int64))
        positions.append(found[first])
        last = int(found[-1])
    return np.concatenate(hashes), np.concatenate(positions)


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Different hashes that two fingerprints share, of all."""
    a, b = np.unique(a), np.unique(b)
    common = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - common
    return common / every if every else 1.0


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *rows])))


_LONGS = T.ArrayType(T.LongType())


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the kept ``hashes`` and their ``positions``."""

    def make(part: pa.RecordBatch) -> list[pa.Array]:
        found = [kept(code_points(value.as_py())) for value in part.column(text)]
        return [_lists([h for h, _ in found]), _lists([p for _, p in found])]

    return add_columns(docs, text, [T.StructField("hashes", _LONGS), T.StructField("positions", _LONGS)], make)


def listed(hashes: str, positions: str) -> Column:
    """A fingerprint as text: ``hash:position`` by position, joined by commas."""
    return F.array_join(F.zip_with(hashes, positions, lambda h, p: F.concat(h.cast("string"), F.lit(":"), p.cast("string"))), ",")


def _range_of(bounds: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The range of each id: how many bounds lie below it. An id that equals several bounds is dealt over their ranges.

    In these ranges smaller hashes come first in descending order.
    """
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    spread = np.maximum(high - low, 1)
    share = ((hashes.astype(np.float64) + 2.0**63) / 2.0**64 * spread).astype(np.int64)
    return low + spread - 1 - np.minimum(share, spread - 1)


def dealt(docs: DataFrame, parts: int) -> DataFrame:
    """Documents (``id``, ``text``) with their ``slot`` and ``borrowed``, sorted in it by descending id.

    Each task has whole slots; the last rows of a slot, ``borrowed`` ones, begin with the document that comes after it.
    """
    worker_path(docs)
    edges = docs.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0]
    bounds = np.array(edges or [], np.int64)
    hot = len(np.unique(bounds)) < len(bounds)
    # Without an id that fills a range, no text is read to find the ranges' first documents.
    order = docs.withColumn("hash", F.xxhash64("text") if hot else F.lit(0).cast("long"))

    def keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = batch.column("id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
        known = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
        return known, ids, batch.column("hash").to_numpy(zero_copy_only=False)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, ids, hashes = keys(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_range_of(bounds, ids, hashes))], [*batch.schema.names, "slot"])

    # The first document of each slot: one row per partition.
    first = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", (-(F.col("hash") + 1)).alias("hash")))
    heads = {
        r["slot"]: (r["known"], r["id"] if r["known"] else -(1 << 63), -r["hash"] - 1)
        for r in order.select("id", "hash").mapInArrow(slots, "id long, hash long, slot long").groupBy("slot").agg(first.alias("f")).select("slot", "f.*").collect()
    }
    used = sorted(heads)
    # The slot read before this one; the first document of all follows the last one.
    before = {s: used[(i + 1) % len(used)] for i, s in enumerate(used)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, ids, hashes = keys(batch)
            own = _range_of(bounds, ids, hashes)
            head = [heads[s] for s in own.tolist()]
            borrowed = np.flatnonzero([h == (bool(k), int(i), int(x)) for h, k, i, x in zip(head, known, ids, hashes)])
            for rows, slot, flag in ((np.arange(len(own)), own, False), (borrowed, np.array([before[s] for s in own[borrowed].tolist()], np.int64), True)):
                part = batch.take(pa.array(rows)) if flag else batch
                made = [*part.columns, pa.array(slot, pa.int64()), pa.array([flag] * len(rows), pa.bool_())]
                yield pa.RecordBatch.from_arrays(made, [*batch.schema.names, "slot", "borrowed"])

    rows = order.select("id", "text", "hash").mapInArrow(deal, "id long, text string, hash long, slot long, borrowed boolean")
    return rows.repartitionById(max(parts, len(bounds) + 1), F.col("slot").cast("int")).sortWithinPartitions(
        "slot", "borrowed", F.desc_nulls_last("id"), "hash", "text"
    )


_COMPARED = (
    "id long, n_chars long, edited string, hashes array<long>, positions array<long>, "
    "edited_hashes array<long>, edited_positions array<long>, near_edited double, near_next double"
)


def compare_edits(docs: DataFrame, id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Each document's fingerprint beside those of an edited text and of the next document.

    The edited text has the next document's first characters in place of the last half. ``parts`` is the number of
    ranges, that of the session's shuffle partitions by default.
    """
    docs = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, before = [], 0, None

        def sent() -> pa.RecordBatch:
            columns = list(zip(*rows))
            kinds = [pa.int64(), pa.int64(), pa.string(), None, None, None, None, pa.float64(), pa.float64()]
            made = [_lists(c) if k is None else pa.array(c, k) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(made, _names)

        for batch in batches:
            for i in range(batch.num_rows):
                slot, borrowed = batch.column("slot")[i].as_py(), batch.column("borrowed")[i].as_py()
                follows = before is not None and before[0] == slot and not before[1]
                if borrowed and not follows:
                    continue
                value = batch.column("text")[i].as_py()
                codes = code_points(value)
                here = kept(codes)
                if follows:
                    _, _, its_id, its_text, its_codes, its = before
                    n = len(its_codes)
                    edited = its_text[: n - n // 2] + value[: n // 2]
                    other = kept(np.concatenate([its_codes[: n - n // 2], codes[: n // 2]]))
                    rows.append((its_id, n, edited, *its, *other, likeness(its[0], other[0]), likeness(its[0], here[0])))
                    held += n
                    if held > SENT:
                        yield sent()
                        rows, held = [], 0
                before = slot, borrowed, batch.column("id")[i].as_py(), value, codes, here
        if rows:
            yield sent()

    _names = [f.split()[0] for f in _COMPARED.split(", ")]
    return dealt(docs, parts).select("id", "text", "slot", "borrowed").mapInArrow(run, _COMPARED)
