"""Hard negatives by a vertical scan over dimensions (BOND).

A row's score is its integer inner product with an anchor; components are scaled and floored first. An anchor's
positives are its best other rows of the same label. For each positive, the hard negatives are the best rows of other
labels whose score lies in a window of percentages of the positive's score.

Rows are kept in blocks, one column of integers per dimension, with each column's smallest and largest value. For an
anchor the columns are read in the order of its own descending component sizes. What the unread columns can still add
is bounded by their smallest and largest values, so each row has a lower and an upper bound, and rows that can reach no
window, or are beaten in every window by enough others, leave the bitmap of candidates. What is left after the last
column has its exact score.

The grid of row groups and anchor groups is dealt over tasks: a task holds one group of anchors (``ANCHORS``) with
their best rows so far and reads its blocks one after the other, so its memory doesn't grow with the table. Nothing is
broadcast or sent to the driver but two counts. Each anchor's best rows of all tasks are merged by a window.

Rows with a null id, label or vector, or with a null or non-finite component, take no part; scaled components are
clipped to +-2^25. Vectors of different lengths are compared as if the shorter ended in zeros. Every row stands for
itself: rows that repeat an id, or a whole row, are further rows. Equal scores are ordered by id. Anchors without a
positive, and positives without a negative, give no rows; an empty table gives none. Only the named columns are read,
so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import worker_path
from tallyline.session import cut_lineage

#: Rows of a block, anchors of a group (about), blocks of a row group, and columns read between two looks at the bounds.
BLOCK_ROWS, ANCHORS, BLOCKS, STEP = 4096, 16_384, 64, 8
LIMIT = 1 << 25
#: Windows are open at this end where a positive's score is missing.
NONE = np.iinfo(np.int64).min

_BLOCK = "number long, uids binary, ids binary, labels binary, columns binary, scores binary"


def integer_vectors(rows: DataFrame, anchors: Column, id: str, vector: str, label: Column, scale: int) -> DataFrame:
    """Usable rows: ``uid`` (a number of the row), ``id``, ``label``, ``vector`` (integers) and whether it is an anchor."""
    component = lambda x: F.floor(F.greatest(F.least(scale * x.cast("double"), F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(id).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id).cast("long").alias("id"),
        label.cast("long").alias("label"),
        F.transform(vector, component).alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"),
    )


def blocks(rows: DataFrame, n_parts: int, n_scores: int = 0) -> DataFrame:
    """Rows (``uid``, ``id``, ``label``, ``vector``, and ``scores`` where asked for) packed column by column."""
    worker_path(rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                uids, ids, labels = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("uid", "id", "label"))
                order = np.lexsort((uids, ids, labels))
                columns = _dense(part.column("vector"))[order].T
                scores = np.full((part.num_rows, n_scores), NONE, np.int64)
                if n_scores:
                    for i, row in enumerate(part.column("scores").to_pylist()):
                        scores[i, : len(row)] = row
                made = [uids[order], ids[order], labels[order], np.ascontiguousarray(columns, np.int32), scores[order]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(uids[0])], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in made)],
                    ["number", "uids", "ids", "labels", "columns", "scores"],
                )

    taken = ["uid", "id", "label", "vector", *(["scores"] if n_scores else [])]
    return rows.select(*taken).repartition(n_parts).mapInArrow(pack, _BLOCK)


def _dense(vectors: pa.ListArray) -> np.ndarray:
    """One row per vector; shorter ones end in zeros."""
    ends = vectors.offsets.to_numpy().astype(np.int64)
    flat = vectors.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].astype(np.int32)
    ends = ends - ends[0]
    sizes = np.diff(ends)
    width = int(sizes.max(initial=0))
    out = np.zeros((len(sizes), width), np.int32)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class Block:
    """Rows sorted by label, one array per dimension."""

    def __init__(self, row: dict):
        self.uids, self.ids, self.labels = (np.frombuffer(row[c], np.int64) for c in ("uids", "ids", "labels"))
        n = len(self.uids)
        self.columns = np.frombuffer(row["columns"], np.int32).reshape(-1, n)
        self.scores = np.frombuffer(row["scores"], np.int64).reshape(n, -1)
        self.low = self.columns.min(axis=1, initial=0).astype(np.int64)
        self.high = self.columns.max(axis=1, initial=0).astype(np.int64)
        self.size = int(np.abs(np.stack([self.low, self.high])).max(initial=0))
        self._exact = None

    def exact(self, size: int) -> np.ndarray:
        """Columns in a type in which inner products with components up to ``size`` are exact."""
        wide = np.float64 if self.size * size * max(1, len(self.columns)) < 1 << 52 else np.int64
        if self._exact is None or self._exact.dtype != wide:
            self._exact = self.columns.astype(wide)
        return self._exact


class Anchor:
    """An anchor, the order of its dimensions, and its best rows so far in each of its windows."""

    def __init__(self, block: Block, i: int, windows: list[tuple[int, int]], most: int):
        self.uid, self.label = int(block.uids[i]), int(block.labels[i])
        self.vector = block.columns[:, i].astype(np.int64)
        self.order = np.argsort(-np.abs(self.vector), kind="stable")
        self.size = int(np.abs(self.vector).max(initial=0))
        self.windows, self.most = windows, most
        self.best = [(np.empty(0, np.int64),) * 3 for _ in windows]

    def least(self, w: int) -> int:
        """What a row has to reach in window ``w``."""
        scores = self.best[w][0]
        return max(self.windows[w][0], int(scores[-1])) if len(scores) >= self.most else self.windows[w][0]

    def look(self, block: Block, same: bool) -> None:
        """Scan the block's rows of the same label, or those of other labels."""
        start, end = np.searchsorted(block.labels, [self.label, self.label + 1])
        if same:
            span, eligible = slice(start, end), block.uids[start:end] != self.uid
        else:
            span, eligible = slice(0, len(block.uids)), np.ones(len(block.uids), bool)
            eligible[start:end] = False
        if not eligible.any():
            return
        order = self.order[self.order < len(block.columns)]
        weights = self.vector[order]
        ends = np.stack([weights * block.low[order], weights * block.high[order]])
        rest_low, rest_high = (np.append(x[::-1].cumsum()[::-1], 0) for x in (ends.min(axis=0), ends.max(axis=0)))
        columns = block.exact(self.size)[:, span]
        alive = None
        partial = np.zeros(len(eligible), columns.dtype)
        for at in range(0, len(order), STEP):
            read = order[at : at + STEP]
            values = columns[read] if alive is None else columns[np.ix_(read, alive)]
            partial = partial + self.vector[read].astype(columns.dtype) @ values
            if alive is None:
                alive = np.flatnonzero(eligible)
                partial = partial[alive]
            done = min(at + STEP, len(order))
            keep = self._possible(partial, int(rest_low[done]), int(rest_high[done]))
            if not keep.all():
                alive, partial = alive[keep], partial[keep]
            if not len(alive):
                return
        if alive is None:
            alive = np.flatnonzero(eligible)
            partial = partial[alive]
        self._take(partial.astype(np.int64), block.ids[span][alive], block.uids[span][alive])

    def _possible(self, partial: np.ndarray, low: int, high: int) -> np.ndarray:
        """Rows that can still be among the best of some window, when the rest adds ``low`` to ``high``."""
        keep = np.zeros(len(partial), bool)
        for w, (lower, upper) in enumerate(self.windows):
            least = self.least(w)
            # Rows that are inside for certain: as many as are wanted beat all that stay below them.
            inside = partial[(partial >= lower - low) & (partial <= upper - high)]
            if len(inside) >= self.most:
                least = max(least, int(np.partition(inside, -self.most)[-self.most]) + low)
            keep |= (partial >= least - high) & (partial <= upper - low)
        return keep

    def _take(self, scores: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        for w, (_, upper) in enumerate(self.windows):
            inside = (scores >= self.least(w)) & (scores <= upper)
            if not inside.any():
                continue
            held = [np.concatenate(x) for x in zip(self.best[w], (scores[inside], ids[inside], uids[inside]))]
            if len(held[0]) > 4 * self.most:
                enough = held[0] >= np.partition(held[0], -self.most)[-self.most]
                held = [x[enough] for x in held]
            first = np.lexsort((held[2], held[1], -held[0]))[: self.most]
            self.best[w] = tuple(x[first] for x in held)


_FOUND = "anchor long, positive_score long, id long, uid long, score long"


def scanned(rows: DataFrame, anchors: DataFrame, groups: tuple[int, int], same: bool, most: int, percents: tuple[int, int]) -> DataFrame:
    """The best rows that each task finds for its anchors: (anchor, positive_score, id, uid, score).

    With ``same`` the search is for positives (positive_score is null); otherwise each of the anchor's ``scores`` has a window.
    """
    n_rows, n_anchors = groups
    cells = lambda df, own, n, other, m, kind: df.select(
        F.pmod(F.xxhash64("number"), F.lit(n)).alias(own),
        F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<long>")).alias(other),
        F.lit(kind).alias("kind"),
        "*",
    )
    grid = cells(anchors, "h", n_anchors, "g", n_rows, 0).unionByName(cells(rows, "g", n_rows, "h", n_anchors, 1))
    dealt = grid.repartition(n_rows * n_anchors, "g", "h").sortWithinPartitions("g", "h", "kind", "number")

    def windows(scores: np.ndarray) -> list[tuple[int, int]]:
        if same:
            return [(-(1 << 62), 1 << 62)]
        return [(-(-percents[0] * s // 100), percents[1] * s // 100) for s in dict.fromkeys(scores[scores != NONE].tolist())]

    def results(held: list[Anchor]) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(held), 1024):
            found = [(a, s, b) for a in held[start : start + 1024] for s, b in zip(a.of, a.best) if len(b[0])]
            sizes = [len(b[0]) for _, _, b in found]
            columns = [
                pa.array(np.repeat(np.array([a.uid for a, _, _ in found], np.int64), sizes)),
                pa.array([s for (_, s, _), n in zip(found, sizes) for _ in range(n)], pa.int64()),
                *(pa.array(np.concatenate([b[i] for _, _, b in found] or [np.empty(0, np.int64)])) for i in (1, 2, 0)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "positive_score", "id", "uid", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if cell != (row["g"], row["h"]):
                    yield from results(held)
                    cell, held = (row["g"], row["h"]), []
                block = Block(row)
                if row["kind"] == 0:
                    for j in range(len(block.uids)):
                        scores = block.scores[j]
                        anchor = Anchor(block, j, windows(scores), most)
                        anchor.of = [None] if same else list(dict.fromkeys(scores[scores != NONE].tolist()))
                        held.append(anchor)
                else:
                    for anchor in held:
                        anchor.look(block, same)
        yield from results(held)

    return dealt.mapInArrow(run, _FOUND)


def _first(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The best ``most`` rows of each key, with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    id: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 10,
    percents: tuple[int, int] = (30, 90),
) -> DataFrame:
    """For each anchor and each of its positives, the ranked hard negatives.

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    label = F.col(label) if isinstance(label, str) else label
    usable = cut_lineage(integer_vectors(rows, anchors, id, vector, label, scale))
    n, n_anchors = usable.agg(F.count("*"), F.count_if("anchor")).first()
    n_blocks = max(1, -(-n // BLOCK_ROWS))
    anchor_groups = max(1, -(-n_anchors // ANCHORS))
    slots = 2 * rows.sparkSession.sparkContext.defaultParallelism
    # As few row groups as keep the tasks long, but enough for all cores.
    row_groups = min(n_blocks, max(-(-n_blocks // BLOCKS), -(-slots // anchor_groups)))
    groups = row_groups, anchor_groups
    stored = cut_lineage(blocks(usable, n_blocks))
    of_anchor = usable.where("anchor")
    parts = max(1, -(-n_anchors // BLOCK_ROWS))
    # Positives: one window without ends.
    best = _first(scanned(stored, blocks(of_anchor, parts), groups, True, positives, percents), ["anchor"], positives)
    best = cut_lineage(best.select("anchor", F.col("id").alias("positive_id"), F.col("uid").alias("positive_uid"), F.col("score").alias("positive_score")))
    # An anchor has at most ``positives`` scores.
    scores = best.groupBy("anchor").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))
    searching = of_anchor.join(scores.withColumnRenamed("anchor", "uid"), "uid")
    found = scanned(stored, blocks(searching, parts, positives), groups, False, negatives, percents)
    found = _first(found, ["anchor", "positive_score"], negatives)
    return (
        found.select("anchor", "positive_score", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(best, ["anchor", "positive_score"])
        .join(of_anchor.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
