"""A Merkle manifest of a dataset: one tree per group, one root over the groups' roots, and a proof per leaf.

A leaf is the SHA-256 of a row's chosen columns. In a group leaves ascend by id; two consecutive nodes become one, a
last single node is hashed alone, until one is left: the group's subroot. Subroots, ordered by group (null first, bytes
of UTF-8), are reduced likewise to the root.

Leaves get their place without a sort. Each group's ids are a compressed bitmap: 64 ids to a word, words without ids
are not kept, and words are merged by OR on the map side first. A popcount directory in three levels (words of a
chunk, chunks of a region, regions of a group) says how many leaves lie before each word, so the place of an id is
that count and the number of lower bits in its word. Only where an id has several leaves, these are
numbered by their hashes, in slices by the hash's first digits, and added to the places behind them.

Nodes are then gathered in slot arrays keyed by (group, place >> 10), at most 1024 to an array, and an array is reduced
by up to ten levels at once, so a table of a billion leaves takes three rounds, each a thousandth of the one before.
On the way down each array learns the siblings above it. No group is collected, no task sees a whole
group, and only the number of leaves of the largest group goes to the driver.

Nulls: a null value counts as ``-``; a null id comes before all others, a null group is a group. Empty texts are values
of length 0. Rows that repeat an id are leaves of their own, ordered by hash; whole repeated rows are equal leaves side by
side. An empty table gives an empty result. Only the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.llm.common import worker_path
from tallyline.session import cut_lineage

#: Levels that a slot array, of 2 ** LEVELS nodes at most, is reduced by.
LEVELS = 10
#: Bits of a word's number that count words in a chunk, and chunks in a region.
CHUNK_BITS, REGION_BITS = 10, 12
#: Equal leaves of one id that are numbered at a time.
RUN = 1 << 16


def digest(values: Sequence[Column]) -> Column:
    """SHA-256 of the values one after the other: length in bytes, ``:``, value; ``-`` for null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def places(leaves: DataFrame) -> DataFrame:
    """Leaves (``grp``, ``id``, ``leaf``, ``copies``, and others) with ``place`` of their first copy and ``size`` of their group."""
    # An id of 64 bits less its last six; a null id is a word before all others.
    word = F.coalesce(F.shiftright("id", 6), F.lit(-(1 << 60)))
    bit = F.coalesce(F.col("id").bitwiseAND(63), F.lit(0)).cast("int")
    keyed = leaves.withColumns({"word": word, "bit": bit})
    words = cut_lineage(
        keyed.groupBy("grp", "word")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.sum("copies").alias("n"))
        .withColumn("chunk", F.shiftright("word", CHUNK_BITS))
        .withColumn("region", F.shiftright("word", CHUNK_BITS + REGION_BITS))
    )

    def before(df: DataFrame, within: list[str], order: str, name: str) -> DataFrame:
        upto = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum("n").over(upto), F.lit(0)))

    chunks = words.groupBy("grp", "region", "chunk").agg(F.sum("n").alias("n"))
    regions = chunks.groupBy("grp", "region").agg(F.sum("n").alias("n"))
    sized = before(regions, ["grp"], "region", "in_group").withColumn("size", F.sum("n").over(Window.partitionBy("grp")))
    same = lambda a, b, names: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    directory = (
        before(words, ["grp", "chunk"], "word", "in_chunk").alias("w")
        .join(before(chunks, ["grp", "region"], "chunk", "in_region").alias("c"), same("w", "c", ["grp", "chunk"]))
        .join(sized.alias("r"), same("w", "r", ["grp", "region"]))
        .select("w.grp", "w.word", "w.bits", "w.n", "r.size", (F.col("in_chunk") + F.col("in_region") + F.col("in_group")).alias("base"))
    )
    found = (
        keyed.alias("k").join(directory.alias("d"), same("k", "d", ["grp", "word"]))
        .select("k.*", "d.bits", "d.n", "d.size", "d.base")
        .withColumn("place", F.col("base") + F.bit_count(F.expr("bits & ~shiftleft(-1L, bit)")))
    )
    several = F.col("n") > F.bit_count("bits")
    names = [*leaves.columns, "place", "size"]
    if words.where(several).isEmpty():
        return found.select(*names)
    shared = cut_lineage(found.where(several))
    # Words in which an id has several leaves: leaves of lower bits, then of the same id by hash.
    of_bit = shared.groupBy("grp", "word", "bit").agg(F.sum("copies").alias("n"))
    of_bit = before(of_bit, ["grp", "word"], "bit", "lower").drop("n")
    slice_of = F.substring("leaf", 1, 3)
    slices = shared.withColumn("slice", slice_of).groupBy("grp", "word", "bit", "slice").agg(F.sum("copies").alias("n"))
    slices = before(slices, ["grp", "word", "bit"], "slice", "in_id").drop("n")
    inside = Window.partitionBy("grp", "word", "bit", "slice").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        shared.withColumn("slice", slice_of)
        .withColumn("in_slice", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .alias("k")
        .join(of_bit.alias("b"), same("k", "b", ["grp", "word", "bit"]))
        .join(slices.alias("s"), same("k", "s", ["grp", "word", "bit", "slice"]))
        .select("k.*", (F.col("base") + F.col("lower") + F.col("in_id") + F.col("in_slice")).alias("its_place"))
        .withColumn("place", F.col("its_place"))
    )
    return found.where(~several).select(*names).unionByName(numbered.select(*names))


def one_each(placed: DataFrame) -> DataFrame:
    """A row per copy: copies of a leaf take the places after its first."""
    runs = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / RUN)))
    each = F.explode(F.sequence(F.col("run") * RUN, F.least((F.col("run") + 1) * RUN, F.col("copies")) - 1))
    return (
        placed.withColumn("run", runs).withColumn("copy", each)
        .withColumn("place", F.col("place") + F.col("copy")).drop("run", "copy", "copies")
    )


def reduced(nodes: list[str], size: int, n_levels: int) -> tuple[list[list[str]], bool]:
    """Levels above the nodes of one slot array, which lie in a level of ``size`` nodes.

    The last level has one node. True if that is the only node of its whole level, the tree's root.
    """
    levels, step = [nodes], 0
    while size > 1 and step < n_levels:
        below = levels[-1]
        levels.append([hashlib.sha256("".join(below[i : i + 2]).encode()).hexdigest() for i in range(0, len(below), 2)])
        size, step = (size + 1) // 2, step + 1
    return levels, size == 1


def arrays(nodes: DataFrame, n_levels: int = LEVELS) -> DataFrame:
    """Nodes (``grp``, ``place``, ``size`` of the level, ``node``, ``tag``) gathered in slot arrays, each with its top node.

    grp, array, size, nodes and tags (by slot), top, whole (the top is the tree's root).
    """
    worker_path(nodes)
    gathered = nodes.groupBy("grp", F.shiftright("place", n_levels).alias("array"), "size").agg(
        F.sort_array(F.collect_list(F.struct("place", "node", "tag"))).alias("slots")
    )
    rows = gathered.select("grp", "array", "size", F.col("slots.node").alias("nodes"), F.col("slots.tag").alias("tags"))
    names = [*rows.columns, "top", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [reduced(found.as_py(), size, n_levels) for found, size in zip(batch.column("nodes"), batch.column("size").to_pylist())]
            tops = [pa.array([levels[-1][0] for levels, _ in made], pa.string()), pa.array([whole for _, whole in made], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *tops], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema, T.StructField("top", T.StringType()), T.StructField("whole", T.BooleanType())]))


def paths(known: DataFrame, others: Sequence[str] = (), n_levels: int = LEVELS) -> DataFrame:
    """Each node of the slot arrays with its ``proof``: its siblings up to the root, after those in ``above``.

    A sibling is ``L`` or ``R`` (the side it stands on) and its hash; ``-`` is a level where the node is hashed alone.
    grp, place, node, tag, proof, and ``others``, which are columns of the arrays.
    """
    worker_path(known)
    repeated = ["grp", *others]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                nodes, array, size, above = (batch.column(c)[row].as_py() for c in ("nodes", "array", "size", "above"))
                levels, _ = reduced(nodes, size, n_levels)
                found = []
                for i in range(len(nodes)):
                    path = []
                    for level in levels[:-1]:
                        path.append(("L" if i & 1 else "R") + level[i ^ 1] if i ^ 1 < len(level) else "-")
                        i >>= 1
                    found.append(path + above)
                same = pa.array([0] * len(nodes), pa.int32())
                made = [
                    *(batch.column(c).slice(row, 1).take(same) for c in repeated),
                    pa.array(range(array << n_levels, (array << n_levels) + len(nodes)), pa.int64()),
                    pa.array(nodes, pa.string()),
                    batch.column("tags").slice(row, 1).flatten(),
                    pa.array(found, pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(made, [*repeated, "place", "node", "tag", "proof"])

    rows = known.select(*repeated, "nodes", "tags", "array", "size", "above")
    tag = rows.schema["tags"].dataType.elementType
    schema = T.StructType(
        [
            *(rows.schema[c] for c in repeated),
            T.StructField("place", T.LongType()),
            T.StructField("node", T.StringType()),
            T.StructField("tag", tag),
            T.StructField("proof", T.ArrayType(T.StringType())),
        ]
    )
    return rows.mapInArrow(run, schema)


def trees(nodes: DataFrame, most: int, n_levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """The roots (``grp``, ``root``) of all groups, and the lowest slot arrays with ``above``, the siblings above each.

    ``most`` is at least the number of nodes of the largest group.
    """
    rounds, level, slots = [], nodes, 1 << n_levels
    while True:
        rounds.append(cut_lineage(arrays(level, n_levels)))
        if most <= slots:
            break
        most = -(-most // slots)
        level = rounds[-1].where("NOT whole").select(
            "grp", F.col("array").alias("place"), F.ceil(F.col("size") / slots).alias("size"), F.col("top").alias("node"), F.lit(None).cast("int").alias("tag")
        )
    none = F.array().cast("array<string>")
    roots = reduce(DataFrame.unionByName, [r.where("whole").select("grp", F.col("top").alias("root")) for r in rounds])
    known = rounds[-1].withColumn("above", none)
    for lower in reversed(rounds[:-1]):
        upper = paths(known, n_levels=n_levels).select(F.col("grp").alias("of"), "place", "proof")
        inner = lower.where("NOT whole").join(upper, F.col("grp").eqNullSafe(F.col("of")) & (F.col("array") == F.col("place")))
        known = lower.where("whole").withColumn("above", none).unionByName(
            inner.withColumn("above", F.col("proof")).drop("of", "place", "proof")
        )
        known = cut_lineage(known)
    return roots, known


def in_order(groups: DataFrame) -> DataFrame:
    """Groups with their ``place`` in ascending order, null first, from a range-partitioned sort."""
    # The partition of a row, and its place there, are the upper and lower bits of its number.
    numbered = cut_lineage(groups.orderBy(F.asc_nulls_first("grp")).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).alias("part")
    counts = numbered.groupBy(part).agg(F.count("*").alias("n"))
    starts = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    inside = F.col("at").bitwiseAND((1 << 33) - 1)
    return numbered.withColumn("part", part).join(starts, "part").withColumn("place", F.col("start") + inside).drop("part", "start", "at")


def manifest(
    docs: DataFrame,
    id: str = "doc_id",
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    group: str = "lang",
    altered: Sequence[Column] | None = None,
    n_levels: int = LEVELS,
) -> DataFrame:
    """A row per leaf: ``id``, ``grp``, ``leaf``, ``subroot``, ``root``, ``proof``; and ``altered_leaf``.

    ``altered`` are the columns' values at a later time, to be verified against the manifest; their leaf is null if they
    are not given. ``folded`` makes a root of a leaf and a proof.
    """
    later = digest(altered) if altered else F.lit(None).cast("string")
    leaves = docs.select(
        F.col(group).alias("grp"), F.col(id).cast("long").alias("id"), digest([F.col(c) for c in columns]).alias("leaf"), later.alias("altered_leaf")
    )
    counted = cut_lineage(leaves.groupBy(*leaves.columns).agg(F.count("*").alias("copies")))
    placed = one_each(places(counted))
    nodes = placed.select("grp", "place", "size", F.col("leaf").alias("node"), F.struct("id", "altered_leaf").alias("tag"))
    sizes = counted.groupBy("grp").agg(F.sum("copies").alias("n"))
    n_groups, most = sizes.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    subroots, known = trees(nodes, most, n_levels)
    tops = in_order(subroots).select(
        F.lit(0).alias("grp"), "place", F.lit(n_groups).cast("long").alias("size"), F.col("root").alias("node"), F.struct(F.col("grp").alias("of")).alias("tag")
    )
    root, upper = trees(tops, n_groups, n_levels)
    # One row per group.
    per_group = paths(upper, n_levels=n_levels).join(root, "grp").select(
        F.col("tag.of").alias("of"), F.col("node").alias("subroot"), "root", F.col("proof").alias("further")
    )
    whole = (
        known.join(per_group, F.col("grp").eqNullSafe(F.col("of")))
        .withColumn("above", F.concat("above", "further"))
        .drop("of", "further")
    )
    found = paths(whole, ["subroot", "root"], n_levels)
    return found.select("tag.id", "grp", F.col("node").alias("leaf"), "subroot", "root", "proof", "tag.altered_leaf")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf has with a proof."""

    def up(node: Column, sibling: Column) -> Column:
        side, hashed = F.substring(sibling, 1, 1), F.substring(sibling, 2, 64)
        left, right = F.when(side == "L", hashed).otherwise(""), F.when(side == "R", hashed).otherwise("")
        return F.sha2(F.concat(left, node, right), 256)

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    """SHA-256 of the siblings of a proof, lowest first."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.substring(s, 2, 64)), ""), 256)
