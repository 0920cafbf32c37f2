"""Exact order statistics without sorting the table on one task."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# Cells per doubling of a value's size, and cells that a held cell is cut into.
COARSE, FINE = 256, 1 << 16


def range_slices(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Range-partition by (group, order), keep the result, and note each row's partition.

    There should be one row per (group, order): then no value can make one partition large.
    """
    return cut_lineage(df.repartitionByRange(group, *order).withColumn("_slice", F.spark_partition_id()))


def rows_at_positions(
    sliced: DataFrame, group: str, order: Sequence[str], freq: str, wanted: Callable[[Column], Column]
) -> DataFrame:
    """The rows found at given 0-based positions when each group is sorted by ``order``.

    Rows come from ``range_slices`` and count ``freq`` times; ``wanted`` maps the size of a group to an
    array of positions. No task sees a whole group: the partition sizes tell which partitions hold a
    wanted position and only those are numbered. Adds ``position`` and ``group_size``.
    """
    # One row per group and partition.
    sizes = sliced.groupBy(group, "_slice").agg(F.sum(freq).alias("_n"))
    held = _holding(sizes, [group], "_slice", wanted).drop("_n")
    running = Window.partitionBy(group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # ``held`` has at most one row per group and wanted position.
    numbered = sliced.join(F.broadcast(held), [group, "_slice"]).withColumn(
        "_upto", F.col("_start") + F.sum(freq).over(running)
    )
    here = F.filter("_wanted", lambda p: (p >= F.col("_upto") - F.col(freq)) & (p < F.col("_upto")))
    return numbered.withColumn("position", F.explode(here)).drop("_slice", "_start", "_upto", "_wanted")


def _holding(sizes: DataFrame, within: Sequence[str], cell: str, wanted: Callable[[Column], Column]) -> DataFrame:
    """The cells (with ``_n`` rows each) that hold a wanted position of their group.

    Adds ``group_size``, the rows before the cell (``_start``) and the positions inside it (``_wanted``).
    """
    whole = Window.partitionBy(*within)
    inside = F.filter("_all", lambda p: (p >= F.col("_start")) & (p < F.col("_start") + F.col("_n")))
    return (
        sizes.withColumn("group_size", F.sum("_n").over(whole))
        .withColumn("_start", F.sum("_n").over(whole.orderBy(cell)) - F.col("_n"))
        .withColumn("_all", wanted(F.col("group_size")))
        .withColumn("_wanted", inside)
        .drop("_all")
        .filter(F.size("_wanted") > 0)
    )


def _held_inside(sizes: DataFrame, within: Sequence[str], cell: str) -> DataFrame:
    """Of the cells inside held ones, those that hold one of the positions sought there."""
    before = F.col("_start") + F.sum("_n").over(Window.partitionBy(*within).orderBy(cell)) - F.col("_n")
    inside = F.filter("_wanted", lambda p: (p >= F.col("_start")) & (p < F.col("_start") + F.col("_n")))
    return sizes.withColumn("_start", before).withColumn("_wanted", inside).filter(F.size("_wanted") > 0)


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(metric, n, quantiles): exact quantiles, interpolated linearly, one row per column. Nothing runs before it is read.

    Values stay where they are. A first pass counts them in cells by size, a second counts those of the few
    cells that hold a wanted position in finer cells, and a third counts the different values of the few fine
    cells that do. So counts alone are shuffled, and a frequent value is one count.
    """
    measures = [F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns]
    long = df.select(F.explode(F.array(*measures)).alias("m")).select("m.metric", "m.value")
    long = long.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    # Both kinds of cells grow with the value, whatever the rounding.
    coarse = (F.signum("value") * F.floor(F.log2(F.abs("value") + 1) * COARSE)).cast("bigint")
    long = long.withColumn("cell", coarse)

    def both_sides(size: Column) -> Column:
        ats = [(size - 1) * F.lit(float(p)) for p in probabilities]
        return F.array_distinct(F.array(*[side(at) for at in ats for side in (F.floor, F.ceil)]))

    ends = (F.count("*").alias("_n"), F.min("value").alias("low"), F.max("value").alias("high"))
    sought = ["metric", "cell", "low", "high", "group_size", "_start", "_wanted"]
    # Held cells are at most as many as columns times wanted positions: small enough for every task.
    held = _holding(long.groupBy("metric", "cell").agg(*ends), ["metric"], "cell", both_sides).select(*sought)
    share = F.when(F.col("high") > F.col("low"), (F.col("value") - F.col("low")) / (F.col("high") - F.col("low")))
    fine = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * FINE), F.lit(FINE - 1)).cast("bigint")
    inside = long.join(F.broadcast(held), ["metric", "cell"]).withColumn("fine", fine)
    counted = inside.groupBy(*sought, "fine").agg(F.count("*").alias("_n"))
    held = _held_inside(counted, ["metric", "cell"], "fine").select(*sought, "fine")
    values = (
        long.join(F.broadcast(held), ["metric", "cell"])
        .filter(fine == F.col("fine"))
        .groupBy("metric", "cell", "fine", "group_size", "_start", "_wanted", "value")
        .agg(F.count("*").alias("_n"))
    )
    found = _held_inside(values, ["metric", "cell", "fine"], "value")
    return _interpolated(found.withColumn("position", F.explode("_wanted")), probabilities)


def _interpolated(located: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    span = F.col("group_size") - 1
    parts = []
    for i, p in enumerate(probabilities):
        at = span * F.lit(float(p))
        parts.append(F.max(F.when(F.col("position") == F.floor(at), F.col("value"))).alias(f"lo{i}"))
        parts.append(F.max(F.when(F.col("position") == F.ceil(at), F.col("value"))).alias(f"hi{i}"))
    ends = located.groupBy("metric").agg(F.max("group_size").alias("group_size"), *parts)
    quantiles = []
    for i, p in enumerate(probabilities):
        at = span * F.lit(float(p))
        low = F.col(f"lo{i}")
        quantiles.append(low + (F.col(f"hi{i}") - low) * (at - F.floor(at)))
    return ends.select("metric", F.col("group_size").alias("n"), F.array(*quantiles).alias("quantiles"))
