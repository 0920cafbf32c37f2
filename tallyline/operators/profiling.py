"""Data-quality tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranks import exact_quantiles
from ..session import cut_lineage
from .duplicates import COPIES, distinct_rows


def _quoted(names: Sequence[str]) -> list[str]:
    return [f"`{name}`" for name in names]


def shape(df: DataFrame) -> DataFrame:
    return df.groupBy().agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def _long(wide: DataFrame, names: Sequence[str], column: str, value: str) -> DataFrame:
    return wide.unpivot([], _quoted(names), column, value)


def missing_values(df: DataFrame) -> DataFrame:
    """column_name, missing_count, missing_pct (2 places): one pass over the table."""
    empty = [F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]
    counts = df.agg(F.count("*").alias("_rows"), *empty)
    long = counts.unpivot(["_rows"], _quoted(df.columns), "column_name", "missing_count")
    pct = F.round(F.try_divide(F.col("missing_count").cast("double") * 100, F.col("_rows").cast("double")), 2)
    return long.select("column_name", "missing_count", pct.alias("missing_pct"))


def _with_types(df: DataFrame, found: DataFrame) -> DataFrame:
    """Add each column's type; the types come from the schema, so no data is read for them."""
    types = F.create_map(*[F.lit(part) for pair in df.dtypes for part in pair])
    return found.withColumn("dtype", types[F.col("column_name")])


def column_types(df: DataFrame) -> DataFrame:
    """column_name, dtype, and how many values are present."""
    present = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return _with_types(df, _long(present, df.columns, "column_name", "present"))


def quality_report(df: DataFrame) -> DataFrame:
    """Every column with its type, its missing share and a flag where something is missing."""
    return _with_types(df, missing_values(df)).withColumn("has_missing", F.col("missing_pct") > 0)


def columns_with_missing(df: DataFrame) -> DataFrame:
    return quality_report(df).filter("has_missing").drop("has_missing")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Number of rows beyond the first of each group of identical rows.

    Rows that are the only ones of their kind add nothing, so they are not even counted.
    """
    if not df.columns:
        return df.groupBy().agg(F.greatest(F.count("*") - 1, F.lit(0)).cast("long").alias("duplicate_rows"))
    groups = distinct_rows(df).where(F.col(COPIES) > 1)
    return groups.agg(F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


#: A size of sketch whose quantiles are off by less than a hundredth of the ranks.
SKETCH_K = 800


def rank_error(k: int) -> float:
    """The normalised rank error of one quantile of a KLL sketch of size ``k``, at 99 % confidence."""
    return 2.296 / k**0.9021


def sketched_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], k: int) -> DataFrame:
    """(metric, n, quantiles): quantiles from one mergeable sketch per column, in one pass; off by ``rank_error(k)`` of the ranks."""
    names = F.array(*[F.lit(c) for c in columns])
    values = [F.col(f"`{c}`").cast("double") for c in columns]
    values = [F.when(~F.isnan(v), v) for v in values]
    sketches = df.agg(
        F.array(*[F.count(v) for v in values]).alias("n"), F.array(*[F.kll_sketch_agg_double(v, k) for v in values]).alias("sketch")
    )
    rows = sketches.select(F.inline(F.arrays_zip(names.alias("metric"), "n", "sketch")))
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    # An empty sketch has no quantiles.
    quantiles = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", wanted))
    return rows.select("metric", "n", quantiles.alias("quantiles"))


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None, sketch: int | None = None) -> DataFrame:
    """metric, n, mean, std, min, p25, p50, p75, max for each numeric column.

    Quartiles are exact, unless ``sketch`` asks for those of a KLL sketch of that size: values that occur, in one pass.
    """
    columns = list(columns or numeric_columns(df))
    values = df.select([F.col(f"`{c}`").cast("double").alias(c) for c in columns])

    def per_column(function) -> Column:
        return F.array(*[function(F.col(f"`{c}`")).cast("double") for c in columns])

    moments = values.agg(
        per_column(F.avg).alias("mean"),
        per_column(F.stddev_samp).alias("std"),
        per_column(F.min).alias("min"),
        per_column(F.max).alias("max"),
    )
    names = F.array(*[F.lit(c) for c in columns])
    rows = moments.select(F.explode(F.arrays_zip(names.alias("metric"), "mean", "std", "min", "max")).alias("m"))
    rows = rows.select("m.metric", "m.mean", "m.std", "m.min", "m.max")
    wanted = (0.25, 0.5, 0.75)
    quartiles = sketched_quantiles(values, columns, wanted, sketch) if sketch else exact_quantiles(values, columns, wanted)
    # Both sides hold one row per numeric column.
    return rows.join(quartiles, "metric", "left").select(
        "metric",
        F.coalesce("n", F.lit(0)).cast("long").alias("n"),
        "mean",
        "std",
        "min",
        F.get("quantiles", F.lit(0)).alias("p25"),
        F.get("quantiles", F.lit(1)).alias("p50"),
        F.get("quantiles", F.lit(2)).alias("p75"),
        "max",
    )


def describe_rounded(df: DataFrame, columns: Sequence[str], places: int = 2, sketch: int | None = None) -> DataFrame:
    found = describe_numeric(df, columns, sketch)
    numbers = [F.round(c, places).alias(c) for c in found.columns if c not in ("metric", "n")]
    return found.select("metric", "n", *numbers)


def date_ranges(df: DataFrame, columns: Sequence[str] = ("Order_Date", "Ship_Date")) -> DataFrame:
    """column_name, first and last moment, in one pass."""
    ends = [F.struct(F.lit(c).alias("column_name"), F.min(c).alias("first"), F.max(c).alias("last")) for c in columns]
    return df.agg(F.array(*ends).alias("r")).select(F.inline("r"))


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, value: the sorted domain of each column, in one pass."""
    texts = df.select([F.col(f"`{c}`").cast("string").alias(c) for c in columns])
    return (
        _long(texts, columns, "column_name", "value")
        .filter(F.col("value").isNotNull())
        .distinct()
        .orderBy("column_name", "value")
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin, lower, upper, count: equal-width bins over the range of the column, the last one closed.

    The range is one row, computed first and kept; the counts are one more pass. Empty bins count zero.
    """
    value = F.col(column).cast("double")
    present = df.select(value.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    same = F.min("x") == F.max("x")
    low = F.when(same, F.min("x") - 0.5).otherwise(F.min("x"))
    high = F.when(same, F.max("x") + 0.5).otherwise(F.max("x"))
    step = (high - low) / F.lit(float(bins))
    edges = cut_lineage(present.agg(F.struct(low.alias("lo"), step.alias("step")).alias("edges")))
    lo, step = F.col("edges.lo"), F.col("edges.step")

    guess = F.least(F.floor((F.col("x") - lo) / step), F.lit(bins - 1).cast("long"))
    placed = present.select("x", edges.scalar().alias("edges")).select("x", "edges", guess.alias("guess"))
    # Rounding can put a value one bin off; the edges decide.
    bin_index = (
        F.when(F.col("x") < lo + F.col("guess") * step, F.col("guess") - 1)
        .when((F.col("guess") < bins - 1) & (F.col("x") >= lo + (F.col("guess") + 1) * step), F.col("guess") + 1)
        .otherwise(F.col("guess"))
    )
    counts = placed.groupBy(bin_index.alias("bin")).agg(F.count("*").alias("found"))
    every_bin = df.sparkSession.range(bins).select(F.col("id").alias("bin"), edges.scalar().alias("edges"))
    return every_bin.join(counts, "bin", "left").select(
        F.col("bin").cast("int").alias("bin"),
        (lo + F.col("bin") * step).alias("lower"),
        (lo + (F.col("bin") + 1) * step).alias("upper"),
        F.coalesce("found", F.lit(0)).cast("long").alias("count"),
    )
