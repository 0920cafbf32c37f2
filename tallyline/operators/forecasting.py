"""Monthly sales series, three forecasts and their held-out evaluation.

Without ``keys`` there is one series; with ``keys`` one per key value, all fitted by the same grouped
aggregates. A series has one row per month, so its windows stay small however many lines feed it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import double, exact, total
from ..schema import known, require
from ..session import cut_lineage

TEST_MONTHS = 12
MIN_TRAIN_MONTHS = 6

# Display names of the models, in order of preference on equal error.
MODELS = (("Pred_Naive", "Naive Baseline"), ("Pred_LR", "Linear Regression"), ("Pred_RF", "Random Forest"))
# Forest settings.
TREES, DEPTH, SEED = 200, 5, 42


def prepare_monthly_series(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Sales per month with a positional index; months without sales leave no gap in it."""
    require(df, "Year_Month", "Sales", *keys)
    by = [*keys, "Year_Month"]
    monthly = known(df, *by).groupBy(*by).agg(double(total(exact(df, "Sales"))).alias("Sales"))
    in_time = Window.partitionBy(*keys).orderBy("Year_Month")
    return monthly.withColumn("time_idx", F.row_number().over(in_time) - 1)


def flag_test_months(monthly: DataFrame, test_months: int = TEST_MONTHS, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``is_test`` for the last months.

    A series too short to split is an error when the data is read; with ``keys`` it is flagged by a NULL
    ``is_test``, has no forecasts, and leaves the others alone.
    """
    size = F.count("*").over(Window.partitionBy(*keys))
    message = F.concat(F.lit("series too short to split: only "), size.cast("string"), F.lit(" months"))
    too_short = size - test_months < MIN_TRAIN_MONTHS
    failure = F.lit(None).cast("boolean") if keys else F.raise_error(message).cast("boolean")
    split = F.when(too_short, failure).otherwise(F.col("time_idx") >= size - test_months)
    return monthly.withColumn("is_test", split)


def train_test_split_time(
    monthly: DataFrame, test_months: int = TEST_MONTHS, keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    flagged = flag_test_months(monthly, test_months, keys)
    return flagged.filter(~F.col("is_test")).drop("is_test"), flagged.filter("is_test").drop("is_test")


def _train(column: str) -> Column:
    return F.when(~F.col("is_test"), F.col(column).cast("double"))


def naive_baseline(flagged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Repeat the last training value in every test month."""
    series = Window.partitionBy(*keys)
    last = F.max_by(_train("Sales"), _train("time_idx")).over(series)
    return flagged.withColumn("Pred_Naive", F.when(F.col("is_test"), last))


def linear_trend(flagged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line over the training months, read off at the test months."""
    series = Window.partitionBy(*keys)
    slope = F.regr_slope(_train("Sales"), _train("time_idx")).over(series)
    intercept = F.regr_intercept(_train("Sales"), _train("time_idx")).over(series)
    return flagged.withColumn("Pred_LR", F.when(F.col("is_test"), intercept + slope * F.col("time_idx")))


def random_forest(flagged: DataFrame) -> DataFrame:
    """A forest on the month index of one series; every month may be a split of its own."""
    # Training reads the series several times; the lines behind it are read once.
    flagged = cut_lineage(flagged)
    prepared = VectorAssembler(inputCols=["time_idx"], outputCol="_features").transform(flagged)
    training = prepared.filter(~F.col("is_test"))
    forest = RandomForestRegressor(
        featuresCol="_features",
        labelCol="Sales",
        predictionCol="_forest",
        numTrees=TREES,
        maxDepth=DEPTH,
        seed=SEED,
        featureSubsetStrategy="all",
        maxBins=max(2, training.count()),
    )
    fitted = forest.fit(training)
    predicted = fitted.transform(prepared)
    return predicted.select(*flagged.columns, F.when(F.col("is_test"), F.col("_forest")).alias("Pred_RF"))


def evaluate(predicted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE (2 places) and R2 (4 places) on the test months for every model present."""
    present = [(column, name) for column, name in MODELS if column in predicted.columns]
    long = predicted.filter("is_test").unpivot([*keys, "Sales"], [c for c, _ in present], "model", "guess")
    names = F.create_map(*[F.lit(part) for pair in present for part in pair])
    error = F.col("Sales") - F.col("guess")
    spread = F.var_pop("Sales") * F.count("Sales")
    return long.groupBy(*keys, names[F.col("model")].alias("model")).agg(
        F.round(F.avg(F.abs(error)), 2).alias("MAE"),
        F.round(F.sqrt(F.avg(error * error)), 2).alias("RMSE"),
        F.round(1 - F.try_divide(F.sum(error * error), spread), 4).alias("R2"),
    )


def _preference() -> Column:
    return F.array_position(F.array(*[F.lit(name) for _, name in MODELS]), F.col("model"))


def ranked_models(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return metrics.orderBy(*keys, "RMSE", _preference())


def best_model(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The model with the lowest RMSE, per key."""
    columns = ["model", "MAE", "RMSE", "R2"]
    best = F.min_by(F.struct(*columns), F.struct("RMSE", _preference()))
    return metrics.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def test_predictions(predicted: DataFrame) -> DataFrame:
    return predicted.filter("is_test").drop("is_test")


def plot_feed(predicted: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Training and test months in one ordered series, with the place where they part."""
    series = Window.partitionBy(*keys)
    return (
        predicted.withColumn("part", F.when(F.col("is_test"), F.lit("test")).otherwise(F.lit("train")))
        .withColumn("split_idx", F.max(_train("time_idx")).over(series).cast("int"))
        .drop("is_test")
        .orderBy(*keys, "time_idx")
    )
