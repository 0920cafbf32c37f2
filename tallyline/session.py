"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SKEW = {
    # One order, customer or part may own a large share of the lines: split it even when
    # the split costs a later aggregate one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Tables that cut a lineage go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    **SKEW,
}


def build_session(app_name: str = "tallyline", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above. Sizing (executors, shuffle partitions) is left to the caller."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def split_hot_keys(spark: SparkSession) -> None:
    """The settings for hot keys, in a session that the caller has made."""
    for key, value in SKEW.items():
        spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """A folder that every executor can read: that of ``spark.checkpoint.dir``, else one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"


#: Shuffle files go when the action that wrote them ends; otherwise when the driver happens to collect its garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Frames made in this block leave no shuffle files. For a row of steps that each cut the lineage; a frame carried out twice shuffles twice."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREED) if before is None else spark.conf.set(FREED, before)


def cut_lineage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Compute ``df`` once and keep it in the shared folder, so later passes survive lost executors.

    What is kept goes when nothing refers to it. With a ``path`` it is kept there as compressed columns, which take a
    fraction of the bytes and are read one by one, and it is the caller's to remove. Either way the shuffle files of
    the computation go with it.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if path is None and context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    with shuffles_freed(spark):
        made = df.select("*")
        if path is None:
            return made.checkpoint()
        made.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
