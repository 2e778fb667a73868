"""Moving expired executions out of the log into an archive by month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procflow.operators import runlog
from procflow.session import new_folder


def read_archive(spark: SparkSession, archive: str, schema: str) -> DataFrame:
    """The archived rows, with the ``month`` (yyyy-MM) of each execution's last transition; empty if none is there."""
    return spark.read.schema(f"{schema}, month string").option("ignoreMissingFiles", True).parquet(archive)


def archive_expired(log: DataFrame, now: Column, archive: str, hours: int = runlog.TTL_HOURS) -> DataFrame:
    """Write the executions of ``log`` (execution_id, ts, ...) whose last transition is older than ``hours`` to
    ``archive``, by the month of that transition, and return the rest of the log.

    Only months that get rows are written again: with the rows they hold of other executions, and with the new ones of
    those that come now, so that a rerun over the same log leaves each row there once. What is written is staged in a
    folder of its own first, as a month cannot be read while it is replaced.
    """
    spark = log.sparkSession
    rest, old = runlog.split_expired(log, now, hours)
    last = old.groupBy("execution_id").agg(F.date_format(F.max("ts"), "yyyy-MM").alias("month"))
    coming = old.join(last, "execution_id")
    staged = new_folder(spark, "archive-staging")
    coming.select(*log.columns, "month").write.parquet(staged)
    new = spark.read.schema(coming.select(*log.columns, "month").schema).parquet(staged)
    months = [r[0] for r in new.select("month").distinct().collect()]  # one row a month
    if not months:
        return rest
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(archive)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        there = spark.read.schema(new.schema).parquet(archive).where(F.col("month").isin(months))
        kept = there.join(new.select("execution_id", "month").distinct(), ["execution_id", "month"], "left_anti").select(new.columns)
        staged = new_folder(spark, "archive-staging")
        new.unionByName(kept).write.parquet(staged)
        new = spark.read.schema(new.schema).parquet(staged)
    new.repartition("month", F.pmod(F.xxhash64("execution_id"), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(archive)
    return rest
