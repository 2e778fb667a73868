"""Files in, files out: what a stream needs to run once over what is there, and to be run again after a stop.

A sink is a folder of one subfolder a micro-batch. A batch that is written again, after a stop between its write and
its commit, replaces its own subfolder, so that no row is there twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def write_batches(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None):
    """The writer of ``stream`` into ``sink``; ``each`` changes a batch before it is written."""

    def put(batch: DataFrame, batch_id: int) -> None:
        (each(batch) if each else batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint)


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None, timeout_s: int = 3600):
    """Run ``stream`` over the files that are there, then stop; returns the finished query, whose last progress tells
    the rows of state that are left. Stateful processors need RocksDB, which is set for this run only."""
    spark = stream.sparkSession
    was = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, ROCKS)
    try:
        q = write_batches(stream, sink, checkpoint, mode, each).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, was)
    if not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError(f"the stream did not end within {timeout_s} s")
    if q.exception() is not None:
        raise q.exception()
    return q


def read_batches(spark: SparkSession, sink: str, schema: str) -> DataFrame:
    """What a sink holds, with the number of the ``batch`` of each row; empty if no batch was written."""
    return spark.read.schema(f"{schema}, batch long").option("ignoreMissingFiles", True).parquet(sink)


def newest(rows: DataFrame, *keys: str, within: str | None = None) -> DataFrame:
    """The row of the last batch for each key (of several in it, the one of the greatest ``within``): the table that an
    update stream stands for."""
    w = W.partitionBy(*keys).orderBy(F.col("batch").desc(), *([F.col(within).desc()] if within else []))
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "batch")


def state_rows(query) -> int:
    """Rows that the state of a query holds after its last batch."""
    return sum(int(op["numRowsTotal"]) for op in (query.lastProgress or {"stateOperators": []})["stateOperators"])


def write_slices(table: DataFrame, folder: str, column: str, bounds: list, format: str = "parquet") -> None:
    """Write a table as the files of a stream would come in: one slice of ``column`` after the other. ``bounds`` are
    where new slices begin; rows whose column is null come last."""
    edges = [None, *bounds, None]
    for k, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = table
        if low is not None:
            part = part.where((F.col(column) >= F.lit(low)) | F.col(column).isNull() if high is None else F.col(column) >= F.lit(low))
        if high is not None:
            part = part.where(F.col(column) < F.lit(high))
        part.write.format(format).save(f"{folder}/slice={k:03d}")
