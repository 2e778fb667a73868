"""Running numbers in the order of time or lines, for groups that no one task should hold.

``Window`` meets a whole group in one task. Here a large group is numbered over ranges (``numbered``), and then cut
into spans of so many rows: what runs within a span starts from the sum of the spans before, found over one row a span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from procflow.session import checkpointed, new_folder

#: Rows of a group from which on it is numbered over ranges, and rows of a span.
HOT_ROWS = 1_000_000
SPAN = 65_536


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` plus ``name``: the row's number (from 1) within its keys, by ``order``.

    Rows are dealt to sorted ranges and written to the shared folder, so that their places hold; a group's offset in a
    range is the number of its rows in the ranges before. Jobs run when this is called. Null keys are a group.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order, "__r"]  # a random last key also splits equal rows
    placed = rows.withColumn("__r", F.rand(1)).repartitionByRange(n, *by).sortWithinPartitions(*by).drop("__r")
    path = new_folder(spark, "numbered")
    placed.withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).withColumn("__range", F.shiftright("__at", 33))
    own = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    names = [f"__k{i}" for i in range(len(keys))]
    parts = placed.groupBy(*own, F.col("__range").alias("__p")).agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = W.partitionBy(*names).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*names, "__p", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    on = F.col("__range") == F.col("__p")
    for k, x in zip(keys, names, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(x))
    return placed.join(parts, on).withColumn(name, (F.col("__at") - F.col("__first") + F.col("__before") + 1).cast("int")).select(*rows.columns, name)


def _in_spans(rows: DataFrame, keys: list[str], number: str, span: int) -> tuple[DataFrame, list[str]]:
    return rows.withColumn("__span", F.expr(f"`{number}` div {span}")), [*keys, "__span"]


def running_count(rows: DataFrame, keys: list[str], number: str, condition: Column, name: str, span: int = SPAN) -> DataFrame:
    """``rows`` plus ``name``: how many rows of the keys up to this one, by ``number``, meet the condition."""
    d, own = _in_spans(rows.withColumn("__c", F.coalesce(condition.cast("int"), F.lit(0))), keys, number, span)
    sums = d.groupBy(*own).agg(F.sum("__c").alias("__sum"))
    before = W.partitionBy(*keys).orderBy("__span").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*own, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = F.sum("__c").over(W.partitionBy(*own).orderBy(number).rowsBetween(W.unboundedPreceding, W.currentRow))
    return d.withColumn("__in", inside).join(sums, own).withColumn(name, F.col("__in") + F.col("__before")).select(*rows.columns, name)


def previous(rows: DataFrame, keys: list[str], number: str, value: str, default, name: str, span: int = SPAN) -> DataFrame:
    """``rows`` plus ``name``: ``value`` of the row before this one, by ``number``; ``default`` for the first."""
    d, own = _in_spans(rows, keys, number, span)
    boxed = F.struct(F.col(value).alias("v"))
    ends = d.groupBy(*own).agg(F.max_by(boxed, number).alias("__end"))
    before = W.partitionBy(*keys).orderBy("__span")
    ends = ends.select(*own, F.lag("__end").over(before).alias("__carried"))
    d = d.withColumn("__last", F.lag(boxed).over(W.partitionBy(*own).orderBy(number))).join(ends, own)
    found = F.coalesce("__last", "__carried")
    return d.withColumn(name, F.when(found.isNull(), F.lit(default)).otherwise(found["v"])).select(*rows.columns, name)


#: Hot keys that are sent to all tasks, at most; of more, only the larger ones count as hot.
MOST_KEYS = 100_000


def hot_keys(rows: DataFrame, key: str, hot_rows: int) -> DataFrame | None:
    """The keys of more than ``hot_rows`` rows, MOST_KEYS at most (with more of them, the bound is raised); None if
    there are none. Rows are counted when this is called."""
    counts = checkpointed(rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > hot_rows))
    while (n := counts.where(F.col("__n") > hot_rows).count()) > MOST_KEYS:
        hot_rows *= 2
    return counts.where(F.col("__n") > hot_rows).select(key) if n else None


def by_heat(rows: DataFrame, key: str, hot_rows: int, usual, hot) -> DataFrame:
    """``usual`` of the rows of ordinary keys and ``hot`` of those of large ones, which are told apart without moving
    them. A large group of null keys is taken as ordinary."""
    keys = hot_keys(rows, key, hot_rows)
    if keys is None:
        return usual(rows)
    keys = F.broadcast(keys)  # MOST_KEYS rows at most
    return usual(rows.join(keys, key, "left_anti").select(rows.columns)).unionByName(hot(rows.join(keys, key, "left_semi").select(rows.columns)))
