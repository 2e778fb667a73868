"""Joins by time: the value that was current at a moment, and the interval that holds a moment.

Neither is a nested loop, and no key, however hot, is one task: rows are dealt by key and span of time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Seconds of a span of the as-of join.
SPAN_S = 86_400


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, value: str, span_s: int = SPAN_S) -> DataFrame:
    """``left`` plus ``value`` of the last row of ``right`` with equal keys and ``right_ts <= left_ts`` (null if none;
    of several at one time the greatest value). Null keys and times meet nothing; null values of ``right`` are values.

    Rows are ordered within spans of ``span_s`` seconds; what a span begins with is the last value of the spans before,
    found over one row a key and span.
    """
    span = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / span_s)
    lk = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    own = [f"__k{i}" for i in range(len(keys))]
    rows = left.select(*lk, F.col(left_ts).alias("__t"), span(left_ts).alias("__span"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__row"), F.lit(None).cast(f"struct<v:{right.schema[value].dataType.simpleString()}>").alias("__v"))
    known = right.select(*lk, F.col(right_ts).alias("__t"), span(right_ts).alias("__span"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), F.struct(F.col(value).alias("v")).alias("__v")).where(" AND ".join(f"{k} IS NOT NULL" for k in own) + " AND __t IS NOT NULL")
    both = rows.unionByName(known)
    ends = both.groupBy(*own, "__span").agg(F.max(F.when(F.col("__v").isNotNull(), F.struct("__t", "__v"))).alias("end"))
    before = W.partitionBy(*own).orderBy("__span").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*own, "__span", F.last("end.__v", ignorenulls=True).over(before).alias("__carried"))
    inside = W.partitionBy(*own, "__span").orderBy("__t", F.col("__row").isNotNull(), "__v").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("__now", F.last("__v", ignorenulls=True).over(inside)).where("__row IS NOT NULL")
    d = found.join(carried, [*own, "__span"], "left")
    return d.select("__row.*", F.coalesce("__now", "__carried")["v"].alias(value))


def intervals_of(points: DataFrame, windows: DataFrame, keys: list[str], ts: str, point_id: str) -> DataFrame:
    """``point_id, window_id, start, end``: every window (keys, window_id, start, end; both ends included) that holds
    a point (keys, ``ts``, ``point_id``).

    Windows are filed by size: one of up to 2^k microseconds lies in at most two cells of that width, and points look
    into one cell for each size there is. Windows without an end, or that end before they begin, hold nothing.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    w = windows.where("start <= end").select(*keys, "window_id", "start", "end", F.ceil(F.log2(F.greatest(us("end") - us("start"), F.lit(1)))).cast("int").alias("__size"))
    sizes = sorted(r[0] for r in w.select("__size").distinct().collect())  # 63 at most
    if not sizes:
        return points.join(w, keys).select(point_id, "window_id", "start", "end")
    w = w.withColumn("__cell", F.explode(F.sequence(F.expr("shiftright(unix_micros(CAST(start AS TIMESTAMP)), __size)"), F.expr("shiftright(unix_micros(CAST(end AS TIMESTAMP)), __size)"))))
    p = points.select(*keys, point_id, F.col(ts).alias("__ts"), F.explode(F.array(*[F.lit(s) for s in sizes])).alias("__size"))
    p = p.withColumn("__cell", F.expr("shiftright(unix_micros(CAST(__ts AS TIMESTAMP)), __size)"))
    return p.join(w, [*keys, "__size", "__cell"]).where("__ts >= start AND __ts <= end").select(point_id, "window_id", "start", "end")


def window_positions(points: DataFrame, windows: DataFrame, keys: list[str], ts: str, point_id: str, span_s: int = SPAN_S) -> DataFrame:
    """``point_id, position, n_windows, window_id``: for each point ``in`` where a window of its keys holds it (the
    first to begin, then the smallest window_id), else ``before`` where one is still to come, ``after`` where all have
    passed, ``allowed`` where its keys have no valid window. ``point_id`` tells points apart.

    No pair of a point and a window is made. The windows that hold a moment are those begun less those ended. The first
    of them to begin is, of the windows that end later than all that begin before them, the next to end; their ends rise
    as their beginnings do. All of it runs in order within spans of ``span_s`` seconds, and over one row a key and span.
    """
    own = [f"__k{i}" for i in range(len(keys))]
    lk = [F.col(k).alias(o) for k, o in zip(keys, own)]
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    span = lambda c: F.coalesce(F.floor(F.col(c) / (span_s * 1_000_000)), F.lit(0)).alias("__span")
    upto, before = (lambda w: w.rowsBetween(W.unboundedPreceding, W.currentRow)), (lambda w: w.rowsBetween(W.unboundedPreceding, -1))
    by_span = W.partitionBy(*own).orderBy("__span")

    w = windows.where("start <= end").select(*lk, "window_id", us("start").alias("__s"), us("end").alias("__e")).where(" AND ".join(f"{k} IS NOT NULL" for k in own)).withColumn("__span", span("__s"))
    reach = w.groupBy(*own, "__span").agg(F.max("__e").alias("__far")).select(*own, "__span", F.max("__far").over(before(by_span)).alias("__far"))
    w = w.withColumn("__near", F.max("__e").over(before(W.partitionBy(*own, "__span").orderBy("__s", "window_id")))).join(reach, [*own, "__span"])
    leads = F.coalesce(F.col("__e") > F.greatest("__near", "__far"), F.lit(True))

    w = w.select(*own, "window_id", "__s", "__e", leads.alias("__leads"))
    row = lambda d, t, kind, **more: d.select(*(lk if kind == 1 else own), t.alias("__t"), F.lit(kind).alias("__kind"), *[c.alias(n) for n, c in more.items()])
    both = row(points, us(ts), 1, __id=F.col(point_id))
    both = both.unionByName(row(w, F.col("__s"), 0), allowMissingColumns=True)
    both = both.unionByName(row(w, F.col("__e"), 2, __lead=F.when(F.col("__leads"), F.struct("__s", "window_id"))), allowMissingColumns=True).withColumn("__span", span("__t"))
    open_ = F.when(F.col("__kind") == 0, 1).when(F.col("__kind") == 2, -1).otherwise(0)
    totals = both.groupBy(*own, "__span").agg(F.sum(open_).alias("__n"), F.min(F.when(F.col("__lead").isNotNull(), F.struct("__t", "__lead")))["__lead"].alias("__lead"), F.max(F.when(F.col("__kind") == 0, F.col("__t"))).alias("__begun"))
    back = W.partitionBy(*own).orderBy(F.desc("__span"))
    carried = totals.select(*own, "__span", F.sum("__n").over(before(by_span)).alias("__n0"), F.last("__lead", ignorenulls=True).over(before(back)).alias("__lead0"), F.max("__begun").over(W.partitionBy(*own)).alias("__last"))

    here = W.partitionBy(*own, "__span")
    d = both.withColumn("__n", F.sum(open_).over(upto(here.orderBy("__t", "__kind"))))
    d = d.withColumn("__next", F.last("__lead", ignorenulls=True).over(upto(here.orderBy(F.desc("__t"), F.desc("__kind"))))).where("__kind = 1")
    d = d.join(carried, [*own, "__span"], "left")
    n = F.when(F.col("__t").isNotNull(), F.col("__n") + F.coalesce("__n0", F.lit(0))).otherwise(0)
    d = d.select("*", n.cast("long").alias("n_windows"))
    held: Column = F.col("n_windows") > 0
    position = F.when(held, "in").when(F.col("__last").isNull(), "allowed").when(F.col("__t") < F.col("__last"), "before").otherwise("after")
    return d.select(F.col("__id").alias(point_id), position.alias("position"), "n_windows", F.when(held, F.coalesce("__next", "__lead0")["window_id"]).alias("window_id"))
