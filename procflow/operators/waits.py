"""Waiting for a condition on a device: a schedule of polls, what the device said at each, and when it was as wished."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procflow.operators.matching import search_pattern
from procflow.operators.timejoin import asof

# ---- Fixed values: seconds before the second poll, factor of each further one, and the longest ----
FIRST_S, FACTOR, LONGEST_S = 5, 2, 60
#: What a poll sees where the device has said nothing yet (fixed value).
SILENT = "ERROR: no output"


def poll_times(max_wait_s: Column, first_s: int = FIRST_S, factor: int = FACTOR, longest_s: int = LONGEST_S) -> Column:
    """Seconds after the start of each poll within ``max_wait_s``: 0, 5, 15, 35, 75, 135, ... A fold: each step adds a
    poll and lengthens the pause up to the longest. The poll that would fall on the limit or beyond is not made."""
    limit = max_wait_s.cast("double")
    grow, n = first_s, 0
    while grow < longest_s:
        grow, n = grow * factor, n + 1
    steps = F.sequence(F.lit(0), (F.ceil(F.greatest(limit, F.lit(0.0)) / longest_s) + n).cast("int"))
    start = F.struct(F.lit(0.0).alias("at"), F.lit(float(first_s)).alias("pause"), F.array().cast("array<double>").alias("polls"))

    def step(s: Column, _: Column) -> Column:
        polls = F.when(s["at"] < limit, F.concat(s["polls"], F.array(s["at"]))).otherwise(s["polls"])
        return F.struct((s["at"] + s["pause"]).alias("at"), F.least(s["pause"] * factor, F.lit(float(longest_s))).alias("pause"), polls.alias("polls"))

    return F.aggregate(steps, start, step, lambda s: s["polls"])


def poll_outcomes(waits: DataFrame, outputs: DataFrame) -> DataFrame:
    """``wait_id, met, attempts, elapsed_s, last_output`` of each wait.

    ``waits``: wait_id, device, command, start, max_wait_s, pattern, negate. ``outputs``: device, command, ts, output;
    a poll sees the last output of its device and command up to its time, SILENT before the first. A wait is met by the
    first poll whose output holds the pattern (in any case, over line ends; with ``negate`` that does not hold it), and
    elapsed_s is that poll's time, else the limit. A limit of zero or less allows no poll; a pattern that is null or
    does not compile stops the wait before the first: not met, no attempts, no time.
    """
    polls = waits.select("wait_id", "device", "command", "pattern", "negate", "start", F.posexplode(poll_times(F.col("max_wait_s"))).alias("k", "at"))
    polls = polls.withColumn("ts", F.col("start") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("at")))
    seen = asof(polls.select("wait_id", "device", "command", "pattern", "negate", "k", "at", "ts"), outputs.select("device", "command", F.col("ts").alias("said_at"), "output"), ["device", "command"], "ts", "said_at", "output")
    seen = seen.withColumn("output", F.coalesce("output", F.lit(SILENT)))
    seen = seen.withColumn("hit", search_pattern("pattern", "output"))
    ok = F.col("hit") != F.coalesce("negate", F.lit(False))
    g = seen.groupBy("wait_id").agg(
        F.min(F.when(ok, F.struct("k", "at", "output"))).alias("first"),
        F.max(F.when(F.col("hit").isNotNull(), F.struct("k", "output"))).alias("last"),
    )
    d = waits.select("wait_id", F.greatest(F.col("max_wait_s").cast("double"), F.lit(0.0)).alias("limit")).join(g, "wait_id", "left")
    met = F.col("first").isNotNull()
    tried = F.col("last").isNotNull()
    return d.select(
        "wait_id",
        met.alias("met"),
        F.when(met, F.col("first.k") + 1).when(tried, F.col("last.k") + 1).otherwise(0).cast("int").alias("attempts"),
        F.when(met, F.col("first.at")).when(tried, F.col("limit")).otherwise(0.0).alias("elapsed_s"),
        F.when(met, F.col("first.output")).otherwise(F.col("last.output")).alias("last_output"),
    )
