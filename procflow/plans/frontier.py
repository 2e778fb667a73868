"""Waves and critical paths of graphs too large for one task: frontier by frontier, with back-pointers.

Steps and edges stay tables. A round takes the steps whose last need was met in the round before; there are as many
rounds as the longest chain has steps. The chain itself is read back along the pointers by a recursive query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procflow.session import new_folder


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, so that a round does not compute the rounds before again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def waves_by_frontier(steps: DataFrame) -> DataFrame:
    """``execution_id, step_id, wave, critical_pos`` as ``graph.waves`` gives them, of ``execution_id, step_id,
    dependencies, place`` (place: what orders the ends of equally long chains). Runs a few jobs a wave while it is
    called."""
    spark = steps.sparkSession
    ids = _kept(steps.groupBy("execution_id", "step_id").agg(F.min("place").alias("place")), "graph-steps")
    named = steps.select("execution_id", "step_id", F.explode("dependencies").alias("needs")).where("needs IS NOT NULL").distinct()
    edges = _kept(named.join(ids.select("execution_id", F.col("step_id").alias("needs")), ["execution_id", "needs"], "left_semi"), "graph-edges")
    degree = edges.groupBy("execution_id", "step_id").agg(F.count("*").alias("open"))
    state = _kept(ids.select("execution_id", "step_id").join(degree, ["execution_id", "step_id"], "left").select("execution_id", "step_id", F.coalesce("open", F.lit(0)).alias("open"), F.lit(None).cast("string").alias("before")), "graph-state")
    done, wave = [], 1
    while True:
        front = state.where("open = 0").select("execution_id", "step_id", F.lit(wave).alias("wave"), "before")
        if not front.limit(1).count():
            break
        done.append(front)
        met = edges.join(front.select("execution_id", F.col("step_id").alias("needs")), ["execution_id", "needs"]).groupBy("execution_id", "step_id").agg(F.count("*").alias("met"), F.min("needs").alias("low"))
        left = state.where("open > 0").select("execution_id", "step_id", "open").join(met, ["execution_id", "step_id"], "left")
        # the last needs to be met are those of the wave before: the chain goes through the first of them by name
        state = _kept(left.select("execution_id", "step_id", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"), F.col("low").alias("before")), "graph-state")
        wave += 1
    leveled = state.select("execution_id", "step_id", F.lit(-1).alias("wave"), F.lit(None).cast("string").alias("before"))
    for front in done:
        leveled = leveled.unionByName(front)
    leveled = _kept(leveled, "graph-waves")
    last = leveled.where("wave > 0").join(ids, ["execution_id", "step_id"]).groupBy("execution_id").agg(F.max("wave").alias("wave"), F.min_by(F.struct("step_id", "before"), F.struct(-F.col("wave"), "place", "step_id")).alias("end"))
    on = _chains(last.select("execution_id", "wave", "end.step_id", "end.before"), leveled.where("before IS NOT NULL OR wave = 1"), wave) if done else last.selectExpr("execution_id", "end.step_id", "wave AS critical_pos")
    return leveled.select("execution_id", "step_id", "wave").join(on, ["execution_id", "step_id"], "left").select("execution_id", "step_id", "wave", "critical_pos")


def _chains(ends: DataFrame, pointers: DataFrame, depth: int) -> DataFrame:
    """``execution_id, step_id, critical_pos`` of the chains that lead to ``ends``: one row a step and level."""
    spark = ends.sparkSession
    names = ("spark.sql.cteRecursionLevelLimit", "spark.sql.cteRecursionRowLimit")
    was = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], str(max(int(was[0]), depth + 2)))
    spark.conf.set(names[1], "-1")
    try:
        sql = """WITH RECURSIVE chain(execution_id, step_id, before, critical_pos) AS (
          SELECT execution_id, step_id, before, wave FROM {ends}
          UNION ALL
          SELECT c.execution_id, p.step_id, p.before, c.critical_pos - 1 FROM chain c JOIN {pointers} p ON p.execution_id = c.execution_id AND p.step_id = c.before)
        SELECT execution_id, step_id, critical_pos FROM chain"""
        return _kept(spark.sql(sql, ends=ends, pointers=pointers), "graph-chains")
    finally:
        for n, v in zip(names, was, strict=True):
            spark.conf.set(n, v)
