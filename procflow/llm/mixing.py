"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket; the bucket in which a source's budget runs out is found by a running
sum over its (at most 4096) buckets, and only that bucket is cut finer, twice more. What remains is one 36-bit
threshold a source: a row is taken if its hash is not above it. No rows are sorted, and a smaller budget takes a
subset of what a larger one takes. Targets above a source's size take it whole as often as it goes, and the rest
by threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from procflow.llm.common import cut, n_words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Three levels of 12 bits each.
LEVEL_BITS = 12
LEVELS = 3
HASH_HEX = LEVEL_BITS * LEVELS // 4
#: Rows of the per-source table up to which it is broadcast; beyond, it is joined by shuffle with salted keys.
BROADCAST_SOURCES = 100_000
SALT = 64


def row_hash(doc_id: Column, text: Column) -> Column:
    """36 bits of the MD5 digest of the id and the text: the same on every run and in every engine."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("\n"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, HASH_HEX), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size`` (one row a source).

    Weights go by the source's place in code-point order, null last, repeating. The targets share the total by
    weight; none exceeds ``max_epochs`` times its source, and the excess is shared again until none does. That
    is a water level: target = min(weight * level, cap), where the sources that reach their cap are a prefix in
    the order of cap / weight. Windows run over one row a source.
    """
    place = W.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    k = F.pmod(F.row_number().over(place) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), k + 1).cast("long")
    s = sources.withColumn("weight", weight).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "utf-8"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    s = s.select(
        "*",
        F.sum("source_size").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"),
        F.coalesce(F.sum("cap").over(before), zero).alias("cap_before"),
        F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).alias("weight_left"),
    )
    s = s.withColumn("level", (F.col("total") - F.col("cap_before")).cast("double") / F.col("weight_left"))
    s = s.withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
    # the level of the first source below its cap (the highest, as levels fall from there) holds for all after it
    s = s.withColumn("water", F.max(F.when(~F.col("capped"), F.col("level"))).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return s.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("water")).alias("target"))


def _by_source(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    """Join rows with one row a source; null is a source. A hot source's rows are spread by salt."""
    p = per_source.withColumnRenamed("source", "__source")
    on = F.col("source").eqNullSafe(F.col("__source"))
    if few:
        return rows.join(F.broadcast(p), on, "left").drop("__source")
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64("h"), F.lit(SALT)).cast("int"))
    p = p.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return salted.join(p, on & (F.col("__salt") == F.col("__salt2")), "left").drop("__source", "__salt", "__salt2")


def thresholds(rows: DataFrame, budgets: DataFrame, few: bool) -> DataFrame:
    """``source, cut``: rows of a source with ``h <= cut`` hold about ``budget`` words (-1: none).

    ``rows``: source, h (36 bits), size. ``budgets``: source, budget. Each level sums the words of the buckets
    inside the bucket that the level above left open. The last, 36-bit, bucket is taken if that is nearer.
    """
    state = budgets.select("source", F.lit(0).cast("long").alias("open"), F.lit(0).cast("double").alias("base"), "budget")
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        inside = _by_source(rows.where("size > 0"), state, few).where(F.shiftright("h", shift + LEVEL_BITS) == F.col("open"))
        hist = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.first("base").alias("base"), F.first("budget").alias("budget"))
        w = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
        hist = hist.withColumn("upto", F.col("base") + F.sum("words").over(w))
        # the bucket in which the budget runs out, or the last one if it never does
        at = hist.groupBy("source").agg(
            F.min_by(F.struct("bucket", "words", "upto"), F.when(F.col("upto") > F.col("budget"), F.col("bucket"))).alias("over"),
            F.max_by(F.struct("bucket", "words", "upto"), F.col("bucket")).alias("last"),
            F.first("budget").alias("budget"),
        )
        at = at.select("source", F.coalesce("over", "last").alias("at"), "budget")
        state = at.select("source", F.col("at.bucket").alias("open"), (F.col("at.upto") - F.col("at.words")).alias("base"), "budget", F.col("at.upto").alias("upto"))
        state = cut(state, f"thresholds-{level}") if level < LEVELS - 1 else state
        if level < LEVELS - 1:
            state = state.drop("upto")
    near = F.col("upto") - F.col("budget") <= F.col("budget") - F.col("base")
    return state.select("source", F.when(F.col("budget") <= 0, -1).when(near, F.col("open")).otherwise(F.col("open") - 1).alias("cut"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame, bool]:
    """Slim rows ``doc_id, source, h, size``; the plan ``source, source_size, target, whole, cut`` of each source;
    and whether the plan is small enough to be broadcast."""
    rows = cut(docs.select("doc_id", "source", row_hash(docs["doc_id"], docs["text"]).alias("h"), n_words(docs["text"]).alias("size")), "sizes")
    per_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    per_source = cut(per_source.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    few = per_source.count() <= BROADCAST_SOURCES
    full = _by_source(per_source.withColumn("h", F.xxhash64("source")), thresholds(rows, per_source, few), few).drop("h")
    return rows, cut(full.select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit(-1)).alias("cut")), "plan"), few


def _epochs(h: str = "h") -> Column:
    return F.col("whole") + F.when(F.col(h) <= F.col("cut"), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``doc_id, source, h, size, source_size, target, epochs, taken`` for every row of ``docs``.

    size: words of the text (null: 0). epochs: how often the mix takes the row, from 0 to ``max_epochs``;
    taken = size * epochs. Rows are told apart by doc_id and text, so equal rows are taken together; reruns
    agree. Null sources form one source. A total of no words gives targets of 0. Needs doc_id, text, source.
    """
    rows, sources, few = plan(docs, weights, max_epochs)
    out = _by_source(rows, sources, few).withColumn("epochs", _epochs())
    return out.withColumn("taken", F.col("size") * F.col("epochs")).select("doc_id", "source", "h", "size", "source_size", "target", "epochs", "taken")


def take(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mixture itself: rows of ``docs``, each as often as the mix takes it. Columns stay as they are."""
    _, sources, few = plan(docs, weights, max_epochs)
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")
    packed = docs.select(own, F.col("source"), row_hash(F.col("doc_id"), F.col("text")).alias("h"))
    taken = _by_source(packed, sources, few).withColumn("__n", _epochs().cast("int")).where("__n > 0")
    return taken.select(F.explode(F.array_repeat("__row", F.col("__n"))).alias("r")).select("r.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || chr(10) || coalesce(text, '')), 1, 9))::BIGINT AS h
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
              3 * source_size AS cap FROM s0),
s2 AS (SELECT *, sum(source_size) OVER () AS total,
              coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
              sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source IS NULL, encode(source) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
       FROM s1),
s3 AS (SELECT *, (total - cap_before)::DOUBLE / weight_left AS level FROM s2),
s4 AS (SELECT *, cap <= weight * level AS capped, max(CASE WHEN cap > weight * level THEN level END) OVER () AS water FROM s3),
s AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE weight * water END AS target FROM s4),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM s),
g AS (SELECT source, h, sum(size) AS words FROM d WHERE size > 0 GROUP BY source, h),
c AS (SELECT g.*, b.target - b.whole * b.source_size AS budget,
             sum(words) OVER (PARTITION BY g.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS upto
      FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source),
o AS (SELECT source, any_value(budget) AS budget,
             coalesce(arg_min(struct_pack(h := h, words := words, upto := upto), h) FILTER (WHERE upto > budget), arg_max(struct_pack(h := h, words := words, upto := upto), h)) AS edge
      FROM c GROUP BY source),
t AS (SELECT source, CASE WHEN budget <= 0 THEN -1 WHEN edge.upto - budget <= budget - (edge.upto - edge.words) THEN edge.h ELSE edge.h - 1 END AS last_h FROM o)
SELECT d.doc_id, d.size, b.source_size, b.target,
       d.size * (b.whole + CASE WHEN d.h <= coalesce(t.last_h, -1) THEN 1 ELSE 0 END) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN t ON d.source IS NOT DISTINCT FROM t.source
"""
