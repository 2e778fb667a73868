"""Sharding along a Hilbert curve over quantised metadata.

Three dimensions of five bits each, language, source and size, give every document a cell of a 32 x 32 x 32
cube; the Hilbert curve visits neighbouring cells one after the other, so that runs of the curve, cut into
shards or files, have narrow ranges in every dimension and readers can prune by any of them.

The order within the curve is made without a global sort and without a task that sees all rows of a cell: each
cell is split into SUB bins by a hash of the row; bins are counted, offsets come from two running sums of bounded
size (over the 32768 cells; over the SUB bins of each cell), and rows are numbered inside their bin.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType

from procflow.llm.common import cut

BITS = 5
SIDE = 1 << BITS
#: Bins of each curve cell. A cell with a third of 10^10 rows has bins of under a million rows.
SUB = 4096
N_SHARDS = 40
ROW_OVERHEAD = 16


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of points ``axes (n, dims)`` with ``bits`` bits a dimension.

    John Skilling's transform (2004): undo excess rotations from the top bit down, Gray-encode, interleave.
    """
    x = axes.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | (x[i] >> b & 1)
    return out


@F.pandas_udf(IntegerType())
def _curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.stack([a, b, c], axis=1), BITS), dtype="int32")


def size_level(size: Column) -> Column:
    """Size on a logarithmic scale: two levels a doubling, in order, the last one open."""
    return F.least(F.lit(SIDE - 1), F.floor(2 * F.log2(size.cast("double")) - 8).cast("int"))


def category(c: Column) -> Column:
    """A bucket of a category of unknown cardinality; null has its own value before hashing."""
    return F.pmod(F.crc32(F.coalesce(c, F.lit("\x00"))), F.lit(SIDE)).cast("int")


def doc_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_OVERHEAD


def with_curve(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep``, and of each row of ``docs`` (doc_id, text, lang and source if they are there): ``__size`` (UTF-8 bytes
    + 16), ``__cell`` (place on the curve), ``__bin``, and what orders the rows of a bin."""
    text = F.col("text")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string")
    d = docs.select(*keep, F.col("doc_id").alias("__id"), F.crc32(F.coalesce(text, F.lit(""))).alias("__crc"), text.isNull().alias("__none"), F.xxhash64("doc_id", "text").alias("__hash"), category(lang).alias("__lang"), category(source).alias("__source"), doc_size(text).alias("__size"))
    level = F.greatest(F.lit(0), size_level(F.col("__size")))
    d = d.withColumn("__cell", _curve(F.col("__lang"), F.col("__source"), level))
    return d.withColumn("__bin", F.pmod("__hash", F.lit(SUB)).cast("int")).drop("__lang", "__source", "__hash")


PLACED = ("__size", "__cell", "__shard", "__slot", "__rows")


def free_names(names: tuple[str, ...], taken: list[str]) -> dict[str, str]:
    """A name for each of ``names`` that no column bears: itself, else with underscores before it."""
    used, out = {c.lower() for c in taken}, {}
    for name in names:
        new = name
        while new.lower() in used:
            new = "_" + new
        out[name] = new
        used.add(new.lower())
    return out


def shard_by_hilbert(docs: DataFrame, n_shards: int = N_SHARDS, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of docs (all by default) plus ``__size, __cell, __shard, __slot, __rows``; where docs has columns of
    these names they stay, and the new ones get more underscores (``free_names``).

    Shards are runs of the curve; their row counts differ by one at most, and slots run from 0 without a gap.
    Null texts have 16 bytes; null languages and sources are a category; rows with equal keys are numbered in
    an order fixed by their doc_id and text digest. ``docs`` has doc_id and text; lang and source may be absent.
    """
    own = columns if columns is not None else docs.columns
    bins = cut(with_curve(docs).groupBy("__cell", "__bin").agg(F.count("*").alias("__n")), "bins")  # read twice
    cells = bins.groupBy("__cell").agg(F.sum("__n").alias("__n"))
    # one task over at most SIDE^3 rows, then one over at most SUB rows for each cell
    upto = W.orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("__cell", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__from"), F.sum("__n").over(W.orderBy("__cell").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("__rows"))
    within = W.partitionBy("__cell").orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.withColumn("__in", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(cells, "__cell")
    starts = bins.select("__cell", "__bin", (F.col("__from") + F.col("__in")).alias("__start"), "__rows")
    rows = with_curve(docs, F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"))
    order = W.partitionBy("__cell", "__bin").orderBy("__id", "__crc", "__none")
    rows = rows.withColumn("__k", F.row_number().over(order) - 1)
    ranked = rows.join(starts, ["__cell", "__bin"]).withColumn("__rank", F.col("__start") + F.col("__k"))
    # shard s holds ranks ceil(s * rows / n) to ceil((s + 1) * rows / n) - 1
    shard = F.expr(f"__rank * {n_shards} div __rows").cast("int")
    first = F.expr(f"(__shard * __rows + {n_shards} - 1) div {n_shards}")
    ranked = ranked.withColumn("__shard", shard).withColumn("__slot", (F.col("__rank") - first).cast("long"))
    return ranked.select("__row.*", *[F.col(c).alias(n) for c, n in free_names(PLACED, own).items()])


def shard_stats(sharded: DataFrame) -> DataFrame:
    """Rows, bytes and curve range of each shard: what a reader needs to prune shards."""
    return sharded.groupBy("__shard").agg(F.count("*").alias("n_rows"), F.sum("__size").alias("n_bytes"), F.min("__cell").alias("first_cell"), F.max("__cell").alias("last_cell"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, rows in slot order inside it."""
    sharded.repartition("__shard").sortWithinPartitions("__shard", "__slot").write.partitionBy("__shard").parquet(path)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = docs.select("doc_id", "text", "lang", "source").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    out = shard_by_hilbert(slim, columns=["doc_id", "text_crc32"])
    return out.select(
        "doc_id",
        F.col("__size").alias("size"),
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
