"""From raw documents to training shards, as a chain of stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back as the next
one's docs. All but the last return the columns of documents; the last adds shard and slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procflow.llm import decontaminate, mixing, sharding, simhash, toxicity
from procflow.llm.common import cut, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the class models score as toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as their source's target weight asks for, from not at all to three times."""
    return mixing.take(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets a shard and a slot along the Hilbert curve. Columns of these names that are there already
    stay; the new ones then have underscores before their names."""
    own = docs.columns
    placed, named = sharding.free_names(sharding.PLACED, own), sharding.free_names(("shard", "slot"), own)
    rows = sharding.shard_by_hilbert(docs)
    return rows.select(*[F.col(f"`{c}`") for c in own], *[F.col(placed[f"__{c}"]).alias(n) for c, n in named.items()])


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The models and fingerprints of the stages have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is cut from its lineage."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{name}")
    return docs
