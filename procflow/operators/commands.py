"""Command detection over lines, documents and given commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procflow.functions import commands as C
from procflow.functions.text import strip
from procflow.session import computed

FIELDS = ("raw", "normalized", "vendor", "protocol", "mode", "confidence")


def classify(lines: DataFrame, column: str = "raw", known: bool = False) -> DataFrame:
    """``lines`` with raw trimmed, and normalized, vendor, protocol, mode, confidence; all null where the line is
    no command. A cheap test on the first word comes before the patterns of each vendor; with ``known``, all lines have
    passed it."""
    d = lines.withColumn("raw", strip(F.col(column)))
    text = C.strip_prompt(F.col("raw"))
    d = computed(d, __text=text if known else F.when(C.is_command(F.col("raw")), text))
    d = d.withColumn("__vm", F.when(F.col("__text").isNotNull(), C.vendor_mode(F.col("__text"))))
    d = d.withColumn("protocol", F.when(F.col("__text").isNotNull(), C.protocol(F.col("__text"))))
    vendor = F.split_part(F.col("__vm"), F.lit("/"), F.lit(1))
    return (
        d.withColumn("normalized", C.normalize(F.col("__text")))
        .withColumn("confidence", F.when(F.col("__text").isNotNull(), C.confidence(vendor, F.col("protocol"))))
        .withColumn("mode", F.split_part(F.col("__vm"), F.lit("/"), F.lit(2)))
        .withColumn("vendor", F.when(F.col("__text").isNotNull(), F.coalesce(vendor, F.lit("generic"))))
        .drop("__text", "__vm")
    )


def extract_commands(lines: DataFrame, column: str = "raw", texts: DataFrame | None = None) -> DataFrame:
    """The lines that are commands, classified. Map-only. ``texts``: every text of the column as ``raw``, each once
    (session.repeated); the patterns then run once a text."""
    if texts is not None:
        # told by a column: a filter on the text itself would be put on the lines, too, by the join's equality
        told = computed(texts.select("raw", F.col("raw").alias("__line")), __is=C.is_command(F.col("raw"))).where("__is").drop("__is")
        known = classify(told, known=True)
        d = lines.withColumnRenamed(column, "__line").join(F.broadcast(known), "__line")
        told = [c for c in known.columns if c not in ("__line", "raw")]
        own = [F.col("__line").alias(column) if c == column != "raw" else F.col(c) for c in lines.columns]
        return d.select(*own, *([] if column == "raw" else ["raw"]), *told)
    return classify(lines.where(C.is_command(F.col(column))), column, known=True)


def enrich_commands(commands: DataFrame, column: str = "raw") -> DataFrame:
    """Given commands with the fields filled in; unrecognised ones are generic with confidence 0.1."""
    d = classify(commands.withColumn("__given", F.col(column)), column)
    unknown = F.col("vendor").isNull()
    return (
        d.withColumn("raw", F.when(unknown, F.col("__given")).otherwise(F.col("raw")))
        .withColumn("normalized", F.coalesce("normalized", C.normalize(F.col("__given"))))
        .withColumn("confidence", F.coalesce("confidence", F.lit(0.1)))
        .withColumn("vendor", F.coalesce("vendor", F.lit("generic")))
        .drop("__given")
    )


def command_counts(docs: DataFrame, commands: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, n_commands`` for every document, none counted as 0."""
    n = commands.groupBy(key).agg(F.count("*").alias("n_commands"))
    return docs.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n_commands", F.lit(0)).alias("n_commands"))
