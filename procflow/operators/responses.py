"""Parsing of stored model responses: JSON out of text, error classes, merged steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from procflow.functions import patterns as P
from procflow.functions.text import strip

COMMAND = "struct<raw:string,vendor:string,protocol:string,mode:string,confidence:double>"
STEP = f"struct<sequence:int,step_type:string,action_type:string,description:string,section:string,expected_output:string,is_rollback:boolean,commands:array<{COMMAND}>>"
RESPONSE = f"struct<document_title:string,steps:array<{STEP}>>"
STEP_TYPES = ("config", "verification", "rollback", "info", "action")
ACTION_TYPES = ("execute", "verify", "observe", "configure", "rollback")


def looks_like_refusal(raw: Column) -> Column:
    """No brace anywhere, and a refusing phrase within the first 300 characters."""
    head = F.lower(F.substring(raw, 1, 300))
    said = F.lit(False)
    for p in P.REFUSALS:
        said = said | F.contains(head, F.lit(p))
    return ~F.contains(raw, F.lit("{")) & said


def extract_json(raw: Column) -> Column:
    """The JSON in a response: without code fences, else from the first brace to the last, else as it stands; null
    if none of these parses."""
    clean = F.regexp_replace(F.regexp_replace(strip(raw), r"(?i)^```(?:json)?\s*", ""), r"\s*```\s*$", "")
    block = F.regexp_extract(clean, r"(?s)(\{.+\})", 1)
    ok = lambda s: F.when(F.try_parse_json(s).isNotNull(), s)
    return F.coalesce(ok(clean), ok(F.nullif(block, F.lit(""))), ok(raw))


def coerce(value: Column, allowed: tuple[str, ...], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(default))


def parse_responses(responses: DataFrame) -> DataFrame:
    """``responses`` plus ``json``, ``parsed``, ``error`` (ok, refusal, json_parse_fail, schema_violation) and
    ``evidence``. A response violates the schema if it has no array of steps."""
    raw = F.coalesce(F.col("raw"), F.lit(""))
    d = responses.withColumn("json", extract_json(raw))
    d = d.withColumn("parsed", F.from_json("json", RESPONSE))
    error = F.when(looks_like_refusal(raw), "refusal").when(F.col("json").isNull(), "json_parse_fail").when(F.col("parsed.steps").isNull(), "schema_violation").otherwise("ok")
    d = d.withColumn("error", error)
    evidence = F.when(F.col("error") == "refusal", F.substring(raw, 1, 500)).when(F.col("error") != "ok", F.substring(raw, 1, 1000))
    return d.withColumn("evidence", evidence)


def response_steps(parsed: DataFrame, start: str | None = None) -> DataFrame:
    """``doc_id, chunk_index, pos, sequence, step_type, ...`` of the steps in good responses. Commands without text
    go; vendor is generic and confidence 0.9 where not given; unknown types take their default; a missing
    sequence is the place, counted from ``start`` (a column; 1 if none)."""
    first = F.coalesce(F.col(start), F.lit(1)) if start else F.lit(1)
    s = parsed.where("error = 'ok'").select("doc_id", "chunk_index", first.alias("start"), F.posexplode("parsed.steps").alias("pos", "s"))
    commands = F.transform(
        F.filter(F.coalesce(F.col("s.commands"), F.array().cast(f"array<{COMMAND}>")), lambda c: strip(F.coalesce(c["raw"], F.lit(""))) != ""),
        lambda c: F.struct(c["raw"].alias("raw"), F.coalesce(c["vendor"], F.lit("generic")).alias("vendor"), c["protocol"].alias("protocol"), c["mode"].alias("mode"), F.coalesce(c["confidence"], F.lit(0.9)).alias("confidence")),
    )
    return s.select(
        "doc_id",
        "chunk_index",
        "pos",
        F.coalesce("s.sequence", F.col("start") + F.col("pos")).alias("sequence"),
        coerce(F.col("s.step_type"), STEP_TYPES, "action").alias("step_type"),
        coerce(F.col("s.action_type"), ACTION_TYPES, "execute").alias("action_type"),
        F.coalesce("s.description", F.lit("")).alias("description"),
        F.col("s.section").alias("section"),
        F.col("s.expected_output").alias("expected_output"),
        F.coalesce("s.is_rollback", F.lit(False)).alias("is_rollback"),
        commands.alias("commands"),
    )


def sequence_starts(parsed: DataFrame) -> DataFrame:
    """``doc_id, chunk_index, sequence_start``: one more than the steps of earlier good chunks."""
    n = F.when(F.col("error") == "ok", F.size("parsed.steps")).otherwise(0)
    w = W.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(W.unboundedPreceding, -1)
    return parsed.withColumn("__n", n).select("doc_id", "chunk_index", (F.coalesce(F.sum("__n").over(w), F.lit(0)) + 1).alias("sequence_start"))


def merge_chunks(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps of all chunks in order, renumbered from 1; and one row a document: chunks, failed chunks, whether the
    result is partial, latency and attempts."""
    w = W.partitionBy("doc_id").orderBy("chunk_index", "pos")
    steps = response_steps(parsed).withColumn("sequence", F.row_number().over(w))
    bad = F.array_sort(F.collect_list(F.when(F.col("error") != "ok", F.col("chunk_index"))))
    g = parsed.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), bad.alias("failed_chunks"), F.sum("latency_ms").alias("latency_ms"), F.sum("attempts").alias("attempts"))
    return steps, g.withColumn("success", F.size("failed_chunks") < F.col("n_chunks")).withColumn("partial", (F.size("failed_chunks") > 0) & F.col("success"))
