"""Queries that write files in a new folder below the shared one and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from procflow.functions import commands as C
from procflow.functions import patterns as P
from procflow.operators import artifacts as R
from procflow.operators import fleet as Z
from procflow.operators import runlog as L
from procflow.plans import graph as G
from procflow.queries import artifacts, operations
from procflow.queries import views as V
from procflow.queries.documents import models
from procflow.session import new_folder, table, tasks
from procflow.sources import dimensions as D
from procflow.sources import documents as S
from procflow.sources import writers

#: Files that a task writes, about.
FILES = 1000

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_TEXT = "CASE WHEN s_suppkey % 7 = 0 THEN '%PDF-1.7 ' ELSE '# ' END || s_name || chr(10) || 'Nation ' || s_nationkey || chr(13) || chr(10) || 'show version'"


@query("s01_read_documents", f"SELECT s_suppkey::BIGINT AS supplier, CASE WHEN s_suppkey % 7 = 0 THEN 'pdf' ELSE 'txt' END AS source_format, CASE WHEN s_suppkey % 7 <> 0 THEN {_TEXT} || chr(10) END AS text FROM supplier")
def s01(spark, sf):
    """One file a supplier; those that begin like a PDF are no text documents."""
    path = new_folder(spark, "documents")
    d = table(spark, sf, "supplier")
    # many tasks write, and each puts its files in place itself, which the driver would do one after the other
    d = d.repartition(tasks(spark, d.count(), FILES), "s_suppkey").selectExpr("s_suppkey", f"{_TEXT.replace('chr(', 'char(')} AS value")
    d.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("s_suppkey").text(path)
    return S.read_files(spark, path).select(F.regexp_extract("path", r"s_suppkey=(\d+)", 1).cast("long").alias("supplier"), "source_format", "text")


@query("s04_read_models", f"WITH {V.STEPS} SELECT '/in/part_' || doc_id AS source_file, (sequence - 1)::INT AS position, step_id, sequence::INT AS sequence, action_type, section, description, raw AS raw_text, expected_output, array_to_string(tags, ',') AS tags FROM steps")
def s04(spark, sf):
    path = new_folder(spark, "models")
    whole = writers.models_with_steps(models(spark, sf), V.proc_steps(spark, sf))
    writers.write_models(whole.withColumn("source_file", F.concat(F.lit("/in/part_"), F.col("doc_id").cast("string"))), path)
    steps = S.model_steps(S.read_models(spark, path, one_a_file=False))
    return steps.select("source_file", "position", "step_id", "sequence", "action_type", "section", "description", "raw_text", "expected_output", F.array_join("tags", ",").alias("tags"))


_DECIDED = "'x' || user_id AS execution_id, 's' || event_id % 6 AS step_id, CASE event_type WHEN 'error' THEN 'RETRY' WHEN 'purchase' THEN 'ROLLBACK' ELSE 'CONTINUE' END AS decision"


@query("s05_read_decisions", f"SELECT {_DECIDED}, (event_id % 9)::DOUBLE / 8 AS confidence, event_id::VARCHAR AS correlation_id FROM events WHERE event_id % 11 NOT IN (3, 7)")
def s05(spark, sf):
    """A log in which some lines are blank and some are cut short."""
    path = new_folder(spark, "decisions")
    d = table(spark, sf, "events").selectExpr("event_id", f"to_json(struct({_DECIDED}, cast(event_id % 9 AS double) / 8 AS confidence, cast(event_id AS string) AS correlation_id)) AS line")
    k = F.col("event_id") % 11
    d.select(F.when(k == 3, "").when(k == 7, F.substring("line", 1, 20)).otherwise(F.col("line"))).write.text(path)
    return S.read_decisions(spark, path).select("execution_id", "step_id", "decision", "confidence", "correlation_id")


@query("s06_write_test_cases", artifacts.SQL["r04_test_cases"])
def s06(spark, sf):
    path = new_folder(spark, "cases")
    names = ("doc_id", "position", "name", "priority", "labels", "component", "folder")
    writers.write_test_cases(R.test_cases(V.proc_steps(spark, sf), models(spark, sf)).select(*names), path)
    return spark.read.schema("doc_id long, position int, " + ", ".join(f"{c} string" for c in names[2:])).option("header", True).option("escape", '"').csv(path)


@query("s09_write_reports", f"""WITH r AS ({operations.SQL["e11_execution_report"]}), c AS (WITH {operations.LOG} SELECT execution_id, epoch_us(min(ts)) // 86400000000 AS day FROM log WHERE entity = 'execution' GROUP BY execution_id)
SELECT r.*, coalesce((DATE '1970-01-01' + c.day::INT)::VARCHAR, 'none') AS report_date FROM r LEFT JOIN c USING (execution_id)""")
def s09(spark, sf):
    """Reports by the day on which their execution was first seen."""
    path = new_folder(spark, "reports")
    made = L.execution_state(operations.log(spark, sf)).select("execution_id", F.floor(L.millis("created_at") / 86_400_000).cast("int").alias("day"))
    day = F.coalesce(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")).cast("string"), F.lit("none"))
    reports = operations.e11(spark, sf).join(made, "execution_id", "left").withColumn("report_date", day).drop("day")
    writers.write_reports(reports, path)
    return spark.read.schema(reports.schema).json(path)


@query("s11_loaded_patterns", f"WITH {V.LINES} SELECT doc_id, line_no, {V.sql_vendor_mode('raw')} AS vendor_mode FROM lines")
def s11_patterns(spark, sf):
    path = new_folder(spark, "patterns")
    D.pattern_rows(spark, P.VENDORS).write.json(path)
    return V.proc_lines(spark, sf).select("doc_id", "line_no", C.vendor_mode(F.col("raw"), D.load_patterns(spark, path)).alias("vendor_mode"))


@query("s11_loaded_block_list", operations.SQL["x11_blocked_commands"])
def s11_blocked(spark, sf):
    path = new_folder(spark, "blocked")
    spark.createDataFrame(list(enumerate(P.BLOCKED_COMMANDS)), D.BLOCKED).write.json(path)
    steps = operations.plan_steps(spark, sf).withColumn("normalized", F.lower("raw"))
    return G.blocked_commands(steps, D.load_block_list(spark, path)).select("execution_id", "step_id", "pattern")


@query("s11_loaded_inventory", operations.SQL["z03_test_plan"])
def s11_inventory(spark, sf):
    """Devices and the catalog from files, resolved and planned."""
    path = new_folder(spark, "fleet")
    operations._instances(spark, sf).write.json(f"{path}/devices")
    operations._catalog(spark).write.json(f"{path}/tests")
    devices = Z.resolve_devices(D.read_inventory(spark, f"{path}/devices"), *operations._dims(spark))
    return Z.test_plan(devices, D.read_catalog(spark, f"{path}/tests"), "smoke").select("device", "protocol", "test_id")
