"""Writing artifacts, models and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_test_cases(rows: DataFrame, path: str) -> None:
    """CSV with a header, every field quoted."""
    rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def rules_by_document(rules: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a document with its rules as an array."""
    fields = [c for c in rules.columns if c not in keys]
    return rules.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("rules"))


def write_rules(rules: DataFrame, path: str, keys: tuple[str, ...] = ("doc_id",), apart: bool = False) -> None:
    """Rules as JSON, one line a document; ``apart``: one file a document, in a folder named by its keys."""
    d = rules_by_document(rules, keys)
    w = d.write.mode("overwrite")
    (w.partitionBy(*keys) if apart else w).json(path)


def models_with_steps(models: DataFrame, steps: DataFrame, key: str = "doc_id") -> DataFrame:
    fields = ["sequence", *[c for c in steps.columns if c not in (key, "sequence")]]
    s = steps.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("sequence", F.struct(*fields).alias("s")))).alias("x"))
    return models.join(s.select(key, F.transform("x", lambda x: x["s"]).alias("steps")), key, "left")


def write_models(models: DataFrame, path: str) -> None:
    models.write.mode("overwrite").json(path)


def write_reports(reports: DataFrame, path: str, date: str = "report_date") -> None:
    """Reports as JSON, one folder a date."""
    reports.write.mode("overwrite").partitionBy(date).json(path)
