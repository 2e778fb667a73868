"""Comparison of outputs before and after, of procedure versions and of test runs."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from procflow.functions.text import strip

# ---- Fixed values: what two runs of one command differ in without meaning, and what stands for it ----
TIMESTAMP = r"\b\d{1,2}:\d{2}:\d{2}(\.\d+)?\b|\b(Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{4}\b|\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\b"
COUNTER = r"(?im)^\s*\d+\s+(packets?|bytes?|errors?|drops?|input|output)\b.*$"


def normalize_output(c: Column, ignore_timestamps: bool = True, ignore_counters: bool = True) -> Column:
    """Output with timestamps and counter lines replaced by marks, trimmed."""
    if ignore_timestamps:
        c = F.regexp_replace(c, TIMESTAMP, "<TS>")
    if ignore_counters:
        c = F.regexp_replace(c, COUNTER, "<COUNTER>")
    return strip(c)


#: What the two sides of a diff are called (fixed values).
BEFORE, AFTER = "pre-check (baseline)", "post-check (current)"


def _line_diff(old: str, new: str) -> tuple[bool, list[str], list[str], list[str]]:
    """Whether any line differs, the lines added and removed (blank ones left out), and the unified diff."""
    b, c = old.splitlines(), new.splitlines()
    sides: tuple[list[str], list[str]] = ([], [])
    for kind, i, j, m, n in difflib.SequenceMatcher(None, b, c).get_opcodes():
        if kind != "equal":
            sides[0].extend(c[m:n])
            sides[1].extend(b[i:j])
    added, removed = ([x.strip() for x in lines if x.strip()] for lines in sides)
    return any(map(len, sides)), added, removed, list(difflib.unified_diff(b, c, BEFORE, AFTER, lineterm=""))


def _unified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        rows = [(k, *_line_diff(old, new)) for k, old, new in zip(x["key"], x["b"], x["c"])]
        yield pd.DataFrame(rows, columns=["key", "changed", "added", "removed", "diff_lines"])


def text_diff(pairs: DataFrame, **ignore: bool) -> DataFrame:
    """``key, changed, added, removed, diff_lines`` (lines in order) from ``key, baseline, current``. A blank line more
    or less is a change, though none of the lines named. Equal outputs are told by their normal forms in the JVM; only
    pairs that differ go through the line differ."""
    n = pairs.select(F.col("key"), normalize_output(F.coalesce("baseline", F.lit("")), **ignore).alias("b"), normalize_output(F.coalesce("current", F.lit("")), **ignore).alias("c"))
    none = F.array().cast("array<string>")
    key = n.schema["key"].dataType.simpleString()
    same = n.where("b = c").select("key", F.lit(False).alias("changed"), none.alias("added"), none.alias("removed"), none.alias("diff_lines"))
    return same.unionByName(n.where("b <> c").mapInPandas(_unified, f"key {key}, changed boolean, added array<string>, removed array<string>, diff_lines array<string>"))


def line_changes(pairs: DataFrame, **ignore: bool) -> DataFrame:
    """``key, n_added, n_removed`` as multisets of lines: what joins and counts alone can say."""
    side = lambda c: pairs.select("key", F.explode(F.split(normalize_output(F.coalesce(c, F.lit("")), **ignore), "\n")).alias("line")).where("line <> ''").groupBy("key", "line").agg(F.count("*").alias("n"))
    d = side("baseline").withColumnRenamed("n", "nb").join(side("current").withColumnRenamed("n", "nc"), ["key", "line"], "full_outer").na.fill(0, ["nb", "nc"])
    return d.groupBy("key").agg(F.sum(F.greatest(F.lit(0), F.col("nc") - F.col("nb"))).alias("n_added"), F.sum(F.greatest(F.lit(0), F.col("nb") - F.col("nc"))).alias("n_removed"))


def step_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``doc_id, sequence, change, details``: steps added, removed or changed. Of steps with one sequence the last
    counts. ``commands`` holds the commands' texts."""
    last = lambda d: d.withColumn("__r", F.row_number().over(W.partitionBy("doc_id", "sequence").orderBy(F.col("position").desc()))).where("__r = 1").drop("__r", "position")
    b, a = last(before), last(after)
    for c in ("description", "commands", "expected_output", "section"):
        b, a = b.withColumnRenamed(c, f"b_{c}"), a.withColumnRenamed(c, f"a_{c}")
    d = b.withColumn("in_b", F.lit(True)).join(a.withColumn("in_a", F.lit(True)), ["doc_id", "sequence"], "full_outer")
    plus, minus = F.array_sort(F.array_except("a_commands", "b_commands")), F.array_sort(F.array_except("b_commands", "a_commands"))
    differs = lambda c: ~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))
    details = F.concat_ws(
        "; ",
        F.when(differs("description"), F.lit("description changed")),
        F.when(F.size(plus) > 0, F.concat(F.lit("commands added: "), F.array_join(F.slice(plus, 1, 3), ", "))),
        F.when(F.size(minus) > 0, F.concat(F.lit("commands removed: "), F.array_join(F.slice(minus, 1, 3), ", "))),
        F.when(differs("expected_output"), F.lit("expected_output changed")),
        F.when(differs("section"), F.concat(F.lit("section moved: "), F.coalesce("b_section", F.lit("None")), F.lit(" → "), F.coalesce("a_section", F.lit("None")))),
    )
    change = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").when(details != "", "changed")
    return d.select("doc_id", "sequence", change.alias("change"), F.when(change == "changed", details).alias("details")).where("change is not null")


def comparison_report(diffs: DataFrame, group: str) -> DataFrame:
    """Per group: checks in total, changed, identical."""
    return diffs.groupBy(group).agg(F.count("*").alias("total"), F.count_if("changed").alias("changed"), F.count_if(~F.col("changed")).alias("identical"))


def comparison_details(diffs: DataFrame, group: str, most: int = 5) -> DataFrame:
    """``group, key, added, removed`` of each changed check: the first ``most`` lines of both kinds. Map-only."""
    some = lambda c: F.array_join(F.slice(c, 1, most), "; ").alias(c)
    return diffs.where("changed").select(group, "key", some("added"), some("removed"))


def diff_summary(added: Column, removed: Column, most: int = 3) -> Column:
    """Number of lines added and removed, with the first of them; or that nothing changed."""
    side = lambda name, c: F.concat(F.lit(name + " ("), F.size(c).cast("string"), F.lit(" lines): "), F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, most), ", ")).otherwise("(none)"), F.when(F.size(c) > most, "…").otherwise(""))
    return F.concat_ws(" | ", side("Added", added), side("Removed", removed))


def step_diff_summary(changes: DataFrame) -> DataFrame:
    """``doc_id, summary``: ``+added/-removed/~changed``."""
    of = lambda k: F.count_if(F.col("change") == k).cast("string")
    return changes.groupBy("doc_id").agg(F.concat(F.lit("+"), of("added"), F.lit("/-"), of("removed"), F.lit("/~"), of("changed")).alias("summary"))


def compare_runs(base: DataFrame, current: DataFrame) -> DataFrame:
    """Test results of two runs by device, protocol and test: both statuses and the change between them."""
    keys = ["device", "protocol", "test_id"]
    d = base.select(*keys, F.col("status").alias("before")).join(current.select(*keys, F.col("status").alias("after")), keys, "full_outer")
    change = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "missing").when((F.col("before") == "PASS") & F.col("after").isin("FAIL", "ERROR"), "regression").when(F.col("before").isin("FAIL", "ERROR") & (F.col("after") == "PASS"), "fixed").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return d.withColumn("change", change)


def run_verdict(compared: DataFrame) -> DataFrame:
    """Per device: regressions, fixes and the verdict."""
    g = compared.groupBy("device").agg(F.count_if(F.col("change") == "regression").alias("regressions"), F.count_if(F.col("change") == "fixed").alias("fixed"))
    return g.withColumn("verdict", F.when(F.col("regressions") > 0, "FAIL").otherwise("PASS"))
