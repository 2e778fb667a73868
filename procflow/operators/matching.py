"""Checks of device output against expectations, whose patterns differ by row and may be no valid regex.

A pattern in a column cannot go to rlike: one that does not compile fails the job. The helpers here are Arrow
functions that compile each distinct pattern once and fall back as defined.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from procflow.functions import patterns as P

#: Characters that make an expectation a pattern (fixed values).
SPECIAL = frozenset(".*+?[](){}^$|\\")


@lru_cache(maxsize=4096)
def _compiled(pattern: str, flags: int) -> re.Pattern | None:
    try:
        return re.compile(pattern, flags)
    except re.error:
        return None


def _matches(expected: str | None, actual: str | None) -> bool:
    if not actual or expected is None:
        return False
    if SPECIAL & set(expected):
        p = _compiled(expected, re.I | re.S)
        if p is not None:
            return p.search(actual) is not None
    return expected.lower() in actual.lower()


@F.pandas_udf(BooleanType())
def match_expected(expected: pd.Series, actual: pd.Series) -> pd.Series:
    """True if the output holds what is expected: as a pattern where it looks like one and compiles, else as text
    in any case. Empty output holds nothing."""
    return pd.Series([_matches(e, a) for e, a in zip(expected, actual)], dtype=bool)


def searched(pattern: str | None, output: str) -> bool | None:
    """Whether a pattern is found in an output, in any case and over line ends; None if it does not compile."""
    p = _compiled(pattern, re.I | re.S) if pattern is not None else None
    return None if p is None else p.search(output) is not None


@F.pandas_udf(BooleanType())
def search_pattern(pattern: pd.Series, output: pd.Series) -> pd.Series:
    """``searched`` of columns whose patterns differ by row."""
    return pd.Series([searched(p, o) for p, o in zip(pattern, output)], dtype=object)


def device_error(output: Column) -> Column:
    """The first sign of an error in a device's output; null if none."""
    return F.nullif(F.regexp_extract(F.coalesce(output, F.lit("")), P.DEVICE_ERROR, 0), F.lit(""))


def validate_outputs(d: DataFrame) -> DataFrame:
    """Rows of ``action_type, expected_output, output`` plus error_sign, expected_found, passed. Every step is
    scanned for errors; only verify and observe steps are held to their expectation."""
    checked = F.col("action_type").isin("verify", "observe") & (F.coalesce("expected_output", F.lit("")) != "")
    d = d.withColumn("error_sign", device_error(F.col("output"))).withColumn("expected_found", F.when(checked, match_expected("expected_output", "output")))
    return d.withColumn("passed", F.col("error_sign").isNull() & F.coalesce("expected_found", F.lit(True)))


def rule_checks(rules: DataFrame, outputs: DataFrame) -> DataFrame:
    """Rules (execution_id, step_id, device, cmd, expect_pattern, negate) against outputs (execution_id, device,
    command, output): ``ok`` per rule, false where there is no output. ``negate`` turns the match around."""
    o = outputs.select("execution_id", "device", F.col("command").alias("cmd"), "output")
    d = rules.join(o, ["execution_id", "device", "cmd"], "left")
    hit = match_expected("expect_pattern", "output")
    return d.withColumn("ok", F.coalesce(F.col("output").isNotNull() & (hit != F.coalesce("negate", F.lit(False))), F.lit(False)))


def step_rule_verdicts(checks: DataFrame) -> DataFrame:
    """``execution_id, step_id, n_rules, n_failed, passed``."""
    g = checks.groupBy("execution_id", "step_id").agg(F.count("*").alias("n_rules"), F.count_if(~F.col("ok")).alias("n_failed"))
    return g.withColumn("passed", F.col("n_failed") == 0)


def _verdict(pattern: str | None, output: str | None) -> str:
    if output is None or pattern is None:
        return "proceed"
    whole = _compiled(pattern, re.I | re.S)
    if whole is None:
        return "proceed"
    if whole.search(output):
        return "skip"
    lines = [x.strip() for x in pattern.split("\\n") if x.strip()]
    if len(lines) > 1:
        found = sum(1 for x in lines if (p := _compiled(x, re.I)) is not None and p.search(output))
        if 0 < found < len(lines):
            return "partial_state"
    return "proceed"


@F.pandas_udf(StringType())
def idempotency_verdict(pattern: pd.Series, output: pd.Series) -> pd.Series:
    """skip if the pattern is found, partial_state if some but not all of its lines are, else proceed."""
    return pd.Series([_verdict(p, o) for p, o in zip(pattern, output)], dtype=object)


def idempotency(rules: DataFrame) -> DataFrame:
    """``execution_id, step_id, verdict, rule_no``: of a step's rules (rule_no, skip_pattern, output) the first
    that does not say proceed."""
    d = rules.withColumn("v", idempotency_verdict("skip_pattern", "output"))
    g = d.groupBy("execution_id", "step_id").agg(F.min(F.when(F.col("v") != "proceed", F.struct("rule_no", "v"))).alias("first"))
    return g.select("execution_id", "step_id", F.coalesce("first.v", F.lit("proceed")).alias("verdict"), F.col("first.rule_no").alias("rule_no"))


_PERCENT = re.compile(r"\b(\d+(?:\.\d+)?)\s*%")


def _status(output: str | None, good: str | None, bad: str | None, most: float | None) -> str:
    if output is None:
        return "ERROR"
    for pattern, fails in ((bad, True), (good, False)):
        if pattern:
            p = _compiled(pattern, re.I)
            if p is None:
                return "ERROR"
            if (p.search(output) is not None) == fails:
                return "FAIL"
    if most and most == most:
        m = _PERCENT.search(output)
        if m and float(m[1]) > most:
            return "FAIL"
    return "PASS"


@F.pandas_udf(StringType())
def test_status(output: pd.Series, success: pd.Series, error: pd.Series, threshold: pd.Series) -> pd.Series:
    """FAIL on an error pattern, a missing success pattern or a first percentage above the threshold; ERROR where
    there is no output or a pattern does not compile; else PASS."""
    return pd.Series([_status(*x) for x in zip(output, success, error, threshold)], dtype=object)


def _reason(output: str | None, bad: str | None) -> str:
    if not bad:
        return "Expected pattern not found in output"
    p = _compiled(bad, re.I)
    for line in (output or "").splitlines():
        if p is not None and p.search(line):
            return line.strip()[:120]
    return "Expected success pattern not found"


@F.pandas_udf(StringType())
def failure_reason(output: pd.Series, error: pd.Series) -> pd.Series:
    """The first line that the error pattern matches, at most 120 characters."""
    return pd.Series([_reason(o, e) for o, e in zip(output, error)], dtype=object)


def evaluate_tests(d: DataFrame) -> DataFrame:
    """Rows of ``output, success_pattern, error_pattern, threshold_pct`` plus status and failure_reason."""
    d = d.withColumn("status", test_status("output", "success_pattern", "error_pattern", "threshold_pct"))
    return d.withColumn("failure_reason", F.when(F.col("status") == "FAIL", failure_reason("output", "error_pattern")))
