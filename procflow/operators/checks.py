"""Guardrails, schema checks and the quality score of structured procedures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from procflow.functions.text import strip

STEP_TYPES = ("config", "verification", "rollback", "info", "action")
FORMATS = ("pdf", "docx", "txt")


def _finding(d: DataFrame, rule: str, severity: str, message: Column, step: Column | None = None) -> DataFrame:
    return d.select("doc_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), (step if step is not None else F.lit(None).cast("string")).alias("step_id"), message.alias("message"))


def no_steps(docs: DataFrame, steps: DataFrame) -> DataFrame:
    return _finding(docs.select("doc_id").distinct().join(steps.select("doc_id"), "doc_id", "left_anti"), "no_steps", "error", F.lit("no steps"))


def _short(least: int = 5) -> Column:
    return F.length(strip(F.coalesce("description", F.lit("")))) < least


def _blank(command: Column) -> Column:
    return strip(F.coalesce(command["raw"], F.lit(""))) == ""


def _unflagged() -> Column:
    return (F.col("step_type") == "rollback") & ~F.col("is_rollback")


def _odd() -> Column:
    return F.col("is_rollback") & ~F.col("step_type").isin("rollback", "action", "verification")


def _share() -> Column:
    return F.when(F.col("n_commands") > 0, F.round(F.col("n_after") / F.col("n_commands"), 4))


def short_descriptions(steps: DataFrame, least: int = 5) -> DataFrame:
    d = steps.where(_short(least))
    return _finding(d, "short_description", "warning", F.lit("description missing or too short"), F.col("step_id"))


def duplicate_sequences(steps: DataFrame) -> DataFrame:
    """One finding for each repeat of a sequence number, naming the step before."""
    w = W.partitionBy("doc_id", "sequence").orderBy("step_id")
    d = steps.withColumn("__before", F.lag("step_id").over(w)).where("__before is not null")
    return _finding(d, "duplicate_sequence", "warning", F.concat(F.lit("sequence also used by "), "__before"), F.col("step_id"))


def blank_commands(steps: DataFrame) -> DataFrame:
    d = steps.select("doc_id", "step_id", F.explode("commands").alias("c")).where(_blank(F.col("c")))
    return _finding(d, "blank_command", "warning", F.lit("blank command"), F.col("step_id"))


def rollback_mismatches(steps: DataFrame) -> DataFrame:
    message = F.when(_unflagged(), "rollback step was not flagged; corrected").otherwise("flagged as rollback, but of another type")
    return _finding(steps.where(_unflagged() | _odd()), "rollback_mismatch", "warning", message, F.col("step_id"))


def correct_rollback(steps: DataFrame) -> DataFrame:
    """Steps of type rollback carry the flag."""
    return steps.withColumn("is_rollback", F.col("is_rollback") | (F.col("step_type") == "rollback"))


def command_coverage(docs: DataFrame, before: DataFrame, steps: DataFrame) -> DataFrame:
    """``doc_id, n_before, n_after, coverage``: commands in steps against commands detected; null if none were."""
    after = steps.groupBy("doc_id").agg(F.sum(F.size("commands")).alias("n_after"))
    d = docs.select("doc_id").distinct().join(before, "doc_id", "left").join(after, "doc_id", "left").na.fill(0, ["n_commands", "n_after"])
    return d.select("doc_id", F.col("n_commands").alias("n_before"), "n_after", _share().alias("coverage"))


def guardrails(docs: DataFrame, steps: DataFrame, before: DataFrame) -> DataFrame:
    """One row a document: passed (no errors), counts, coverage, findings as arrays of texts. Steps are read once: each
    tells its own findings, and one aggregation counts and collects."""
    label = lambda rule, *more: F.concat_ws(":", F.lit(rule), *more)
    own = lambda hit, rule: F.when(hit, F.array(label(rule, "step_id"))).otherwise(none)
    none = F.array().cast("array<string>")
    again = W.partitionBy("doc_id", "sequence").orderBy("step_id")
    s = steps.select("doc_id", "step_id", "sequence", "description", "commands", "step_type", "is_rollback", F.lag("step_id").over(again).isNotNull().alias("__again"))
    told = F.concat(
        own(_short(), "short_description"),
        own(F.col("__again"), "duplicate_sequence"),
        F.coalesce(F.transform(F.filter("commands", lambda c: _blank(c)), lambda c: label("blank_command", "step_id")), none),
        own(_unflagged() | _odd(), "rollback_mismatch"),
    )
    g = s.groupBy("doc_id").agg(F.sum(F.size("commands")).alias("n_after"), F.flatten(F.collect_list(told)).alias("warnings"), F.count("*").alias("n_steps"))
    cover = docs.select("doc_id").distinct().join(before, "doc_id", "left").join(g, "doc_id", "left").na.fill(0, ["n_commands", "n_after", "n_steps"])
    d = cover.select("doc_id", F.col("n_commands").alias("n_before"), "n_after", _share().alias("coverage"), "n_steps", F.coalesce("warnings", none).alias("warnings"))
    low = F.when(F.col("coverage") < 0.5, F.array(label("low_coverage"))).otherwise(none)
    errors = F.when(F.col("n_steps") == 0, F.array(label("no_steps"))).otherwise(none)
    return d.select("doc_id", "n_before", "n_after", "coverage", errors.alias("errors"), F.array_sort(F.concat("warnings", low)).alias("warnings"), (F.col("n_steps") > 0).alias("passed"))


def schema_checks(models: DataFrame, steps: DataFrame) -> DataFrame:
    """``doc_id, ascending, has_title, known_format, valid``."""
    w = W.partitionBy("doc_id").orderBy("position")
    s = steps.withColumn("__down", F.lag("sequence").over(w) > F.col("sequence")).groupBy("doc_id").agg(F.coalesce(~F.bool_or("__down"), F.lit(True)).alias("ascending"))
    d = models.join(s, "doc_id", "left").select("doc_id", F.coalesce("ascending", F.lit(True)).alias("ascending"), (strip(F.coalesce("document_title", F.lit(""))) != "").alias("has_title"), F.coalesce(F.col("source_format").isin(*FORMATS), F.lit(False)).alias("known_format"))
    return d.withColumn("valid", F.col("ascending") & F.col("has_title") & F.col("known_format"))


def enum_violations(d: DataFrame, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows with a value outside of its column's list, plus ``violations`` naming the columns."""
    bad = F.filter(F.array(*[F.when(~F.coalesce(F.col(c).isin(*v), F.lit(False)), F.lit(c)) for c, v in allowed.items()]), lambda x: x.isNotNull())
    return d.withColumn("violations", bad).where(F.size("violations") > 0)


PRE = ("pre-checks", "pre checks", "pre_checks")
POST = ("verification", "post-checks", "post checks")
CRITERIA = {"commands_detected": 3, "rollback_steps": 2, "pre_checks": 1, "verification_section": 1, "expected_output_coverage": 2, "command_confidence": 1, "section_diversity": 1, "failure_strategy": 1}


def quality_score(steps: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """One row a document: its steps, the points of eight criteria, score (of 12), band, percentage, bar, warnings and
    recommendations. ``models`` gives failure_strategy by doc_id (abort if not given). One aggregation."""
    low = F.lower(F.coalesce("section", F.lit("")))
    own = ~F.col("is_rollback")
    g = steps.groupBy("doc_id").agg(
        F.count("*").alias("n_steps"),
        F.sum(F.size("commands")).alias("n_commands"),
        F.count_if(F.col("is_rollback")).alias("n_rollback"),
        F.bool_or(low.isin(*PRE)).alias("has_pre"),
        F.bool_or(low.isin(*POST)).alias("has_post"),
        F.count_if(own).alias("n_own"),
        F.count_if(own & (F.coalesce("expected_output", F.lit("")) != "")).alias("n_expected"),
        F.sum(F.aggregate("commands", F.lit(0.0), lambda a, c: a + F.coalesce(c["confidence"], F.lit(0.0)))).alias("sum_confidence"),
        F.count_distinct(F.when(F.col("section") != "", F.col("section"))).alias("n_sections"),
    )
    g = g.join(models.select("doc_id", "failure_strategy"), "doc_id", "left") if models is not None else g.withColumn("failure_strategy", F.lit("abort"))
    g = g.withColumn("failure_strategy", F.coalesce("failure_strategy", F.lit("abort")))
    cover = F.when(F.col("n_own") > 0, F.col("n_expected") / F.col("n_own")).otherwise(0.0)
    mean = F.when(F.col("n_commands") > 0, F.round(F.col("sum_confidence") / F.col("n_commands"), 6)).otherwise(0.0)
    n = F.col("n_commands")
    points = {
        "commands_detected": F.when(n == 0, 0).when(n <= 5, 1).when(n <= 15, 2).otherwise(3),
        "rollback_steps": F.when(F.col("n_rollback") > 0, 2).otherwise(0),
        "pre_checks": F.col("has_pre").cast("int"),
        "verification_section": F.col("has_post").cast("int"),
        "expected_output_coverage": F.when(cover > 0.5, 2).when(cover > 0.2, 1).otherwise(0),
        "command_confidence": (mean >= 0.85).cast("int"),
        "section_diversity": (F.col("n_sections") >= 3).cast("int"),
        "failure_strategy_set": (F.col("failure_strategy") != "abort").cast("int"),
    }
    g = g.withColumns(points)
    g = g.withColumn("score", reduce(lambda a, b: a + b, [F.col(c) for c in points]))
    g = g.withColumn("band", F.when(F.col("score") >= 8, "HIGH").when(F.col("score") >= 4, "MEDIUM").otherwise("LOW"))
    g = g.withColumn("percentage", F.bround(F.col("score") / 12 * 100, 0).cast("int"))
    full = F.bround(F.col("score") / 12 * 20, 0).cast("int")
    g = g.withColumn("bar", F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), 20 - full)))
    warn = {"no commands": n == 0, "few commands": (n > 0) & (n <= 5), "no rollback": F.col("n_rollback") == 0, "expected outputs scarce": F.col("expected_output_coverage") == 0}
    advise = {
        "check that the document holds commands": n == 0,
        "add a rollback section": F.col("n_rollback") == 0,
        "add pre-checks": F.col("pre_checks") == 0,
        "add verification": F.col("verification_section") == 0,
        "define expected outputs": F.col("expected_output_coverage") < 2,
        "review uncertain commands": F.col("command_confidence") == 0,
        "use more sections": F.col("section_diversity") == 0,
        "set a failure strategy": F.col("failure_strategy_set") == 0,
    }
    texts = lambda m: F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in m.items()]), lambda x: x.isNotNull())
    return g.withColumn("warnings", texts(warn)).withColumn("recommendations", texts(advise)).drop("sum_confidence")


def quality_distribution(scores: DataFrame, structures: DataFrame) -> DataFrame:
    """``band, structure, n``."""
    return scores.join(structures, "doc_id").groupBy("band", "structure").agg(F.count("*").alias("n"))
