"""Validation rules, test cases and scripts from structured steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from procflow.functions import patterns as P
from procflow.functions.text import squeeze, strip

NOT_CONTAIN = ("Error", "Invalid input", "%")
#: Test-case priority by step type (fixed values).
PRIORITY = {"rollback": "Critical", "verification": "High", "config": "Medium", "action": "Medium", "info": "Low"}


def must_contain(expected: Column) -> Column:
    """What an output must contain: quoted strings of two characters or more, then state keywords, each once."""
    text = F.coalesce(expected, F.lit(""))
    quoted = F.regexp_extract_all(text, F.lit(r"""['"]([^'"]{2,})['"]"""), F.lit(1))
    states = F.filter(F.array(*map(F.lit, P.STATE_KEYWORDS)), lambda k: F.contains(F.lower(text), F.lower(k)))
    return F.array_distinct(F.concat(quoted, states))


def validation_rules(steps: DataFrame) -> DataFrame:
    """One rule for each command that is not blank, and one for each verification step without commands."""
    step = ["doc_id", F.col("sequence").alias("step_sequence"), "step_id"]
    more = ["section", "is_rollback", "tags", "description", must_contain(F.col("expected_output")).alias("must_contain")]
    c = steps.select(*step, "step_type", *more, F.posexplode("commands").alias("command_no", "c")).where(strip(F.coalesce("c.raw", F.lit(""))) != "")
    own = c.select("doc_id", "step_sequence", "step_id", "step_type", "command_no", F.col("c.raw").alias("command"), "c.vendor", "c.protocol", "c.mode", "c.confidence", "section", "is_rollback", "must_contain", F.array(*map(F.lit, NOT_CONTAIN)).alias("must_not_contain"), "tags", "description")
    manual = steps.where((F.coalesce(F.size("commands"), F.lit(0)) <= 0) & (F.col("step_type") == "verification")).select(*step, F.lit("manual_verification").alias("step_type"), *more, F.lit(1.0).alias("confidence"), F.lit(0).alias("command_no"), F.array().cast("array<string>").alias("must_not_contain"))
    return own.unionByName(manual, allowMissingColumns=True)


def section_order(steps: DataFrame) -> DataFrame:
    """``steps`` plus ``section_first``, the first sequence of the step's section in its document."""
    return steps.withColumn("section_first", F.min("sequence").over(W.partitionBy("doc_id", F.coalesce("section", F.lit("_default")))))


def safe_folder(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)[^\w\s\-]", ""))


def _names(commands: Column, field: str) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(commands, lambda c: c[field]), lambda v: v.isNotNull() & (v != "generic") & (v != ""))))


def test_cases(steps: DataFrame, titles: DataFrame, prefix: str = "/Procedures") -> DataFrame:
    """One test case a step, in the order of sections' first appearance (``position``). ``titles`` has doc_id and
    document_title."""
    s = section_order(steps).join(titles.select("doc_id", "document_title"), "doc_id")
    kind = F.col("step_type")
    labels = F.when(F.array_contains("tags", kind), F.col("tags")).otherwise(F.concat(F.array(kind), F.col("tags")))
    labels = F.when(F.col("is_rollback") & ~F.array_contains(labels, "rollback"), F.concat(F.array(F.lit("rollback")), labels)).otherwise(labels)
    priority = F.when(F.col("is_rollback"), "Critical")
    for k, v in PRIORITY.items():
        priority = priority.when(kind == k, v)
    vendors, protocols = F.array_join(_names(F.col("commands"), "vendor"), ", "), F.array_join(_names(F.col("commands"), "protocol"), ", ")
    folder = F.concat(F.lit(prefix + "/"), safe_folder(F.col("document_title")), F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit("/"), safe_folder(F.col("section")))).otherwise(""))
    w = W.partitionBy("doc_id").orderBy("section_first", "sequence", "step_id")
    return s.select(
        "doc_id",
        F.row_number().over(w).alias("position"),
        F.concat(F.lit("TC-"), F.format_string("%03d", F.col("sequence").cast("int")), F.lit(": "), strip(F.substring("description", 1, 80))).alias("name"),
        F.col("description").alias("objective"),
        F.when(F.col("is_rollback"), "Only if the main procedure fails.").otherwise("").alias("precondition"),
        F.lit("Draft").alias("status"),
        priority.otherwise("Medium").alias("priority"),
        F.array_join(labels, ", ").alias("labels"),
        F.when(vendors != "", vendors).otherwise(protocols).alias("component"),
        folder.alias("folder"),
        test_case_steps().alias("steps"),
    )


def test_case_steps() -> Column:
    """The steps of a test case as JSON: one a command, or the description."""
    note = lambda c: F.concat_ws(" | ", F.concat(F.lit("Vendor: "), F.when(c["vendor"] != "generic", c["vendor"])), F.concat(F.lit("Protocol: "), c["protocol"]), F.concat(F.lit("Mode: "), c["mode"]))
    done = F.coalesce("expected_output", F.lit("Command executes without errors."))
    own = F.transform("commands", lambda c: F.struct(c["raw"].alias("step"), note(c).alias("data"), done.alias("result")))
    manual = F.array(F.struct(F.col("description").alias("step"), F.when(F.col("raw_text") != F.col("description"), F.col("raw_text")).otherwise("").alias("data"), F.coalesce("expected_output", F.lit("")).alias("result")))
    return F.to_json(F.when(F.size("commands") > 0, own).otherwise(manual))


def escape_robot(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")), F.lit("@"), F.lit("\\@"))


def robot_name(sequence: Column, description: Column) -> Column:
    text = squeeze(F.regexp_replace(strip(F.substring(description, 1, 70)), r"(?U)[^\w\s\-\.]", " "))
    return F.concat(F.lit("Step_"), F.format_string("%03d", sequence.cast("int")), F.lit(": "), text)


def variable_name(command: Column) -> Column:
    """The first three words of a command, lower-cased and joined."""
    words = F.filter(F.split(F.regexp_replace(command, r"(?U)[^\w\s]", ""), r"(?U)\s+"), lambda w: w != "")
    name = F.array_join(F.transform(F.slice(words, 1, 3), F.lower), "_")
    return F.when(name == "", "output").otherwise(name)


def robot_cases(steps: DataFrame) -> DataFrame:
    """``doc_id, sequence, name, tags, commands``: for each step that is no rollback, its case; for each of its
    commands, variable, kind of capture and the checks that follow."""
    tags = F.concat(F.array("step_type"), F.filter("tags", lambda t: t != F.col("step_type")), _names(F.col("commands"), "protocol"), _names(F.col("commands"), "vendor"))
    section = F.lower(F.coalesce("section", F.lit("")))
    verify, pre, post = F.col("action_type").isin("verify", "observe"), section == "pre-checks", section.isin("verification", "post-checks")

    def one(c: Column) -> Column:
        v = variable_name(c["raw"])
        checks = F.filter(
            F.array(F.when(verify & F.col("expected_output").isNotNull(), F.lit("verify")), F.when(post, F.lit("compare")), F.when(~verify & ~pre, F.lit("no_error"))),
            lambda x: x.isNotNull(),
        )
        return F.struct(F.when(pre, F.concat(F.lit("BASELINE_"), F.upper(v))).otherwise(v).alias("variable"), escape_robot(c["raw"]).alias("command"), F.when(pre, "baseline").otherwise("run").alias("capture"), checks.alias("checks"))

    kind = F.when(F.col("step_type") == "info", "info").when(F.size("commands") <= 0, "manual").otherwise("commands")
    return steps.where(~F.col("is_rollback")).select("doc_id", "sequence", robot_name(F.col("sequence"), F.col("description")).alias("name"), F.array_join(tags, "    ").alias("tags"), kind.alias("kind"), F.transform("commands", one).alias("commands"))


# ---- Fixed values: the lines of a suite ----
SETTINGS = ("Library          SSHLibrary", "Library          String", "Library          Collections", "Suite Setup      Open SSH Connection")
TEARDOWN = "Suite Teardown   Close All Connections"
TEARDOWN_BACK = "Suite Teardown   Run Keywords    Run Keyword If Any Tests Failed    Execute Rollback Procedure\n...              AND    Close All Connections"
VARIABLES = ("${HOST}              ${ENV_HOST}", "${USERNAME}          ${ENV_USERNAME}", "${PASSWORD}          ${ENV_PASSWORD}", "${PROMPT}            #", "${TIMEOUT}          30s", "${ABORT_ON_ERROR}    ${TRUE}")
RULE = "# " + "=" * 60
BACK_RULE = "Log    ==============================    WARN"
INDENT = "    "


def _lines(*parts: Column | str | None) -> Column:
    """An array of lines; strings are texts, null lines go."""
    return F.filter(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts]), lambda x: x.isNotNull())


def _say(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _case_lines() -> Column:
    """The lines of one step's case, from the columns of steps plus failure_strategy."""
    section = F.lower(F.coalesce("section", F.lit("")))
    verify, pre, post = F.col("action_type").isin("verify", "observe"), section == "pre-checks", section.isin("verification", "post-checks")
    text = escape_robot(F.col("description"))

    def one(c: Column) -> Column:
        name = variable_name(c["raw"])
        base = _say("${BASELINE_", F.upper(name), "}")
        out = F.when(pre, base).otherwise(_say("${", name, "}"))
        return _lines(
            _say(INDENT, out, "=    Execute CLI Command    ", escape_robot(c["raw"])),
            F.when(pre, _say(INDENT, "Set Suite Variable    ", base)),
            F.when(verify & (F.coalesce("expected_output", F.lit("")) != ""), _say(INDENT, "Verify Command Output    ", out, "    ", escape_robot(F.col("expected_output")))),
            F.when(post, _say(INDENT, "Compare With Baseline    ", base, "    ", out, "    ", escape_robot(F.substring(c["raw"], 1, 50)))),
            F.when(~verify & ~pre, _say(INDENT, "Verify No Device Error    ", out)),
        )

    tags = F.array_join(F.concat(F.array("step_type"), F.filter("tags", lambda t: t != F.col("step_type")), _names(F.col("commands"), "protocol"), _names(F.col("commands"), "vendor")), "    ")
    tags = F.concat(tags, F.when(F.col("failure_strategy") == "continue", "    robot:continue-on-failure").otherwise(""))
    head = _lines(
        robot_name(F.col("sequence"), F.col("description")),
        _say(INDENT, "[Documentation]    ", F.replace(F.col("description"), F.lit("\\"), F.lit("\\\\"))),
        _say(INDENT, "[Tags]    ", tags),
        _say(INDENT, "[Teardown]    Run Keyword If Test Failed    Log Step Failure    ", escape_robot(F.substring("description", 1, 60))),
    )
    info = F.array(_say(INDENT, "Log    ", text, "    INFO"))
    manual = F.array(_say(INDENT, "Log    MANUAL STEP: ", text, "    WARN"))
    body = F.when(F.col("step_type") == "info", info).when(F.size("commands") <= 0, manual).otherwise(F.flatten(F.transform("commands", one)))
    return F.concat(head, body, F.array(F.lit("")))


def suite_text(models: DataFrame, steps: DataFrame, library: str = "") -> DataFrame:
    """``doc_id, suite``: the text of a document's whole suite, in order: settings, variables, a case for each step that
    is no rollback (with a heading where a section begins), keywords. The last are ``library``, the text of the
    keywords that do not hang on the document, and the rollback procedure where there are rollback steps.

    ``models``: doc_id, document_title, source_file, structure, failure_strategy (null: abort). Steps are ordered by
    sequence, then step_id; a document's lines meet in one row, as its suite does.
    """
    model = models.select("doc_id", "document_title", F.coalesce("source_file", F.lit("")).alias("source_file"), F.coalesce("structure", F.lit("")).alias("structure"), F.coalesce("failure_strategy", F.lit("abort")).alias("failure_strategy"))
    w = W.partitionBy("doc_id").orderBy("sequence", "step_id")
    own = F.nullif(F.col("section"), F.lit(""))
    cases = steps.where("NOT is_rollback").withColumn("__before", F.last(own, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    cases = cases.join(model.select("doc_id", "failure_strategy"), "doc_id")
    begins = own.isNotNull() & ~own.eqNullSafe(F.col("__before"))
    heading = F.when(begins, F.array(F.lit("\n" + RULE), _say("# Section: ", F.col("section")), F.lit(RULE))).otherwise(F.array().cast("array<string>"))
    cases = cases.select("doc_id", F.struct("sequence", "step_id", F.array_join(F.concat(heading, _case_lines()), "\n").alias("t")).alias("x"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["t"])
    cases = cases.groupBy("doc_id").agg(in_order("x").alias("cases"))
    back = steps.where("is_rollback").select("doc_id", "sequence", "step_id", F.posexplode_outer("commands").alias("n", "c"))
    undo = F.array_join(_lines(_say(INDENT, "Log    Rollback: ", escape_robot(F.substring("c.raw", 1, 60)), "    WARN"), _say(INDENT, "Run Keyword And Continue On Failure    Execute CLI Command    ", escape_robot(F.col("c.raw")))), "\n")
    order = F.struct((-F.col("sequence")).alias("s"), "step_id", "n", undo.alias("t"))
    back = back.groupBy("doc_id").agg(in_order(F.when(F.col("c").isNotNull(), order)).alias("undo"))
    d = model.join(cases, "doc_id", "left").join(back, "doc_id", "left")
    auto = F.col("failure_strategy").isin("rollback_all", "rollback_group") & F.col("undo").isNotNull()
    settings = _lines("*** Settings ***", _say("Documentation    Auto-generated Robot Framework tests for: ", F.col("document_title")), _say("...              Source: ", F.regexp_extract("source_file", "[^/]*$", 0)), _say("...              MOP Structure: ", F.col("structure")), _say("...              Failure Strategy: ", F.upper("failure_strategy")), *SETTINGS, F.when(auto, TEARDOWN_BACK).otherwise(TEARDOWN))
    none = F.array().cast("array<string>")
    rollback = F.concat(
        _lines("Execute Rollback Procedure", INDENT + "[Documentation]    Execute rollback steps in reverse order to restore network state.", INDENT + "...                Called automatically by Suite Teardown on failure.", INDENT + BACK_RULE.replace("Log    ", "Log    \\n"), INDENT + "Log    ROLLBACK PROCEDURE STARTING    WARN", INDENT + BACK_RULE),
        F.coalesce("undo", none),
        _lines(INDENT + BACK_RULE, INDENT + "Log    ROLLBACK PROCEDURE COMPLETE    WARN", INDENT + BACK_RULE),
    )
    keywords = F.array_join(_lines(*([library] if library else []), F.when(F.col("undo").isNotNull(), F.array_join(rollback, "\n"))), "\n\n")
    whole = F.array(F.array_join(settings, "\n"), F.lit("\n".join(("*** Variables ***", *VARIABLES))), F.array_join(F.concat(F.array(F.lit("*** Test Cases ***")), F.coalesce("cases", none)), "\n"), _say("\n*** Keywords ***\n", keywords))
    return d.select("doc_id", F.array_join(whole, "\n\n").alias("suite"))


def rollback_script(steps: DataFrame) -> DataFrame:
    """``doc_id, line_no, command``: commands of rollback steps, the last step first."""
    c = steps.where("is_rollback").select("doc_id", "sequence", F.posexplode("commands").alias("n", "c"))
    w = W.partitionBy("doc_id").orderBy(F.col("sequence").desc(), "n")
    return c.select("doc_id", F.row_number().over(w).alias("line_no"), F.col("c.raw").alias("command"))


def dry_run_plan(steps: DataFrame) -> DataFrame:
    """``doc_id, part, line_no, section, command``: commands by section in the order of first appearance, then the
    rollback commands reversed."""
    s = section_order(steps.where("not is_rollback")).select("doc_id", "section", "section_first", "sequence", F.posexplode("commands").alias("n", "c"))
    w = W.partitionBy("doc_id").orderBy("section_first", "sequence", "n")
    main = s.select("doc_id", F.lit("plan").alias("part"), F.row_number().over(w).alias("line_no"), "section", F.col("c.raw").alias("command"))
    back = rollback_script(steps).select("doc_id", F.lit("rollback").alias("part"), "line_no", F.lit("Rollback").alias("section"), "command")
    return main.unionByName(back)


def document_results(scores: DataFrame, outlines: DataFrame) -> DataFrame:
    """One row a document with blocks: steps, structure, score and band, outline tokens and ratio. Steps are counted by
    the quality score, and the outlines (with structure) tell structures, so steps and blocks are made once each."""
    s = scores.select("doc_id", "n_steps", "score", "band")
    return outlines.join(s, "doc_id", "left").select("doc_id", "structure", "n_steps", "score", "band", "raw_tokens", "outline_tokens", "ratio").na.fill(0, ["n_steps"])
