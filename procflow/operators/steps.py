"""Commands into canonical steps, without a model: phase by words and place, deduplicated per section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from procflow.functions import patterns as P
from procflow.functions.text import strip
from procflow.session import computed


def phase(command: Column, place: Column, total: Column) -> Column:
    """Section of a command by its words and its place among all commands of the document."""
    return _phase(phase_words(command), place, total)


def phase_words(command: Column) -> dict[str, Column]:
    """What a command's words say about its phase: of a rollback, a check before, a check, and whether it shows."""
    return {"back": command.rlike(P.ROLLBACK_WORDS), "pre": command.rlike(P.PRE_CHECK_WORDS), "check": command.rlike(P.VERIFY_WORDS), "shows": F.contains(F.lower(command), F.lit("show"))}


def _phase(says: Column | dict, place: Column, total: Column) -> Column:
    part = place / F.greatest(total, F.lit(1))
    return (
        F.when(says["back"], "Rollback")
        .when((part <= 0.20) & says["pre"], "Pre-checks")
        .when((part >= 0.75) & says["check"], "Verification")
        .when(says["check"] & says["shows"], F.when(part < 0.4, "Pre-checks").otherwise("Verification"))
        .otherwise("Implementation")
    )


def step_type(section: Column) -> Column:
    return F.when(section == "Rollback", "rollback").when(section == "Implementation", "action").otherwise("verification")


def action_type(section: Column) -> Column:
    return F.when(section == "Rollback", "rollback").when(section == "Implementation", "execute").otherwise("verify")


def description(raw: Column, vendor: Column, protocol: Column, action: Column) -> Column:
    """``Verb (PROTOCOL) [vendor]: command``, the command cut at 60 characters."""
    verb = F.when(action == "verify", "Verify").when(action == "rollback", "Rollback").when(action == "configure", "Configure").when(action == "observe", "Observe").otherwise("Execute")
    proto = F.when(protocol.isNotNull(), F.concat(F.lit(" ("), F.upper(protocol), F.lit(")"))).otherwise("")
    brand = F.when(vendor.isNotNull() & (vendor != "generic"), F.concat(F.lit(" ["), vendor, F.lit("]"))).otherwise("")
    return F.concat(verb, proto, brand, F.lit(": "), F.substring(raw, 1, 60), F.when(F.length(raw) > 60, "…").otherwise(""))


# ---- Fixed values: words of a verification command, and the output to expect; the first line whose words are all
# in the command counts ----
EXPECTED_HINTS = (
    (("bgp",), "BGP neighbors in Established state"),
    (("ospf",), "OSPF neighbors in FULL state"),
    (("isis",), "IS-IS adjacencies in UP state"),
    (("interface",), "Interface state: up/up"),
    (("ip int",), "Interface state: up/up"),
    (("install", "active"), "SMU listed in active packages"),
    (("install",), "Install operation completed successfully"),
    (("ping",), "Success rate 100% (no packet loss)"),
    (("version",), "Expected software version shown"),
)
EXPECTED_ELSE = "Command completes without errors"


def expected_hint(raw: Column, action: Column) -> Column:
    """A plausible expected output of a verification command; null for other steps."""
    hint = F.when(F.lit(False), "")
    for words, text in EXPECTED_HINTS:
        hint = hint.when(_all(F.lower(raw), words), text)
    return F.when(action == "verify", hint.otherwise(EXPECTED_ELSE))


def _all(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & F.contains(c, F.lit(w))
    return out


def tags(raw: Column, vendor: Column, protocol: Column) -> Column:
    c = F.lower(raw)
    has = lambda w: F.contains(c, F.lit(w))
    every = F.array(
        F.when(vendor.isNotNull() & (vendor != "generic"), vendor),
        protocol,
        F.when(has("install"), "smu"),
        F.when(has("rollback") | has("undo") | has("no "), "rollback"),
        F.when(has("show") | has("display"), "read-only"),
    )
    return F.filter(every, lambda x: x.isNotNull())


def _worded(commands: DataFrame, texts: DataFrame | None) -> DataFrame:
    """Commands plus ``__says``, their phase_words(), found once a command or, with ``texts``, once a text."""
    says = lambda d: computed(d, __says=F.struct(*[c.alias(k) for k, c in phase_words(F.col("raw")).items()]))
    if texts is None:
        return says(commands)
    return commands.join(F.broadcast(says(texts.select(strip(F.col("raw")).alias("raw")).distinct())), "raw")


def dedup_commands(commands: DataFrame) -> DataFrame:
    """The first command of each (document, section, normalized form), ``idx`` and ``total`` being its place among
    all commands (from 0) and their number, ``section`` the phase that place gives."""
    return _dedup(_worded(commands, None)).drop("__says")


def _dedup(commands: DataFrame) -> DataFrame:
    order = W.partitionBy("doc_id").orderBy("line_no")
    d = commands.withColumn("idx", F.row_number().over(order) - 1).withColumn("total", F.count("*").over(W.partitionBy("doc_id")))
    d = d.withColumn("section", _phase(F.col("__says"), F.col("idx"), F.col("total")))
    first = W.partitionBy("doc_id", "section", "normalized").orderBy("idx")
    return d.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def build_steps(commands: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One step a command that is left after deduplication, renumbered; the phase is judged again by the new
    place. ``commands`` has doc_id, line_no, raw, normalized, vendor, protocol, mode, confidence. ``texts`` as given to
    extract_commands(): words are then looked for once a text."""
    d = _dedup(_worded(commands, texts))
    order = W.partitionBy("doc_id").orderBy("idx")
    d = d.withColumn("sequence", F.row_number().over(order)).withColumn("n", F.count("*").over(W.partitionBy("doc_id")))
    d = d.withColumn("section", _phase(F.col("__says"), F.col("sequence") - 1, F.col("n")))
    action = action_type(F.col("section"))
    return d.select(
        "doc_id",
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("sequence").cast("string")).alias("step_id"),
        "sequence",
        step_type(F.col("section")).alias("step_type"),
        action.alias("action_type"),
        description(F.col("raw"), F.col("vendor"), F.col("protocol"), action).alias("description"),
        F.col("raw").alias("raw_text"),
        F.array(F.struct("raw", "normalized", "vendor", "protocol", "mode", "confidence")).alias("commands"),
        expected_hint(F.col("raw"), action).alias("expected_output"),
        "section",
        (F.col("section") == "Rollback").alias("is_rollback"),
        tags(F.col("raw"), F.col("vendor"), F.col("protocol")).alias("tags"),
    )


def with_placeholders(docs: DataFrame, steps: DataFrame) -> DataFrame:
    """``steps`` plus one INFO step for each document without any."""
    none = docs.select("doc_id").distinct().join(steps.select("doc_id"), "doc_id", "left_anti")
    info = none.select(
        "doc_id",
        F.concat(F.col("doc_id").cast("string"), F.lit("-1")).alias("step_id"),
        F.lit(1).alias("sequence"),
        F.lit("info").alias("step_type"),
        F.lit("observe").alias("action_type"),
        F.lit("No CLI commands detected in document — manual review required").alias("description"),
        F.lit("(No commands detected)").alias("raw_text"),
        F.lit("General").alias("section"),
        F.lit(False).alias("is_rollback"),
    )
    return steps.unionByName(info, allowMissingColumns=True)


def phase_summary(commands: DataFrame, steps: DataFrame) -> DataFrame:
    """``doc_id, detected, kept``: commands before and after deduplication."""
    a = commands.groupBy("doc_id").agg(F.count("*").alias("detected"))
    b = steps.groupBy("doc_id").agg(F.count("*").alias("kept"))
    return a.join(b, "doc_id", "left").select("doc_id", "detected", F.coalesce("kept", F.lit(0)).alias("kept"))
