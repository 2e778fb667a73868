"""Planning over step graphs: waves, critical paths, approval, rollback, outcomes.

Executions are many and their graphs small, so each is one row of an Arrow batch (large ones are levelled as tables, in
frontier.py); nothing else here leaves the JVM.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from procflow.functions import patterns as P
from procflow.functions.text import strip
from procflow.plans.frontier import waves_by_frontier
from procflow.sources.dimensions import _bounded


def dependencies(steps: DataFrame) -> DataFrame:
    return steps.select("execution_id", "step_id", F.explode("dependencies").alias("needs"))


def unknown_dependencies(steps: DataFrame) -> DataFrame:
    """``execution_id, step_id, needs`` where the needed step does not exist."""
    have = steps.select("execution_id", F.col("step_id").alias("needs"))
    return dependencies(steps).join(have, ["execution_id", "needs"], "left_anti").select("execution_id", "step_id", "needs")


def _levels(ids: list[str], needed: list[list[str]], places: list) -> tuple[dict[str, int], tuple[str, ...]]:
    """Waves and the longest chain of one graph; steps on or behind a cycle have no wave."""
    known = set(ids)
    needs = {s: known & set(ds if ds is not None else ()) for s, ds in zip(ids, needed)}
    followers = defaultdict(set)
    for s, ds in needs.items():
        for d in ds:
            followers[d].add(s)
    open_ = {s: len(ds) for s, ds in needs.items()}
    wave: dict[str, int] = {}
    before: dict[str, str | None] = {}  # the last step of the longest chain that leads here; of equals the first by name
    ready = sorted(s for s, n in open_.items() if not n)
    while ready:
        after = []
        for s in ready:
            before[s] = max(sorted(needs[s]), key=wave.__getitem__, default=None)
            wave[s] = 1 + (wave[before[s]] if before[s] is not None else 0)
            for t in followers[s]:
                open_[t] -= 1
                if not open_[t]:
                    after.append(t)
        ready = sorted(after)
    first = dict(sorted(zip(ids, places), key=lambda x: x[1], reverse=True))  # a step that is there twice counts by its first place
    at = min(wave, key=lambda s: (-wave[s], first[s], s), default=None)
    chain: list[str] = []
    while at is not None:
        chain.append(at)
        at = before[at]
    return wave, tuple(reversed(chain))


def _each_graph(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for e, steps in zip(b["execution_id"], b["steps"]):
            ids = [s["step_id"] for s in steps]
            wave, chain = _levels(ids, [s["dependencies"] for s in steps], [s["place"] for s in steps])
            place = {s: k + 1 for k, s in enumerate(chain)}
            out += [(e, s, wave.get(s, -1), place.get(s)) for s in sorted(set(ids))]
        yield pd.DataFrame(out, columns=["execution_id", "step_id", "wave", "critical_pos"]).astype({"critical_pos": "Int32"})


#: Steps up to which a graph is one row.
LARGE_GRAPH = 50_000


def waves(steps: DataFrame, large: int = LARGE_GRAPH) -> DataFrame:
    """``execution_id, step_id, wave, critical_pos``: wave is one more than the latest wave needed (-1 on a cycle or
    behind one); critical_pos is the step's place on the longest chain. Of equally long chains it is the one whose end
    has the smallest ``sequence`` (where there is such a column; then the smallest step_id), and which goes back to the
    first by name of the needs of the wave before.

    A graph is one row (ids and dependencies only), so that small graphs share Arrow batches. Graphs of more than
    ``large`` steps are levelled as tables, round by round. To know whether there are any, steps are counted when this
    is called.
    """
    kind = steps.schema["execution_id"].dataType.simpleString()
    place = F.col("sequence").cast("long") if "sequence" in steps.columns else F.lit(0).cast("long")
    s = steps.select("execution_id", "step_id", "dependencies", place.alias("place"))
    big = s.groupBy("execution_id").agg(F.count("*").alias("n")).where(F.col("n") > large).select("execution_id")
    found = bool(big.limit(1).count())
    small = s.join(big, "execution_id", "left_anti") if found else s
    graphs = small.groupBy("execution_id").agg(F.collect_list(F.struct("step_id", "dependencies", F.coalesce("place", F.lit(1 << 62)).alias("place"))).alias("steps"))
    leveled = graphs.mapInPandas(_each_graph, f"execution_id {kind}, step_id string, wave int, critical_pos int")
    if found:
        leveled = leveled.unionByName(waves_by_frontier(s.join(big, "execution_id", "left_semi").withColumn("place", F.coalesce("place", F.lit(1 << 62)))))
    return leveled


def cycles(leveled: DataFrame) -> DataFrame:
    """Executions with steps that no order can reach."""
    return leveled.where("wave = -1").groupBy("execution_id").agg(F.array_sort(F.collect_list("step_id")).alias("unreachable"))


def topological_order(leveled: DataFrame) -> DataFrame:
    w = W.partitionBy("execution_id").orderBy("wave", "step_id")
    return leveled.where("wave > 0").select("execution_id", F.row_number().over(w).alias("position"), "step_id")


def ready_steps(steps: DataFrame, done: DataFrame) -> DataFrame:
    """Steps that are not done and need nothing that is not."""
    open_ = dependencies(steps).join(done.select("execution_id", F.col("step_id").alias("needs")), ["execution_id", "needs"], "left_anti").select("execution_id", "step_id").distinct()
    return steps.select("execution_id", "step_id").join(done, ["execution_id", "step_id"], "left_anti").join(open_, ["execution_id", "step_id"], "left_anti")


def estimated_duration(steps: DataFrame, leveled: DataFrame) -> DataFrame:
    """``execution_id, estimated_s``: time-outs and delays along the critical path."""
    on = leveled.where("critical_pos is not null").select("execution_id", "step_id")
    return steps.join(on, ["execution_id", "step_id"]).groupBy("execution_id").agg(F.round(F.sum(F.col("timeout_s") + F.col("delay_before_s") + F.col("delay_after_s")), 3).alias("estimated_s"))


def transaction_groups(steps: DataFrame) -> DataFrame:
    """Groups of two steps or more, in the order of their steps."""
    g = steps.where("transaction_group is not null").groupBy("execution_id", "transaction_group").agg(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "step_id"))), lambda x: x["step_id"]).alias("step_ids"))
    return g.where(F.size("step_ids") >= 2)


def device_list(steps: DataFrame) -> DataFrame:
    return steps.where("device is not null").groupBy("execution_id").agg(F.array_sort(F.collect_set("device")).alias("devices"))


def approval(steps: DataFrame, models: DataFrame) -> DataFrame:
    """``execution_id, requires_approval, high_blast, flagged``: by the model's flag, steps of high or critical
    reach, and steps that ask for it (the first five of each are named)."""
    wide = F.coalesce(F.col("blast_radius").isin("high", "critical"), F.lit(False)).alias("wide")
    asks = F.coalesce("approval_required", F.lit(False)).alias("asks")
    # each kind is ranked by itself before it is gathered: five meet, however many there are
    place = lambda c: F.row_number().over(W.partitionBy("execution_id", c).orderBy("sequence", "step_id"))
    s = steps.select("execution_id", "sequence", "step_id", wide, asks).withColumn("rw", place("wide")).withColumn("ra", place("asks"))
    kept = lambda c, r: F.transform(F.array_sort(F.collect_list(F.when(F.col(c) & (F.col(r) <= 5), F.struct("sequence", "step_id")))), lambda x: x["step_id"])
    g = s.groupBy("execution_id").agg(kept("wide", "rw").alias("high_blast"), kept("asks", "ra").alias("flagged"))
    d = models.select("execution_id", F.col("approval_required").alias("__m")).join(g, "execution_id")
    return d.select("execution_id", (F.col("__m") | (F.size("high_blast") > 0) | (F.size("flagged") > 0)).alias("requires_approval"), "high_blast", "flagged")


def blocked_commands(commands: DataFrame, patterns: tuple[str, ...] = P.BLOCKED_COMMANDS) -> DataFrame:
    """Commands on the block list, with the first pattern that matches; steps of high or critical reach that are
    approved may run them."""
    text = F.coalesce("normalized", F.col("raw"))
    hit = F.when(F.lit(False), F.lit(""))
    for p in patterns:
        hit = hit.when(text.rlike("(?i)" + p), F.lit(p))
    override = F.col("blast_radius").isin("high", "critical") & F.col("approval_required")
    return commands.withColumn("pattern", hit).where(F.col("pattern").isNotNull() & ~override)


def invalid_patterns(block_list: DataFrame) -> DataFrame:
    """``pattern_no, pattern, error`` of the patterns of a block list that do not compile."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(n, p, str(e)) for n, p in zip(b["pattern_no"], b["pattern"]) if (e := _error(p))], columns=["pattern_no", "pattern", "error"])

    return block_list.select("pattern_no", "pattern").where("pattern IS NOT NULL").mapInPandas(told, "pattern_no int, pattern string, error string")


def _error(pattern: str) -> str | None:
    try:
        re.compile(pattern, re.I)
        return None
    except re.error as e:
        return str(e)


def blocked_by_table(commands: DataFrame, block_list: DataFrame) -> DataFrame:
    """Commands that a table of patterns (pattern_no, pattern) blocks, with pattern_no and pattern of the first by
    number that is found in them in any case; overridden as in ``blocked_commands``. Patterns that do not compile block
    nothing (``invalid_patterns`` tells them), null ones neither.

    The table goes to every task whole: it may have dimensions.MOST rows, more are an error. A text is tried against
    the patterns only if their alternation is found in it, and each text of a batch once.
    """
    rows = sorted(_bounded(block_list.select("pattern_no", "pattern").where("pattern IS NOT NULL")), key=lambda r: (r.pattern_no is None, r.pattern_no, r.pattern))
    valid = [(r.pattern_no, r.pattern) for r in rows if not _error(r.pattern)]
    both = "|".join(f"(?:{p})" for _, p in valid)
    any_of = None if _error(both) else both  # patterns with flags of their own do not join

    @F.pandas_udf("pattern_no int, pattern string")
    def first(text: pd.Series) -> pd.DataFrame:
        found = {}
        for t in text.dropna().unique():
            if any_of is None or re.search(any_of, t, re.I):
                found[t] = next(((n, p) for n, p in valid if re.search(p, t, re.I)), (None, None))
        return pd.DataFrame([found.get(t, (None, None)) for t in text], columns=["pattern_no", "pattern"]).astype({"pattern_no": "Int32"})

    if not valid:
        return commands.withColumn("pattern_no", F.lit(None).cast("int")).withColumn("pattern", F.lit(None).cast("string")).where("false")
    override = F.col("blast_radius").isin("high", "critical") & F.col("approval_required")
    d = commands.where(~F.coalesce(override, F.lit(False))).withColumn("__hit", first(F.coalesce("normalized", F.col("raw"))))
    return d.withColumn("pattern_no", F.col("__hit.pattern_no")).withColumn("pattern", F.col("__hit.pattern")).drop("__hit").where("pattern IS NOT NULL")


def inverse_command(raw: Column, vendor: Column) -> Column:
    """The command that undoes a configuration command; null if there is none."""
    c, v = strip(raw), F.lower(F.coalesce(vendor, F.lit("generic")))
    starts = c.startswith
    return (
        F.when(v.isin("cisco", "arista", "nokia", "ericsson"), F.when(~starts("no ") & ~starts("end"), F.concat(F.lit("no "), c)))
        .when(v == "juniper", F.when(starts("set "), F.concat(F.lit("delete "), F.substring(c, F.lit(5), F.length(c)))).when(starts("activate "), F.concat(F.lit("deactivate "), F.substring(c, F.lit(10), F.length(c)))))
        .when(v == "huawei", F.when(~starts("undo "), F.concat(F.lit("undo "), c)))
        .otherwise(F.when(~starts("no "), F.concat(F.lit("no "), c)))
    )


def inverse_commands(steps: DataFrame) -> DataFrame:
    """``steps`` plus ``inverse``, the commands that undo a step, last first; none for steps that check or undo."""
    own = F.transform(F.filter(F.reverse("commands"), lambda c: ~c["mode"].eqNullSafe(F.lit("exec"))), lambda c: inverse_command(c["raw"], c["vendor"]))
    none = F.array().cast("array<string>")
    return steps.withColumn("inverse", F.when(F.col("action_type").isin("verify", "observe", "rollback"), none).otherwise(F.filter(own, lambda x: x.isNotNull())))


def rollback_order(steps: DataFrame) -> DataFrame:
    """``execution_id, position, step_id`` of the passed steps, last first. ``steps`` has status."""
    w = W.partitionBy("execution_id").orderBy(F.col("sequence").desc(), F.col("step_id").desc())
    return steps.where("status = 'passed'").select("execution_id", F.row_number().over(w).alias("position"), "step_id")


def group_rollback(steps: DataFrame) -> DataFrame:
    """Per transaction group, the passed steps after its last passed savepoint, last first."""
    g = W.partitionBy("execution_id", "transaction_group")
    d = steps.where("transaction_group is not null").withColumn("sp", F.max(F.when(F.col("savepoint") & (F.col("status") == "passed"), F.col("sequence"))).over(g))
    d = d.where((F.col("status") == "passed") & (F.col("sp").isNull() | (F.col("sequence") > F.col("sp"))))
    return d.select("execution_id", "transaction_group", F.row_number().over(g.orderBy(F.col("sequence").desc(), F.col("step_id").desc())).alias("position"), "step_id")


def recovery_decisions(failures: DataFrame) -> DataFrame:
    """Failed attempts (attempt, retry_count, error_message, failure_strategy, evidence) plus decision, reason,
    confidence, auto_decided and the evidence kept."""
    low = F.lower(F.coalesce("error_message", F.lit("")))
    fatal = F.lit(False)
    for p in P.FATAL_ERRORS:
        fatal = fatal | F.contains(low, F.lit(p))
    s = F.coalesce("failure_strategy", F.lit("abort"))
    retry = F.col("attempt") < F.col("retry_count")
    back = s.isin("rollback_group", "rollback_all")
    decision = F.when(retry, "RETRY").when(fatal, "ESCALATE").when(s == "continue", "CONTINUE").when(back, "ROLLBACK").otherwise("ABORT")
    reason = (
        F.when(retry, F.concat(F.lit("attempt "), F.col("attempt").cast("string"), F.lit(" < max_retries "), F.col("retry_count").cast("string")))
        .when(fatal, F.concat(F.lit("fatal error: "), F.substring("error_message", 1, 80)))
        .when((s == "continue") | back, F.concat(F.lit("failure strategy "), s))
        .otherwise("retries exhausted, no recovery strategy")
    )
    sure = F.when(retry | fatal, 1.0).when((s == "continue") | back, 0.7).otherwise(0.5)
    d = failures.withColumn("decision", decision).withColumn("reason", reason).withColumn("confidence", sure)
    return d.withColumn("auto_decided", F.col("confidence") >= 0.6).withColumn("evidence", F.substring(F.coalesce("evidence", "error_message"), 1, 200))


def failure_outcomes(steps: DataFrame, models: DataFrame) -> DataFrame:
    """``execution_id, first_failed_wave, outcome`` from steps with wave and status: what failures lead to by the
    failure strategy. With rollback_group, only a failed step that is in a group of two or more is rolled back."""
    group = W.partitionBy("execution_id", "transaction_group")
    d = steps.withColumn("__n", F.when(F.col("transaction_group").isNotNull(), F.count("*").over(group)).otherwise(0))
    bad = F.col("status") == "failed"
    g = d.groupBy("execution_id").agg(F.min(F.when(bad, F.col("wave"))).alias("first_failed_wave"), F.coalesce(F.bool_or(bad & (F.col("__n") >= 2)), F.lit(False)).alias("grouped"))
    m = models.select("execution_id", F.coalesce("failure_strategy", F.lit("abort")).alias("s"))
    out = F.when(F.col("first_failed_wave").isNull(), "passed").when(F.col("s") == "rollback_all", "rolled_back").when((F.col("s") == "rollback_group") & F.col("grouped"), "rolled_back").otherwise("failed")
    return g.join(m, "execution_id").select("execution_id", "first_failed_wave", out.alias("outcome"), ((F.col("s") != "continue") & F.col("first_failed_wave").isNotNull()).alias("halted"))


def plan_summary(steps: DataFrame, models: DataFrame, leveled: DataFrame) -> DataFrame:
    """One row an execution: steps, waves, groups, devices, estimate, approval."""
    n = steps.groupBy("execution_id").agg(F.count("*").alias("n_steps"))
    v = leveled.groupBy("execution_id").agg(F.max("wave").alias("n_waves"), F.bool_or(F.col("wave") == -1).alias("has_cycle"))
    t = transaction_groups(steps).groupBy("execution_id").agg(F.count("*").alias("n_groups"))
    d = n.join(v, "execution_id").join(t, "execution_id", "left").join(device_list(steps).select("execution_id", F.size("devices").alias("n_devices")), "execution_id", "left")
    d = d.join(estimated_duration(steps, leveled), "execution_id", "left").join(approval(steps, models).select("execution_id", "requires_approval"), "execution_id")
    return d.na.fill(0, ["n_groups", "n_devices"])
