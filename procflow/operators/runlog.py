"""Execution logs: transitions folded into state, reports, metrics, notifications.

The log (ts, execution_id, entity, to_status, ...) is append-only; entity is "execution" or a step. All folds use
max_by and counts, which aggregate partially, so that one very active execution does not meet in one task; what runs in
order of time is counted in spans for such executions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from procflow.operators import ordered

STEP_ENDS = ("passed", "failed", "skipped", "rolled_back")
EXECUTION_ENDS = ("passed", "failed", "rolled_back", "aborted")
STATUSES = ("pending", "approved", "running", "passed", "failed", "skipped", "rolled_back", "aborted", "paused", "waiting")


def millis(c: str) -> Column:
    """A timestamp of either kind as milliseconds."""
    return F.unix_millis(F.col(c).cast("timestamp"))


def _ends(*values: str) -> Column:
    return F.col("to_status").isin(*values)


def step_state(log: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """One row a step: last status, attempts, times, duration, and the last value that is not null of each of the
    ``carried`` columns."""
    s = log.where("entity <> 'execution'")
    end, run = F.when(_ends(*STEP_ENDS), F.col("ts")), F.when(_ends("running"), F.col("ts"))
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ts"))).alias(c) for c in carried]
    g = s.groupBy("execution_id", F.col("entity").alias("step_id")).agg(F.max_by("to_status", "ts").alias("status"), F.count_if(_ends("running")).alias("attempts"), F.max(run).alias("started_at"), F.max(end).alias("completed_at"), *last)
    ms = millis("completed_at") - millis("started_at")
    return g.withColumn("duration_ms", F.when(ms >= 0, ms))


def execution_state(log: DataFrame) -> DataFrame:
    """One row an execution, from its own transitions: last status, first start, last end."""
    s = log.where("entity = 'execution'")
    return s.groupBy("execution_id").agg(F.max_by("to_status", "ts").alias("status"), F.min("ts").alias("created_at"), F.min(F.when(_ends("running"), F.col("ts"))).alias("started_at"), F.max(F.when(_ends(*EXECUTION_ENDS), F.col("ts"))).alias("completed_at"))


def enrich_transitions(log: DataFrame, hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """The log plus from_status, the running attempt number and the correlation id of each transition. Executions of
    more than ``hot_rows`` transitions are numbered over ranges of time (the log is counted when this is called)."""
    keys = ["execution_id", "entity"]

    def usual(d: DataFrame) -> DataFrame:
        w = W.partitionBy(*keys).orderBy("ts")
        d = d.withColumn("from_status", F.lag("to_status", 1, "pending").over(w))
        return d.withColumn("attempt", F.count_if(_ends("running")).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))

    def hot(d: DataFrame) -> DataFrame:
        d = ordered.numbered(d, keys, ["ts"], "__no")
        d = ordered.previous(d, keys, "__no", "to_status", "pending", "from_status")
        return ordered.running_count(d, keys, "__no", _ends("running"), "attempt").drop("__no")

    d = ordered.by_heat(log, "execution_id", hot_rows, usual, hot)
    return d.withColumn("correlation_id", F.concat_ws(":", "execution_id", "entity", F.col("attempt").cast("string")))


def step_report(steps: DataFrame, state: DataFrame) -> DataFrame:
    """One row a step of the plan, with what the log says of it; steps that never ran are pending."""
    d = steps.join(state, ["execution_id", "step_id"], "left")
    return d.select(
        "execution_id",
        "step_id",
        "sequence",
        F.coalesce("device", F.lit("(none)")).alias("device"),
        F.coalesce("status", F.lit("pending")).alias("status"),
        F.substring(F.coalesce("actual_output", F.lit("")), 1, 300).alias("output"),
        F.round(F.col("duration_ms") / 1000, 2).alias("duration_s"),
        F.greatest(F.lit(0), F.coalesce("attempts", F.lit(0)) - 1).alias("retries"),
    )


def device_summary(report: DataFrame) -> DataFrame:
    """Per device: steps run, passed, failed, mean duration."""
    cs = F.round(F.col("duration_s") * 100).cast("long")  # whole numbers, so that the mean does not hang on the order of sums
    g = report.groupBy("execution_id", "device").agg(F.count_if(F.col("status") != "pending").alias("run"), F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum(cs).alias("s"), F.count(cs).alias("n"))
    return g.select("execution_id", "device", "run", "passed", "failed", F.when(F.col("n") > 0, F.expr("(20 * s + n) div (2 * n)") / 1000.0).alias("mean_s"))


def execution_report(report: DataFrame, state: DataFrame) -> DataFrame:
    """Per execution: steps by status, overall status, total duration."""
    of = lambda s: F.count_if(F.col("status") == s)
    g = report.groupBy("execution_id").agg(F.count("*").alias("total"), of("passed").alias("passed"), of("failed").alias("failed"), of("skipped").alias("skipped"), of("pending").alias("pending"))
    s = state.select("execution_id", F.col("status").alias("overall"), F.round((millis("completed_at") - millis("started_at")) / 1000, 2).alias("duration_s"))
    return g.join(s, "execution_id", "left").withColumn("overall", F.coalesce("overall", F.lit("pending")))


def timeline(log: DataFrame, hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """``execution_id, event_no, ts, step_id, label`` in order of time. Executions of more than ``hot_rows`` events are
    numbered over ranges of time (the log is counted when this is called)."""
    order = ["ts", "entity"]
    usual = lambda d: d.withColumn("event_no", F.row_number().over(W.partitionBy("execution_id").orderBy(*order)))
    d = ordered.by_heat(log.select("execution_id", "ts", "entity", "to_status"), "execution_id", hot_rows, usual, lambda d: ordered.numbered(d, ["execution_id"], order, "event_no"))
    return d.select("execution_id", "event_no", "ts", F.when(F.col("entity") != "execution", F.col("entity")).alias("step_id"), F.concat("entity", F.lit(" → "), "to_status").alias("label"))


def latest_executions(log: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` executions with the newest transitions, with their steps in total and passed."""
    last = log.groupBy("execution_id").agg(F.max("ts").alias("last_ts")).orderBy(F.col("last_ts").desc(), "execution_id").limit(n)
    s = step_state(log.join(last.select("execution_id"), "execution_id", "left_semi")).groupBy("execution_id").agg(F.count("*").alias("steps_total"), F.count_if(F.col("status") == "passed").alias("steps_passed"))
    return last.join(s, "execution_id", "left").na.fill(0, ["steps_total", "steps_passed"])


def _latest_status(log: DataFrame, n: int) -> DataFrame:
    """The last status of each of the ``n`` executions with the newest transitions of their own."""
    return log.where("entity = 'execution'").groupBy("execution_id").agg(F.max_by("to_status", "ts").alias("status"), F.max("ts").alias("t")).orderBy(F.col("t").desc(), "execution_id").limit(n)


def status_metrics(log: DataFrame, n: int = 500) -> DataFrame:
    """``status, n, line``: statuses of the latest ``n`` executions, also as lines of text exposition."""
    return _latest_status(log, n).groupBy("status").agg(F.count("*").alias("n")).withColumn("line", F.format_string('executions_total{status="%s"} %d', "status", "n"))


def active_executions(log: DataFrame, n: int = 500) -> DataFrame:
    """One row, ``n, line``: how many of the latest ``n`` executions run, also as a line of text exposition."""
    return _latest_status(log, n).agg(F.count_if(F.col("status") == "running").alias("n")).withColumn("line", F.format_string("executions_active %d", "n"))


def decision_summary(decisions: DataFrame) -> DataFrame:
    """``execution_id, decision, n, mean_confidence``."""
    return decisions.groupBy("execution_id", "decision").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


def window_position(ts: Column, start: Column, end: Column) -> Column:
    """before, in (both ends included) or after a maintenance window; allowed where it is missing or invalid."""
    return F.when(start.isNull() | end.isNull() | (start > end), "allowed").when(ts < start, "before").when(ts > end, "after").otherwise("in")


def iso_timestamp(c: Column) -> Column:
    """An ISO-8601 text as a timestamp, with Z or an offset; null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(c, r"[zZ]$", "+00:00"))


#: Hours after its last transition for which an execution stays in the log (fixed value).
TTL_HOURS = 168


def split_expired(log: DataFrame, now: Column, hours: int = TTL_HOURS) -> tuple[DataFrame, DataFrame]:
    """The log of executions whose last transition is younger than ``hours``, and the rest."""
    last = log.groupBy("execution_id").agg(F.max("ts").alias("last_ts"))
    old = last.where(F.col("last_ts") < now - F.expr(f"INTERVAL {int(hours)} HOURS")).select("execution_id")
    return log.join(old, "execution_id", "left_anti"), log.join(old, "execution_id", "left_semi")


# ---- Fixed values: lifecycle events, and which of them page, resolve or go by mail ----
EVENTS = ("execution_started", "execution_passed", "execution_failed", "step_failed_with_retry", "step_failed_no_retry", "rollback_started", "rollback_passed", "rollback_failed", "kill_switch_engaged", "approval_required", "maintenance_window_expiring")
TRIGGERS = ("execution_failed", "rollback_failed", "kill_switch_engaged")
RESOLVES = ("execution_passed", "rollback_passed")
MAILED = ("execution_failed", "rollback_failed", "kill_switch_engaged", "execution_passed", "approval_required")
CHANNEL_RULES = tuple((e, "slack") for e in EVENTS) + tuple((e, "email") for e in MAILED) + tuple((e, "pagerduty") for e in TRIGGERS + RESOLVES)


def notifications(events: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each event and channel: text, and for paging the action, the severity and the key it goes by."""
    d = events.join(rules, "event")
    paging = F.col("channel") == "pagerduty"
    return d.select(
        "execution_id",
        "ts",
        "event",
        "channel",
        F.substring(F.concat_ws(": ", "event", "execution_id", "message"), 1, 200).alias("text"),
        F.when(paging, F.when(F.col("event").isin("kill_switch_engaged", "rollback_failed"), "critical").otherwise("error")).alias("severity"),
        F.when(paging, F.when(F.col("event").isin(*RESOLVES), "resolve").otherwise("trigger")).alias("action"),
        F.when(paging, F.concat(F.lit("run-"), "execution_id")).alias("dedup_key"),
    )


def open_incidents(paged: DataFrame) -> DataFrame:
    """Keys whose last action is a trigger."""
    return paged.where("action is not null").groupBy("dedup_key").agg(F.max_by("action", "ts").alias("action"), F.max("ts").alias("ts")).where("action = 'trigger'").select("dedup_key", "ts")


def ticket_comments(report: DataFrame, state: DataFrame, most: int = 10) -> DataFrame:
    """A comment for each execution that passed or failed, naming at most ``most`` failed steps."""
    counts = report.groupBy("execution_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "passed").alias("passed"))
    # ranked before they are gathered, so no more than the named ones meet
    place = F.row_number().over(W.partitionBy("execution_id").orderBy("step_id"))
    bad = report.where("status = 'failed' and step_id is not null").select("execution_id", "step_id", place.alias("__r")).where(F.col("__r") <= most)
    bad = bad.groupBy("execution_id").agg(F.array_sort(F.collect_list("step_id")).alias("failed_ids"))
    g = counts.join(bad, "execution_id", "left")
    d = state.where("status in ('passed', 'failed')").select("execution_id", "status").join(g, "execution_id")
    more = F.when(F.size("failed_ids") > 0, F.concat(F.lit("; failed: "), F.array_join("failed_ids", ", "))).otherwise("")
    return d.select("execution_id", "status", F.concat(F.lit("Execution "), "status", F.lit(": "), F.col("passed").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" steps passed"), more).alias("comment"))


def newest_jobs(jobs: DataFrame, n: int = 20) -> DataFrame:
    return jobs.orderBy(F.col("created_at").desc(), "job_id").limit(n)


def last_log_lines(lines: DataFrame, n: int = 500) -> DataFrame:
    """The last ``n`` lines (500 at most) of each job's log."""
    w = W.partitionBy("job_id").orderBy(F.col("ts").desc(), F.col("line_no").desc())
    return lines.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= min(n, 500)).drop("__r")


def killable(state: DataFrame) -> DataFrame:
    """Executions that run."""
    return state.where("status = 'running'").select("execution_id")


def wait_outcomes(requests: DataFrame, polls: DataFrame) -> DataFrame:
    """Waiting for a condition, after the fact: ``wait_id, met, attempts, elapsed_s``.

    ``requests``: wait_id, start, max_wait_s. ``polls``: wait_id, ts, matched. Met by the first match within the
    time allowed; attempts count polls up to it (or all in time).
    """
    d = requests.join(polls, "wait_id", "left")
    limit = F.col("start") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("max_wait_s"))
    timely = (F.col("ts") >= F.col("start")) & (F.col("ts") <= limit)
    d = d.withColumn("ok_ts", F.when(timely & F.col("matched"), F.col("ts"))).withColumn("in_ts", F.when(timely, F.col("ts")))
    g = d.groupBy("wait_id", "start", "max_wait_s").agg(F.min("ok_ts").alias("met_at"))
    # a second, conditional count: no wait's polls are ever collected
    tries = d.select("wait_id", "in_ts").join(g, "wait_id").groupBy("wait_id").agg(F.count_if(F.col("in_ts") <= F.coalesce("met_at", "in_ts")).cast("int").alias("attempts"))
    g = g.join(tries, "wait_id")
    elapsed = F.when(F.col("met_at").isNotNull(), (millis("met_at") - millis("start")) / 1000).otherwise(F.col("max_wait_s"))
    return g.select("wait_id", F.col("met_at").isNotNull().alias("met"), "attempts", F.round(elapsed, 3).alias("elapsed_s"))


def approval_outcomes(requests: DataFrame, answers: DataFrame, timeout_s: int = 3600) -> DataFrame:
    """``request_id, outcome``: the first answer within the time allowed; denied counts as rejected; else timed_out.

    ``requests``: request_id, ts. ``answers``: request_id, answered_at, answer.
    """
    late = F.col("ts") + F.expr(f"INTERVAL {int(timeout_s)} SECONDS")
    d = requests.join(answers, "request_id", "left")
    g = d.groupBy("request_id").agg(F.min_by("answer", F.when((F.col("answered_at") >= F.col("ts")) & (F.col("answered_at") <= late), F.col("answered_at"))).alias("a"))
    return g.select("request_id", F.when(F.col("a") == "denied", "rejected").otherwise(F.coalesce("a", F.lit("timed_out"))).alias("outcome"))
