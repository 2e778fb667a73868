"""Queries on plans, execution logs, output checks, diffs and fleets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from procflow.functions import commands as C
from procflow.functions import patterns as P
from procflow.operators import diffing as D
from procflow.operators import fleet as Z
from procflow.operators import matching as E
from procflow.operators import runlog as L
from procflow.plans import graph as G
from procflow.queries.views import sql_list, sql_strip, sql_text
from procflow.session import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _pick(values, k: str) -> str:
    """The same SQL text in both engines: the k-th (from 0) of some texts or numbers."""
    return "CASE " + k + " " + " ".join(f"WHEN {i} THEN {sql_text(v) if isinstance(v, str) else v}" for i, v in enumerate(values)) + " END"


# ---- plans: an order is an execution, its lines are steps ----
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
_RAWS = ("show ip bgp summary", "router bgp 65001", "set protocols ospf area 0", "interface ge-0/0/1", "write erase", "activate interfaces ge-0/0/1", "end", "no shutdown", "format disk0:")
_VENDORS = ("cisco", "nokia", "juniper", "huawei", "cisco", "juniper", "arista", "cisco", "generic")
_STEP_COLS = f"""'s' || lpad(cast(n AS STRING), 2, '0') AS step_id, n AS sequence, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'PE' || l_suppkey END AS device, CASE WHEN l_partkey % 3 = 0 THEN 'g' || l_suppkey % 2 END AS transaction_group,
  {_pick(("low", "low", "medium", "high", "critical"), "l_partkey % 5")} AS blast_radius, l_suppkey % 11 = 0 AS approval_required, l_partkey % 6 = 0 AS savepoint, {_pick(("execute", "execute", "verify", "rollback"), "l_suppkey % 4")} AS action_type,
  {_pick(_RAWS, "l_partkey % 9")} AS raw, {_pick(_VENDORS, "l_partkey % 9")} AS vendor, CASE WHEN l_partkey % 9 = 0 THEN 'exec' ELSE 'config' END AS mode,
  {_pick(("passed", "passed", "passed", "failed", "skipped", "passed", "pending"), "l_suppkey % 7")} AS status, l_partkey, l_suppkey"""
_NEEDS = "CASE WHEN n = 1 THEN CASE WHEN ok % 50 = 0 THEN 's02' ELSE '' END WHEN n % 4 = 0 THEN 's' || lpad(cast(n - 1 AS STRING), 2, '0') || ',s' || lpad(cast(n - 3 AS STRING), 2, '0') WHEN n % 3 = 0 THEN 's' || lpad(cast(n - 2 AS STRING), 2, '0') ELSE 's' || lpad(cast(n - 1 AS STRING), 2, '0') END || CASE WHEN l_partkey % 97 = 0 THEN ',s99' ELSE '' END"
_PSTEPS = f"""ps0 AS (SELECT *, l_orderkey AS ok, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS n FROM lineitem),
psteps AS (SELECT 'e' || ok AS execution_id, ok, {_NEEDS} AS needs, {_STEP_COLS} FROM ps0),
deps AS (SELECT execution_id, step_id, unnest(list_filter(string_split(needs, ','), lambda x: x <> '')) AS needs FROM psteps),
pmodels AS (SELECT DISTINCT execution_id, {_pick(("abort", "continue", "rollback_group", "rollback_all"), "ok % 4")} AS failure_strategy, ok % 5 = 0 AS approval_required FROM psteps)"""


def plan_steps(spark, sf):
    li = table(spark, sf, "lineitem")
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_ORDER.split(", ")))
    d = li.withColumn("n", n).withColumn("ok", F.col("l_orderkey"))
    d = d.selectExpr("'e' || ok AS execution_id", "ok", f"{_NEEDS} AS needs", *_split_cols())
    d = d.withColumn("dependencies", F.filter(F.split("needs", ","), lambda x: x != "")).withColumn("timeout_s", F.lit(30.0)).withColumn("delay_before_s", F.lit(1.5)).withColumn("delay_after_s", F.lit(0.5))
    return d.withColumn("commands", F.array(F.struct("raw", F.lower("raw").alias("normalized"), "vendor", "mode")))


def _split_cols() -> list[str]:
    """The select list above as single expressions."""
    out, depth, at, quoted = [], 0, 0, False
    for i, ch in enumerate(_STEP_COLS):
        quoted ^= ch == "'"
        if not quoted:
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                out.append(_STEP_COLS[at:i].strip())
                at = i + 1
    return [*out, _STEP_COLS[at:].strip()]


def plan_models(spark, sf):
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("ok")).distinct()
    return d.selectExpr("'e' || ok AS execution_id", f"{_pick(('abort', 'continue', 'rollback_group', 'rollback_all'), 'ok % 4')} AS failure_strategy", "ok % 5 = 0 AS approval_required")


# the longest path by recursion; executions with a cycle have none
_WAVES = f"""WITH RECURSIVE {_PSTEPS}, known AS (SELECT d.* FROM deps d SEMI JOIN psteps p ON d.execution_id = p.execution_id AND d.needs = p.step_id),
cyclic AS (SELECT execution_id FROM psteps WHERE ok % 50 = 0 GROUP BY execution_id HAVING count(*) >= 2),
path(execution_id, step_id, depth) AS (SELECT execution_id, step_id, 1 FROM psteps p WHERE execution_id NOT IN (SELECT execution_id FROM cyclic) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.execution_id = p.execution_id AND k.step_id = p.step_id)
  UNION SELECT k.execution_id, k.step_id, depth + 1 FROM path p JOIN known k ON k.execution_id = p.execution_id AND k.needs = p.step_id),
wv AS (SELECT p.execution_id, p.step_id, coalesce(max(depth), -1) AS wave FROM psteps p LEFT JOIN path q ON p.execution_id = q.execution_id AND p.step_id = q.step_id GROUP BY p.execution_id, p.step_id)"""


@query("x01_unknown_dependencies", f"WITH {_PSTEPS} SELECT d.* FROM deps d ANTI JOIN psteps p ON d.execution_id = p.execution_id AND d.needs = p.step_id")
def x01(spark, sf):
    return G.unknown_dependencies(plan_steps(spark, sf))


@query("x02_cycles", f"{_WAVES} SELECT execution_id, string_agg(step_id, ',' ORDER BY step_id) AS unreachable FROM wv WHERE wave = -1 GROUP BY execution_id")
def x02(spark, sf):
    return G.cycles(G.waves(plan_steps(spark, sf))).withColumn("unreachable", F.array_join("unreachable", ","))


@query("x03_waves", f"{_WAVES} SELECT * FROM wv")
def x03(spark, sf):
    return G.waves(plan_steps(spark, sf)).select("execution_id", "step_id", "wave")


# the chain: from the last wave's first step in the plan back to the first by name of the needs one wave before
_CHAIN = """ends AS (SELECT wv.execution_id, arg_min(wv.step_id, (-wave, sequence, wv.step_id)) AS step_id, max(wave) AS wave FROM wv JOIN psteps p ON p.execution_id = wv.execution_id AND p.step_id = wv.step_id WHERE wave > 0 GROUP BY wv.execution_id),
back AS (SELECT k.execution_id, k.step_id, min(k.needs) AS before FROM known k JOIN wv a ON a.execution_id = k.execution_id AND a.step_id = k.step_id JOIN wv b ON b.execution_id = k.execution_id AND b.step_id = k.needs WHERE b.wave = a.wave - 1 AND b.wave > 0 GROUP BY k.execution_id, k.step_id),
chain(execution_id, step_id, critical_pos) AS (SELECT * FROM ends UNION ALL SELECT c.execution_id, b.before, critical_pos - 1 FROM chain c JOIN back b ON b.execution_id = c.execution_id AND b.step_id = c.step_id)"""


@query("x04_critical_path", f"{_WAVES}, {_CHAIN} SELECT execution_id, critical_pos, step_id FROM chain")
def x04(spark, sf):
    return G.waves(plan_steps(spark, sf)).where("critical_pos is not null").select("execution_id", "critical_pos", "step_id")


# one graph of all orders: each needs two earlier ones, none of which need be there
_BIG = """WITH RECURSIVE big AS (SELECT 'all' AS execution_id, 'o' || o_orderkey AS step_id, o_orderkey AS sequence, 'o' || (o_orderkey // 3) AS a, 'o' || (o_orderkey * 2 // 5) AS b FROM orders),
known AS (SELECT DISTINCT d.* FROM (SELECT execution_id, step_id, a AS needs FROM big UNION SELECT execution_id, step_id, b FROM big) d SEMI JOIN big p ON d.needs = p.step_id AND d.needs <> d.step_id),
psteps AS (SELECT * FROM big),
path(execution_id, step_id, depth) AS (SELECT execution_id, step_id, 1 FROM big p WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.step_id = p.step_id) UNION SELECT k.execution_id, k.step_id, depth + 1 FROM path p JOIN known k ON k.needs = p.step_id),
wv AS (SELECT execution_id, step_id, max(depth) AS wave FROM path GROUP BY ALL)"""


def _big_graph(spark, sf):
    d = table(spark, sf, "orders").selectExpr("'all' AS execution_id", "'o' || o_orderkey AS step_id", "o_orderkey AS sequence", "'o' || (o_orderkey div 3) AS a", "'o' || (o_orderkey * 2 div 5) AS b")
    return d.select("execution_id", "step_id", "sequence", F.filter(F.array("a", "b"), lambda x: x != F.col("step_id")).alias("dependencies"))


@query("x03_large_graph", f"{_BIG}, {_CHAIN} SELECT wv.*, critical_pos FROM wv LEFT JOIN chain USING (execution_id, step_id)")
def x03_large(spark, sf):
    """All orders as one graph, levelled as tables whatever its size."""
    return G.waves(_big_graph(spark, sf), large=1000)


@query("x05_topological_order", f"{_WAVES} SELECT execution_id, row_number() OVER (PARTITION BY execution_id ORDER BY wave, step_id) AS position, step_id FROM wv WHERE wave > 0")
def x05(spark, sf):
    return G.topological_order(G.waves(plan_steps(spark, sf)))


@query("x06_ready_steps", f"WITH {_PSTEPS}, done AS (SELECT execution_id, step_id FROM psteps WHERE status = 'passed') SELECT execution_id, step_id FROM psteps p WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.execution_id = p.execution_id AND d.step_id = p.step_id) AND NOT EXISTS (SELECT 1 FROM deps x WHERE x.execution_id = p.execution_id AND x.step_id = p.step_id AND NOT EXISTS (SELECT 1 FROM done d WHERE d.execution_id = x.execution_id AND d.step_id = x.needs))")
def x06(spark, sf):
    s = plan_steps(spark, sf)
    return G.ready_steps(s, s.where("status = 'passed'").select("execution_id", "step_id"))


@query("x07_estimated_duration", f"{_WAVES} SELECT execution_id, round(32.0 * max(wave), 3) AS estimated_s FROM wv WHERE wave > 0 GROUP BY execution_id")
def x07(spark, sf):
    s = plan_steps(spark, sf)
    return G.estimated_duration(s, G.waves(s))


_GROUPS = "tg AS (SELECT execution_id, transaction_group, string_agg(step_id, ',' ORDER BY sequence) AS step_ids, count(*) AS n FROM psteps WHERE transaction_group IS NOT NULL GROUP BY execution_id, transaction_group HAVING count(*) >= 2)"


@query("x08_transaction_groups", f"WITH {_PSTEPS}, {_GROUPS} SELECT execution_id, transaction_group, step_ids FROM tg")
def x08(spark, sf):
    return G.transaction_groups(plan_steps(spark, sf)).withColumn("step_ids", F.array_join("step_ids", ","))


@query("x09_devices", f"WITH {_PSTEPS} SELECT execution_id, string_agg(DISTINCT device, ',' ORDER BY device) AS devices FROM psteps WHERE device IS NOT NULL GROUP BY execution_id")
def x09(spark, sf):
    return G.device_list(plan_steps(spark, sf)).withColumn("devices", F.array_join("devices", ","))


_APPROVAL = """hb AS (SELECT execution_id, coalesce(array_to_string((list(step_id ORDER BY sequence) FILTER (WHERE blast_radius IN ('high', 'critical')))[1:5], ','), '') AS high_blast, coalesce(array_to_string((list(step_id ORDER BY sequence) FILTER (WHERE approval_required))[1:5], ','), '') AS flagged FROM psteps GROUP BY execution_id),
appr AS (SELECT execution_id, m.approval_required OR high_blast <> '' OR flagged <> '' AS requires_approval, high_blast, flagged FROM pmodels m JOIN hb USING (execution_id))"""


@query("x10_approval", f"WITH {_PSTEPS}, {_APPROVAL} SELECT * FROM appr")
def x10(spark, sf):
    d = G.approval(plan_steps(spark, sf), plan_models(spark, sf))
    return d.withColumn("high_blast", F.array_join("high_blast", ",")).withColumn("flagged", F.array_join("flagged", ","))


@query("x11_blocked_commands", f"WITH {_PSTEPS} SELECT execution_id, step_id, CASE " + " ".join(f"WHEN regexp_matches(lower(raw), {sql_text('(?i)' + p)}) THEN {sql_text(p)}" for p in P.BLOCKED_COMMANDS) + " END AS pattern FROM psteps WHERE (" + " OR ".join(f"regexp_matches(lower(raw), {sql_text('(?i)' + p)})" for p in P.BLOCKED_COMMANDS) + ") AND NOT (blast_radius IN ('high', 'critical') AND approval_required)")
def x11(spark, sf):
    return G.blocked_commands(plan_steps(spark, sf).withColumn("normalized", F.lower("raw"))).select("execution_id", "step_id", "pattern")


@query("x11_block_table", SQL["x11_blocked_commands"])
def x11_table(spark, sf):
    """The block list as a table, with a pattern that does not compile and one that is null."""
    rows = [*enumerate(P.BLOCKED_COMMANDS), (-1, "(((" ), (-2, None)]
    steps = plan_steps(spark, sf).withColumn("normalized", F.lower("raw"))
    return G.blocked_by_table(steps, spark.createDataFrame(rows, "pattern_no int, pattern string")).select("execution_id", "step_id", "pattern")


_INVERSE = """CASE WHEN action_type IN ('verify', 'rollback') OR mode = 'exec' THEN NULL WHEN vendor IN ('cisco', 'arista', 'nokia', 'ericsson') THEN CASE WHEN NOT starts_with(raw, 'no ') AND NOT starts_with(raw, 'end') THEN 'no ' || raw END
  WHEN vendor = 'juniper' THEN CASE WHEN starts_with(raw, 'set ') THEN 'delete ' || substr(raw, 5) WHEN starts_with(raw, 'activate ') THEN 'deactivate ' || substr(raw, 10) END WHEN vendor = 'huawei' THEN CASE WHEN NOT starts_with(raw, 'undo ') THEN 'undo ' || raw END
  WHEN NOT starts_with(raw, 'no ') THEN 'no ' || raw END"""


@query("x12_inverse_commands", f"WITH {_PSTEPS} SELECT execution_id, step_id, coalesce({_INVERSE}, '') AS inverse FROM psteps")
def x12(spark, sf):
    return G.inverse_commands(plan_steps(spark, sf)).select("execution_id", "step_id", F.array_join("inverse", ",").alias("inverse"))


@query("x13_rollback_order", f"WITH {_PSTEPS} SELECT execution_id, row_number() OVER (PARTITION BY execution_id ORDER BY sequence DESC) AS position, step_id FROM psteps WHERE status = 'passed'")
def x13(spark, sf):
    return G.rollback_order(plan_steps(spark, sf))


@query("x14_group_rollback", f"WITH {_PSTEPS}, s AS (SELECT *, max(CASE WHEN savepoint AND status = 'passed' THEN sequence END) OVER (PARTITION BY execution_id, transaction_group) AS sp FROM psteps WHERE transaction_group IS NOT NULL) SELECT execution_id, transaction_group, row_number() OVER (PARTITION BY execution_id, transaction_group ORDER BY sequence DESC) AS position, step_id FROM s WHERE status = 'passed' AND (sp IS NULL OR sequence > sp)")
def x14(spark, sf):
    return G.group_rollback(plan_steps(spark, sf))


_ERRS = ("Authentication failed for user", "timed out", "Permission denied", "syntax error")
_FAILS = f"fails AS (SELECT execution_id, step_id, 1 + l_partkey % 3 AS attempt, 1 + l_suppkey % 3 AS retry_count, {_pick(_ERRS, 'l_partkey % 4')} AS error_message, failure_strategy FROM psteps JOIN pmodels USING (execution_id) WHERE status = 'failed')"


@query("x15_recovery_decisions", f"""WITH {_PSTEPS}, {_FAILS}, d AS (SELECT *, CASE WHEN attempt < retry_count THEN 'RETRY' WHEN error_message IN ('Authentication failed for user', 'Permission denied') THEN 'ESCALATE' WHEN failure_strategy = 'continue' THEN 'CONTINUE' WHEN failure_strategy <> 'abort' THEN 'ROLLBACK' ELSE 'ABORT' END AS decision FROM fails)
SELECT execution_id, step_id, decision, CASE decision WHEN 'RETRY' THEN 1.0 WHEN 'ESCALATE' THEN 1.0 WHEN 'ABORT' THEN 0.5 ELSE 0.7 END AS confidence, decision <> 'ABORT' AS auto_decided, substr(error_message, 1, 200) AS evidence,
CASE decision WHEN 'RETRY' THEN 'attempt ' || attempt || ' < max_retries ' || retry_count WHEN 'ESCALATE' THEN 'fatal error: ' || substr(error_message, 1, 80) WHEN 'ABORT' THEN 'retries exhausted, no recovery strategy' ELSE 'failure strategy ' || failure_strategy END AS reason FROM d""")
def x15(spark, sf):
    d = plan_steps(spark, sf).where("status = 'failed'").drop("approval_required").join(plan_models(spark, sf), "execution_id")
    d = d.selectExpr("execution_id", "step_id", "1 + l_partkey % 3 AS attempt", "1 + l_suppkey % 3 AS retry_count", f"{_pick(_ERRS, 'l_partkey % 4')} AS error_message", "failure_strategy", "cast(NULL AS STRING) AS evidence")
    return G.recovery_decisions(d).select("execution_id", "step_id", "decision", "confidence", "auto_decided", "evidence", "reason")


@query("x16_failure_outcomes", f"""{_WAVES}, s AS (SELECT p.*, wave, CASE WHEN transaction_group IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY p.execution_id, transaction_group) END AS gn FROM psteps p JOIN wv USING (execution_id, step_id)),
g AS (SELECT execution_id, min(wave) FILTER (WHERE status = 'failed') AS w, bool_or(status = 'failed' AND gn >= 2) AS grouped FROM s GROUP BY execution_id)
SELECT execution_id, w AS first_failed_wave, CASE WHEN w IS NULL THEN 'passed' WHEN failure_strategy = 'rollback_all' THEN 'rolled_back' WHEN failure_strategy = 'rollback_group' AND grouped THEN 'rolled_back' ELSE 'failed' END AS outcome, failure_strategy <> 'continue' AND w IS NOT NULL AS halted FROM g JOIN pmodels USING (execution_id)""")
def x16(spark, sf):
    s = plan_steps(spark, sf)
    return G.failure_outcomes(s.join(G.waves(s).select("execution_id", "step_id", "wave"), ["execution_id", "step_id"]), plan_models(spark, sf))


@query("x17_plan_summary", f"""{_WAVES}, {_GROUPS}, {_APPROVAL} SELECT p.execution_id, count(*) AS n_steps, any_value(nw) AS n_waves, any_value(cyc) AS has_cycle, coalesce(any_value(ng), 0) AS n_groups, count(DISTINCT device) AS n_devices, any_value(requires_approval) AS requires_approval, CASE WHEN any_value(nw) > 0 THEN round(32.0 * any_value(nw), 3)::DOUBLE END AS estimated_s
FROM psteps p JOIN (SELECT execution_id, max(wave) AS nw, bool_or(wave = -1) AS cyc FROM wv GROUP BY execution_id) w USING (execution_id) LEFT JOIN (SELECT execution_id, count(*) AS ng FROM tg GROUP BY execution_id) t USING (execution_id) JOIN appr USING (execution_id) GROUP BY p.execution_id""")
def x17(spark, sf):
    s = plan_steps(spark, sf)
    return G.plan_summary(s, plan_models(spark, sf), G.waves(s))


# ---- execution logs: events are transitions ----
_STATUS = "CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'passed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' ELSE 'rolled_back' END"
_OUT = "CASE WHEN event_type = 'error' THEN '% Invalid command at ' || event_id WHEN event_id % 2 = 0 THEN 'BGP state = Established, loss ' || event_id % 100 || '%' END"
_LOG_COLS = f"event_id, ts, 'x' || user_id AS execution_id, CASE WHEN event_id % 6 = 5 THEN 'execution' ELSE 's' || event_id % 6 END AS entity, {_STATUS} AS to_status, {_OUT} AS actual_output, user_id"
LOG = f"log AS (SELECT {_LOG_COLS} FROM events)"


def log(spark, sf):
    ev = table(spark, sf, "events")
    return ev.selectExpr("event_id", "ts", "'x' || user_id AS execution_id", "CASE WHEN event_id % 6 = 5 THEN 'execution' ELSE 's' || event_id % 6 END AS entity", f"{_STATUS} AS to_status", f"{_OUT} AS actual_output", "user_id")


STATE = """sst AS (SELECT execution_id, entity AS step_id, arg_max(to_status, ts) AS status, count(*) FILTER (WHERE to_status = 'running') AS attempts, max(ts) FILTER (WHERE to_status = 'running') AS started_at,
  max(ts) FILTER (WHERE to_status IN ('passed', 'failed', 'skipped', 'rolled_back')) AS completed_at, arg_max(actual_output, ts) FILTER (WHERE actual_output IS NOT NULL) AS actual_output FROM log WHERE entity <> 'execution' GROUP BY execution_id, entity),
state AS (SELECT *, CASE WHEN (epoch_us(completed_at) // 1000) - (epoch_us(started_at) // 1000) >= 0 THEN (epoch_us(completed_at) // 1000) - (epoch_us(started_at) // 1000) END AS duration_ms FROM sst),
est AS (SELECT execution_id, arg_max(to_status, ts) AS status, min(ts) AS created_at, min(ts) FILTER (WHERE to_status = 'running') AS started_at, max(ts) FILTER (WHERE to_status IN ('passed', 'failed', 'rolled_back', 'aborted')) AS completed_at FROM log WHERE entity = 'execution' GROUP BY execution_id)"""


@query("e01_step_state", f"WITH {LOG}, {STATE} SELECT execution_id, step_id, status, attempts, (epoch_us(started_at) // 1000) AS started_ms, (epoch_us(completed_at) // 1000) AS completed_ms, duration_ms, actual_output FROM state")
def e01(spark, sf):
    d = L.step_state(log(spark, sf), ("actual_output",))
    return d.select("execution_id", "step_id", "status", "attempts", L.millis("started_at").alias("started_ms"), L.millis("completed_at").alias("completed_ms"), "duration_ms", "actual_output")


@query("e02_execution_state", f"WITH {LOG}, {STATE} SELECT execution_id, status, (epoch_us(created_at) // 1000) AS created_ms, (epoch_us(started_at) // 1000) AS started_ms, (epoch_us(completed_at) // 1000) AS completed_ms FROM est")
def e02(spark, sf):
    return L.execution_state(log(spark, sf)).select("execution_id", "status", L.millis("created_at").alias("created_ms"), L.millis("started_at").alias("started_ms"), L.millis("completed_at").alias("completed_ms"))


@query("e03_enriched", f"WITH {LOG} SELECT event_id, lag(to_status, 1, 'pending') OVER w AS from_status, count(*) FILTER (WHERE to_status = 'running') OVER w AS attempt, execution_id || ':' || entity || ':' || count(*) FILTER (WHERE to_status = 'running') OVER w AS correlation_id FROM log WINDOW w AS (PARTITION BY execution_id, entity ORDER BY ts)")
def e03(spark, sf):
    return L.enrich_transitions(log(spark, sf)).select("event_id", "from_status", "attempt", "correlation_id")


_CHECKED = f"chk AS (SELECT *, {_pick(('verify', 'execute', 'observe'), 'event_id % 3')} AS action_type, {_pick(('Established', 'Estab.*loss', 'loss 7(', 'no such text'), 'event_id % 4')} AS expected_output FROM log WHERE actual_output IS NOT NULL)"


def _checked(spark, sf):
    return log(spark, sf).where("actual_output is not null").selectExpr("*", f"{_pick(('verify', 'execute', 'observe'), 'event_id % 3')} AS action_type", f"{_pick(('Established', 'Estab.*loss', 'loss 7(', 'no such text'), 'event_id % 4')} AS expected_output", "actual_output AS output")


_FOUND = "CASE event_id % 4 WHEN 0 THEN contains(lower(actual_output), 'established') WHEN 1 THEN regexp_matches(actual_output, '(?is)Estab.*loss') WHEN 2 THEN contains(lower(actual_output), 'loss 7(') ELSE false END"
_SIGN = f"nullif(regexp_extract(actual_output, {sql_text(P.DEVICE_ERROR)}, 0), '')"


@query("e04_validation", f"WITH {LOG}, {_CHECKED} SELECT event_id, {_SIGN} AS error_sign, {_SIGN} IS NULL AND (action_type = 'execute' OR {_FOUND}) AS passed FROM chk")
def e04(spark, sf):
    return E.validate_outputs(_checked(spark, sf)).select("event_id", "error_sign", "passed")


@query("e05_expected_match", f"WITH {LOG}, {_CHECKED} SELECT event_id, {_FOUND} AS found FROM chk")
def e05(spark, sf):
    return _checked(spark, sf).select("event_id", E.match_expected("expected_output", "output").alias("found"))


_RULES = f"{LOG}, rules AS (SELECT execution_id, entity AS step_id, 'd' || event_id % 4 AS device, 'show r' || event_id AS cmd, event_id % 5 = 0 AS negate, event_id FROM log), outs AS (SELECT execution_id, 'd' || event_id % 4 AS device, 'show r' || event_id AS command, actual_output AS output FROM log WHERE actual_output IS NOT NULL)"
_OK = "output IS NOT NULL AND (contains(lower(output), 'established') <> negate)"


def _rule_checks(spark, sf):
    lg = log(spark, sf)
    rules = lg.selectExpr("execution_id", "entity AS step_id", "'d' || event_id % 4 AS device", "'show r' || event_id AS cmd", "'Established' AS expect_pattern", "event_id % 5 = 0 AS negate", "event_id")
    outs = lg.where("actual_output is not null").selectExpr("execution_id", "'d' || event_id % 4 AS device", "'show r' || event_id AS command", "actual_output AS output")
    return E.rule_checks(rules, outs)


@query("e06_rule_checks", f"WITH {_RULES} SELECT r.execution_id, step_id, count(*) AS n_rules, count(*) FILTER (WHERE NOT coalesce({_OK}, false)) AS n_failed, count(*) FILTER (WHERE NOT coalesce({_OK}, false)) = 0 AS passed FROM rules r LEFT JOIN outs o ON r.execution_id = o.execution_id AND r.device = o.device AND r.cmd = o.command GROUP BY r.execution_id, step_id")
def e06(spark, sf):
    return E.step_rule_verdicts(_rule_checks(spark, sf))


_SKIP = f"{_pick(('Established', 'Established~ no such line', '((('), 'event_id % 3')}".replace("~", "\\n")


@query("e07_idempotency", f"""WITH {LOG}, r AS (SELECT *, {_SKIP} AS pattern, list_filter(list_transform(string_split({_SKIP}, '\\n'), lambda x: trim(x)), lambda x: x <> '') AS lines FROM log),
n AS (SELECT *, len(list_filter(lines, lambda x: regexp_matches(actual_output, '(?i)' || x))) AS found FROM r WHERE actual_output IS NOT NULL AND pattern <> '((('),
v AS (SELECT execution_id, entity AS step_id, event_id AS rule_no, CASE WHEN regexp_matches(actual_output, '(?is)' || pattern) THEN 'skip' WHEN len(lines) > 1 AND found > 0 AND found < len(lines) THEN 'partial_state' END AS v FROM n),
f AS (SELECT execution_id, step_id, min(rule_no) AS rule_no, arg_min(v, rule_no) AS v FROM v WHERE v IS NOT NULL GROUP BY execution_id, step_id)
SELECT execution_id, step_id, coalesce(v, 'proceed') AS verdict, rule_no FROM (SELECT DISTINCT execution_id, entity AS step_id FROM log) LEFT JOIN f USING (execution_id, step_id)""")
def e07(spark, sf):
    pattern = _pick(("Established", "Established\\n no such line", "((("), "event_id % 3").replace("\\n", "\\\\n")
    d = log(spark, sf).selectExpr("execution_id", "entity AS step_id", "event_id AS rule_no", f"{pattern} AS skip_pattern", "actual_output AS output")
    return E.idempotency(d)


@query("e08_non_idempotent", f"WITH ps AS (SELECT l_orderkey, l_partkey, l_suppkey, {_pick(_RAWS, 'l_partkey % 9')} AS raw FROM lineitem) SELECT raw, regexp_matches(lower(raw), '^(undo |no |delete |reload|erase|shutdown|format )') AS non_idempotent, count(*) AS n FROM ps GROUP BY ALL")
def e08(spark, sf):
    d = table(spark, sf, "lineitem").selectExpr(f"{_pick(_RAWS, 'l_partkey % 9')} AS raw")
    return d.select("raw", C.is_non_idempotent(F.col("raw")).alias("non_idempotent")).groupBy("raw", "non_idempotent").agg(F.count("*").alias("n"))


_PLAN = "plan AS (SELECT DISTINCT 'x' || user_id AS execution_id, 's' || k AS step_id, k + 1 AS sequence, CASE WHEN k = 4 THEN NULL ELSE 'PE' || user_id % 7 END AS device FROM events, range(6) r(k))"
_REPORT = """rep AS (SELECT p.execution_id, p.step_id, sequence, coalesce(device, '(none)') AS device, coalesce(status, 'pending') AS status, substr(coalesce(actual_output, ''), 1, 300) AS output, (duration_ms + 5) // 10 / 100.0::DOUBLE AS duration_s, greatest(0, coalesce(attempts, 0) - 1) AS retries FROM plan p LEFT JOIN state s USING (execution_id, step_id))"""


def _report(spark, sf):
    users = table(spark, sf, "events").select("user_id").distinct()
    plan = users.select("user_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).selectExpr("'x' || user_id AS execution_id", "'s' || k AS step_id", "k + 1 AS sequence", "CASE WHEN k = 4 THEN NULL ELSE 'PE' || user_id % 7 END AS device")
    return L.step_report(plan, L.step_state(log(spark, sf), ("actual_output",)))


@query("e09_step_report", f"WITH {LOG}, {STATE}, {_PLAN}, {_REPORT} SELECT * FROM rep")
def e09(spark, sf):
    return _report(spark, sf)


@query("e10_device_summary", f"WITH {LOG}, {STATE}, {_PLAN}, {_REPORT} SELECT execution_id, device, count(*) FILTER (WHERE status <> 'pending') AS run, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'failed') AS failed, CASE WHEN count(duration_s) > 0 THEN ((20 * sum(round(duration_s * 100)::BIGINT) + count(duration_s)) // (2 * count(duration_s)))::DOUBLE / 1000 END AS mean_s FROM rep GROUP BY execution_id, device")
def e10(spark, sf):
    return L.device_summary(_report(spark, sf))


@query("e11_execution_report", f"WITH {LOG}, {STATE}, {_PLAN}, {_REPORT}, g AS (SELECT execution_id, count(*) AS total, count(*) FILTER (WHERE status = 'passed') AS passed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status = 'pending') AS pending FROM rep GROUP BY execution_id) SELECT g.*, coalesce(est.status, 'pending') AS overall, CASE WHEN completed_at >= started_at THEN ((epoch_us(completed_at) // 1000) - (epoch_us(started_at) // 1000) + 5) // 10 / 100.0::DOUBLE ELSE -(((epoch_us(started_at) // 1000) - (epoch_us(completed_at) // 1000) + 5) // 10) / 100.0::DOUBLE END AS duration_s FROM g LEFT JOIN est USING (execution_id)")
def e11(spark, sf):
    return L.execution_report(_report(spark, sf), L.execution_state(log(spark, sf)))


@query("e12_timeline", f"WITH {LOG} SELECT execution_id, row_number() OVER (PARTITION BY execution_id ORDER BY ts, entity) AS event_no, CASE WHEN entity <> 'execution' THEN entity END AS step_id, entity || ' → ' || to_status AS label FROM log")
def e12(spark, sf):
    return L.timeline(log(spark, sf)).drop("ts")


@query("e13_latest_executions", f"WITH {LOG}, {STATE}, l AS (SELECT execution_id, max(ts) AS t FROM log GROUP BY execution_id ORDER BY t DESC LIMIT 20) SELECT execution_id, (epoch_us(any_value(t)) // 1000) AS last_ms, count(step_id) AS steps_total, count(*) FILTER (WHERE status = 'passed') AS steps_passed FROM l LEFT JOIN state USING (execution_id) GROUP BY execution_id")
def e13(spark, sf):
    return L.latest_executions(log(spark, sf)).select("execution_id", L.millis("last_ts").alias("last_ms"), "steps_total", "steps_passed")


@query("e14_metrics", f"WITH {LOG}, {STATE}, l AS (SELECT execution_id, arg_max(to_status, ts) AS status, max(ts) AS t FROM log WHERE entity = 'execution' GROUP BY execution_id ORDER BY t DESC LIMIT 500) SELECT status, count(*) AS n, printf('executions_total{{status=\"%s\"}} %d', status, count(*)) AS line FROM l GROUP BY status")
def e14(spark, sf):
    return L.status_metrics(log(spark, sf))


_DEC = "dec AS (SELECT 'x' || user_id AS execution_id, CASE event_type WHEN 'error' THEN 'RETRY' WHEN 'purchase' THEN 'ROLLBACK' ELSE 'CONTINUE' END AS decision, event_id % 9 / 8.0::DOUBLE AS confidence, event_id FROM events)"


def _decisions(spark, sf):
    return table(spark, sf, "events").selectExpr("'x' || user_id AS execution_id", "CASE event_type WHEN 'error' THEN 'RETRY' WHEN 'purchase' THEN 'ROLLBACK' ELSE 'CONTINUE' END AS decision", "cast(event_id % 9 AS double) / 8 AS confidence", "event_id")


@query("e15_decisions", f"WITH {_DEC} SELECT execution_id, decision, count(*) AS n, round(avg(confidence)::DECIMAL(30, 12), 4)::DOUBLE AS mean_confidence FROM dec GROUP BY ALL")
def e15(spark, sf):
    return L.decision_summary(_decisions(spark, sf))


_WIN = ("2024-01-05T00:00:00Z", "2024-01-10T12:00:00+00:00", "not a time", "2024-01-20T06:30:00Z")


@query("e16_windows", "WITH w AS (SELECT event_id, ts, event_id % 4 AS k FROM events) SELECT event_id, CASE WHEN k IN (2, 3) THEN 'allowed' WHEN ts < (CASE k WHEN 0 THEN TIMESTAMP '2024-01-05 00:00:00' ELSE TIMESTAMP '2024-01-10 12:00:00' END) THEN 'before' WHEN ts > (CASE k WHEN 0 THEN TIMESTAMP '2024-01-10 12:00:00' ELSE TIMESTAMP '2024-01-20 06:30:00' END) THEN 'after' ELSE 'in' END AS position FROM w")
def e16(spark, sf):
    ends = ("2024-01-10T12:00:00+00:00", "2024-01-20T06:30:00Z", "2024-01-20T06:30:00Z", "2024-01-01T00:00:00Z")
    d = table(spark, sf, "events").selectExpr("event_id", "ts", f"{_pick(_WIN, 'event_id % 4')} AS a", f"{_pick(ends, 'event_id % 4')} AS b")
    return d.select("event_id", L.window_position(F.col("ts"), L.iso_timestamp(F.col("a")), L.iso_timestamp(F.col("b"))).alias("position"))


@query("e17_expired", f"WITH {LOG}, l AS (SELECT execution_id, max(ts) AS t FROM log GROUP BY execution_id) SELECT execution_id, count(*) AS n FROM log JOIN l USING (execution_id) WHERE t < TIMESTAMP '2024-02-06 12:00:00' - INTERVAL 168 HOURS GROUP BY execution_id")
def e17(spark, sf):
    _, old = L.split_expired(log(spark, sf), F.lit("2024-02-06 12:00:00").cast("timestamp_ntz").cast("timestamp"))
    return old.groupBy("execution_id").agg(F.count("*").alias("n"))


_EVENTS = "ev AS (SELECT execution_id, ts, event_id, CASE to_status WHEN 'running' THEN 'execution_started' WHEN 'passed' THEN 'execution_passed' WHEN 'failed' THEN 'execution_failed' WHEN 'skipped' THEN 'approval_required' ELSE 'kill_switch_engaged' END AS event, 'note ' || event_id AS message FROM log WHERE entity = 'execution')"
_CH = ", ".join(f"('{e}', '{c}')" for e, c in L.CHANNEL_RULES)
_NOTES = f"rl(event, channel) AS (VALUES {_CH}), notes AS (SELECT execution_id, ts, event_id, event, channel, substr(event || ': ' || execution_id || ': ' || message, 1, 200) AS text, CASE WHEN channel = 'pagerduty' THEN CASE WHEN event = 'kill_switch_engaged' THEN 'critical' ELSE 'error' END END AS severity, CASE WHEN channel = 'pagerduty' THEN CASE WHEN event = 'execution_passed' THEN 'resolve' ELSE 'trigger' END END AS action, CASE WHEN channel = 'pagerduty' THEN 'run-' || execution_id END AS dedup_key FROM ev JOIN rl USING (event))"


def _notes(spark, sf):
    ev = log(spark, sf).where("entity = 'execution'").selectExpr("execution_id", "ts", "event_id", "CASE to_status WHEN 'running' THEN 'execution_started' WHEN 'passed' THEN 'execution_passed' WHEN 'failed' THEN 'execution_failed' WHEN 'skipped' THEN 'approval_required' ELSE 'kill_switch_engaged' END AS event", "'note ' || event_id AS message")
    return L.notifications(ev, spark.createDataFrame(L.CHANNEL_RULES, "event string, channel string"))


@query("e18_notifications", f"WITH {LOG}, {_EVENTS}, {_NOTES} SELECT execution_id, event, channel, text, severity, action, dedup_key FROM notes")
def e18(spark, sf):
    return _notes(spark, sf).drop("ts")


@query("e19_open_incidents", f"WITH {LOG}, {_EVENTS}, {_NOTES}, o AS (SELECT dedup_key, arg_max(action, ts) AS a, max(ts) AS t FROM notes WHERE action IS NOT NULL GROUP BY dedup_key) SELECT dedup_key, (epoch_us(t) // 1000) AS ms FROM o WHERE a = 'trigger'")
def e19(spark, sf):
    return L.open_incidents(_notes(spark, sf)).select("dedup_key", L.millis("ts").alias("ms"))


@query("e20_ticket_comments", f"WITH {LOG}, {STATE}, {_PLAN}, {_REPORT}, g AS (SELECT execution_id, count(*) AS total, count(*) FILTER (WHERE status = 'passed') AS passed, array_to_string((list(step_id ORDER BY step_id) FILTER (WHERE status = 'failed'))[1:10], ', ') AS ids FROM rep GROUP BY execution_id) SELECT execution_id, status, 'Execution ' || status || ': ' || passed || '/' || total || ' steps passed' || CASE WHEN coalesce(ids, '') <> '' THEN '; failed: ' || ids ELSE '' END AS comment FROM est JOIN g USING (execution_id) WHERE status IN ('passed', 'failed')")
def e20(spark, sf):
    return L.ticket_comments(_report(spark, sf), L.execution_state(log(spark, sf)))


@query("e21_newest_jobs", "SELECT o_orderkey AS job_id, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def e21(spark, sf):
    d = table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))
    return L.newest_jobs(d).select("job_id", "status")


@query("e21_last_log_lines", "SELECT user_id AS job_id, event_id AS line_no FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")
def e21b(spark, sf):
    d = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), "ts", F.col("event_id").alias("line_no"))
    return L.last_log_lines(d, 50).select("job_id", "line_no")


@query("e22_killable", f"WITH {LOG}, {STATE} SELECT execution_id FROM est WHERE status = 'running'")
def e22(spark, sf):
    return L.killable(L.execution_state(log(spark, sf)))


# ---- the batch forms of the streams ----
@query("y01_live_state", f"WITH {LOG}, {STATE} SELECT execution_id, step_id, status, attempts FROM state")
def y01(spark, sf):
    from procflow.streaming import streams

    return streams.live_step_state(log(spark, sf)).select("execution_id", "step_id", "status", "attempts")


@query("y02_minute_counts", f"WITH {LOG} SELECT (epoch_us(date_trunc('minute', ts)) // 1000) AS minute_ms, to_status, count(*) AS n FROM log GROUP BY ALL")
def y02(spark, sf):
    from procflow.streaming import streams

    return streams.minute_counts(log(spark, sf)).select(L.millis("minute").alias("minute_ms"), "to_status", "n")


_WAITS = "rq AS (SELECT user_id AS wait_id, min(ts) AS start, 600 * (1 + user_id % 20) AS max_wait_s FROM events GROUP BY user_id), po AS (SELECT user_id AS wait_id, ts, event_type = 'purchase' AS matched FROM events)"


@query("y03_wait_outcomes", f"WITH {_WAITS}, j AS (SELECT rq.*, ts, matched FROM rq JOIN po USING (wait_id) WHERE ts <= start + to_seconds(max_wait_s)), m AS (SELECT wait_id, min(ts) FILTER (WHERE matched) AS met_at FROM j GROUP BY wait_id) SELECT wait_id, any_value(met_at) IS NOT NULL AS met, count(*) FILTER (WHERE met_at IS NULL OR ts <= met_at)::INT AS attempts, round(CASE WHEN any_value(met_at) IS NULL THEN any_value(max_wait_s) ELSE ((epoch_us(any_value(met_at)) // 1000) - (epoch_us(any_value(start)) // 1000)) / 1000 END, 3) AS elapsed_s FROM j JOIN m USING (wait_id) GROUP BY wait_id")
def y03(spark, sf):
    ev = table(spark, sf, "events")
    rq = ev.groupBy(F.col("user_id").alias("wait_id")).agg(F.min("ts").alias("start")).withColumn("max_wait_s", 600 * (1 + F.col("wait_id") % 20))
    return L.wait_outcomes(rq, ev.select(F.col("user_id").alias("wait_id"), "ts", (F.col("event_type") == "purchase").alias("matched")))


@query("y04_approvals", "WITH rq AS (SELECT event_id AS request_id, user_id, ts FROM events WHERE event_type = 'signup'), an AS (SELECT r.request_id, e.ts AS answered_at, CASE e.event_type WHEN 'error' THEN 'denied' ELSE 'approved' END AS answer FROM rq r JOIN events e ON e.user_id = r.user_id AND e.event_type IN ('error', 'click') AND e.ts >= r.ts AND e.ts <= r.ts + INTERVAL 3600 SECONDS), f AS (SELECT request_id, arg_min(answer, answered_at) AS a FROM an GROUP BY request_id) SELECT request_id, CASE a WHEN 'denied' THEN 'rejected' WHEN 'approved' THEN 'approved' ELSE 'timed_out' END AS outcome FROM rq LEFT JOIN f USING (request_id)")
def y04(spark, sf):
    ev = table(spark, sf, "events")
    rq = ev.where("event_type = 'signup'").select(F.col("event_id").alias("request_id"), "user_id", "ts")
    e = ev.where("event_type in ('error', 'click')").select(F.col("user_id").alias("u"), F.col("ts").alias("answered_at"), F.when(F.col("event_type") == "error", "denied").otherwise("approved").alias("answer"))
    hour = F.expr("INTERVAL 3600 SECONDS")
    answers = rq.join(e, (F.col("user_id") == F.col("u")) & (F.col("answered_at") >= F.col("ts")) & (F.col("answered_at") <= F.col("ts") + hour)).select("request_id", "answered_at", "answer")
    return L.approval_outcomes(rq.select("request_id", "ts"), answers)


@query("y06_escalations", f"WITH {_DEC} SELECT event_id, execution_id, decision FROM dec WHERE confidence < 0.6")
def y06(spark, sf):
    from procflow.streaming import streams

    return streams.escalations(_decisions(spark, sf)).select("event_id", "execution_id", "decision")


# ---- diffs: outputs of one supplier's lines before and after ----
_BASE = "'2024-01-0' || (1 + event_id % 3) || 'T10:00:00 up' || {nl} || 'neighbor ' || user_id || ' ' || event_type || {nl} || 'line ' || event_id % 7 || {nl} || '  ' || event_id || ' packets sent'"
_CURR = "'2024-02-0' || (1 + event_id % 5) || 'T11:22:33 up' || {nl} || 'neighbor ' || user_id || ' ' || CASE WHEN event_id % 4 = 0 THEN 'down' ELSE event_type END || {nl} || 'line ' || event_id % 7 || {nl} || '  7 packets sent' || CASE WHEN event_id % 6 = 0 THEN {nl} || 'extra' ELSE '' END"


def _pairs(spark, sf):
    b, c = (x.replace("{nl}", "char(10)") for x in (_BASE, _CURR))
    return table(spark, sf, "events").selectExpr("event_id AS key", "event_type", f"{b} AS baseline", f"{c} AS current")


def _sql_normal(x: str) -> str:
    x = f"regexp_replace(({x.replace('{nl}', 'chr(10)')}), {sql_text(D.TIMESTAMP)}, '<TS>', 'g')"
    return sql_strip(f"regexp_replace({x}, {sql_text(D.COUNTER)}, '<COUNTER>', 'g')")


@query("d01_normalized", f"SELECT event_id AS key, {_sql_normal(_BASE)} AS normal FROM events")
def d01(spark, sf):
    return _pairs(spark, sf).select("key", D.normalize_output(F.col("baseline")).alias("normal"))


_SIDE = "(SELECT key, line, count(*) AS n FROM (SELECT key, unnest(string_split({c}, chr(10))) AS line FROM pairs) WHERE trim(line) <> '' GROUP BY key, line)"
_CHG = f"""pairs AS (SELECT event_id AS key, event_type, {_sql_normal(_BASE)} AS b, {_sql_normal(_CURR)} AS c FROM events), lb AS {_SIDE.format(c="b")}, lc AS {_SIDE.format(c="c")},
by_line AS (SELECT key, greatest(0, coalesce(lc.n, 0) - coalesce(lb.n, 0)) AS more, greatest(0, coalesce(lb.n, 0) - coalesce(lc.n, 0)) AS fewer FROM lb FULL JOIN lc USING (key, line)),
chg AS (SELECT key, any_value(event_type) AS event_type, any_value(b <> c) AS changed, sum(more)::INT AS n_added, sum(fewer)::INT AS n_removed FROM pairs JOIN by_line USING (key) GROUP BY key)"""


@query("d02_text_diff", f"WITH {_CHG} SELECT key, changed, n_added, n_removed FROM chg")
def d02(spark, sf):
    return D.text_diff(_pairs(spark, sf)).select("key", "changed", F.size("added").alias("n_added"), F.size("removed").alias("n_removed"))


@query("d03_line_changes", f"WITH {_CHG} SELECT key, n_added::BIGINT AS n_added, n_removed::BIGINT AS n_removed FROM chg")
def d03(spark, sf):
    return D.line_changes(_pairs(spark, sf))


_NEW = "concat_ws('; ', CASE WHEN event_id % 4 = 0 THEN 'neighbor ' || user_id || ' down' END, CASE WHEN event_id % 6 = 0 THEN 'extra' END)"
_OLD = "CASE WHEN event_id % 4 = 0 THEN 'neighbor ' || user_id || ' ' || event_type ELSE '' END"


@query("d05_comparison_details", f"SELECT event_type, event_id AS key, {_NEW} AS added, {_OLD} AS removed FROM events WHERE event_id % 4 = 0 OR event_id % 6 = 0")
def d05_details(spark, sf):
    """The first five lines of each changed check."""
    p = _pairs(spark, sf)
    return D.comparison_details(D.text_diff(p).join(p.select("key", "event_type"), "key"), "event_type")


@query("d02_diff_summaries", f"SELECT event_id AS key, 'Added (' || ((event_id % 4 = 0)::INT + (event_id % 6 = 0)::INT) || ' lines): ' || coalesce(nullif(replace({_NEW}, '; ', ', '), ''), '(none)') || ' | Removed (' || (event_id % 4 = 0)::INT || ' lines): ' || coalesce(nullif({_OLD}, ''), '(none)') AS summary FROM events")
def d02_summaries(spark, sf):
    return D.text_diff(_pairs(spark, sf)).select("key", D.diff_summary(F.col("added"), F.col("removed")).alias("summary"))


# two versions of a procedure: the lines of an order, the later one with changes by their keys
_V = "SELECT l_orderkey AS doc_id, {seq} AS sequence, l_partkey AS position, 'step ' || {desc} AS description, 'cmd ' || {cmd} AS command, CASE WHEN l_suppkey % 3 = 0 THEN 'up' END AS expected_output, {sec} AS section FROM lineitem"
_V1 = _V.format(seq="l_linenumber", desc="l_partkey", cmd="l_partkey", sec="'A'")
_V2 = _V.format(seq="CASE WHEN l_partkey % 9 = 0 THEN l_linenumber + 20 ELSE l_linenumber END", desc="CASE WHEN l_partkey % 5 = 0 THEN l_suppkey ELSE l_partkey END", cmd="CASE WHEN l_partkey % 7 = 0 THEN l_suppkey ELSE l_partkey END", sec="CASE WHEN l_partkey % 11 = 0 THEN 'B' ELSE 'A' END")
_LAST = "SELECT * FROM ({}) QUALIFY row_number() OVER (PARTITION BY doc_id, sequence ORDER BY position DESC, command DESC, description DESC, section DESC, expected_output DESC NULLS LAST) = 1"
_STEPDIFF = f"""b AS ({_LAST.format(_V1)}), a AS ({_LAST.format(_V2)}), sd AS (SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, coalesce(b.sequence, a.sequence) AS sequence, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed'
  WHEN concat_ws('; ', CASE WHEN b.description <> a.description THEN 'description changed' END, CASE WHEN b.command <> a.command THEN 'commands added: ' || a.command || '; commands removed: ' || b.command END, CASE WHEN b.expected_output IS DISTINCT FROM a.expected_output THEN 'expected_output changed' END, CASE WHEN b.section <> a.section THEN 'section moved: ' || b.section || ' → ' || a.section END) <> '' THEN 'changed' END AS change,
  concat_ws('; ', CASE WHEN b.description <> a.description THEN 'description changed' END, CASE WHEN b.command <> a.command THEN 'commands added: ' || a.command || '; commands removed: ' || b.command END, CASE WHEN b.expected_output IS DISTINCT FROM a.expected_output THEN 'expected_output changed' END, CASE WHEN b.section <> a.section THEN 'section moved: ' || b.section || ' → ' || a.section END) AS details
  FROM b FULL OUTER JOIN a ON b.doc_id = a.doc_id AND b.sequence = a.sequence)"""


def _step_diff(spark, sf):
    # equal places cannot be told apart by place alone: one more order for a result that does not vary
    place = F.struct("position", "command", "description", "section", F.coalesce("expected_output", F.lit("")))
    li = table(spark, sf, "lineitem")
    v = lambda q: spark.sql(q.replace("FROM lineitem", "FROM {lineitem}"), lineitem=li).withColumn("position", place).withColumn("commands", F.array("command")).drop("command")
    return D.step_diff(v(_V1), v(_V2))


@query("d04_step_diff", f"WITH {_STEPDIFF} SELECT doc_id, sequence, change, CASE WHEN change = 'changed' THEN details END AS details FROM sd WHERE change IS NOT NULL")
def d04(spark, sf):
    return _step_diff(spark, sf)


@query("d05_comparison_report", f"WITH {_CHG} SELECT event_type, count(*) AS total, count(*) FILTER (WHERE changed) AS changed, count(*) FILTER (WHERE NOT changed) AS identical FROM chg GROUP BY event_type")
def d05(spark, sf):
    p = _pairs(spark, sf)
    return D.comparison_report(D.text_diff(p).join(p.select("key", "event_type"), "key"), "event_type")


@query("d06_summaries", f"WITH {_STEPDIFF} SELECT doc_id, '+' || count(*) FILTER (WHERE change = 'added') || '/-' || count(*) FILTER (WHERE change = 'removed') || '/~' || count(*) FILTER (WHERE change = 'changed') AS summary FROM sd WHERE change IS NOT NULL GROUP BY doc_id")
def d06(spark, sf):
    return D.step_diff_summary(_step_diff(spark, sf))


# ---- fleets: suppliers are devices ----
_VEN = ("cisco", "juniper", "nokia", "arista", "huawei")
_OSES = ("ios-xr", "junos", "sros", "eos", "vrp")
_ROLES = ("pe-router", "p-router", "route-reflector")
_DEV = f"dev AS (SELECT 'R' || s_suppkey AS device, {_pick(_VEN, 's_nationkey % 5')} AS vendor, {_pick(_OSES, 's_nationkey % 5')} AS os, 'm' || s_suppkey % 3 AS model_key, {_pick(_ROLES, 's_suppkey % 3')} AS role, '10.0.' || s_suppkey // 250 || '.' || s_suppkey % 250 AS host, s_suppkey FROM supplier)"


def _instances(spark, sf):
    d = table(spark, sf, "supplier")
    return d.selectExpr("'R' || s_suppkey AS device", f"{_pick(_VEN, 's_nationkey % 5')} AS vendor", f"{_pick(_OSES, 's_nationkey % 5')} AS os", "'m' || s_suppkey % 3 AS model_key", "'7.' || s_suppkey % 9 AS version", f"{_pick(_ROLES, 's_suppkey % 3')} AS role", "'10.0.' || s_suppkey div 250 || '.' || s_suppkey % 250 AS host", "CASE WHEN s_suppkey % 4 = 0 THEN 830 END AS port", "CASE WHEN s_suppkey % 2 = 0 THEN array('isis', 'bgp') END AS protocols", "cast(NULL AS array<string>) AS features")


def _dims(spark):
    os_d = [(v, o, ["bgp"] if k % 2 else ["bgp", "ospf"], ["ssh"], 22 if k else 2222) for k, (v, o) in enumerate(zip(_VEN, _OSES))]
    mod = [(v, o, "m1", f"{v}-big", ["mpls"], ["netconf"]) for v, o in zip(_VEN, _OSES)]
    return spark.createDataFrame(os_d, "vendor string, os string, protocols array<string>, features array<string>, port int"), spark.createDataFrame(mod, "vendor string, os string, model_key string, model string, protocols array<string>, features array<string>")


def devices(spark, sf):
    o, m = _dims(spark)
    return Z.resolve_devices(_instances(spark, sf), o, m)


_RES = "res AS (SELECT *, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN vendor IN ('cisco', 'nokia', 'huawei') THEN ['bgp', 'ospf'] ELSE ['bgp'] END, CASE WHEN model_key = 'm1' THEN ['mpls'] ELSE [] END, CASE WHEN s_suppkey % 2 = 0 THEN ['isis', 'bgp'] ELSE [] END))), ',') AS protocols, CASE WHEN model_key = 'm1' THEN vendor || '-big' END AS model, CASE WHEN s_suppkey % 4 = 0 THEN 830 WHEN vendor = 'cisco' THEN 2222 ELSE 22 END AS port FROM dev)"


@query("z01_resolved_devices", f"WITH {_DEV}, {_RES} SELECT device, vendor, os, model, port, protocols FROM res")
def z01(spark, sf):
    return devices(spark, sf).select("device", "vendor", "os", "model", "port", F.array_join("protocols", ",").alias("protocols"))


@query("z02_selected_devices", f"WITH {_DEV}, {_RES} SELECT device FROM res WHERE vendor = 'cisco' AND role = 'pe-router' AND contains(protocols, 'ospf')")
def z02(spark, sf):
    return Z.select_devices(devices(spark, sf), vendor="cisco", role="pe-router", protocol="ospf").select("device")


_CATALOG = (
    ("bgp", "smoke", "bgp_neighbors_up", "All configured BGP neighbors are in Established state", "critical", None), ("bgp", "smoke", "bgp_prefix_nonzero", "BGP routing table has at least one prefix", "high", None), ("ospf", "smoke", "ospf_up", "OSPF adjacencies are full on every interface", "critical", None),
    ("isis", "smoke", "isis_up", "All IS-IS adjacencies are up", "critical", None), ("mpls", "smoke", "ldp_up", "LDP sessions are operational", "high", None), ("mpls", "gating", "cpu_low", "CPU stays low", "medium", 80.0),
)


def _catalog(spark):
    return spark.createDataFrame(_CATALOG, "protocol string, test_type string, test_id string, intent string, severity string, threshold_pct double")


_CAT = "cat(protocol, test_type, test_id, intent, severity) AS (VALUES " + ", ".join("(" + ", ".join(sql_text(x) for x in r[:5]) + ")" for r in _CATALOG) + ")"
_TPLAN = f"{_DEV}, {_RES}, {_CAT}, tp AS (SELECT device, vendor, os, p.protocol, test_id, intent, severity FROM (SELECT *, unnest(string_split(protocols, ',')) AS protocol FROM res) p JOIN cat c ON c.protocol = p.protocol WHERE test_type = 'smoke')"


@query("z03_test_plan", f"WITH {_TPLAN} SELECT device, protocol, test_id FROM tp")
def z03(spark, sf):
    return Z.test_plan(devices(spark, sf), _catalog(spark), "smoke").select("device", "protocol", "test_id")


def _translated(spark, sf):
    cache = spark.createDataFrame([("cisco", "ios-xr", "bgp_neighbors_up", "show bgp all", "Estab", "Idle")], "vendor string, os string, intent_id string, command string, success_pattern string, error_pattern string")
    return Z.translate(Z.test_plan(devices(spark, sf), _catalog(spark), "smoke"), cache), cache


_BYV = lambda words: next(x for x in Z.INTENTS if x[0] == words)
_CMD = "CASE WHEN vendor = 'cisco' AND test_id = 'bgp_neighbors_up' THEN 'show bgp all' " + " ".join(
    f"WHEN test_id = '{t}' THEN CASE vendor " + " ".join(f"WHEN '{v}' THEN {sql_text(c)}" for v, c in _BYV(w)[1].items()) + f" ELSE {sql_text(_BYV(w)[2])} END" for t, w in (("bgp_neighbors_up", ("bgp", "neighbor")), ("isis_up", ("isis|is-is",)), ("ldp_up", ("ldp|mpls",)), ("ospf_up", ("interface",)))
) + " ELSE 'show version' END"


@query("z04_translated", f"WITH {_TPLAN} SELECT device, test_id, vendor = 'cisco' AND test_id = 'bgp_neighbors_up' AS from_cache, {_CMD} AS command FROM tp")
def z04(spark, sf):
    return _translated(spark, sf)[0].select("device", "test_id", "from_cache", "command")


@query("z04_new_cache_entries", f"WITH {_TPLAN} SELECT DISTINCT vendor, os, test_id AS intent_id FROM tp WHERE NOT (vendor = 'cisco' AND test_id = 'bgp_neighbors_up')")
def z04b(spark, sf):
    t, cache = _translated(spark, sf)
    return Z.new_cache_entries(t, cache).select("vendor", "os", "intent_id")


# captured outputs: events stand for test runs
_TXT = f"{_pick(('peer Established', 'peer Idle now', 'cpu at {n}% of limit', 'nothing to see'), 'event_id % 4')}"
_TSQL = "CASE event_id % 4 WHEN 2 THEN 'cpu at ' || event_id % 100 || '% of limit' ELSE " + _TXT + " END"
_GOOD, _BAD = "Established|cpu", "Idle|Active"
_PCT = f"TRY_CAST(nullif(regexp_extract(({_TSQL}), '\\b(\\d+(?:\\.\\d+)?)\\s*%', 1), '') AS DOUBLE)"
_STAT = f"CASE WHEN regexp_matches(({_TSQL}), '(?i){_BAD}') OR NOT regexp_matches(({_TSQL}), '(?i){_GOOD}') THEN 'FAIL' WHEN event_id % 4 = 2 AND {_PCT} > 80 THEN 'FAIL' ELSE 'PASS' END"
_TESTS = f"tests AS (SELECT event_id, 'su' || user_id % 10 AS suite_id, 'R' || user_id AS device, CASE WHEN event_id % 3 = 0 THEN 'bgp' ELSE 'isis' END AS protocol, CASE WHEN event_id % 5 = 0 THEN 'critical' ELSE 'low' END AS severity, {_STAT} AS status, {_TSQL} AS output, user_id % 13 <> 0 AS reachable FROM events)"


def _tests(spark, sf):
    d = table(spark, sf, "events").selectExpr("event_id", "'su' || user_id % 10 AS suite_id", "'R' || user_id AS device", "CASE WHEN event_id % 3 = 0 THEN 'bgp' ELSE 'isis' END AS protocol", "CASE WHEN event_id % 5 = 0 THEN 'critical' ELSE 'low' END AS severity", "user_id % 13 <> 0 AS reachable", f"{_TSQL} AS output", f"'{_GOOD}' AS success_pattern", f"'{_BAD}' AS error_pattern", "CASE WHEN event_id % 4 = 2 THEN cast(80 AS double) END AS threshold_pct", "'t' || event_id % 50 AS test_id")
    return E.evaluate_tests(d)


@query("z05_test_status", f"WITH {_TESTS} SELECT event_id, status FROM tests")
def z05(spark, sf):
    return _tests(spark, sf).select("event_id", "status")


@query("z06_failure_reasons", f"WITH {_TESTS} SELECT event_id, CASE WHEN status = 'FAIL' THEN coalesce(substr(trim(list_filter(string_split(output, chr(10)), lambda x: regexp_matches(x, '(?i){_BAD}'))[1]), 1, 120), 'Expected success pattern not found') END AS failure_reason FROM tests")
def z06(spark, sf):
    return _tests(spark, sf).select("event_id", "failure_reason")


_DREP = "drep AS (SELECT suite_id, device, protocol, count(*) FILTER (WHERE status = 'PASS') AS passed, count(*) FILTER (WHERE status = 'FAIL') AS failed, count(*) FILTER (WHERE status = 'FAIL' AND severity = 'critical') AS critical_failures, bool_and(reachable) AS reachable FROM tests GROUP BY suite_id, device, protocol), dr AS (SELECT *, CASE WHEN NOT reachable THEN 'UNREACHABLE' WHEN critical_failures > 0 THEN 'FAIL' WHEN failed > 0 THEN 'WARN' ELSE 'PASS' END AS overall FROM drep)"


@query("z07_device_reports", f"WITH {_TESTS}, {_DREP} SELECT * FROM dr")
def z07(spark, sf):
    return Z.device_reports(_tests(spark, sf))


@query("z08_suite_status", f"WITH {_TESTS}, {_DREP} SELECT suite_id, count(*) AS n_reports, CASE WHEN bool_or(overall = 'FAIL') THEN 'FAIL' WHEN bool_or(overall IN ('WARN', 'UNREACHABLE')) THEN 'WARN' ELSE 'PASS' END AS overall FROM dr GROUP BY suite_id")
def z08(spark, sf):
    return Z.suite_status(Z.device_reports(_tests(spark, sf)))


# two runs: the first and the last result of each device and test
_RUNS = f"{_TESTS}, tk AS (SELECT device, protocol, 't' || event_id % 50 AS test_id, arg_min(status, event_id) AS b, arg_max(status, event_id) AS a, count(*) AS n FROM tests GROUP BY ALL), cmp AS (SELECT device, protocol, test_id, b AS before, CASE WHEN n > 1 THEN a END AS after FROM tk)"
_CHANGE = "CASE WHEN after IS NULL THEN 'missing' WHEN before = 'PASS' AND after IN ('FAIL', 'ERROR') THEN 'regression' WHEN before IN ('FAIL', 'ERROR') AND after = 'PASS' THEN 'fixed' WHEN before = after THEN 'same' ELSE 'changed' END"


def _compared(spark, sf):
    g = _tests(spark, sf).groupBy("device", "protocol", "test_id").agg(F.min_by("status", "event_id").alias("b"), F.max_by("status", "event_id").alias("a"), F.count("*").alias("n"))
    return D.compare_runs(g.withColumn("status", F.col("b")), g.where("n > 1").withColumn("status", F.col("a")))


@query("z09_run_comparison", f"WITH {_RUNS} SELECT device, protocol, test_id, before, after, {_CHANGE} AS change FROM cmp")
def z09(spark, sf):
    return _compared(spark, sf)


@query("z09_run_verdicts", f"WITH {_RUNS} SELECT device, count(*) FILTER (WHERE {_CHANGE} = 'regression') AS regressions, count(*) FILTER (WHERE {_CHANGE} = 'fixed') AS fixed, CASE WHEN count(*) FILTER (WHERE {_CHANGE} = 'regression') > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM cmp GROUP BY device")
def z09b(spark, sf):
    return D.run_verdict(_compared(spark, sf))


_VTEXT = ("Cisco IOS XR Software, Version {v}", "JUNOS {v}", "TiMOS-C-{v} both/x86 Nokia 7750 SR", "Arista vEOS-lab, EOS version: {v}", "Huawei VRP software V{v}", "something else")
_VT = "CASE s_suppkey % 6 " + " ".join(f"WHEN {i} THEN {sql_text(t.split('{v}')[0])}" + (f" || '7.' || s_suppkey % 9 || {sql_text(t.split('{v}')[1])}" if "{v}" in t else "") for i, t in enumerate(_VTEXT)) + " END"


def _sql_version(field: int) -> str:
    """One detail of a platform (3: version, 4: model, 5: host) by the first sign that the output has."""
    get = lambda p: f"coalesce(nullif(trim(regexp_extract(output, {sql_text('(?i)' + p[0])}, 1)), ''), {sql_text(p[1])})"
    rows = [f"WHEN regexp_matches(output, {sql_text('(?i)' + r[0])}) THEN {get(r[field]) if field > 2 else sql_text(r[field])}" for r in Z.VERSION_RULES]
    return "CASE " + " ".join(rows) + " ELSE 'unknown' END"


@query("z10_versions", f"WITH o AS (SELECT s_suppkey AS host, {_VT} AS output FROM supplier) SELECT host, {_sql_version(1)} AS vendor, {_sql_version(2)} AS os, {_sql_version(3)} AS version, {_sql_version(4)} AS model, {_sql_version(5)} AS hostname FROM o")
def z10(spark, sf):
    d = table(spark, sf, "supplier").selectExpr("s_suppkey AS host", f"{_VT} AS output").withColumn("v", Z.detect_version(F.col("output")))
    return d.select("host", "v.vendor", "v.os", "v.version", "v.model", "v.hostname")


_LLDP = "CASE WHEN s_suppkey % 2 = 0 THEN 'Management Addresses: 10.1.0.' || s_suppkey % 250 || {nl} || 'Management Addresses -  10.1.0.' || s_suppkey % 250 || {nl} || 'Chassis 10.9.9.9' ELSE 'neighbor 10.2.0.' || s_suppkey % 250 || ' via 10.2.1.' || s_suppkey % 250 END"


_IP = r"(\d{1,3}(?:\.\d{1,3}){3})"


@query("z11_neighbours", f"""WITH o AS (SELECT s_suppkey AS host, {_LLDP.replace('{nl}', 'chr(10)')} AS output FROM supplier),
f AS (SELECT host, regexp_extract_all(output, {sql_text('(?s)Management Addresses.*?' + _IP)}, 1) AS managed, regexp_extract_all(output, {sql_text(_IP)}, 1) AS every FROM o),
x AS (SELECT host, CASE WHEN len(managed) > 0 THEN managed ELSE every END AS found FROM f)
SELECT host, array_to_string(list_filter(found, lambda v, i: list_position(found, v) = i), ',') AS addresses FROM x""")
def z11(spark, sf):
    d = table(spark, sf, "supplier").selectExpr("s_suppkey AS host", f"{_LLDP.replace('{nl}', 'char(10)')} AS output")
    return d.select("host", F.array_join(Z.neighbour_addresses(F.col("output")), ",").alias("addresses"))


_EDGES = "e AS (SELECT DISTINCT a.l_suppkey AS src, b.l_suppkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)"


def _edges(spark, sf):
    """Devices are neighbours where one follows the other in an order; pairs may repeat. A range of the order's lines
    gives those that follow, so the lines are shuffled once."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").where("l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL")
    after = F.collect_list(F.struct("l_suppkey")).over(W.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(1, 1))
    return li.select(F.col("l_suppkey").alias("src"), after.alias("after")).select("src", F.inline("after")).toDF("src", "dst")


@query("z12_discovered", f"""WITH RECURSIVE {_EDGES}, d1 AS (SELECT DISTINCT dst AS node FROM e WHERE src IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 0)),
d2 AS (SELECT DISTINCT dst AS node FROM e WHERE src IN (SELECT node FROM d1)),
r AS (SELECT s_suppkey AS node, 0 AS distance FROM supplier WHERE s_nationkey = 0 UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2)
SELECT node, min(distance) AS distance FROM r GROUP BY node""")
def z12(spark, sf):
    """From the devices of one site (nation 0): steps to each device that is two steps away or nearer."""
    site = table(spark, sf, "supplier").where("s_nationkey = 0").select(F.col("s_suppkey").alias("node"))
    return Z.discover_nearest(_edges(spark, sf), site, 2)


@query("z12_discovered_by_all", f"WITH RECURSIVE {_EDGES}, r(seed, node, d) AS (SELECT s_suppkey, s_suppkey, 0 FROM supplier UNION SELECT seed, dst, d + 1 FROM r JOIN e ON e.src = r.node WHERE d < 2) SELECT seed, node, min(d) AS distance FROM r GROUP BY seed, node")
def z12_all(spark, sf):
    """From every device: a row for each pair of them that is two steps apart or nearer."""
    return Z.discover(_edges(spark, sf), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node")), 2)


@query("z13_topology_rows", f"WITH {_DEV} SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'device_' || replace(host, '.', '_') ELSE device END AS device, host, CASE vendor WHEN 'cisco' THEN 'cisco/ios-xr/asr9000' WHEN 'juniper' THEN 'juniper/junos/mx-series' WHEN 'nokia' THEN 'nokia/sros/7750-sr' WHEN 'arista' THEN 'arista/eos/7280' ELSE 'huawei/vrp/ne40e' END AS ref, CASE WHEN s_suppkey % 3 = 0 THEN upper('device_' || replace(host, '.', '_')) ELSE upper(device) END || '_PASSWORD' AS credential FROM dev")
def z13(spark, sf):
    return Z.topology_rows(_instances(spark, sf).withColumn("hostname", F.when(F.regexp_extract("device", r"(\d+)", 1).cast("int") % 3 != 0, F.col("device"))))


_GRP = " UNION ALL ".join(f"SELECT device, '{g}' AS \"group\" FROM dev WHERE " + (" AND ".join(x for x in (f"list_contains({sql_list(r)}, role)" if r else "", f"list_contains({sql_list(v)}, vendor)" if v else "") if x)) for g, r, v in Z.GROUPS)


@query("z14_groups", f"WITH {_DEV} {_GRP}")
def z14(spark, sf):
    return Z.group_members(devices(spark, sf))
