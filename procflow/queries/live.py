"""Queries that run a stream over files written from the events, and those of joins by time.

Each stream query writes its input as slices in order of time below the shared folder, runs once over all of them in
several batches, and reads back what the sink holds. A last slice holds one row far ahead, which moves the watermark
past everything else.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procflow.operators import runlog as L
from procflow.operators import timejoin, waits
from procflow.queries.operations import _DEC, _EVENTS, _NOTES, _decisions, _notes, LOG, STATE, log
from procflow.session import new_folder, table
from procflow.sources import archive
from procflow.streaming import sinks, streams

QUERIES, SQL = {}, {}
SLICES = 3
AHEAD = timedelta(days=400)


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _bounds(spark, sf) -> tuple[list, str]:
    """Where the slices of the events begin, and a delay no shorter than a slice and its neighbour."""
    low, high = table(spark, sf, "events").agg(F.min(F.col("ts").cast("timestamp")), F.max(F.col("ts").cast("timestamp"))).first()
    if low is None:
        return [], "1 day"
    width = (high - low) / SLICES
    return [*(low + k * width for k in range(1, SLICES)), high + timedelta(days=200)], f"{2 * int(width.total_seconds()) + 60} seconds"


def _ahead(spark, sf):
    return table(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp")) + F.expr(f"INTERVAL {AHEAD.days} DAYS"))


def _with_tick(rows: DataFrame, ahead: DataFrame, column: str, **ids) -> DataFrame:
    """Plus a row far ahead, of which all but its time and the given values is null."""
    tick = ahead.toDF("__t").select(*[(F.col("__t") if c == column else F.lit(ids.get(c))).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    return rows.unionByName(tick.where(F.col(column).isNotNull()))


def _stream(rows: DataFrame, column: str, bounds: list, format: str = "parquet") -> DataFrame:
    """The rows as a stream of files, one slice after the other."""
    spark = rows.sparkSession
    folder = new_folder(spark, "stream-in")
    sinks.write_slices(rows.coalesce(4), folder, column, bounds, format)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).format(format).load(folder)


def _run(spark: SparkSession, stream: DataFrame, mode: str = "append", each=None) -> DataFrame:
    out = new_folder(spark, "stream-out")
    sinks.run_available(stream, f"{out}/rows", f"{out}/checkpoint", mode, each)
    schema = (each(stream.sparkSession.createDataFrame([], stream.schema)) if each else stream).schema
    return sinks.read_batches(spark, f"{out}/rows", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields))


@query("y01_live_stream", f"WITH {LOG}, {STATE}, e AS (SELECT execution_id, count(*) FILTER (WHERE to_status = 'running') AS attempts FROM log WHERE entity = 'execution' GROUP BY execution_id) SELECT execution_id, step_id AS entity, status, attempts, (epoch_us(started_at) // 1000) AS started_ms, (epoch_us(completed_at) // 1000) AS completed_ms, true AS final FROM state UNION ALL SELECT execution_id, 'execution', status, attempts, (epoch_us(started_at) // 1000), (epoch_us(completed_at) // 1000), true FROM est JOIN e USING (execution_id)")
def y01_stream(spark, sf):
    """Kept as long as the events last, so that the fold is that of the batch; at the end all state has gone."""
    bounds, late = _bounds(spark, sf)
    d = log(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), "execution_id", "entity", "to_status")
    src = _stream(_with_tick(d, _ahead(spark, sf), "ts", execution_id="tick", entity="tick", to_status="running"), "ts", bounds)
    rows = _run(spark, streams.live_state(src, late, hold=40 * 86_400, idle=40 * 86_400), "update")
    d = sinks.newest(rows, "execution_id", "entity", within="created_at").where("execution_id <> 'tick'")
    return d.select("execution_id", "entity", "status", "attempts", L.millis("started_at").alias("started_ms"), L.millis("completed_at").alias("completed_ms"), "final")


_POLLS = """rq AS (SELECT 'w' || event_id AS wait_id, 'u' || user_id % 40 AS device, ts AS start, 1800 * (event_id % 13) AS max_wait_s,
    CASE event_id % 3 WHEN 0 THEN 'purchase.*[0-4]$' WHEN 1 THEN 'ERROR|VIEW' ELSE 'click' END AS pattern, event_id % 5 = 0 AS negate FROM events WHERE event_id % 16 = 3),
  said AS (SELECT 'u' || user_id % 40 AS device, ts, event_type || ' ' || event_id AS output FROM events)"""


def _waits(spark, sf) -> tuple[DataFrame, DataFrame]:
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rq = ev.where("event_id % 16 = 3").selectExpr("'w' || event_id AS wait_id", "'u' || user_id % 40 AS device", "'show log' AS command", "ts AS start", "1800 * (event_id % 13) AS max_wait_s", "CASE event_id % 3 WHEN 0 THEN 'purchase.*[0-4]$' WHEN 1 THEN 'ERROR|VIEW' ELSE 'click' END AS pattern", "event_id % 5 = 0 AS negate")
    return rq, ev.selectExpr("'u' || user_id % 40 AS device", "'show log' AS command", "ts", "event_type || ' ' || event_id AS output")


_POLL_SQL = f"""WITH {_POLLS},
p AS (SELECT *, start + to_microseconds((CASE WHEN k <= 4 THEN 5 * (2 ** k - 1) ELSE 75 + 60 * (k - 4) END * 1000000)::BIGINT) AS at, (CASE WHEN k <= 4 THEN 5 * (2 ** k - 1) ELSE 75 + 60 * (k - 4) END)::DOUBLE AS t
      FROM rq, range(500) r(k)),
q AS (SELECT * FROM p WHERE t < max_wait_s),
s AS (SELECT q.*, coalesce(said.output, 'ERROR: no output') AS output FROM q ASOF LEFT JOIN said ON q.device = said.device AND q.at >= said.ts),
h AS (SELECT *, CASE pattern WHEN 'click' THEN contains(output, 'click') WHEN 'ERROR|VIEW' THEN regexp_matches(output, '(?is)ERROR|VIEW') ELSE regexp_matches(output, '(?is)purchase.*[0-4]$') END <> negate AS ok FROM s),
f AS (SELECT wait_id, min(k) FILTER (WHERE ok) AS k, max(k) AS last_k, arg_min(output, k) FILTER (WHERE ok) AS hit, arg_max(output, k) AS said FROM h GROUP BY wait_id),
g AS (SELECT wait_id, max_wait_s, f.k IS NOT NULL AS met, coalesce(f.k + 1, last_k + 1, 0)::INT AS attempts, coalesce(hit, said) AS last_output FROM rq LEFT JOIN f USING (wait_id))
SELECT wait_id, met, attempts, CASE WHEN met THEN (CASE WHEN attempts <= 5 THEN 5 * (2 ** (attempts - 1) - 1) ELSE 75 + 60 * (attempts - 5) END)::DOUBLE ELSE max_wait_s::DOUBLE END AS elapsed_s, last_output FROM g"""


@query("y03_polls", _POLL_SQL)
def y03_polls(spark, sf):
    return waits.poll_outcomes(*_waits(spark, sf))


@query("y03_poll_stream", _POLL_SQL)
def y03_stream(spark, sf):
    bounds, late = _bounds(spark, sf)
    rq, said = _waits(spark, sf)
    said = _with_tick(said, _ahead(spark, sf), "ts", device="tick", command="tick", output="tick")
    return _run(spark, streams.poll_waits(_stream(rq, "start", bounds), _stream(said, "ts", bounds), late)).drop("batch")


_GATES = """rq AS (SELECT event_id AS request_id, user_id, ts FROM events WHERE event_type = 'signup'),
an AS (SELECT r.request_id, e.ts AS answered_at, CASE e.event_type WHEN 'error' THEN 'denied' ELSE 'approved' END AS answer, r.ts FROM rq r JOIN events e ON e.user_id = r.user_id AND e.event_type IN ('error', 'click')),
f AS (SELECT request_id, arg_min(answer, answered_at) FILTER (WHERE answered_at >= ts AND answered_at <= ts + INTERVAL {0} SECONDS) AS a FROM an GROUP BY request_id),
g AS (SELECT request_id, CASE a WHEN 'denied' THEN 'rejected' WHEN 'approved' THEN 'approved' ELSE 'timed_out' END AS outcome FROM rq LEFT JOIN f USING (request_id))"""


def _gate(spark, sf, timeout_s: int) -> DataFrame:
    """Requests, and answers from ten minutes before them to twice the time allowed, as two streams."""
    bounds, late = _bounds(spark, sf)
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rq = ev.where("event_type = 'signup'").select(F.col("event_id").alias("request_id"), "user_id", "ts")
    e = ev.where("event_type in ('error', 'click')").select(F.col("user_id").alias("u"), F.col("ts").alias("answered_at"), F.when(F.col("event_type") == "error", "denied").otherwise("approved").alias("answer"))
    an = rq.join(e, F.expr(f"user_id = u AND answered_at >= ts - INTERVAL 600 SECONDS AND answered_at <= ts + INTERVAL {2 * timeout_s} SECONDS")).select("request_id", "answered_at", "answer")
    ahead = _ahead(spark, sf)
    r = _stream(_with_tick(rq.select("request_id", "ts"), ahead, "ts", request_id=-1), "ts", bounds)
    a = _stream(_with_tick(an, ahead, "answered_at", request_id=-2), "answered_at", bounds)
    return _run(spark, streams.approval_gate(r, a, timeout_s, late))


@query("y04_approval_stream", f"WITH {_GATES.format(3600)} SELECT request_id, outcome FROM g")
def y04_stream(spark, sf):
    return _gate(spark, sf, 3600).select("request_id", "outcome")


@query("y04_step_approval_stream", f"WITH {_GATES.format(1800)} SELECT request_id, outcome FROM g")
def y04_step_stream(spark, sf):
    return _gate(spark, sf, 1800).select("request_id", "outcome")


@query("y05_once", f"WITH {LOG} SELECT execution_id, entity, to_status, count(*) AS n FROM log GROUP BY ALL")
def y05(spark, sf):
    """Every event comes three times, twice in one slice and again with the next; it is taken once."""
    bounds, late = _bounds(spark, sf)
    d = log(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "execution_id", "entity", "to_status")
    folder = new_folder(spark, "stream-in")
    for k, part in enumerate((d.where("event_id % 2 = 0"), d, d.where("event_id % 2 = 1"), d.limit(0))):
        part.union(part).coalesce(2).write.parquet(f"{folder}/slice={k}")
    src = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    rows = _run(spark, streams.once(src, ["event_id"], "60 days"))
    return rows.groupBy("execution_id", "entity", "to_status").agg(F.count("*").alias("n"))


@query("y06_escalation_stream", f"WITH {_DEC} SELECT event_id, execution_id, decision, confidence FROM dec WHERE confidence < 0.6")
def y06_stream(spark, sf):
    """The decision log as JSON files that come in one after the other."""
    d = _decisions(spark, sf)
    folder = new_folder(spark, "stream-in")
    for k in range(SLICES):
        d.where(F.col("event_id") % SLICES == k).coalesce(2).write.json(f"{folder}/slice={k}")
    src = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 2).json(folder)
    return _run(spark, streams.escalations(src)).select("event_id", "execution_id", "decision", "confidence")


@query("e19_incident_stream", f"WITH {LOG}, {_EVENTS}, {_NOTES}, o AS (SELECT dedup_key, arg_max(action, ts) AS a, max(ts) AS t FROM notes WHERE action IS NOT NULL GROUP BY dedup_key) SELECT dedup_key, (epoch_us(t) // 1000) AS ms FROM o WHERE a = 'trigger'")
def e19_stream(spark, sf):
    bounds, _ = _bounds(spark, sf)
    notes = _notes(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    rows = _run(spark, _stream(notes, "ts", bounds), each=streams.incident_changes)
    return L.open_incidents(rows).select("dedup_key", L.millis("ts").alias("ms"))


_WINDOWS = "SELECT c_custkey AS window_id, 'd' || c_custkey % 9 AS device, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * (c_custkey * 7919 % 2592000) AS start, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * (c_custkey * 7919 % 2592000 + CASE WHEN c_custkey % 11 = 0 THEN -1 ELSE c_custkey % 50 * c_custkey % 5000 END) AS \"end\" FROM customer"


@query("e16_window_join", f"""WITH w AS (SELECT * FROM ({_WINDOWS}) WHERE start <= "end"), p AS (SELECT event_id, 'd' || user_id % 11 AS device, ts FROM events),
h AS (SELECT event_id, count(*) AS n, arg_min(window_id, (start, window_id)) AS window_id FROM p JOIN w ON p.device = w.device AND ts >= start AND ts <= "end" GROUP BY event_id),
l AS (SELECT device, max(start) AS last FROM w GROUP BY device)
SELECT event_id, CASE WHEN n > 0 THEN 'in' WHEN last IS NULL THEN 'allowed' WHEN ts < last THEN 'before' ELSE 'after' END AS position, coalesce(n, 0) AS n_windows, window_id FROM p LEFT JOIN l USING (device) LEFT JOIN h USING (event_id)""")
def e16_join(spark, sf):
    """Executions of 11 devices, of which 9 have many windows each."""
    second = "make_dt_interval(0, 0, 0, c_custkey * 7919 % 2592000)"
    length = "make_dt_interval(0, 0, 0, CASE WHEN c_custkey % 11 = 0 THEN -1 ELSE c_custkey % 50 * c_custkey % 5000 END)"
    w = table(spark, sf, "customer").selectExpr("c_custkey AS window_id", "'d' || c_custkey % 9 AS device", f"TIMESTAMP '2024-01-01 00:00:00' + {second} AS start", f"TIMESTAMP '2024-01-01 00:00:00' + {second} + {length} AS end")
    p = table(spark, sf, "events").selectExpr("event_id", "'d' || user_id % 11 AS device", "CAST(ts AS timestamp) AS ts")
    return timejoin.window_positions(p, w, ["device"], "ts", "event_id")


@query("e17_archive", f"WITH {LOG}, l AS (SELECT execution_id, max(ts) AS t FROM log GROUP BY execution_id) SELECT CASE WHEN t < TIMESTAMP '2024-02-06 06:00:00' - INTERVAL 168 HOURS THEN 'archive' ELSE 'log' END AS place, CASE WHEN t < TIMESTAMP '2024-02-06 06:00:00' - INTERVAL 168 HOURS THEN strftime(t, '%Y-%m') END AS month, execution_id, event_id, to_status FROM log JOIN l USING (execution_id)")
def e17_archive(spark, sf):
    """Archived in two runs, the second one over the whole log again; what is archived and what is left, read back."""
    d = log(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "execution_id", "entity", "to_status")
    folder = new_folder(spark, "archive")
    at = lambda t: F.lit(t).cast("timestamp")
    archive.archive_expired(d, at("2024-02-05 12:00:00"), f"{folder}/old")
    archive.archive_expired(d, at("2024-02-06 06:00:00"), f"{folder}/old").write.parquet(f"{folder}/rest")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields)
    old = archive.read_archive(spark, f"{folder}/old", schema).selectExpr("'archive' AS place", "month", "execution_id", "event_id", "to_status")
    rest = spark.read.schema(d.schema).parquet(f"{folder}/rest").selectExpr("'log' AS place", "CAST(null AS string) AS month", "execution_id", "event_id", "to_status")
    return old.union(rest)


@query("e14_active", f"WITH {LOG}, l AS (SELECT execution_id, arg_max(to_status, ts) AS status FROM log WHERE entity = 'execution' GROUP BY execution_id ORDER BY max(ts) DESC LIMIT 500) SELECT count(*) FILTER (WHERE status = 'running') AS n, printf('executions_active %d', count(*) FILTER (WHERE status = 'running')) AS line FROM l")
def e14_active(spark, sf):
    return L.active_executions(log(spark, sf))
