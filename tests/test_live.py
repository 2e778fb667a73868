"""Streams that end their state and survive a stop, joins by time, waits with their schedule of polls, the archive."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from procflow.operators import runlog as L
from procflow.operators import timejoin, waits
from procflow.sources import archive
from procflow.streaming import sinks, streams

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.fixture
def files(spark, tmp_path):
    """Writes rows as slices of a stream, and runs streams over what is there."""

    class Files:
        def stream(self, df, name, column, bounds, batches=1):
            sinks.write_slices(df.coalesce(1), f"{tmp_path}/{name}", column, bounds)
            return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", batches).parquet(f"{tmp_path}/{name}")

        def run(self, stream, name, mode="append", each=None):
            q = sinks.run_available(stream, f"{tmp_path}/{name}-out", f"{tmp_path}/{name}-state", mode, each)
            return q, sinks.read_batches(spark, f"{tmp_path}/{name}-out", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields))

    return Files()


LOG = "ts timestamp, execution_id string, entity string, to_status string"


def transitions(n=60):
    """Executions one after the other, each of which ends."""
    rng = random.Random(3)
    rows = []
    for k in range(n):
        t = k * 900
        rows += [(at(t), f"x{k:03d}", "execution", "running"), (at(t + 600), f"x{k:03d}", "execution", rng.choice(["passed", "failed"]))]
        for s in range(3):
            for a in range(rng.randint(1, 3)):
                rows.append((at(t + 20 * s + 5 * a + 1), f"x{k:03d}", f"s{s}", "running"))
            rows.append((at(t + 20 * s + 30), f"x{k:03d}", f"s{s}", rng.choice(["passed", "failed", "skipped"])))
    return rows


def test_live_state_equals_the_batch_and_stays_bounded(spark, files):
    rows = transitions()
    log = spark.createDataFrame(rows, LOG)
    bounds = [at(900 * k) for k in range(10, 60, 10)] + [at(10**6)]
    src = files.stream(log.union(spark.createDataFrame([(at(2 * 10**6), "tick", "tick", "running")], LOG)), "log", "ts", bounds)
    q, out = files.run(streams.live_state(src, "10 minutes", hold=1800), "live", "update")
    d = sinks.newest(out, "execution_id", "entity").where("execution_id <> 'tick'")
    got = {(r.execution_id, r.entity): (r.status, r.attempts, r.started_at, r.completed_at, r.final) for r in d.collect()}
    steps = {(r.execution_id, r.step_id): (r.status, r.attempts, r.started_at, r.completed_at, True) for r in L.step_state(log).collect()}
    runs = {(r.execution_id, "execution"): (r.status, 1, r.started_at, r.completed_at, True) for r in L.execution_state(log).collect()}
    assert got == steps | runs
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress]
    # a value and a timer each; ten executions of four entities come with a slice, and no more than a few slices are held
    assert max(held) < 3 * 2 * 4 * 10 < 2 * 4 * 60 and sinks.state_rows(q) <= 3


def test_live_state_begins_anew_after_its_hold_and_takes_stragglers_before(spark, files):
    rows = [(at(0), "x", "s", "running"), (at(10), "x", "s", "passed"), (at(1500), "x", "s", "failed"), (at(9000), "x", "s", "running"), (at(99_000), "tick", "tick", "running")]
    src = files.stream(spark.createDataFrame(rows, LOG), "log", "ts", [at(100), at(5000), at(20_000)])
    _, out = files.run(streams.live_state(src, "1 minute", hold=1800, idle=3600), "live", "update")
    got = [(r.status, r.attempts, r.final) for r in out.where("execution_id = 'x'").orderBy("batch", "created_at", "final").collect()]
    assert got == [("passed", 1, False), ("failed", 1, False), ("failed", 1, True), ("running", 1, False), ("running", 1, True)]


REQUESTS, ANSWERS = "request_id string, ts timestamp", "request_id string, answered_at timestamp, answer string"


def test_approvals_end_their_state_and_survive_a_stop(spark, files, tmp_path):
    requests = [("a", at(0)), ("b", at(0)), ("c", at(0)), ("d", at(5)), ("e", at(40_000))]
    answers = [("a", at(10), "approved"), ("a", at(20), "denied"), ("b", at(5), "denied"), ("c", at(4000), "approved"), ("d", at(1), "denied"), ("d", at(9), "approved"), ("never asked", at(3), "approved"), ("e", at(43_600), "approved")]
    rq, an = spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(answers, ANSWERS)
    want = {r.request_id: r.outcome for r in L.approval_outcomes(rq, an).collect()}
    assert want == {"a": "approved", "b": "rejected", "c": "timed_out", "d": "approved", "e": "approved"}
    r, a = files.stream(rq, "r", "ts", [at(20_000)], 9), files.stream(an, "a", "answered_at", [at(20_000)], 9)
    gate = streams.approval_gate(r, a)
    files.run(gate, "gate")
    # what is there is done; the heartbeat comes later, to the same checkpoint and sink
    spark.createDataFrame([("tick", at(90_000))], REQUESTS).write.parquet(f"{tmp_path}/r/slice=900")
    spark.createDataFrame([("tock", at(90_000), "approved")], ANSWERS).write.parquet(f"{tmp_path}/a/slice=900")
    q, out = files.run(gate, "gate")
    assert sorted((x.request_id, x.outcome) for x in out.collect()) == sorted(want.items())  # each once
    assert sinks.state_rows(q) == 2  # the two heartbeats: no request, no answer, early or late, is left
    again, out = files.run(gate, "gate")
    assert out.count() == len(want)


def test_a_batch_written_twice_is_there_once(spark, files, tmp_path):
    d = spark.createDataFrame([(at(k), f"e{k % 5}", "note") for k in range(20)], "ts timestamp, id string, text string")
    src = files.stream(d.union(d), "n", "ts", [at(10)])
    once = streams.once(src, ["ts", "id"], "1 hour")
    _, out = files.run(once, "once")
    rows = out.count()
    # a stop after the last batch's write and before its commit: the batch is run again
    commits = sorted((tmp_path / "once-state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    _, out = files.run(once, "once")
    assert rows == out.count() == out.select("ts", "id").distinct().count() == 20


def test_incidents_need_no_state(spark, files):
    notes = [(at(k), f"run-{k % 3}", "resolve" if k % 4 == 0 else "trigger") for k in range(40)] + [(at(50), "run-0", None)]
    d = spark.createDataFrame(notes, "ts timestamp, dedup_key string, action string")
    src = files.stream(d, "notes", "ts", [at(13), at(29)])
    q, out = files.run(src, "inc", each=streams.incident_changes)
    got = {r.dedup_key for r in L.open_incidents(out).collect()}
    assert got == {r.dedup_key for r in L.open_incidents(d).collect()} and not q.lastProgress["stateOperators"]


def slow_wait(start, limit, pattern, negate, said):
    """A wait as a loop over its polls; ``said``: (ts, output) in order."""
    try:
        p = re.compile(pattern, re.I | re.S)
    except (re.error, TypeError):
        return False, 0, 0.0, None
    elapsed, pause, attempts, seen = 0.0, 5.0, 0, None
    while elapsed < limit:
        attempts += 1
        now = start + timedelta(seconds=elapsed)
        seen = next((o for t, o in reversed(said) if t <= now), None)
        seen = "ERROR: no output" if seen is None else seen
        if (p.search(seen) is not None) != bool(negate):
            return True, attempts, elapsed, seen
        step = min(pause, limit - elapsed)
        elapsed, pause = elapsed + step, min(pause * 2, 60.0)
    return False, attempts, elapsed, seen


WAITS = "wait_id string, device string, command string, start timestamp, max_wait_s double, pattern string, negate boolean"
SAID = "device string, command string, ts timestamp, output string"


def waiting(seed=0):
    rng = random.Random(seed)
    said = sorted(("d" + rng.choice("12"), "show x", at(rng.randrange(0, 6000)), rng.choice(["down", "Up\nand stable", "flap", None])) for _ in range(60))
    said = [s for k, s in enumerate(said) if not k or said[k - 1][:3] != s[:3]]
    rows = [(f"w{k}", "d" + rng.choice("123"), "show x", at(rng.randrange(0, 5000)), float(rng.choice([0, -1, 3, 5, 6, 75, 76, 700, 1301])), rng.choice(["up.and", "DOWN", "flap|Error", "((", None, "x"]), rng.choice([True, False, None])) for k in range(120)]
    return rows, said


def test_poll_schedule(spark):
    polls = spark.range(1).select(*[waits.poll_times(F.lit(m)).alias(f"m{k}") for k, m in enumerate((0, -3, 5, 6, 75, 76, 200))]).first()
    assert list(polls) == [[], [], [0.0], [0.0, 5.0], [0.0, 5.0, 15.0, 35.0], [0.0, 5.0, 15.0, 35.0, 75.0], [0.0, 5.0, 15.0, 35.0, 75.0, 135.0, 195.0]]


def test_waits_equal_a_loop_in_batch_and_stream(spark, files):
    rows, said = waiting()
    want = {w: slow_wait(start, limit, pattern, negate, [(t, o) for d, _, t, o in said if d == device]) for w, device, _, start, limit, pattern, negate in rows}
    rq, out = spark.createDataFrame(rows, WAITS), spark.createDataFrame(said, SAID)
    of = lambda d: {r.wait_id: (r.met, r.attempts, r.elapsed_s, r.last_output) for r in d.collect()}
    assert of(waits.poll_outcomes(rq, out)) == want
    tick = spark.createDataFrame([("tick", "tick", at(10**6), "tick")], SAID)
    bounds = [at(1500), at(3000), at(4500), at(10**5)]
    q, got = files.run(streams.poll_waits(files.stream(rq, "rq", "start", bounds), files.stream(out.union(tick), "said", "ts", bounds), "30 minutes"), "waits")
    assert got.count() == len(want) and of(got) == want
    assert sinks.state_rows(q) <= 12  # what each device said last, no wait


def test_asof_equals_a_loop_over_many_spans(spark):
    rng = random.Random(1)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(k, key(), at(rng.randrange(0, 10**6))) for k in range(400)] + [(999, "a", None)]
    right = [(key(), at(rng.randrange(0, 10**6)), rng.choice([None, f"v{k}"])) for k in range(300)]
    got = timejoin.asof(spark.createDataFrame(left, "id long, k string, ts timestamp"), spark.createDataFrame(right, "k string, at timestamp, v string"), ["k"], "ts", "at", "v", span_s=3600)
    want = {}
    for i, k, t in left:
        known = [(u, v is not None, v or "") for kk, u, v in right if k is not None and kk == k and t is not None and u <= t]
        want[i] = (max(known)[2] or None) if known else None
    assert {r.id: r.v for r in got.collect()} == want


def test_windows_join_without_a_nested_loop(spark):
    rng = random.Random(2)
    p = [(k, rng.choice(["hot"] * 5 + ["a", "none", "bad", None]), at(rng.randrange(0, 10**5))) for k in range(300)]
    w = []
    for k in range(200):
        s = rng.randrange(0, 10**5)
        w.append((k, rng.choice(["hot", "a"]), at(s), at(s + rng.choice([0, 1, 40, 4000, 60_000]))))
    w += [(901, "bad", at(9), at(8)), (902, "bad", None, at(8)), (903, "bad", at(8), None), (904, "hot", p[0][2], p[0][2]), (905, "a", p[0][2] - timedelta(days=9), p[0][2])]
    d = timejoin.window_positions(spark.createDataFrame(p, "event_id long, device string, ts timestamp"), spark.createDataFrame(w, "window_id long, device string, start timestamp, end timestamp"), ["device"], "ts", "event_id")
    valid = [x for x in w if x[2] and x[3] and x[2] <= x[3]]
    for r in d.collect():
        device, ts = p[r.event_id][1:]
        mine = [x for x in valid if x[1] == device]
        held = sorted((x[2], x[0]) for x in mine if x[2] <= ts <= x[3])
        want = "in" if held else "allowed" if not mine else "before" if ts < max(x[2] for x in mine) else "after"
        assert (r.position, r.n_windows, r.window_id) == (want, len(held), held[0][1] if held else None)
    plan = d._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_archive_is_complete_disjoint_and_rerun_without_repeats(spark, tmp_path):
    rows = [(at(86_400 * (k % 50)), f"x{k % 50}", "s", "passed", k) for k in range(300)]
    log = spark.createDataFrame(rows, LOG + ", n long")
    folder = str(tmp_path / "archive")
    now = lambda day: F.lit(at(86_400 * day))
    schema = LOG + ", n long"
    assert archive.read_archive(spark, folder, schema).count() == 0 if (tmp_path / "archive").exists() else True
    for day in (20, 20, 45):  # the second run finds the same, the third one more in January and February
        rest = archive.archive_expired(log, now(day), folder)
        old = archive.read_archive(spark, folder, schema)
        a, b = sorted(r.n for r in old.collect()), sorted(r.n for r in rest.collect())
        assert sorted(a + b) == list(range(300)) and set(old.select("execution_id").distinct().toPandas()["execution_id"]) == {f"x{k}" for k in range(50) if k < day - 7}
    untouched = {f: f.stat().st_mtime_ns for f in (tmp_path / "archive" / "month=2024-01").glob("*.parquet")}
    later = spark.createDataFrame([(at(86_400 * 45), "x45", "s", "passed", 1000)], schema)
    archive.archive_expired(later, now(60), folder)
    assert archive.read_archive(spark, folder, schema).where("n = 1000").first().month == "2024-02"
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "archive" / "month=2024-01").glob("*.parquet")} == untouched


def test_active_executions_are_among_the_latest(spark):
    rows = [(at(k), f"x{k}", "execution", "running" if k % 2 else "passed") for k in range(30)]
    assert L.active_executions(spark.createDataFrame(rows, LOG), 10).first()["n"] == 5


class Calls:
    """A state handle in memory that counts its calls."""

    def __init__(self):
        self.n, self.lists, self.timers = 0, {}, set()

    def getListState(self, name, schema):
        calls = self

        class State:
            def exists(self):
                calls.n += 1
                return bool(calls.lists.get(name))

            def get(self):
                calls.n += 1
                return iter(calls.lists[name])

            def put(self, rows):
                calls.n += 1
                calls.lists[name] = list(rows)

            def appendList(self, rows):
                calls.n += 1
                calls.lists[name] = calls.lists.get(name, []) + list(rows)

            def clear(self):
                calls.n += 1
                calls.lists.pop(name, None)

        return State()

    def registerTimer(self, t):
        self.n, self.timers = self.n + 1, self.timers | {t}

    def deleteTimer(self, t):
        self.n, self.timers = self.n + 1, self.timers - {t}

    def listTimers(self):
        self.n += 1
        return iter(self.timers)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def test_state_is_called_a_few_times_a_batch_whatever_its_rows(spark):
    import pandas as pd

    n = 20_000
    p, calls = streams.PollWaits(), Calls()
    p.init(calls)
    ts = [at(k) for k in range(n)]
    none = [None] * n
    said = pd.DataFrame({"ts": ts, "wait_id": none, "max_wait_s": 0.0, "pattern": none, "negate": False, "output": [f"o{k}" for k in range(n)]})
    asked = pd.DataFrame({"ts": ts, "wait_id": [f"w{k}" for k in range(n)], "max_wait_s": 60.0, "pattern": "o1$", "negate": False, "output": none})
    assert list(p.handleInputRows(("d", "c"), iter([said, asked]), Now(0))) == [] and calls.n <= 3
    ms = lambda k: int((at(k) - datetime(1970, 1, 1)).total_seconds() * 1000)
    (out,) = p.handleExpiredTimer(("d", "c"), Now(ms(2 * n)), None)
    assert len(out) == n and out.met.sum() == 1 and calls.n <= 10  # the wait that begins at o1 meets it
    assert calls.lists == {"said": [([_us(ts[-1])], [f"o{n - 1}"])]}

    live, calls = streams.LiveState(1800, 3600), Calls()
    live.init(calls)
    log = pd.DataFrame({"ts": ts, "execution_id": [f"x{k}" for k in range(n)], "entity": "s", "to_status": "running"})
    (out,) = live.handleInputRows((0,), iter([log]), Now(0))
    assert len(out) == n and calls.n <= 6 and len(calls.timers) == 1
    (out,) = live.handleExpiredTimer((0,), Now(ms(3 * n)), Now(ms(3600) + 1))
    assert len(out) == n and out.final.all() and not calls.lists and not calls.timers


def _us(t):
    return int((t - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
