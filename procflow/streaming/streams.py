"""Structured Streaming over the transition, approval, event and decision streams.

The folds are those of operators.runlog; a stream and a batch over the same rows agree.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from procflow.operators import matching, runlog, waits
from procflow.sources.documents import DECISION

TRANSITION = "ts timestamp, execution_id string, entity string, to_status string, agent string, message string, actual_output string"


def read_transitions(spark: SparkSession, path: str, schema: str = TRANSITION) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def live_step_state(log: DataFrame) -> DataFrame:
    """The state of each step as one aggregation: for tables, or streams whose number of steps is bounded, as it is kept
    for ever. ``live_state`` ends it."""
    return runlog.step_state(log)


#: Event time for which a finished step or execution is kept for stragglers, and one that never ends.
HOLD, IDLE = 3600, 168 * 3600
_LIVE = "execution_id string, entity string, status string, attempts long, created_at timestamp, started_at timestamp, completed_at timestamp, final boolean"


def _ms(t: pd.Series) -> pd.Series:
    """Timestamps (of a session in UTC) as microseconds."""
    return t.astype("datetime64[us]").astype("int64")


class LiveState(StatefulProcessor):
    """The fold of the transitions of one bucket's steps and executions, which lie in one list, so that a batch reads and
    writes each bucket's state once. Each batch that touches an entity gives its row; once event time has passed ``hold``
    seconds since the last transition of one that ended (``idle`` seconds else), its row is given a last time as final
    and its state goes."""

    def __init__(self, hold: int, idle: int):
        self.hold, self.idle = hold, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("live", "execution_id string, entity string, status string, at long, attempts long, created long, first_run long, last_run long, ended long, due long")

    def _rows(self, found: list) -> pd.DataFrame:
        """``found``: (key, state, final)."""
        columns = [c.split()[0] for c in _LIVE.split(", ")]
        rows = [(*k, s[0], s[2], s[3], s[4] if k[1] == "execution" else s[5], s[6], final) for k, s, final in found]
        out = pd.DataFrame(rows, columns=columns)
        for c in ("created_at", "started_at", "completed_at"):
            out[c] = pd.to_datetime(out[c].astype("Int64"), unit="us")
        return out

    def _keep(self, states: dict) -> None:
        """Write the states, and one timer: for the first of them that is due."""
        if states:
            self.state.put([(*k, *s) for k, s in states.items()])
        else:
            self.state.clear()
        due = min((s[7] for s in states.values()), default=None)
        timers = list(self.handle.listTimers())
        for t in timers:
            if t != due:
                self.handle.deleteTimer(t)
        if due is not None and due not in timers:
            self.handle.registerTimer(due)

    def _states(self) -> dict:
        return {(s[0], s[1]): s[2:] for s in self.state.get()} if self.state.exists() else {}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        none = (None, None, 0, None, None, None, None, None)
        states = self._states()
        touched: dict = {}
        for pdf in rows:
            for k, us, to in zip(zip(pdf["execution_id"], pdf["entity"]), _ms(pdf["ts"]).tolist(), pdf["to_status"]):
                touched.setdefault(k, []).append((us, to))
        out = []
        for k, came in touched.items():
            status, at, attempts, created, first_run, last_run, ended, due = states.get(k, none)
            ends = runlog.EXECUTION_ENDS if k[1] == "execution" else runlog.STEP_ENDS
            for us, to in sorted(came):
                if due is not None and us // 1000 >= due:  # its time was over before this one, which begins anew
                    out.append((k, (status, at, attempts, created, first_run, last_run, ended, due), True))
                    status, at, attempts, created, first_run, last_run, ended, due = none
                if at is None or us >= at:
                    status, at = to, us
                created = us if created is None else min(created, us)
                if to == "running":
                    attempts += 1
                    first_run, last_run = us if first_run is None else min(first_run, us), us if last_run is None else max(last_run, us)
                if to in ends:
                    ended = us if ended is None else max(ended, us)
                due = at // 1000 + (self.hold if status in ends else self.idle) * 1000 + 1
            states[k] = (status, at, attempts, created, first_run, last_run, ended, due)
            out.append((k, states[k], False))
        self._keep(states)
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        states, passed = self._states(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        over = [k for k, s in states.items() if s[7] <= passed]
        if over:
            out = [(k, states.pop(k), True) for k in over]
            self._keep(states)
            yield self._rows(out)

    def close(self) -> None:
        pass


#: Buckets that the entities of a log are kept in; a checkpoint holds for one number of them.
BUCKETS = 512


def live_state(log: DataFrame, late: str = "10 minutes", hold: int = HOLD, idle: int = IDLE, buckets: int = BUCKETS) -> DataFrame:
    """``execution_id, entity, status, attempts, created_at, started_at, completed_at, final`` as the transitions come
    in, for update mode: a row for each entity that a batch touches, and a final one when its state goes.

    The numbers are those of ``runlog.step_state`` and ``runlog.execution_state`` as long as no transition comes more
    than ``hold`` seconds (``idle``, if it has not ended) of event time after the one before; a later one begins anew.
    Transitions behind the watermark are dropped. Entities are kept by bucket, of which there should be many more than
    tasks. Needs the RocksDB state store and a session in UTC.
    """
    d = log.select("ts", "execution_id", "entity", "to_status", F.pmod(F.xxhash64("execution_id", "entity"), F.lit(buckets)).alias("bucket")).withWatermark("ts", late)
    return d.groupBy("bucket").transformWithStateInPandas(statefulProcessor=LiveState(hold, idle), outputStructType=_LIVE, outputMode="update", timeMode="eventTime")


def minute_counts(log: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Transitions by minute and status; a minute is done when the watermark has passed it."""
    w = log.withWatermark("ts", late).groupBy(F.window("ts", width), "to_status").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("minute"), "to_status", "n")


class Waiter(StatefulProcessor):
    """Waits for the first match of each key: emits it, or a time-out once event time has passed the limit."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("wait", "start_ms long, limit_ms long, attempts int, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("ts")
        start, limit, attempts, done = self.state.get() if self.state.exists() else (None, None, 0, False)
        out = []
        for r in pdf.itertuples():
            ms = int(r.ts.timestamp() * 1000)
            if start is None:
                start, limit = ms, ms + int(r.max_wait_s * 1000)
                self.handle.registerTimer(limit)
            if done or ms > limit:
                continue
            attempts += 1
            if r.matched:
                done = True
                out.append((key[0], True, attempts, (ms - start) / 1000))
        self.state.update((start, limit, attempts, done))
        if out:
            yield pd.DataFrame(out, columns=["wait_id", "met", "attempts", "elapsed_s"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, limit, attempts, done = self.state.get()
        self.state.clear()
        if not done:
            yield pd.DataFrame([(key[0], False, attempts, (limit - start) / 1000)], columns=["wait_id", "met", "attempts", "elapsed_s"])

    def close(self) -> None:
        pass


def wait_for(polls: DataFrame, late: str = "1 minute") -> DataFrame:
    """``wait_id, met, attempts, elapsed_s`` from polls (wait_id, ts, matched, max_wait_s); the first poll of a key
    starts its clock. Needs the RocksDB state store."""
    d = polls.withWatermark("ts", late)
    return d.groupBy("wait_id").transformWithStateInPandas(statefulProcessor=Waiter(), outputStructType="wait_id string, met boolean, attempts int, elapsed_s double", outputMode="append", timeMode="eventTime")


_POLLED = "wait_id string, met boolean, attempts int, elapsed_s double, last_output string"


#: Outputs of one entry of a device's list.
ENTRY = 4096


class PollWaits(StatefulProcessor):
    """The waits on one command of one device. A poll is made once event time has passed it, so that every output up
    to it is there. Waits go when they end; of the outputs only the one that is current and newer ones are kept. Both
    are lists that a batch adds to at once, and that are read when event time moves on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waits = handle.getListState("waits", "wait_id string, start long, at double, pause double, attempts int, limit double, pattern string, negate boolean, last string")
        self.said = handle.getListState("said", "us array<long>, output array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ended, begun, said = [], [], []
        for pdf in rows:
            told = pdf["wait_id"].isna()
            o = pdf[told]
            said += zip(_ms(o["ts"]).tolist(), o["output"].where(o["output"].notna(), None))
            r = pdf[~told]
            for us, wait_id, limit, pattern, negate in zip(_ms(r["ts"]).tolist(), r["wait_id"], r["max_wait_s"], r["pattern"], r["negate"]):
                if limit <= 0 or matching.searched(pattern, "") is None:
                    ended.append((wait_id, False, 0, 0.0, None))
                else:
                    begun.append((wait_id, us, 0.0, float(waits.FIRST_S), 0, float(limit), pattern, bool(negate), None))
        if begun:
            self.waits.appendList(begun)
        if said:
            self.said.appendList(self._entries(said))
        self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), 0) + 1)
        if ended:
            yield pd.DataFrame(ended, columns=[c.split()[0] for c in _POLLED.split(", ")])

    def _entries(self, said: list) -> list:
        return [tuple(map(list, zip(*said[k : k + ENTRY]))) for k in range(0, len(said), ENTRY)]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        said = [x for us, output in self.said.get() for x in zip(us, output)] if self.said.exists() else []
        n = len(said)
        said.sort(key=lambda x: (x[0], x[1] or ""))
        times = [us for us, _ in said]
        open_waits = {w[0]: w for w in self.waits.get()} if self.waits.exists() else {}
        out, left, due = [], [], []
        for wait_id, start, at, pause, attempts, limit, pattern, negate, last in open_waits.values():
            now = start + int(at * 1e6)
            seen, hit = None, False
            while at < limit and now < passed:
                k = bisect_right(times, now)
                if k != seen:  # a poll that sees the same output ends as the one before
                    seen, last = k, said[k - 1][1] if k and said[k - 1][1] is not None else waits.SILENT
                    hit = matching.searched(pattern, last) != negate
                attempts += 1
                if hit:
                    out.append((wait_id, True, attempts, at, last))
                    break
                at, pause = at + pause, min(pause * waits.FACTOR, float(waits.LONGEST_S))
                now = start + int(at * 1e6)
            else:
                if at < limit:
                    left.append((wait_id, start, at, pause, attempts, limit, pattern, negate, last))
                    due.append(now)
                else:
                    out.append((wait_id, False, attempts, limit, last))
        if left:
            self.waits.put(left)
        elif open_waits:
            self.waits.clear()
        # outputs that no poll can see any more go
        current = bisect_right(times, min([passed, *due]))
        said = said[max(0, current - 1) :]
        if len(said) < n:
            self.said.put(self._entries(said))
        later = [*due, *(us for us, _ in said[1:2])]
        if later:
            self.handle.registerTimer(max(min(later), passed) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _POLLED.split(", ")])

    def close(self) -> None:
        pass


def poll_waits(requests: DataFrame, outputs: DataFrame, late: str = "1 minute") -> DataFrame:
    """``operators.waits.poll_outcomes`` of a stream of waits and a stream of outputs, each wait once, when event time
    has passed the poll that ends it. wait_id is a text that tells waits apart. Needs the RocksDB state store and a
    session in UTC."""
    r = requests.select("device", "command", F.col("start").alias("ts"), F.col("wait_id").cast("string").alias("wait_id"), F.col("max_wait_s").cast("double").alias("max_wait_s"), "pattern", F.coalesce("negate", F.lit(False)).alias("negate"), F.lit(None).cast("string").alias("output"))
    o = outputs.select("device", "command", "ts", F.lit(None).cast("string").alias("wait_id"), F.lit(0.0).alias("max_wait_s"), F.lit(None).cast("string").alias("pattern"), F.lit(False).alias("negate"), "output")
    d = r.unionByName(o).withWatermark("ts", late)
    return d.groupBy("device", "command").transformWithStateInPandas(statefulProcessor=PollWaits(), outputStructType=_POLLED, outputMode="append", timeMode="eventTime")


def approval_gate(requests: DataFrame, answers: DataFrame, timeout_s: int = 3600, late: str = "10 minutes") -> DataFrame:
    """``request_id, ts, outcome``, one row a request (request_id, ts): its first answer (request_id, answered_at,
    answer) in time, denied counting as rejected, or timed_out.

    A left outer join of two streams by request and range of time, then the first of the answers. Both sides have
    watermarks, so that answers and requests leave the state once neither can meet any more: answers whose request
    never comes, early ones too. An outcome comes once the event time of both streams has passed the limit.
    Gates of steps have a timeout of 1800 s.
    """
    r = requests.select("request_id", "ts").withWatermark("ts", late)
    a = answers.select(F.col("request_id").alias("__id"), "answered_at", "answer").withWatermark("answered_at", late)
    in_time = F.expr(f"request_id = __id AND answered_at >= ts AND answered_at <= ts + INTERVAL {int(timeout_s)} SECONDS")
    g = r.join(a, in_time, "left_outer").groupBy("request_id", "ts").agg(F.min(F.when(F.col("answer").isNotNull(), F.struct("answered_at", "answer"))).alias("first"))
    return g.select("request_id", "ts", F.when(F.col("first.answer") == "denied", "rejected").otherwise(F.coalesce("first.answer", F.lit("timed_out"))).alias("outcome"))


def once(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each lifecycle event once, repeats within the watermark dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(DECISION).json(path)


def escalations(decisions: DataFrame, least: float = 0.6) -> DataFrame:
    """Decisions of low confidence."""
    return decisions.where(F.col("confidence") < least)


def incident_changes(notes: DataFrame) -> DataFrame:
    """The last paging action of each key among some notifications (a batch of the stream, or all): ``dedup_key,
    action, ts``. Written batch by batch, they are all that ``open_incidents`` needs, whatever the length of the
    stream; no state is kept."""
    return notes.where("action IS NOT NULL").groupBy("dedup_key").agg(F.max(F.struct("ts", "action")).alias("m")).select("dedup_key", "m.action", "m.ts")
