"""Plans, logs, matching, diffs, fleets and streams on small inputs."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from procflow.operators import diffing as D
from procflow.operators import fleet as Z
from procflow.operators import matching as E
from procflow.operators import runlog as L
from procflow.plans import graph as G
from procflow.streaming import streams as Y

T0 = datetime(2024, 1, 1)


def graph(spark, **needs):
    return spark.createDataFrame([("e", s, k, d) for k, (s, d) in enumerate(needs.items())], "execution_id string, step_id string, sequence int, dependencies array<string>")


def waves(spark, **needs):
    return {r.step_id: r.wave for r in G.waves(graph(spark, **needs)).collect()}


def test_waves(spark):
    assert waves(spark, a=[], b=[], c=[]) == {"a": 1, "b": 1, "c": 1}
    assert waves(spark, a=[], b=["a"], c=["a"], d=["b", "c"]) == {"a": 1, "b": 2, "c": 2, "d": 3}
    assert waves(spark, a=["b"], b=["a"], c=["b"], d=[]) == {"a": -1, "b": -1, "c": -1, "d": 1}
    chain = G.waves(graph(spark, a=[], b=["a"], c=["b"], x=[])).where("critical_pos is not null").orderBy("critical_pos").collect()
    assert [r.step_id for r in chain] == ["a", "b", "c"]
    assert G.unknown_dependencies(graph(spark, a=["zz"])).first().needs == "zz"


def test_waves_against_longest_paths(spark):
    rng = random.Random(3)
    needs = {f"s{k:02d}": sorted({f"s{rng.randrange(k):02d}" for _ in range(rng.randint(0, 3))} if k else set()) for k in range(30)}
    want: dict = {}
    for s, ds in needs.items():
        want[s] = 1 + max((want[d] for d in ds), default=0)
    assert waves(spark, **needs) == want


def test_inverse_commands(spark):
    rows = [("router bgp 100", "cisco"), ("set x y", "juniper"), ("activate z", "juniper"), ("bgp 100", "huawei"), ("no x", "cisco"), ("frob", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "raw string, vendor string").select(G.inverse_command(F.col("raw"), F.col("vendor"))).collect()]
    assert got == ["no router bgp 100", "delete x y", "deactivate z", "undo bgp 100", None, "no frob"]


def test_decisions(spark):
    rows = [(1, 3, "x", "abort"), (3, 3, "x", "abort"), (1, 1, "x", "continue"), (1, 1, "Authentication failed", "continue"), (1, 1, None, "rollback_all")]
    d = G.recovery_decisions(spark.createDataFrame(rows, "attempt int, retry_count int, error_message string, failure_strategy string").withColumn("evidence", F.lit(None).cast("string")))
    assert [r.decision for r in d.collect()] == ["RETRY", "ABORT", "CONTINUE", "ESCALATE", "ROLLBACK"]


def test_matching(spark):
    rows = [("Estab\\w+", "is Established", True), ("(((", "has ((( in it", True), ("plain", "PLAIN text", True), ("x", "", False), ("a", None, False), ("a.b", "axb", True)]
    d = spark.createDataFrame(rows, "e string, a string, want boolean").select("want", E.match_expected("e", "a").alias("got"))
    assert all(r.want == r.got for r in d.collect())
    rows = [("verify", "Established", "State Established", True), ("verify", "Established", "State Active", False), ("verify", "x", "% Invalid command", False), ("execute", "Established", "ok", True), ("execute", None, "% Unknown command", True)]
    d = E.validate_outputs(spark.createDataFrame(rows, "action_type string, expected_output string, output string, want boolean"))
    assert all(r.want == r.passed for r in d.collect())
    d = spark.createDataFrame([("up", "is up"), ("a\\nb", "only a"), ("(", "x"), ("z", None)], "p string, o string").select(E.idempotency_verdict("p", "o"))
    assert [r[0] for r in d.collect()] == ["skip", "partial_state", "proceed", "proceed"]


def log_rows():
    rows = []
    for k, (e, s) in enumerate([("execution", "running"), ("s1", "running"), ("s1", "passed"), ("s2", "running"), ("s2", "failed"), ("s2", "running"), ("s2", "passed"), ("execution", "passed")]):
        rows.append((T0 + timedelta(seconds=k), "x", e, s, "a", "m", None if k % 2 else f"out{k}"))
    return rows


def test_state_in_batch_and_stream(spark, tmp_path):
    d = spark.createDataFrame(log_rows(), Y.TRANSITION)
    state = {r.step_id: r for r in L.step_state(d, ("actual_output",)).collect()}
    assert state["s2"].attempts == 2 and state["s2"].status == "passed" and state["s2"].duration_ms == 1000 and state["s2"].actual_output == "out6"
    assert L.execution_state(d).first().status == "passed"
    d.write.json(str(tmp_path / "log"))
    q = Y.live_step_state(Y.read_transitions(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    live = {r.step_id: (r.status, r.attempts) for r in spark.table("live").collect()}
    assert live == {k: (r.status, r.attempts) for k, r in state.items()}


def test_waiting_in_batch_and_stream(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    polls = [("a", at(0), False, 60.0), ("a", at(10), True, 60.0), ("b", at(0), False, 30.0), ("b", at(20), False, 30.0), ("z", at(9000), True, 1.0)]
    d = spark.createDataFrame(polls, "wait_id string, ts timestamp, matched boolean, max_wait_s double")
    rq = d.groupBy("wait_id").agg(F.min("ts").alias("start"), F.max("max_wait_s").alias("max_wait_s"))
    want = {r.wait_id: (r.met, r.attempts, r.elapsed_s) for r in L.wait_outcomes(rq, d.select("wait_id", "ts", "matched")).collect()}
    assert want["a"] == (True, 2, 10.0) and want["b"][:2] == (False, 2)
    for k, part in enumerate((polls[:4], polls[4:])):
        spark.createDataFrame(part, d.schema).coalesce(1).write.json(str(tmp_path / f"p{k}"))
    src = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "p*"))
    q = Y.wait_for(src).writeStream.format("memory").queryName("waits").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {r.wait_id: (r.met, r.attempts, r.elapsed_s) for r in spark.table("waits").collect()}
    assert got["a"] == want["a"] and got["b"] == want["b"] == (False, 2, 30.0)


def test_approvals_in_batch_and_stream(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    requests = [("a", at(0)), ("b", at(0)), ("c", at(0)), ("d", at(5)), ("z", at(90_000))]
    answers = [("a", at(10), "approved"), ("a", at(20), "denied"), ("b", at(5), "denied"), ("c", at(4000), "approved"), ("d", at(1), "denied"), ("d", at(9), "approved")]
    rq = spark.createDataFrame(requests, "request_id string, ts timestamp")
    an = spark.createDataFrame(answers, "request_id string, answered_at timestamp, answer string")
    want = {r.request_id: r.outcome for r in L.approval_outcomes(rq.where("request_id <> 'z'"), an).collect()}
    assert want == {"a": "approved", "b": "rejected", "c": "timed_out", "d": "approved"}
    for k, ids in enumerate(("a b c d", "z")):
        rq.where(F.col("request_id").isin(ids.split())).coalesce(1).write.json(str(tmp_path / f"r{k}"))
    tick = spark.createDataFrame([("z", at(90_000), "approved")], an.schema)  # both streams move on
    an.union(tick).coalesce(1).write.json(str(tmp_path / "a0"))
    read = lambda schema, path: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / path))
    q = Y.approval_gate(read(rq.schema, "r*"), read(an.schema, "a*")).writeStream.format("memory").queryName("gates").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = [(r.request_id, r.outcome) for r in spark.table("gates").collect()]
    assert sorted(got) == sorted(want.items())  # each once


def test_stream_counts_and_repeats(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [(at(k), f"e{k % 3}", "passed" if k % 4 else "failed") for k in range(0, 300, 7)] * 2 + [(at(9000), "late", "passed")]
    d = spark.createDataFrame(rows, "ts timestamp, entity string, to_status string")
    for k, part in enumerate((rows[:-1], rows[-1:])):
        spark.createDataFrame(part, d.schema).coalesce(1).write.json(str(tmp_path / f"t{k}"))
    read = lambda: spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "t*"))

    def rows_of(stream, name):
        stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(180)
        return [tuple(r) for r in spark.table(name).collect()]

    want = {(m, s): n for m, s, n in (tuple(r) for r in L.minute_counts(d.where("entity <> 'late'")).select("minute", "to_status", "n").collect())} if hasattr(L, "minute_counts") else None
    counted = {(m, s): n for m, s, n in rows_of(Y.minute_counts(read()), "minutes")}
    assert sum(counted.values()) == len(rows) - 1 and (want is None or counted == want)
    assert sorted(rows_of(Y.once(read(), ["ts", "entity"]), "once"), key=str) == sorted({r for r in rows}, key=str)
    low = spark.createDataFrame([("e1", 0.2), ("e2", 0.6), ("e3", None), ("e4", 0.59)], "execution_id string, confidence double")
    low.write.json(str(tmp_path / "log"))
    assert {r[1] for r in rows_of(Y.escalations(Y.read_decisions(spark, str(tmp_path / "log"))), "low")} == {"e1", "e4"}


def test_diffs(spark):
    pairs = [(1, "a\nb", "a\nb"), (2, "a", "a\nb"), (3, "a\nb", "a"), (4, "at 10:00:00 up", "at 11:11:11 up"), (5, "x down", "x up"), (6, None, "")]
    d = {r.key: r for r in D.text_diff(spark.createDataFrame(pairs, "key long, baseline string, current string")).collect()}
    blank = D.text_diff(spark.createDataFrame([(1, "a\nb", "a\n\nb"), (2, "a\r\nb", "a\nb")], "key long, baseline string, current string")).orderBy("key").collect()
    assert blank[0].changed and blank[0].added == [] and "+" in blank[0].diff_lines and not blank[1].changed
    assert d[2].diff_lines[:2] == ["--- pre-check (baseline)", "+++ post-check (current)"] and d[2].diff_lines[-1] == "+b"
    assert not d[1].changed and d[2].added == ["b"] and d[3].removed == ["b"] and not d[4].changed and d[5].added == ["x up"] and not d[6].changed


def test_fleet(spark):
    rows = [("s", f"d{k}", "bgp", st, sev, True) for k, st, sev in ((1, "PASS", "high"), (1, "FAIL", "critical"), (2, "FAIL", "low"), (3, "ERROR", "critical"))]
    rep = Z.device_reports(spark.createDataFrame(rows, "suite_id string, device string, protocol string, status string, severity string, reachable boolean"))
    assert {r.device: r.overall for r in rep.collect()} == {"d1": "FAIL", "d2": "WARN", "d3": "PASS"}
    assert Z.suite_status(rep).first().overall == "FAIL"
    v = spark.createDataFrame([("Cisco IOS XR Software, Version 7.3.2\nPE1 uptime is 2 weeks",), ("Hostname: mx1\nModel: mx960\nJUNOS 21.2R1",), ("?",)], "t string").select(Z.detect_version(F.col("t")).alias("v")).select("v.*").collect()
    assert (v[0].os, v[0].version, v[0].hostname, v[1].model, v[2].vendor) == ("ios-xr", "7.3.2", "PE1", "mx960", "unknown")
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 1)], "src long, dst long")
    found = {r.node: r.distance for r in Z.discover(edges, spark.createDataFrame([(1,)], "node long"), 2).collect()}
    assert found == {1: 0, 2: 1, 3: 2}


def test_windows(spark):
    d = spark.createDataFrame([("2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", T0), ("x", None, T0), ("2024-01-01T00:00:01Z", "2024-01-02T00:00:00Z", T0)], "a string, b string, ts timestamp")
    assert [r[0] for r in d.select(L.window_position(F.col("ts"), L.iso_timestamp(F.col("a")), L.iso_timestamp(F.col("b")))).collect()] == ["in", "allowed", "before"]


def test_walks_of_a_dense_graph_are_united_by_bits(spark):
    """Two steps from each of 300 devices of which each has 100 neighbours: 3,000,000 walks, 90,000 pairs."""
    from procflow.operators import fleet as Z

    n, near = 300, 100
    edges = spark.range(n * near).selectExpr(f"id div {near} AS src", f"(id div {near} * 7 + id % {near}) % {n} - 20 AS dst")
    edges = edges.union(spark.createDataFrame([(-5, 1000), (3, None), (None, 4)], "src long, dst long"))
    seeds = spark.range(n).selectExpr("id - 20 AS node").union(spark.createDataFrame([(5000,), (None,)], "node long"))
    out = {}
    for r in edges.collect():
        out.setdefault(r.src, set()).add(r.dst)
    out.pop(None)
    want = set()
    for s in [r.node for r in seeds.collect()]:
        seen, front = {s: 0}, {s}
        for k in (1, 2):
            front = {d for f in front for d in out.get(f, ()) if d not in seen}
            seen |= dict.fromkeys(front, k)
        want |= {(s, node, d) for node, d in seen.items()}
    got = Z.discover(edges, seeds, 2)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert got.schema["node"].dataType.simpleString() == "bigint"
    named = Z.discover(edges.selectExpr("CAST(src AS STRING) AS src", "CAST(dst AS STRING) AS dst"), seeds.selectExpr("CAST(node AS STRING) AS node"), 2)
    text = lambda x: None if x is None else str(x)
    rows = [tuple(r) for r in named.collect()]
    assert len(rows) == len(want) and set(rows) == {(text(s), text(n), d) for s, n, d in want}
    assert Z.discover(edges, seeds, 0).count() == n + 2
    # rows that rounds write: words of 256 nodes, not one a walk
    assert Z._bits(edges, "src", "dst").count() < 1000
