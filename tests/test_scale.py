"""Large graphs, hot groups and indexes: the forms for large input give what the plain ones do."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from procflow.operators import blocks as B
from procflow.operators import chunks as K
from procflow.operators import ordered
from procflow.operators import runlog as L
from procflow.plans import graph as G

T0 = datetime(2024, 1, 1)
STEPS = "execution_id string, step_id string, sequence int, dependencies array<string>"


def random_graphs(seed):
    rng = random.Random(seed)
    rows = []
    for e in range(6):
        n = rng.randint(1, 40)
        names = [f"s{k}" for k in range(n)]
        rng.shuffle(names)
        for k, s in enumerate(names):
            needs = rng.sample(names[:k], min(k, rng.randint(0, 3))) + rng.choice([[], [], ["unknown"], [None]]) + (rng.sample(names, 1) if rng.random() < 0.03 else [])
            rows.append((f"e{e}", s, rng.choice([k, k, None]), rng.choice([needs, needs, needs * 2]) if needs or k else None))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_frontier_equals_the_graph_in_one_row(spark, seed):
    steps = spark.createDataFrame(random_graphs(seed), STEPS)
    of = lambda large: {(r.execution_id, r.step_id): (r.wave, r.critical_pos) for r in G.waves(steps, large).collect()}
    assert of(0) == of(10**6) == of(20)


def test_a_graph_of_a_hundred_thousand_steps(spark):
    n, width = 100_000, 5000
    d = spark.range(n).selectExpr("'big' AS execution_id", "'s' || id AS step_id", "id AS sequence", f"CASE WHEN id < {width} THEN array() ELSE array('s' || (id - {width}), 's' || (id - {width} - id % 7), 's0') END AS dependencies")
    got = G.waves(d).where("critical_pos IS NOT NULL").orderBy("critical_pos").collect()
    assert [int(r.step_id[1:]) // width + 1 for r in got] == list(range(1, 21)) == [r.wave for r in got] == [r.critical_pos for r in got]
    assert got[-1].step_id == f"s{n - width}"  # the first in the plan of those of the last wave


def test_chain_ends_at_the_first_step_of_the_plan(spark):
    rows = [("e", "z", 1, []), ("e", "y", 2, ["z"]), ("e", "b", 3, ["z"]), ("e", "a", 4, ["z"])]
    for large in (0, 100):
        got = G.waves(spark.createDataFrame(rows, STEPS), large).where("critical_pos IS NOT NULL").orderBy("critical_pos").collect()
        assert [r.step_id for r in got] == ["z", "y"]


def test_hot_executions_are_numbered_in_spans(spark, monkeypatch):
    rng = random.Random(0)
    rows = [(T0 + timedelta(seconds=k), rng.choice(["hot"] * 9 + ["x", None]), rng.choice(["execution", "s1", "s2"]), rng.choice(["running", "passed", None])) for k in range(3000)]
    log = spark.createDataFrame(rows, "ts timestamp, execution_id string, entity string, to_status string")
    monkeypatch.setattr(ordered, "SPAN", 64)
    for f in (L.timeline, L.enrich_transitions):
        a, b = (sorted(map(str, f(log, n).collect())) for n in (10**9, 500))
        assert a == b
    # the hot rows are told apart and numbered without being dealt by their key
    hot = []
    ordered.by_heat(log, "execution_id", 500, lambda d: d, lambda d: hot.append(d) or d)
    plan = hot[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_spans_start_from_the_sums_before(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([True, False, None]), rng.choice(["a", None])) for k in range(1, 500)]
    d = spark.createDataFrame(rows, "n int, c boolean, v string").withColumn("g", F.lit(1))
    got = ordered.previous(ordered.running_count(d, ["g"], "n", F.col("c"), "total", 16), ["g"], "n", "v", "none", "last", 16).orderBy("n").collect()
    total, last = 0, "none"
    for r, (_, c, v) in zip(got, rows, strict=True):
        total += bool(c)
        assert (r["total"], r["last"]) == (total, last)
        last = v


def test_numbers_of_equal_rows(spark):
    d = spark.createDataFrame([("a", 1)] * 400 + [(None, 2)] * 30 + [("b", 3)], "k string, v int")
    got = ordered.numbered(d, ["k"], ["v"], "no").groupBy("k").agg(F.sort_array(F.collect_list("no")).alias("x")).collect()
    assert {r.k: r.x for r in got} == {"a": list(range(1, 401)), None: list(range(1, 31)), "b": [1]}


def test_fences_of_long_documents(spark):
    rng = random.Random(5)
    rows = [(d, k, rng.choice(["```", "text", "", "``` x"])) for d, n in ((1, 900), (2, 30)) for k in range(1, n)]
    lines = spark.createDataFrame(rows, "doc_id long, line_no int, raw string")
    of = lambda n: sorted(tuple(r) for r in B.fence_state(lines, n).select("doc_id", "line_no", "is_fence", "fence_no", "in_fence", "closed").collect())
    assert of(None) == of(100) == of(0)


def chunked_and_commands(seed=0):
    rng = random.Random(seed)
    words = ["show", "ip", "bgp", "ROUTE", "Größe", "x", "interface", "ge-0/0/1", "10.0.0.1", "no", "shut"]
    chunks = [(d, k, rng.choice([" ", "\n", "\t"]).join(rng.choices(words, k=60)) if rng.random() < 0.95 else None) for d in range(8) for k in range(12)]
    commands = []
    for d in range(9):
        for _ in range(40):
            commands.append((d, " ".join(rng.choices(words, k=rng.randint(1, 4))), rng.randint(1, 99)))
        commands += [(d, "x", 3), (d, "ow ip b", 4), (d, "SHOW IP", 5), (d, " ", 6), (d, None, 7), (d, "never here", 8), (d, "no", 1)]
    return chunks, commands


def test_commands_of_chunks_by_index(spark):
    chunks, commands = chunked_and_commands()
    c = spark.createDataFrame(chunks, "doc_id long, chunk_index int, text string")
    m = spark.createDataFrame(commands, "doc_id long, raw string, line_no int")
    got = sorted(tuple(r) for r in K.chunk_commands(c, m).collect())
    mine = {}
    for d, raw, line in commands:
        if raw is not None:
            n, first = mine.get((d, raw), (0, 10**9))
            mine[d, raw] = (n + 1, min(first, line))
    want = sorted((d, k, raw, n, first) for d, k, text in chunks if text is not None for (e, raw), (n, first) in mine.items() if e == d and raw.lower() in text.lower())
    assert got == want


def test_candidates_are_few_where_commands_are_rare(spark):
    chunks = [(1, k, " ".join(f"word{k * 50 + j}x" for j in range(50))) for k in range(40)]
    commands = [(1, f"word{k * 50}x word{k * 50 + 1}x") for k in range(40)] + [(1, "never there")]
    pairs = K.command_candidates(spark.createDataFrame(chunks, "doc_id long, chunk_index int, text string"), spark.createDataFrame(commands, "doc_id long, raw string"))
    assert pairs.count() < 3 * 40  # of 1,640


def evaluations(df, word):
    return df._jdf.queryExecution().optimizedPlan().toString().count(word)


def test_nodes_are_computed_once_a_row(spark):
    """A filter on what a chain of replacements gives repeats no chain, and a table's columns are told by its header."""
    from procflow.operators import outline as O

    blocks = spark.createDataFrame([(1, 1, "s", 1, "table_row", "Action | Result", 1, 0), (1, 1, "s", 2, "table_row", "kindly run | up", 1, 1)], "doc_id long, section_index int, section string, block_no int, block_type string, content string, level int, row_index int")
    nodes = O.table_nodes(blocks)
    assert evaluations(nodes, "what to do") == 1  # of the words that column_map looks for
    assert evaluations(O.block_nodes(blocks), "kindly") == 2  # one look for all fillers, one replacement
    assert [tuple(r) for r in nodes.select("block_no", "description", "expected_output").collect()] == [(2, "run", "up")]


def test_white_space_and_fillers_as_their_patterns_have_them(spark):
    from functools import reduce

    from procflow.functions import patterns as P
    from procflow.functions import text as X

    rng = random.Random(5)
    parts = ["Please", "note that", "note:", "in order to", "x", "ok ,", " ", "\x1c", "\n", "\t ", " ", "  ", "\xa0", "expected: all of it is up", "State is down now", ""]
    d = spark.createDataFrame([(" ".join(rng.choices(parts, k=rng.randint(0, 8))),) for _ in range(400)] + [(None,)], "c string").select("c")
    old_strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    old_squeeze = lambda c: old_strip(F.regexp_replace(c, r"(?U)\s+", " "))
    old_compress = lambda c: F.regexp_replace(old_squeeze(reduce(lambda x, f: F.regexp_replace(x, "(?i)" + f[0], f[1]), P.FILLERS, c)), r"\s+([,.:;])", "$1")
    values = [F.rtrim(old_strip(F.regexp_extract("c", p, g)), F.lit(".")) for p, g in P.EXPECTATIONS]
    old_expectation = F.coalesce(*[F.when(F.length(v) >= 5, F.substring(v, 1, 120)) for v in values])
    for new, old in ((X.strip, old_strip), (X.squeeze, old_squeeze), (X.compress, old_compress), (X.expectation, lambda _: old_expectation)):
        assert d.where(~new(F.col("c")).eqNullSafe(old(F.col("c")))).count() == 0


def test_guardrails_read_the_steps_once(spark):
    from procflow.operators import checks as Q

    kind = "doc_id long, step_id string, sequence int, description string, commands array<struct<raw:string>>, step_type string, is_rollback boolean"
    rows = [(1, "a", 1, "ok then", [("x",), (" ",), (None,)], "action", False), (1, "b", 1, "no", None, "rollback", False), (2, "c", 1, None, [("x",)], "info", True)]
    steps = spark.createDataFrame(rows, kind).where(F.col("step_type").rlike("marker|."))
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    before = spark.createDataFrame([(1, 9), (3, 2)], "doc_id long, n_commands long")
    d = Q.guardrails(docs, steps, before)
    got = {r.doc_id: (r.passed, r.n_before, r.n_after, r.coverage, r.errors, r.warnings) for r in d.collect()}
    assert got == {
        1: (True, 9, 3, 0.3333, [], ["blank_command:a", "blank_command:a", "duplicate_sequence:b", "low_coverage", "rollback_mismatch:b", "short_description:b"]),
        2: (True, 0, 1, None, [], ["rollback_mismatch:c", "short_description:c"]),
        3: (False, 2, 0, 0.0, ["no_steps"], ["low_coverage"]),
    }
    assert evaluations(d, "marker") == 1


def test_a_line_is_tested_once_for_a_command(spark):
    from procflow.operators import commands as G

    d = G.extract_commands(spark.createDataFrame([(1, 1, " PE1# show version "), (1, 2, "prose"), (1, 3, None)], "doc_id long, line_no int, raw string"))
    assert evaluations(d, "tmsh\\s+|") == 1  # of the indicators of a command, in the first test
    assert evaluations(d, "RP/") == 2  # prompts: in that test, and for the command's text
    assert [(r.raw, r.normalized, r.vendor, r.mode) for r in d.collect()] == [("PE1# show version", "show version", "cisco", "exec")]
