"""Forms that grow with the input: blocks dealt once, windows without pairs, files written by many tasks."""

import random
from datetime import datetime, timedelta

from procflow.functions import text as X
from procflow.operators import blocks as B
from procflow.operators import chunks as K
from procflow.operators import commands as G
from procflow.operators import outline as O
from procflow.operators import steps as M
from procflow.operators import timejoin
from procflow.queries import files, views
from procflow.session import dealt, repeated

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_outlines_deal_the_blocks_once(spark):
    p = plan(O.outlines(views.proc_docs(spark, SF), views.proc_blocks(spark, SF)))
    # the lines, and the documents of the semi-join (before it and for it)
    assert p.count("Exchange") <= 3 and "Scan ExistingRDD" not in p


def test_tasks_do_not_grow_with_the_table(spark):
    d = spark.range(10)
    assert dealt(d, "id", rows=2_500_000).rdd.getNumPartitions() == 10
    assert "Exchange" not in plan(dealt(d, "id"))


def test_partitions_of_the_session_do_not_merge_into_large_tasks(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        # 144 tasks' worth of rows: within 200 partitions, which would be merged to one a core
        d = dealt(spark.range(10), "id", rows=36_000_000)
        assert "REPARTITION_BY_NUM" in plan(d) and d.rdd.getNumPartitions() == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_signs_and_white_space_are_found_by_the_short_looks(spark):
    texts = ["plain words", "two  spaces", "a\tb", "a b", " x ", "", "host 10.0.0.1", "fe80::1:2", "vlan", "ae1 up", "AS 65001", "R7", "please note that all is well , so", None]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in d.select("t", X.significance(d.t).alias("n"), X.is_significant(d.t).alias("some"), X.squeeze(d.t).alias("s")).collect():
        assert r.some == (r.n >= 1)
        assert r.s == (None if r.t is None else " ".join(r.t.split()))


def test_positions_without_pairs(spark):
    rng = random.Random(7)
    at = lambda: T0 + timedelta(seconds=rng.randint(0, 3000))
    points = [(k, rng.choice(["a", "b", "c", None]), rng.choice([at(), at(), at(), None])) for k in range(300)]
    windows = [(k, rng.choice(["a", "b", None]), s, s + timedelta(seconds=rng.choice([-5, 0, 40, 700, 2500]))) for k in range(120) for s in [at()]]
    windows += [(500 + k, "a", T0 + timedelta(seconds=90), T0 + timedelta(seconds=90 + k % 3)) for k in range(6)] + [(600, "a", T0, None)]
    p, w = spark.createDataFrame(points, "event_id long, device string, ts timestamp"), spark.createDataFrame(windows, "window_id long, device string, start timestamp, end timestamp")
    for span in (20, 500, 86_400):
        d = timejoin.window_positions(p, w, ["device"], "ts", "event_id", span)
        got = {r.event_id: (r.position, r.n_windows, r.window_id) for r in d.collect()}
        assert len(got) == len(points)
        for e, device, ts in points:
            valid = [x for x in windows if x[3] is not None and x[2] <= x[3] and device is not None and x[1] == device]
            held = [x for x in valid if ts is not None and x[2] <= ts <= x[3]]
            position = "in" if held else "allowed" if not valid else "before" if ts is not None and ts < max(x[2] for x in valid) else "after"
            assert got[e] == (position, len(held), min((x[2], x[0]) for x in held)[1] if held else None), (span, e)
    # the pairs were made by cells of each size of window
    assert "explode" not in plan(d).lower()


def test_files_are_written_by_many_tasks_and_read_once(spark):
    d = files.s01(spark, "/root/testdata/sf0.1")
    assert len({f.rsplit("/", 1)[1] for f in d.inputFiles()}) > 1
    assert plan(d).count("binaryFile") == 1


def same(a, b):
    return a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_lines_are_read_once_a_text(spark):
    lines = views.proc_lines(spark, SF)
    texts = repeated(lines, "raw", 6000, least=0)
    assert texts.count() == lines.select("raw").distinct().count() == len(set(views.TEMPLATES))
    blocks = B.parse_blocks(lines)
    assert same(B.parse_blocks(lines, texts), blocks)
    commands = G.extract_commands(lines)
    assert same(G.extract_commands(lines, texts=texts), commands)
    assert same(M.build_steps(commands, texts), M.build_steps(commands))
    docs, some = views.proc_docs(spark, SF), B.block_texts(texts)
    assert same(O.outlines(docs, B.parse_blocks(lines, texts), some), O.outlines(docs, blocks))
    # contents that the texts lack are looked through as they stand
    assert same(O.outlines(docs, blocks, some.limit(5)), O.outlines(docs, blocks))


def test_texts_are_told_apart_only_where_many_rows_repeat_few(spark):
    d = spark.range(50_000).selectExpr("cast(id AS string) AS t", "repeat('x', 9000000) AS long")
    assert repeated(d, "t", 50_000, least=0) is None
    assert repeated(d.limit(10), "long", 10, least=0) is None
    assert repeated(d.limit(10), "t", 10) is None


def test_nodes_of_outlines_parse_the_blocks_once(spark):
    p = plan(O.outline_nodes(B.sections(views.proc_blocks(spark, SF))))
    assert "Scan parquet" not in p and "FileScan" not in p


def test_chunks_are_searched_for_the_commands_of_their_document(spark):
    chunked = [(1, 0, "Show version\nping 10.0.0.1"), (1, 1, "nothing here"), (2, 0, "show ip\nno x"), (2, 1, "NO X, show ip bgp"), (3, 0, "")]
    rows = [(1, 1, "show version"), (1, 2, "ping 10.0.0.1"), (1, 3, "show version"), (2, 1, "show ip"), (2, 2, "show ip bgp"), (2, 3, "no"), (2, 4, "absent command"), (3, 1, "x"), (2, 5, None)]
    c = spark.createDataFrame(chunked, "doc_id long, chunk_index int, text string")
    r = spark.createDataFrame(rows, "doc_id long, line_no int, raw string")
    want = {(1, 0, "show version", 2, 1), (1, 0, "ping 10.0.0.1", 1, 2), (2, 0, "show ip", 1, 1), (2, 1, "show ip", 1, 1), (2, 1, "show ip bgp", 1, 2), (2, 0, "no", 1, 3), (2, 1, "no", 1, 3)}
    for searched in (0, 3, 200):
        d = K.chunk_commands(c, r, searched)
        got = [tuple(x) for x in d.collect()]
        assert len(got) == len(want) and set(got) == want, searched
    assert "regexp_extract_all" not in plan(d)


def test_edges_of_devices_shuffle_the_lines_once(spark):
    from procflow.queries import operations

    got = operations._edges(spark, SF)
    assert plan(got).count("Exchange") == 1
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey")
    li.createOrReplaceTempView("edge_lines")
    want = spark.sql("SELECT a.l_suppkey AS src, b.l_suppkey AS dst FROM edge_lines a JOIN edge_lines b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1")
    spark.catalog.dropTempView("edge_lines")
    assert same(got, want)


def test_walks_meet_by_pages_as_by_rows(spark, monkeypatch):
    from procflow.operators import fleet, reach

    rng = random.Random(5)
    ids = [k * 97 - 20_000 for k in range(400)]  # three pages, one of them below 0
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(1500)] + [(ids[0], x) for x in ids] + [(ids[3], None), (None, ids[4]), (ids[5], ids[5])]
    edges, seeds = spark.createDataFrame(pairs, "src long, dst long"), spark.createDataFrame([(x,) for x in ids[::2]] + [(None,), (7,)], "node long")
    out = {}
    for s, d in pairs:
        out.setdefault(s, set()).add(d)
    out.pop(None)
    want = set()
    for s in [*ids[::2], None, 7]:
        seen, front = {s: 0}, {s}
        for k in (1, 2, 3):
            front = {d for f in front for d in out.get(f, ()) if d not in seen}
            seen |= dict.fromkeys(front, k)
        want |= {(s, node, d) for node, d in seen.items()}
    for gain, bits, nodes in ((0, 13, 10**6), (0, 10, 1), (10**9, 13, 10**6)):
        monkeypatch.setattr(reach, "GAIN", gain)
        monkeypatch.setattr(reach, "BLOCK_BITS", bits)
        monkeypatch.setattr(reach, "BLOCK_NODES", nodes)
        rows = [tuple(r) for r in fleet.discover(edges, seeds, 3).collect()]
        assert len(rows) == len(want) and set(rows) == want, (gain, bits)


def test_results_of_documents_make_steps_and_blocks_once(spark):
    from procflow.operators import artifacts as R
    from procflow.operators import checks as Q
    from procflow.queries import artifacts, documents

    d = artifacts.r09(spark, SF)
    p = plan(d)
    # the lines for the steps and for the blocks, the documents of the models and of the semi-join
    assert p.count("FileScan") <= 4 and p.count("Exchange hashpartitioning") <= 4
    docs, b, s = views.proc_docs(spark, SF), views.proc_blocks(spark, SF), views.proc_steps(spark, SF)
    n = s.groupBy("doc_id").count().withColumnRenamed("count", "n_steps")
    want = B.document_structure(docs, b).join(n, "doc_id", "left").join(Q.quality_score(s, documents.models(spark, SF)).select("doc_id", "score", "band"), "doc_id", "left")
    want = want.join(O.outlines(docs, b).select("doc_id", "raw_tokens", "outline_tokens", "ratio"), "doc_id").na.fill(0, ["n_steps"])
    assert same(d, want)


def test_lines_that_are_read_once_a_text_are_not_searched_by_row(spark):
    lines = views.proc_lines(spark, SF)
    d = G.extract_commands(lines, texts=lines.select("raw").distinct().localCheckpoint())
    p = d._jdf.queryExecution().optimizedPlan().toString()
    # the only filter is that of the texts; the lines are met by the join alone
    assert "Join Inner" in p and p.count("Filter ") == 1
