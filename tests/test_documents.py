"""Blocks, commands, steps, checks, outlines, chunks and responses on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from procflow.functions import commands as C
from procflow.functions import text as X
from procflow.operators import blocks as B
from procflow.operators import checks as Q
from procflow.operators import chunks as K
from procflow.operators import commands as G
from procflow.operators import outline as O
from procflow.operators import responses as J
from procflow.operators import steps as M
from procflow.operators import artifacts as R
from procflow.sources import documents as S
from procflow.sources import writers


def lines(spark, text, doc_id=1):
    return B.split_lines(spark.createDataFrame([(doc_id, text)], "doc_id long, text string"))


def parsed(spark, text):
    return [(r.block_type, r.content, r.level) for r in B.parse_blocks(lines(spark, text)).orderBy("block_no").collect()]


def test_blocks_of_every_kind(spark):
    text = "# Title\n## Part\n1. first\n1.2. deep\nStep 3 - third\n- bullet\n    indented\n```\na\nb\n```\nplain\n\n```\n```\n```\nlost"
    assert parsed(spark, text) == [("heading", "Title", 1), ("heading", "Part", 2), ("list_item", "first", 1), ("list_item", "deep", 2), ("list_item", "third", 1), ("list_item", "bullet", 1), ("code_block", "indented", 0), ("code_block", "a\nb", 0), ("paragraph", "plain", 0)]


def test_lines_of_every_break_and_empty_documents(spark):
    assert [r.raw for r in lines(spark, "a\r\nb\rc\n").orderBy("line_no").collect()] == ["a", "b", "c"]
    assert lines(spark, "").count() == 0 and lines(spark, None).count() == 0


@pytest.mark.parametrize(
    "raw,vendor,mode,protocol",
    [
        ("show ip bgp summary", "cisco", "exec", "bgp"),
        ("set routing-options autonomous-system 65001", "juniper", "config", None),
        ("PE1# show mpls ldp neighbor", "cisco", "exec", "mpls"),
        ("display ip routing-table", "huawei", "exec", None),
        ("tmsh show ltm virtual", "f5", "exec", "lb"),
        ("fw stat", "checkpoint", "exec", "firewall"),
        ("undo shutdown", "huawei", "config", "interface"),
        ("This is a description paragraph explaining what to do.", None, None, None),
        ("ab", None, None, None),
    ],
)
def test_commands(spark, raw, vendor, mode, protocol):
    r = G.classify(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (r.vendor, r.mode, r.protocol) == (vendor, mode, protocol)
    if vendor:
        assert "#" not in r.normalized and r.confidence == (1.0 if protocol else 0.9)


def test_is_command_agrees_with_classification(spark):
    rows = [(x,) for x in ("show x", "commit", "quit", "hello there", "## Show interfaces", "", "interface  ge-0", "tools dump", "copy a b")]
    d = G.classify(spark.createDataFrame(rows, "raw string").withColumn("is", C.is_command(F.col("raw"))))
    assert all(r["is"] == (r.vendor is not None) for r in d.collect())


def test_steps_and_quality(spark):
    text = "\n".join(["show ip bgp summary", "configure terminal", "router bgp 100", "no shutdown", "show ip bgp summary", "show version"])
    steps = M.build_steps(G.extract_commands(lines(spark, text)))
    rows = steps.orderBy("sequence").collect()
    assert [r.section for r in rows][0] == "Pre-checks" and any(r.is_rollback for r in rows)
    q = Q.quality_score(steps).first()
    assert 0 <= q.score <= 12 and q.band in ("LOW", "MEDIUM", "HIGH") and len(q.bar) == 20
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert M.with_placeholders(docs, steps).where("doc_id = 2").first().step_type == "info"
    g = {r.doc_id: r for r in Q.guardrails(docs, steps, G.command_counts(docs, G.extract_commands(lines(spark, text)))).collect()}
    assert g[1].passed and not g[2].passed and g[2].coverage is None


def test_text_rules(spark):
    one = lambda f, t: spark.createDataFrame([(t,)], "t string").select(f(F.col("t"))).first()[0]
    assert one(X.compress, "Please ensure that  the link is up , prior to work.") == "the link is up, before work."
    assert one(X.truncate, "a" * 100 + " " + "b" * 50) == "a" * 100 + "…"
    assert one(X.truncate, "a" * 50 + " " + "b" * 100) == ("a" * 50 + " " + "b" * 100)[:120] + "…"
    assert one(X.expectation, "Expected: all neighbors Established.") == "all neighbors Established"
    assert one(X.significance, "nothing here") == 0
    assert one(X.file_key, " Café (v2)!") == "Café__v2"
    assert one(R.must_contain, "state is 'Estab ok' and up") == ["Estab ok", "Up"]


def greedy(sizes, budget):
    out, total, g = [], 0, 1
    for n in sizes:
        if total > 0 and total + n > budget:
            g, total = g + 1, 0
        total += n
        out.append(g)
    return out


def test_greedy_packing_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(k, [rng.randint(1, 40) for _ in range(rng.randint(0, 30))]) for k in range(60)]
    d = spark.createDataFrame(rows, "k long, xs array<int>").select("xs", K.greedy_groups(F.col("xs"), 50).alias("g"))
    assert all(r.g == greedy(r.xs, 50) for r in d.collect())


def test_chunks_fit_their_budget_and_lose_nothing(spark):
    text = "\n".join(f"## Part {k}\n" + "\n".join(f"- item {k}.{i} with several words in it" for i in range(k * 4)) for k in range(1, 6))
    b = B.parse_blocks(lines(spark, text))
    c = K.chunks(b, 60).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in c] == list(range(len(c))) and all(r.total_chunks == len(c) for r in c)
    whole = "\n".join(r.text for r in c)
    assert all(f"item {k}.{i} with" in whole for k in range(1, 6) for i in range(k * 4))
    assert any("(continued 2)" in r.text for r in c)


def test_words_to_lines_against_a_loop(spark):
    rng = random.Random(2)
    words = [(1, 1 + k % 2, f"w{k}", float(rng.randint(0, 99)), float(rng.randint(0, 40))) for k in range(40)]
    got = B.page_words_to_lines(spark.createDataFrame(words, "doc_id long, page int, text string, x0 double, top double")).orderBy("page", "line_no").collect()
    for page in (1, 2):
        out, y = [], None
        for _, _, t, x0, top in sorted((w for w in words if w[1] == page), key=lambda w: (int(w[4] / 3 + 0.5), w[3], w[2])):
            if y is None or abs(top - y) > 3:
                out.append([])
                y = top
            out[-1].append(t)
        assert [r.text for r in got if r.page == page] == [" ".join(x) for x in out]


def test_tables(spark):
    rows = [(1, 1, "Step | Action | Expected | Rollback", 0), (1, 2, "1 | configure a | up | no a", 1), (1, 3, "2 |  | ok | ", 2)]
    d = spark.createDataFrame(rows, "doc_id long, block_no int, content string, row_index int")
    assert B.table_steps(d).orderBy("block_no").first().text == "Step 1: | configure a | Expected: up | Rollback: no a"
    n = O.table_nodes(d.selectExpr("*", "'table_row' AS block_type", "'Main' AS section", "1 AS section_index")).orderBy("block_no").collect()
    assert n[1].description == "configure a" and n[1].is_rollback  # merged cells take the value above


def test_responses(spark):
    raws = ["I cannot assist with this.", '```json\n{"steps": [{"description": "d"}]}\n```', 'x {"steps": []} y', "{broken", '{"a": 1}', None]
    d = J.parse_responses(spark.createDataFrame([(1, k, r, 10, 1) for k, r in enumerate(raws)], "doc_id long, chunk_index int, raw string, latency_ms long, attempts int"))
    assert [r.error for r in d.orderBy("chunk_index").collect()] == ["refusal", "ok", "ok", "json_parse_fail", "schema_violation", "json_parse_fail"]
    steps, docs = J.merge_chunks(d)
    assert steps.count() == 1 and docs.first().partial and docs.first().failed_chunks == [0, 3, 4, 5]


def test_files(spark, tmp_path):
    import zipfile

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "my_plan-one.txt").write_text("# A\nshow version\n")
    (tmp_path / "in" / "raw").write_bytes(b"a\x00b")
    (tmp_path / "in" / "p.dat").write_bytes(b"%PDF-1.4")
    with zipfile.ZipFile(tmp_path / "in" / "d.bin", "w") as z:
        z.writestr("word/document.xml", "x")
    texts, rest = S.read_documents(spark, str(tmp_path / "in"))
    assert texts.first().title == "My Plan One" and "show version" in texts.first().text
    assert sorted(r.source_format for r in rest.collect()) == ["docx", "pdf", "unsupported"]
    log = tmp_path / "d.log"
    log.write_text('{"execution_id": "a", "decision": "RETRY", "confidence": 1.0}\n\nnot json\n{"execution_id": "b", "decision": "ABORT"}\n')
    assert S.read_decisions(spark, str(log), "a").count() == 1
    writers.write_test_cases(spark.createDataFrame([("a", 'say "x", y')], "n string, t string"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).first().t == 'say "x", y'


def test_models_round_trip(spark, tmp_path):
    steps = M.build_steps(G.extract_commands(lines(spark, "show version\nconfigure terminal")))
    m = spark.createDataFrame([(1, "T", "t.txt", "txt", "abort")], "doc_id long, document_title string, source_file string, source_format string, failure_strategy string")
    writers.write_models(writers.models_with_steps(m, steps), str(tmp_path / "m"))
    back = S.model_steps(S.read_models(spark, str(tmp_path / "m")))
    assert back.count() == steps.count() and set(r.raw_text for r in back.collect()) == set(r.raw_text for r in steps.collect())


def test_commands_of_chunks_and_requests(spark):
    text = "## One\nshow version\nSHOW VERSION\n## Two\n" + "- words that fill the part until the budget is used up\n" * 6 + "commit\n"
    ls = lines(spark, text)
    b, cmds = B.parse_blocks(ls), G.extract_commands(ls)
    c = K.chunks(b, 40)
    got = {(r.chunk_index, r.raw): r.n for r in K.chunk_commands(c, cmds).collect()}
    whole = {r.chunk_index: r.text.lower() for r in c.collect()}
    want = {}
    for r in cmds.groupBy("raw").count().collect():
        for k, t in whole.items():
            if r.raw.lower() in t:
                want[(k, r.raw)] = r["count"]
    assert got == want and len(whole) > 1
    docs = spark.createDataFrame([(1, "my_plan.txt")], "doc_id long, source_file string")
    rq = K.requests(c, B.document_titles(docs, b), B.document_structure(docs, b), K.chunk_commands(c, cmds)).orderBy("chunk_index").collect()
    assert len(rq) == len(whole) and rq[0].request.startswith("Title: One\n") and "First step: 1" in rq[0].request and "show version" in rq[0].request


def test_formats_of_bytes(spark):
    from procflow.sources.documents import detect_format

    rows = [(b"\xff\xfe\xc3\x28 text", "x.dat"), (b"plain", "x.dat"), (b"a" * 511 + "é".encode() + b"b", "x.dat"), (b"a\x00b", "x"), (b"a" * 100 + b"\xc3", "x"), (b"%PDF-1.4", "x.txt"), (b"", "x")]
    got = [r[0] for r in spark.createDataFrame(rows, "c binary, p string").select(detect_format(F.col("c"), F.col("p"))).collect()]
    assert got == ["unsupported", "txt", "txt", "unsupported", "unsupported", "pdf", "txt"]


def test_dimensions_from_files(spark, tmp_path):
    from procflow.functions import patterns as P
    from procflow.sources import dimensions as D

    D.pattern_rows(spark, P.VENDORS).write.json(str(tmp_path / "p"))
    got = D.load_patterns(spark, str(tmp_path / "p"))
    assert list(got) == list(P.VENDORS) and got == P.VENDORS
    (tmp_path / "b").write_text('{"pattern_no": 2, "pattern": "^b"}\n\n{"pattern_no": 1, "pattern": "^a"}\n{"pattern_no": 3}\n')
    assert D.load_block_list(spark, str(tmp_path / "b")) == ("^a", "^b")
    (tmp_path / "d").write_text('{"device": "r1", "vendor": "cisco", "protocols": ["bgp"], "other": 1}\n{"vendor": "x"}\n')
    (row,) = D.read_inventory(spark, str(tmp_path / "d")).collect()
    assert (row.device, row.protocols, row.port) == ("r1", ["bgp"], None)
    spark.range(D.MOST + 1).selectExpr("cast(id AS int) AS pattern_no", "'x' AS pattern").write.json(str(tmp_path / "many"))
    with pytest.raises(ValueError):
        D.load_block_list(spark, str(tmp_path / "many"))


def test_models_one_a_line(spark, tmp_path):
    steps = M.build_steps(G.extract_commands(lines(spark, "show version", 1).unionByName(lines(spark, "commit", 2))))
    m = spark.createDataFrame([(1, "a.txt"), (2, "b.txt"), (3, "c.txt")], "doc_id long, source_file string")
    writers.write_models(writers.models_with_steps(m, steps).coalesce(1), str(tmp_path / "m"))
    models = S.read_models(spark, str(tmp_path / "m"), one_a_file=False)
    assert models.count() == 3 and sorted((r.source_file, r.raw_text) for r in S.model_steps(models).collect()) == [("a.txt", "show version"), ("b.txt", "commit")]
