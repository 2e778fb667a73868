"""Queries on artifacts, outlines, chunks and model responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from procflow.functions import patterns as P
from procflow.functions import text as X
from procflow.operators import artifacts as R
from procflow.operators import blocks as B
from procflow.operators import checks as Q
from procflow.operators import chunks as K
from procflow.operators import outline as O
from procflow.operators import responses as J
from procflow.queries import views as V
from procflow.queries.documents import _MODELS, SCORES, SECTIONS, STRUCTURES, TABLE_ROWS, models, table_rows
from procflow.queries.views import sql_squeeze, sql_strip, sql_text
from procflow.session import dealt, new_folder, table
from procflow.sources import writers

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_STATES = V.sql_list(P.STATE_KEYWORDS)


def _must(expected: str) -> str:
    quoted = f"regexp_extract_all(coalesce({expected}, ''), '[''\"]([^''\"]{{2,}})[''\"]', 1)"
    states = f"list_filter({_STATES}, lambda k: contains(lower(coalesce({expected}, '')), lower(k)))"
    return f"list_concat({quoted}, {states})"


# ---- rules and test cases ----
@query("r01_rules", f"WITH {V.STEPS} SELECT step_id, step_type, raw AS command, vendor, protocol, mode, confidence, is_rollback, array_to_string({_must('expected_output')}, '|') AS must_contain, 'Error|Invalid input|%' AS must_not_contain FROM steps")
def r01(spark, sf):
    return R.validation_rules(V.proc_steps(spark, sf)).select("step_id", "step_type", "command", "vendor", "protocol", "mode", "confidence", "is_rollback", F.array_join("must_contain", "|").alias("must_contain"), F.array_join("must_not_contain", "|").alias("must_not_contain"))


@query("r02_manual_rules", f"WITH {V.STEPS} SELECT step_id, CASE WHEN sequence % 2 = 0 THEN 'manual_verification' ELSE step_type END AS step_type FROM steps WHERE sequence % 2 = 1 OR step_type = 'verification'")
def r02(spark, sf):
    d = V.proc_steps(spark, sf).withColumn("commands", F.when(F.col("sequence") % 2 == 0, F.slice("commands", 1, 0)).otherwise(F.col("commands")))
    return R.validation_rules(d).select("step_id", "step_type")


_QUOTED = "text || ' expects ''' || lang || ''' and state is up or \"' || source || '\"'"


@query("r03_must_contain", f"SELECT doc_id, array_to_string(list_filter({_STATES}, lambda k: contains(lower({_QUOTED}), lower(k))), '|') AS states, len(regexp_extract_all({_QUOTED}, '[''\"]([^''\"]{{2,}})[''\"]', 1)) > 0 AS has_quotes, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all({_QUOTED}, '[''\"]([^''\"]{{2,}})[''\"]', 1), list_filter({_STATES}, lambda k: contains(lower({_QUOTED}), lower(k)))))), '|') AS all_sorted FROM documents")
def r03(spark, sf):
    d = table(spark, sf, "documents").withColumn("m", R.must_contain(F.concat(F.col("text"), F.lit(" expects '"), F.col("lang"), F.lit("' and state is up or \""), F.col("source"), F.lit('"'))))
    known = F.array(*map(F.lit, P.STATE_KEYWORDS))
    return d.select("doc_id", F.array_join(F.filter(known, lambda k: F.array_contains(F.col("m"), k)), "|").alias("states"), (F.size(F.array_except("m", known)) > 0).alias("has_quotes"), F.array_join(F.sort_array("m"), "|").alias("all_sorted"))


_ORDERED = "ordered AS (SELECT *, min(sequence) OVER (PARTITION BY doc_id, section) AS section_first FROM steps)"


@query("r04_test_cases", f"""WITH {V.STEPS}, {_MODELS}, {_ORDERED} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section_first, sequence, step_id) AS position, printf('TC-%03d', sequence) || ': ' || {sql_strip('substr(description, 1, 80)')} AS name,
  CASE WHEN is_rollback THEN 'Critical' WHEN step_type = 'verification' THEN 'High' ELSE 'Medium' END AS priority, array_to_string(list_concat(CASE WHEN list_contains(tags, step_type) THEN [] ELSE [step_type] END, tags), ', ') AS labels,
  CASE WHEN vendor <> 'generic' THEN vendor ELSE coalesce(protocol, '') END AS component, '/Procedures/' || {sql_strip("regexp_replace(document_title, '[^\\w\\s\\-]', '', 'g')")} || '/' || section AS folder FROM ordered JOIN models USING (doc_id)""")
def r04(spark, sf):
    return R.test_cases(V.proc_steps(spark, sf), models(spark, sf)).select("doc_id", "position", "name", "priority", "labels", "component", "folder")


@query("r05_test_case_steps", f"""WITH {V.STEPS} SELECT step_id, '[{{"step":' || to_json(raw) || ',"data":' || to_json(concat_ws(' | ', CASE WHEN vendor <> 'generic' THEN 'Vendor: ' || vendor END, 'Protocol: ' || protocol, 'Mode: ' || mode)) || ',"result":' || to_json(coalesce(expected_output, 'Command executes without errors.')) || '}}]' AS steps FROM steps""")
def r05(spark, sf):
    return V.proc_steps(spark, sf).select("step_id", R.test_case_steps().alias("steps"))


_VAR = r"array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(raw, '[^\w\s]', '', 'g'), '\s+'), lambda w: w <> '')[1:3], lambda w: lower(w)), '_')"


@query("r06_robot_cases", f"""WITH {V.STEPS} SELECT step_id, printf('Step_%03d', sequence) || ': ' || {sql_squeeze(r"regexp_replace(" + sql_strip("substr(description, 1, 70)") + r", '[^\w\s\-\.]', ' ', 'g')")} AS name,
  CASE WHEN section = 'Pre-checks' THEN 'BASELINE_' || upper({_VAR}) ELSE {_VAR} END AS variable, CASE WHEN section = 'Pre-checks' THEN 'baseline' ELSE 'run' END AS capture,
  concat_ws(',', CASE WHEN action_type = 'verify' AND expected_output IS NOT NULL THEN 'verify' END, CASE WHEN section = 'Verification' THEN 'compare' END, CASE WHEN action_type <> 'verify' AND section <> 'Pre-checks' THEN 'no_error' END) AS checks FROM steps WHERE NOT is_rollback""")
def r06(spark, sf):
    d = R.robot_cases(V.proc_steps(spark, sf))
    c = F.col("commands")[0]
    return d.select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("sequence").cast("string")).alias("step_id"), "name", c["variable"].alias("variable"), c["capture"].alias("capture"), F.array_join(c["checks"], ",").alias("checks"))


_E = lambda c: f"replace(replace(replace({c}, '\\', '\\\\'), '$', '\\$'), '@', '\\@')"
_L = lambda *parts: "concat_ws(chr(10), " + ", ".join(parts) + ")"
_NAME = f"printf('Step_%03d', sequence) || ': ' || " + sql_squeeze(r"regexp_replace(" + sql_strip("substr(description, 1, 70)") + r", '[^\w\s\-\.]', ' ', 'g')")
_BASE, _OUT_V = f"'${{BASELINE_' || upper({_VAR}) || '}}'", f"CASE WHEN section = 'Pre-checks' THEN '${{BASELINE_' || upper({_VAR}) || '}}' ELSE '${{' || {_VAR} || '}}' END"
_CASE = _L(
    f"CASE WHEN section IS DISTINCT FROM prev THEN chr(10) || {sql_text(R.RULE)} || chr(10) || '# Section: ' || section || chr(10) || {sql_text(R.RULE)} END",
    _NAME,
    "'    [Documentation]    ' || replace(description, '\\', '\\\\')",
    "'    [Tags]    ' || array_to_string(list_concat([step_type], list_filter(tags, lambda t: t <> step_type), list_filter([protocol], lambda x: x IS NOT NULL), list_filter([vendor], lambda x: x <> 'generic')), '    ') || CASE WHEN failure_strategy = 'continue' THEN '    robot:continue-on-failure' ELSE '' END",
    f"'    [Teardown]    Run Keyword If Test Failed    Log Step Failure    ' || {_E('substr(description, 1, 60)')}",
    f"'    ' || {_OUT_V} || '=    Execute CLI Command    ' || {_E('raw')}",
    f"CASE WHEN section = 'Pre-checks' THEN '    Set Suite Variable    ' || {_BASE} END",
    f"CASE WHEN action_type = 'verify' AND expected_output <> '' THEN '    Verify Command Output    ' || {_OUT_V} || '    ' || {_E('expected_output')} END",
    f"CASE WHEN section = 'Verification' THEN '    Compare With Baseline    ' || {_BASE} || '    ' || {_OUT_V} || '    ' || {_E('substr(raw, 1, 50)')} END",
    f"CASE WHEN action_type <> 'verify' AND section <> 'Pre-checks' THEN '    Verify No Device Error    ' || {_OUT_V} END",
    "''",
)


@query("r06_suite_text", f"""WITH {V.STEPS}, {_MODELS},
main AS (SELECT *, lag(section) OVER (PARTITION BY doc_id ORDER BY sequence) AS prev FROM steps JOIN models USING (doc_id) WHERE NOT is_rollback),
cases AS (SELECT doc_id, string_agg({_CASE}, chr(10) ORDER BY sequence) AS cases FROM main GROUP BY doc_id),
undo AS (SELECT doc_id, string_agg('    Log    Rollback: ' || {_E('substr(raw, 1, 60)')} || '    WARN' || chr(10) || '    Run Keyword And Continue On Failure    Execute CLI Command    ' || {_E('raw')}, chr(10) ORDER BY sequence DESC) AS undo FROM steps WHERE is_rollback GROUP BY doc_id)
SELECT doc_id, {_L("'*** Settings ***'", "'Documentation    Auto-generated Robot Framework tests for: ' || document_title", "'...              Source: ' || doc_id || '.' || source_format", "'...              MOP Structure: ' || source_format", "'...              Failure Strategy: ' || upper(failure_strategy)", *map(sql_text, R.SETTINGS), f"CASE WHEN failure_strategy IN ('rollback_all', 'rollback_group') AND undo IS NOT NULL THEN {sql_text(R.TEARDOWN_BACK)} ELSE {sql_text(R.TEARDOWN)} END")}
 || chr(10) || chr(10) || {_L("'*** Variables ***'", *map(sql_text, R.VARIABLES))} || chr(10) || chr(10) || {_L("'*** Test Cases ***'", "cases")}
 || chr(10) || chr(10) || chr(10) || '*** Keywords ***' || chr(10) || 'Library Keyword' || CASE WHEN undo IS NULL THEN '' ELSE chr(10) || chr(10) || {_L("'Execute Rollback Procedure'", "'    [Documentation]    Execute rollback steps in reverse order to restore network state.'", "'    ...                Called automatically by Suite Teardown on failure.'", "'    Log    ' || chr(92) || 'n==============================    WARN'", "'    Log    ROLLBACK PROCEDURE STARTING    WARN'", sql_text(R.INDENT + R.BACK_RULE), "undo", sql_text(R.INDENT + R.BACK_RULE), "'    Log    ROLLBACK PROCEDURE COMPLETE    WARN'", sql_text(R.INDENT + R.BACK_RULE))} END AS suite
FROM models LEFT JOIN cases USING (doc_id) LEFT JOIN undo USING (doc_id)""")
def r06_suite(spark, sf):
    m = models(spark, sf).withColumn("source_file", F.concat(F.lit("/in/"), F.col("doc_id").cast("string"), F.lit("."), "source_format")).withColumn("structure", F.col("source_format"))
    return R.suite_text(m, V.proc_steps(spark, sf), "Library Keyword")


@query("r07_rollback_script", f"WITH {V.STEPS} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sequence DESC) AS line_no, raw AS command FROM steps WHERE is_rollback")
def r07(spark, sf):
    return R.rollback_script(V.proc_steps(spark, sf))


@query("r08_dry_run_plan", f"""WITH {V.STEPS}, {_ORDERED} SELECT doc_id, 'plan' AS part, row_number() OVER (PARTITION BY doc_id ORDER BY section_first, sequence) AS line_no, section, raw AS command FROM ordered WHERE NOT is_rollback
  UNION ALL SELECT doc_id, 'rollback', row_number() OVER (PARTITION BY doc_id ORDER BY sequence DESC), 'Rollback', raw FROM steps WHERE is_rollback""")
def r08(spark, sf):
    return R.dry_run_plan(V.proc_steps(spark, sf))


@query("s07_rules_by_document", f"WITH {V.STEPS} SELECT doc_id, count(*) AS n_rules FROM steps GROUP BY doc_id")
def s07(spark, sf):
    return writers.rules_by_document(R.validation_rules(V.proc_steps(spark, sf)).select("doc_id", "step_sequence", "command")).select("doc_id", F.size("rules").cast("long").alias("n_rules"))


@query("s07_written_rules", f"WITH {V.STEPS} SELECT doc_id, sequence AS step_sequence, raw AS command, vendor, array_to_string({_must('expected_output')}, '|') AS must_contain FROM steps")
def s07_written(spark, sf):
    """Rules written as JSON, one line a document, and read back."""
    path = new_folder(spark, "rules")
    d = R.validation_rules(V.proc_steps(spark, sf)).select("doc_id", "step_sequence", "command", "vendor", F.array_join("must_contain", "|").alias("must_contain"))
    writers.write_rules(d, path)
    back = spark.read.schema(writers.rules_by_document(d).schema).json(path)
    return back.select("doc_id", F.explode("rules").alias("r")).select("doc_id", "r.*")


@query("s08_models_with_steps", f"WITH {V.STEPS}, {_MODELS}, n AS (SELECT doc_id, count(*) AS n FROM steps GROUP BY doc_id) SELECT doc_id, document_title, n AS n_steps FROM models JOIN n USING (doc_id)")
def s08(spark, sf):
    return writers.models_with_steps(models(spark, sf), V.proc_steps(spark, sf, V.line_texts(spark, sf))).where("steps is not null").select("doc_id", "document_title", F.size("steps").cast("long").alias("n_steps"))


# ---- outlines ----
def sql_compress(x: str) -> str:
    for p, to in P.FILLERS:
        x = f"regexp_replace({x}, {sql_text('(?i)' + p)}, {sql_text(to)}, 'g')"
    return rf"regexp_replace({sql_squeeze(x)}, '\s+([,.:;])', '\1', 'g')"


def sql_truncate(x: str, most: int = 120) -> str:
    head = f"substr({x}, 1, {most})"
    space = f"(length({head}) - strpos(reverse({head}), ' '))"
    return f"CASE WHEN length({x}) <= {most} THEN {x} WHEN strpos({head}, ' ') > 0 AND {space} > {most * 0.75} THEN substr({head}, 1, {space}) || '…' ELSE {head} || '…' END"


def sql_significance(x: str) -> str:
    return "(" + " + ".join(f"least({n}, len(regexp_extract_all({x}, {sql_text(p)})))" for n, p in P.SIGNIFICANCE) + ")"


def sql_expectation(x: str) -> str:
    vals = [f"rtrim({sql_strip(f'regexp_extract({x}, {sql_text(p)}, {g})')}, '.')" for p, g in P.EXPECTATIONS]
    return "coalesce(" + ", ".join(f"CASE WHEN length({v}) >= 5 THEN substr({v}, 1, 120) END" for v in vals) + ")"


@query("c01_compressed", f"WITH {V.LINES} SELECT doc_id, line_no, {sql_compress('raw')} AS text FROM lines")
def c01(spark, sf):
    return V.proc_lines(spark, sf).select("doc_id", "line_no", X.compress(F.col("raw")).alias("text"))


@query("c02_truncated", f"WITH t AS (SELECT doc_id, {sql_squeeze('text')} AS t FROM documents) SELECT doc_id, {sql_truncate('t')} AS text FROM t")
def c02(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.truncate(F.regexp_replace(F.regexp_replace("text", r"\s+", " "), r"^\s+|\s+$", "")).alias("text"))


@query("c03_significance", f"WITH {V.LINES} SELECT doc_id, line_no, {sql_significance('raw')} AS score FROM lines")
def c03(spark, sf):
    return V.proc_lines(spark, sf).select("doc_id", "line_no", X.significance(F.col("raw")).alias("score"))


@query("c04_expectations", f"WITH {V.LINES} SELECT doc_id, line_no, {sql_expectation('raw')} AS expected FROM lines")
def c04(spark, sf):
    return V.proc_lines(spark, sf).select("doc_id", "line_no", X.expectation(F.col("raw")).alias("expected"))


_ROUTE = "CASE WHEN structure IN ('numbered_list', 'bulleted_list', 'table') THEN 'outline' WHEN structure = 'mixed' THEN 'mixed' ELSE 'text' END"


@query("c05_routes", f"WITH {V.BLOCKS}, {STRUCTURES} SELECT doc_id, {_ROUTE} AS route FROM structures")
def c05(spark, sf):
    return B.block_counts(V.proc_blocks(spark, sf)).select("doc_id", O.route(B.structure_of(F.col)).alias("route"))


MODES = f"modes AS (SELECT doc_id, section_index, any_value(section) AS section, round(avg((block_type IN ('list_item', 'table_row', 'code_block'))::INT), 6) AS structured_share, CASE WHEN avg((block_type IN ('list_item', 'table_row', 'code_block'))::INT) >= 0.4 THEN 'outline' ELSE 'text' END AS mode, regexp_matches(any_value(section), {sql_text(P.ROLLBACK_SECTION)}) AS is_rollback FROM sections GROUP BY doc_id, section_index)"


@query("c06_section_modes", f"WITH {V.BLOCKS}, {SECTIONS}, {MODES} SELECT doc_id, section_index, structured_share, mode FROM modes")
def c06(spark, sf):
    return O.section_modes(V.proc_blocks(spark, sf)).select("doc_id", "section_index", "structured_share", "mode")


@query("c07_rollback_sections", f"WITH {V.BLOCKS}, {SECTIONS}, {MODES} SELECT doc_id, section_index, section, is_rollback FROM modes")
def c07(spark, sf):
    return O.section_modes(V.proc_blocks(spark, sf)).select("doc_id", "section_index", "section", "is_rollback")


# commands of each block: its lines, classified, joined in order
NODES = f"""{SECTIONS}, bl0 AS (SELECT doc_id, block_no, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS k FROM sections), {V.sql_commands('bl0', 'bcmds')},
bc AS (SELECT doc_id, block_no, string_agg(raw, ' ▸ ' ORDER BY k) AS commands, count(*) AS n FROM bcmds GROUP BY doc_id, block_no),
comp AS (SELECT s.*, coalesce(commands, '') AS commands, coalesce(n, 0) AS n_commands, {sql_compress('s.content')} AS cc FROM sections s LEFT JOIN bc USING (doc_id, block_no) WHERE block_type IN ('list_item', 'code_block', 'paragraph')),
nodes AS (SELECT doc_id, section_index, section, block_no, block_type, CASE WHEN block_type = 'code_block' THEN 'Execute ' || n_commands || ' command(s)' ELSE {sql_truncate('cc')} END AS description, commands, n_commands,
   CASE WHEN block_type <> 'code_block' THEN {sql_expectation('content')} END AS expected_output, regexp_matches(section, {sql_text(P.ROLLBACK_SECTION)}) AS is_rollback FROM comp
   WHERE CASE block_type WHEN 'list_item' THEN length({sql_truncate('cc')}) >= 5 WHEN 'code_block' THEN n_commands > 0 ELSE {sql_significance('content')} >= 1 END),
ids AS (SELECT *, 's' || section_index || '.' || row_number() OVER (PARTITION BY doc_id, section_index ORDER BY block_no) AS node_id FROM nodes)"""


@query("c08_nodes", f"WITH {V.BLOCKS}, {NODES} SELECT doc_id, block_no, block_type, description, commands, expected_output, is_rollback FROM nodes")
def c08(spark, sf):
    d = O.block_nodes(B.sections(V.proc_blocks(spark, sf)))
    return d.select("doc_id", "block_no", "block_type", "description", F.array_join("commands", " ▸ ").alias("commands"), "expected_output", "is_rollback")


_FF = lambda i: f"coalesce(last_value(nullif(cells[{i}], '') IGNORE NULLS) OVER w, '')"


@query("c09_table_nodes", f"""WITH {TABLE_ROWS}, c AS (SELECT doc_id, block_no, list_transform(string_split(content, ' | '), lambda x: trim(x)) AS cells FROM trows WHERE row_index > 0),
f AS (SELECT doc_id, block_no, {_FF(1)} AS c1, {_FF(2)} AS c2, {_FF(3)} AS c3, {_FF(4)} AS c4 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
n AS (SELECT doc_id, block_no, CASE doc_id % 4 WHEN 0 THEN c2 WHEN 1 THEN c2 WHEN 2 THEN c1 ELSE c1 END AS a0, CASE doc_id % 4 WHEN 0 THEN c3 WHEN 1 THEN c3 ELSE c2 END AS e0, CASE doc_id % 4 WHEN 0 THEN c4 WHEN 1 THEN c4 WHEN 2 THEN '' ELSE '' END AS r0,
  concat_ws(' | ', nullif(c1, ''), nullif(c2, ''), nullif(c3, ''), nullif(c4, '')) AS every FROM f)
SELECT doc_id, block_no, coalesce(nullif(a0, ''), every) AS description, coalesce(nullif(e0, ''), {sql_expectation("coalesce(nullif(a0, ''), every)")}) AS expected_output, r0 <> '' AS is_rollback, nullif(r0, '') AS rollback_command FROM n""")
def c09(spark, sf):
    rows = table_rows(spark, sf).withColumn("block_type", F.lit("table_row")).withColumn("section", F.lit("_preamble")).withColumn("section_index", F.lit(1))
    return O.table_nodes(rows).select("doc_id", "block_no", "description", "expected_output", "is_rollback", "rollback_command")


@query("c10_node_ids", f"WITH {V.BLOCKS}, {NODES} SELECT doc_id, block_no, node_id FROM ids")
def c10(spark, sf):
    return O.node_ids(O.block_nodes(B.sections(V.proc_blocks(spark, sf)))).select("doc_id", "block_no", "node_id")


@query("c11_document_commands", f"WITH {V.BLOCKS}, {NODES}, x AS (SELECT b.doc_id, b.raw, min(b.block_no * 1000 + b.k) AS pos FROM bcmds b SEMI JOIN nodes n ON b.doc_id = n.doc_id AND b.block_no = n.block_no GROUP BY b.doc_id, b.raw) SELECT doc_id, string_agg(raw, '|' ORDER BY pos) AS commands FROM x GROUP BY doc_id")
def c11(spark, sf):
    return O.document_commands(O.block_nodes(B.sections(V.proc_blocks(spark, sf)))).select("doc_id", F.array_join("commands", "|").alias("commands"))


_LINE = "'[' || node_id || '] ' || description || CASE WHEN n_commands > 0 THEN ' | CMD: ' || commands ELSE '' END || CASE WHEN expected_output IS NOT NULL THEN ' | EXPECT: ' || expected_output ELSE '' END || CASE WHEN is_rollback AND NOT starts_with(lower(section), 'rollback') THEN ' | [ROLLBACK]' ELSE '' END"
OUTLINES = f"""{NODES}, {STRUCTURES}, {MODES}, m2 AS (SELECT m.*, CASE WHEN {_ROUTE} = 'mixed' THEN mode ELSE {_ROUTE} END AS md, {_ROUTE} AS route FROM modes m JOIN structures USING (doc_id)),
body AS (SELECT doc_id, section_index, 'outline' AS md, string_agg({_LINE}, chr(10) ORDER BY block_no) AS body FROM ids GROUP BY doc_id, section_index UNION ALL SELECT doc_id, section_index, 'text', string_agg('  ' || content, chr(10) ORDER BY block_no) FROM sections GROUP BY doc_id, section_index),
parts2 AS (SELECT m2.doc_id, m2.section_index, route, concat_ws(chr(10), 'SECTION: ' || section || CASE WHEN is_rollback THEN '  [ROLLBACK]' ELSE '' END, body) AS part FROM m2 LEFT JOIN body USING (doc_id, section_index, md)),
whole AS (SELECT doc_id, any_value(route) AS route, string_agg(part, chr(10) ORDER BY section_index) AS outline FROM parts2 GROUP BY doc_id),
sizes AS (SELECT doc_id, greatest(1, floor(sum(length(content) + 1) / 3.5)::INT) AS raw_tokens FROM blocks GROUP BY doc_id),
o1 AS (SELECT doc_id, coalesce(route, 'text') AS route, CASE WHEN coalesce(route, 'text') = 'text' THEN '' ELSE outline END AS outline, raw_tokens FROM sizes LEFT JOIN whole USING (doc_id)),
outlines AS (SELECT *, greatest(1, floor(length(outline) / 3.5)::INT) AS outline_tokens, CASE WHEN route = 'text' THEN 0.0 ELSE round(greatest(0.0, 1 - greatest(1, floor(length(outline) / 3.5)::INT)::DOUBLE / raw_tokens), 3) END AS ratio FROM o1)"""


@query("c12_ratios", f"WITH {V.BLOCKS}, {OUTLINES} SELECT doc_id, route, raw_tokens, outline_tokens, ratio FROM outlines")
def c12(spark, sf):
    return O.outlines(V.proc_docs(spark, sf), V.proc_blocks(spark, sf)).select("doc_id", "route", "raw_tokens", "outline_tokens", "ratio")


@query("c13_outlines", f"WITH {V.BLOCKS}, {OUTLINES} SELECT doc_id, outline FROM outlines")
def c13(spark, sf):
    texts = V.line_texts(spark, sf)
    return O.outlines(V.proc_docs(spark, sf), V.proc_blocks(spark, sf, texts), V.block_texts(texts)).select("doc_id", "outline")


# ---- outlines of documents with tables: a part's lines, then the rows of the order of that number ----
def table_blocks(spark, sf, texts=None):
    """Blocks of documents by part, each followed by the table of the order of that number, if there is one."""
    text = V.proc_blocks(spark, sf, texts).withColumn("row_index", F.lit(None).cast("int"))
    rows = table_rows(spark, sf).join(V.proc_docs(spark, sf), "doc_id", "left_semi")
    rows = rows.select("doc_id", (F.col("block_no") + 1000).cast("int").alias("block_no"), F.lit("table_row").alias("block_type"), "content", F.lit(0).alias("level"), F.col("row_index").cast("int").alias("row_index"))
    return dealt(text.unionByName(rows), "doc_id", rows=2 * table(spark, sf, "lineitem").count())


TABLE_BLOCKS = (
    V.BLOCKS.replace("\nblocks AS (", "\ntext_blocks AS (")
    + f""", {TABLE_ROWS}, blocks AS (SELECT doc_id, block_no, block_type, content, level, NULL::INT AS row_index FROM text_blocks
  UNION ALL SELECT doc_id, 1000 + block_no, 'table_row', content, 0, row_index FROM trows WHERE doc_id IN (SELECT doc_id FROM lines))"""
)
# nodes of rows as in c09, with the section that they stand in
_TABLE_NODES = f"""tc AS (SELECT doc_id, section_index, section, block_no, list_transform(string_split(content, ' | '), lambda x: trim(x)) AS cells FROM sections WHERE block_type = 'table_row' AND row_index > 0),
tf AS (SELECT doc_id, section_index, section, block_no, {_FF(1)} AS c1, {_FF(2)} AS c2, {_FF(3)} AS c3, {_FF(4)} AS c4 FROM tc WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
tn AS (SELECT *, CASE WHEN doc_id % 4 < 2 THEN c2 ELSE c1 END AS a0, CASE WHEN doc_id % 4 < 2 THEN c3 ELSE c2 END AS e0, CASE WHEN doc_id % 4 < 2 THEN c4 ELSE '' END AS r0, concat_ws(' | ', nullif(c1, ''), nullif(c2, ''), nullif(c3, ''), nullif(c4, '')) AS every FROM tf),
tnodes AS (SELECT doc_id, section_index, section, block_no, 'table_row' AS block_type, {sql_compress("coalesce(nullif(a0, ''), every)")} AS description, '' AS commands, 0 AS n_commands,
  coalesce(nullif(e0, ''), {sql_expectation("coalesce(nullif(a0, ''), every)")}) AS expected_output, r0 <> '' OR regexp_matches(section, {sql_text(P.ROLLBACK_SECTION)}) AS is_rollback FROM tn)"""
TABLE_OUTLINES = OUTLINES.replace("ids AS (SELECT *,", _TABLE_NODES + ",\nids AS (SELECT *,").replace("AS node_id FROM nodes)", "AS node_id FROM (SELECT * FROM nodes UNION ALL SELECT * FROM tnodes))")


@query("c10_table_node_ids", f"WITH {TABLE_BLOCKS}, {TABLE_OUTLINES} SELECT doc_id, block_no, node_id FROM ids")
def c10_tables(spark, sf):
    texts = V.line_texts(spark, sf)
    return O.outline_nodes(B.sections(table_blocks(spark, sf, texts)), V.block_texts(texts)).select("doc_id", "block_no", "node_id")


@query("c12_table_ratios", f"WITH {TABLE_BLOCKS}, {TABLE_OUTLINES} SELECT doc_id, route, raw_tokens, outline_tokens, ratio FROM outlines")
def c12_tables(spark, sf):
    return O.outlines(V.proc_docs(spark, sf), table_blocks(spark, sf)).select("doc_id", "route", "raw_tokens", "outline_tokens", "ratio")


@query("c13_table_outlines", f"WITH {TABLE_BLOCKS}, {TABLE_OUTLINES} SELECT doc_id, outline FROM outlines")
def c13_tables(spark, sf):
    return O.outlines(V.proc_docs(spark, sf), table_blocks(spark, sf)).select("doc_id", "outline")


@query("c14_compression_report", f"WITH {V.BLOCKS}, {OUTLINES} SELECT structure, count(*) AS n_docs, count(*) FILTER (WHERE route <> 'text') AS n_outlined, sum(raw_tokens)::BIGINT AS raw_tokens, sum(outline_tokens)::BIGINT AS outline_tokens, round(avg(ratio) FILTER (WHERE route <> 'text'), 4) AS mean_ratio FROM outlines JOIN structures USING (doc_id) GROUP BY structure")
def c14(spark, sf):
    b = V.proc_blocks(spark, sf)
    return O.compression_report(O.outlines(V.proc_docs(spark, sf), b), B.document_structure(V.proc_docs(spark, sf), b))


# ---- chunks ----
_PART = "CASE block_type WHEN 'heading' THEN chr(10) || '## ' || content || chr(10) WHEN 'list_item' THEN repeat('  ', greatest(0, level - 1)::BIGINT) || '- ' || content WHEN 'table_row' THEN '| ' || content || ' |' WHEN 'code_block' THEN '    ' || content ELSE content END"
KSEC = f"""ks0 AS (SELECT *, block_type = 'heading' AND level <= 2 AS starts, {_PART} AS part FROM blocks),
ks AS (SELECT *, sum(starts::INT) OVER w AS section_no, coalesce(last_value(CASE WHEN starts THEN content END IGNORE NULLS) OVER w, '_preamble') AS section FROM ks0 WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
stexts AS (SELECT doc_id, section_no::BIGINT AS section_no, any_value(section) AS section, string_agg(part, chr(10) ORDER BY block_no) AS text, greatest(1, floor(length(string_agg(part, chr(10) ORDER BY block_no)) / 3.5)::INT) AS n_tokens FROM ks WHERE part <> '' GROUP BY doc_id, section_no)"""
BUDGET = 150


@query("k01_tokens", "SELECT doc_id, greatest(1, floor(length(text) / 3.5)::INT) AS n_tokens FROM documents")
def k01(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.tokens(F.col("text")).alias("n_tokens"))


@query("k02_needs_chunking", "SELECT doc_id, greatest(1, floor(length(text) / 3.5)::INT) > 1000 AS chunked FROM documents")
def k02(spark, sf):
    return table(spark, sf, "documents").select("doc_id", K.needs_chunking(X.tokens(F.col("text")), 1000).alias("chunked"))


@query("k03_section_texts", f"WITH {V.BLOCKS}, {KSEC} SELECT * FROM stexts")
def k03(spark, sf):
    return K.section_texts(V.proc_blocks(spark, sf))


def _reduce(xs: str, budget: int) -> str:
    """Greedy groups in SQL: a list of (o, n, s, g) folded to a list of groups."""
    return f"""list_reduce(list_prepend(struct_pack(o := [0]::BIGINT[], n := 0::BIGINT, s := 0::BIGINT, g := 1::BIGINT, gs := []::BIGINT[]), {xs}),
      lambda a, x: struct_pack(o := a.o, n := x.n, s := CASE WHEN a.s > 0 AND a.s + x.n > {budget} THEN x.n ELSE a.s + x.n END, g := CASE WHEN a.s > 0 AND a.s + x.n > {budget} THEN a.g + 1 ELSE a.g END, gs := list_append(a.gs, CASE WHEN a.s > 0 AND a.s + x.n > {budget} THEN a.g + 1 ELSE a.g END))).gs"""


_XS = "list(struct_pack(o := [section_no]::BIGINT[], n := n_tokens::BIGINT, s := 0::BIGINT, g := 0::BIGINT, gs := []::BIGINT[]) ORDER BY section_no)"
PACKED = f"pk AS (SELECT doc_id, list(section_no ORDER BY section_no) AS os, {_reduce(_XS, BUDGET)} AS gs FROM stexts GROUP BY doc_id), packed AS (SELECT doc_id, unnest(os) AS section_no, unnest(gs)::INT AS group_no FROM pk)"


@query("k05_packed", f"WITH {V.BLOCKS}, {KSEC}, {PACKED} SELECT * FROM packed")
def k05(spark, sf):
    return K.pack(K.section_texts(V.proc_blocks(spark, sf)), "section_no", "n_tokens", BUDGET)


def _pieces(budget: int) -> str:
    """Sections cut between blocks where they are over the budget, as text with their tokens."""
    xs = "list(struct_pack(o := []::BIGINT[], n := n::BIGINT, s := 0::BIGINT, g := 0::BIGINT, gs := []::BIGINT[]) ORDER BY block_no)"
    return f"""kp AS (SELECT doc_id, section_no::BIGINT AS section_no, section, block_no, part, greatest(1, floor(length(part) / 3.5)::INT) AS n, floor(sum(length(part) + 1) OVER (PARTITION BY doc_id, section_no) / 3.5) > {budget} AS big FROM ks WHERE part <> ''),
cut AS (SELECT doc_id, section_no, list(block_no ORDER BY block_no) AS os, {_reduce(xs, budget)} AS gs FROM kp WHERE big GROUP BY doc_id, section_no),
cuts AS (SELECT doc_id, section_no, unnest(os) AS block_no, unnest(gs) AS piece FROM cut),
pc AS (SELECT doc_id, section_no, coalesce(piece, 1)::INT AS piece, any_value(section) AS name, string_agg(part, chr(10) ORDER BY block_no) AS body FROM kp LEFT JOIN cuts USING (doc_id, section_no, block_no) GROUP BY doc_id, section_no, coalesce(piece, 1)),
pn AS (SELECT *, CASE WHEN piece > 1 THEN name || ' (continued ' || piece || ')' ELSE name END AS section FROM pc),
pt AS (SELECT doc_id, section_no, piece, section, CASE WHEN piece > 1 AND section_no > 0 THEN chr(10) || '## ' || section || chr(10) || chr(10) || body ELSE body END AS text FROM pn),
pieces AS (SELECT *, greatest(1, floor(length(text) / 3.5)::INT) AS n_tokens, row_number() OVER (PARTITION BY doc_id ORDER BY section_no, piece) AS place FROM pt)"""


CHUNKS = f"""{KSEC}, {_pieces(BUDGET)},
cg AS (SELECT doc_id, list(place ORDER BY place) AS os, {_reduce("list(struct_pack(o := []::BIGINT[], n := n_tokens::BIGINT, s := 0::BIGINT, g := 0::BIGINT, gs := []::BIGINT[]) ORDER BY place)", BUDGET)} AS gs FROM pieces GROUP BY doc_id),
cp AS (SELECT doc_id, unnest(os) AS place, unnest(gs) AS group_no FROM cg),
cj AS (SELECT doc_id, (group_no - 1)::INT AS chunk_index, list(section ORDER BY place) FILTER (WHERE section <> '_preamble') AS headings, string_agg(text, chr(10) || chr(10) ORDER BY place) AS text FROM pieces JOIN cp USING (doc_id, place) GROUP BY doc_id, group_no),
chunks AS (SELECT doc_id, chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, headings, text, greatest(1, floor(length(text) / 3.5)::INT) AS n_tokens FROM cj)"""
CHUNK_COMMANDS = f"""{V.sql_commands("lines")},
cn AS (SELECT doc_id, raw, count(*) AS n, min(line_no) AS first_line FROM cmds GROUP BY doc_id, raw),
cc AS (SELECT doc_id, chunk_index, raw, n, first_line FROM chunks JOIN cn USING (doc_id) WHERE contains(lower(text), lower(raw)))"""


@query("k04_split_sections", f"WITH {V.BLOCKS}, {KSEC}, {_pieces(60)} SELECT * EXCLUDE (place) FROM pieces")
def k04(spark, sf):
    return K.split_oversized(V.proc_blocks(spark, sf), 60)


@query("k06_chunks", f"WITH {V.BLOCKS}, {CHUNKS} SELECT * REPLACE (coalesce(array_to_string(headings, ' > '), '') AS headings) FROM chunks")
def k06(spark, sf):
    return K.chunks(V.proc_blocks(spark, sf), BUDGET).withColumn("headings", F.array_join("headings", " > "))


@query("k07_chunk_commands", f"WITH {V.BLOCKS}, {CHUNKS}, {CHUNK_COMMANDS} SELECT * FROM cc")
def k07(spark, sf):
    texts = V.line_texts(spark, sf)
    return K.chunk_commands(K.chunks(V.proc_blocks(spark, sf, texts), BUDGET), V.proc_commands(spark, sf, texts))


@query("k08_requests", f"""WITH {V.BLOCKS}, {CHUNKS}, {CHUNK_COMMANDS}, {STRUCTURES}, titles AS (SELECT doc_id, arg_min(content, block_no) AS title FROM blocks WHERE block_type = 'heading' AND content <> '' GROUP BY doc_id),
first50 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY first_line, raw) AS place FROM cc QUALIFY place <= 50),
hints AS (SELECT doc_id, chunk_index, string_agg(raw, '; ' ORDER BY place) AS hints FROM first50 GROUP BY doc_id, chunk_index)
SELECT doc_id, chunk_index, concat_ws(chr(10), 'Title: ' || coalesce(title, 'Part'), 'Structure: ' || coalesce(structure, 'unknown'), 'Part: ' || CASE WHEN len(headings) > 0 THEN array_to_string(headings, ' → ') ELSE 'Document' END, 'First step: 1', 'Commands seen: ' || hints, '---', text) AS request
FROM chunks LEFT JOIN titles USING (doc_id) LEFT JOIN structures USING (doc_id) LEFT JOIN hints USING (doc_id, chunk_index)""")
def k08(spark, sf):
    texts = V.line_texts(spark, sf)
    b = V.proc_blocks(spark, sf, texts)
    c = K.chunks(b, BUDGET)
    docs = V.proc_docs(spark, sf)
    titles = B.document_titles(docs.withColumn("source_file", F.lit("part.txt")), b)
    return K.requests(c, titles, B.document_structure(docs, b), K.chunk_commands(c, V.proc_commands(spark, sf, texts)))


@query("k09_processing_routes", f"WITH {V.BLOCKS}, {OUTLINES} SELECT doc_id, CASE WHEN route <> 'text' THEN 'outline' WHEN raw_tokens > 200 THEN 'chunked' ELSE 'single' END AS processing FROM outlines")
def k09(spark, sf):
    return O.outlines(V.proc_docs(spark, sf), V.proc_blocks(spark, sf)).select("doc_id", K.processing_route(F.col("route"), F.col("raw_tokens"), 200).alias("processing"))


@query("c15_packed_outline", f"WITH {V.BLOCKS}, {OUTLINES}, stexts2 AS (SELECT doc_id, section_index AS section_no, greatest(1, floor(length(part) / 3.5)::INT) AS n_tokens FROM parts2), pk AS (SELECT doc_id, list(section_no ORDER BY section_no) AS os, {_reduce(_XS, 60)} AS gs FROM stexts2 GROUP BY doc_id) SELECT doc_id, unnest(os)::INT AS section_index, unnest(gs)::INT AS group_no FROM pk")
def c15(spark, sf):
    """Outline sections packed by budget."""
    texts = V.line_texts(spark, sf)
    parts = O.outline_sections(V.proc_blocks(spark, sf, texts), V.block_texts(texts)).withColumn("n", X.tokens(F.col("part")))
    return K.pack(parts, "section_index", "n", 60)


# ---- responses: the turns of conversations, wrapped as a model would ----
_RAW = """CASE turn % 6 WHEN 0 THEN 'I cannot assist with this. ' || substr(text, 1, 20) WHEN 1 THEN '```json' || chr(10) || '{"document_title": "c' || conv_id || '", "steps": [{"description": "d' || turn || '", "step_type": "verification", "commands": [{"raw": "show version"}, {"raw": " "}]}, {"sequence": 7, "step_type": "odd", "is_rollback": true}]}' || chr(10) || '```'
  WHEN 2 THEN 'Here it is: {"steps": [{"description": "x", "commands": [{"raw": "no shutdown", "vendor": "cisco", "confidence": 0.5}]}]} and that is all' WHEN 3 THEN '{"title": "no steps"}' WHEN 4 THEN 'Sorry { not json' ELSE '{"steps": []}' END"""
RESP = f"resp AS (SELECT conv_id AS doc_id, turn::INT AS chunk_index, {_RAW} AS raw, 100 + length(text) AS latency_ms, 1 + turn % 3 AS attempts, turn % 6 AS k FROM conversations)"


def _responses(spark, sf):
    c = table(spark, sf, "conversations")
    raw = F.expr(_RAW.replace("chr(10)", "char(10)"))
    return c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("chunk_index"), raw.alias("raw"), (F.length("text") + 100).cast("long").alias("latency_ms"), (F.col("turn") % 3 + 1).alias("attempts"))


_ERR = "CASE k WHEN 0 THEN 'refusal' WHEN 3 THEN 'schema_violation' WHEN 4 THEN 'json_parse_fail' ELSE 'ok' END"


@query("j01_refusals", f"WITH {RESP} SELECT doc_id, chunk_index, NOT contains(raw, '{{') AND ({' OR '.join(f'contains(lower(substr(raw, 1, 300)), {sql_text(p)})' for p in P.REFUSALS)}) AS refusal FROM resp")
def j01(spark, sf):
    return _responses(spark, sf).select("doc_id", "chunk_index", J.looks_like_refusal(F.col("raw")).alias("refusal"))


_CLEAN = rf"regexp_replace(regexp_replace({sql_strip('raw')}, '(?i)^```(?:json)?\s*', ''), '\s*```\s*$', '')"
_BLOCK = rf"regexp_extract({_CLEAN}, '(?s)(\{{.+\}})', 1)"


@query("j02_json", f"WITH {RESP} SELECT doc_id, chunk_index, CASE WHEN json_valid({_CLEAN}) THEN {_CLEAN} WHEN {_BLOCK} <> '' AND json_valid({_BLOCK}) THEN {_BLOCK} WHEN json_valid(raw) THEN raw END AS json FROM resp")
def j02(spark, sf):
    return _responses(spark, sf).select("doc_id", "chunk_index", J.extract_json(F.col("raw")).alias("json"))


@query("j03_errors", f"WITH {RESP} SELECT doc_id, chunk_index, {_ERR} AS error, CASE WHEN k = 0 THEN substr(raw, 1, 500) WHEN k IN (3, 4) THEN substr(raw, 1, 1000) END AS evidence FROM resp")
def j03(spark, sf):
    return J.parse_responses(_responses(spark, sf)).select("doc_id", "chunk_index", "error", "evidence")


@query("j04_steps", f"""WITH {RESP} SELECT doc_id, chunk_index, 0 AS pos, 1 AS sequence, 'verification' AS step_type, 'd' || chunk_index AS description, false AS is_rollback, 'show version/generic/0.9' AS commands FROM resp WHERE k = 1
  UNION ALL SELECT doc_id, chunk_index, 1, 7, 'action', '', true, '' FROM resp WHERE k = 1 UNION ALL SELECT doc_id, chunk_index, 0, 1, 'action', 'x', false, 'no shutdown/cisco/0.5' FROM resp WHERE k = 2""")
def j04(spark, sf):
    d = J.response_steps(J.parse_responses(_responses(spark, sf)))
    return d.select("doc_id", "chunk_index", "pos", "sequence", "step_type", "description", "is_rollback", F.array_join(F.transform("commands", lambda c: F.concat_ws("/", c["raw"], c["vendor"], c["confidence"].cast("string"))), ",").alias("commands"))


@query("j05_merged", f"WITH {RESP} SELECT doc_id, count(*) AS n_chunks, coalesce(string_agg(chunk_index::VARCHAR, ',' ORDER BY chunk_index) FILTER (WHERE k IN (0, 3, 4)), '') AS failed, sum(latency_ms)::BIGINT AS latency_ms, sum(attempts)::BIGINT AS attempts, count(*) FILTER (WHERE k IN (0, 3, 4)) < count(*) AS success, count(*) FILTER (WHERE k IN (0, 3, 4)) BETWEEN 1 AND count(*) - 1 AS partial FROM resp GROUP BY doc_id")
def j05(spark, sf):
    _, g = J.merge_chunks(J.parse_responses(_responses(spark, sf)))
    return g.select("doc_id", "n_chunks", F.array_join(F.transform("failed_chunks", lambda x: x.cast("string")), ",").alias("failed"), "latency_ms", "attempts", "success", "partial")


@query("j05_merged_steps", f"WITH {RESP}, s AS (SELECT doc_id, chunk_index, unnest(CASE k WHEN 1 THEN [0, 1] ELSE [0] END) AS pos FROM resp WHERE k IN (1, 2)) SELECT doc_id, chunk_index, pos, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index, pos) AS sequence FROM s")
def j05b(spark, sf):
    steps, _ = J.merge_chunks(J.parse_responses(_responses(spark, sf)))
    return steps.select("doc_id", "chunk_index", "pos", "sequence")


@query("j06_sequence_starts", f"WITH {RESP} SELECT doc_id, chunk_index, 1 + coalesce(sum(CASE k WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sequence_start FROM resp")
def j06(spark, sf):
    return J.sequence_starts(J.parse_responses(_responses(spark, sf)))


@query("r09_document_results", f"WITH {V.STEPS.replace('numbered AS', 'numbered0 AS').replace('FROM numbered)', 'FROM numbered0)')}, {_MODELS}, {SCORES}, {V.BLOCKS.replace('lines AS', 'lines2 AS', 1).replace('FROM lines)', 'FROM lines2)', 1)}, {OUTLINES.replace('bcmds', 'bcm')}, n AS (SELECT doc_id, count(*) AS n_steps FROM steps GROUP BY doc_id) SELECT st.doc_id, structure, coalesce(n_steps, 0) AS n_steps, score, band, raw_tokens, outline_tokens, ratio FROM structures st LEFT JOIN n USING (doc_id) LEFT JOIN scores USING (doc_id) LEFT JOIN outlines USING (doc_id)")
def r09(spark, sf):
    texts = V.line_texts(spark, sf)
    b, s = V.proc_blocks(spark, sf, texts), V.proc_steps(spark, sf, texts)
    return R.document_results(Q.quality_score(s, models(spark, sf)), O.outlines(V.proc_docs(spark, sf), b, V.block_texts(texts), structure=True))
