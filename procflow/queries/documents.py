"""Queries on documents, blocks, commands, steps and their checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from procflow.functions import commands as C
from procflow.functions import patterns as P
from procflow.functions import text as X
from procflow.operators import blocks as B
from procflow.operators import checks as Q
from procflow.operators import commands as G
from procflow.operators import steps as M
from procflow.queries import views as V
from procflow.queries.views import sql_strip, sql_text
from procflow.session import dealt, table
from procflow.sources import documents as S

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# ---- sources ----
_PATHS = "'/in/' || coalesce(source, '') || '_' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.pdf' WHEN 3 THEN '' ELSE '.bin' END"
_HEADS = "CASE doc_id % 7 WHEN 0 THEN '%PDF-1.7 ' WHEN 1 THEN 'PK' || chr(3) || chr(4) ELSE '' END || text"


@query("s02_detect_format", f"""
WITH f AS (SELECT doc_id, lower({_PATHS}) AS path, {_HEADS} AS content FROM documents)
SELECT doc_id, CASE WHEN starts_with(content, '%PDF') THEN 'pdf' WHEN starts_with(content, 'PK' || chr(3) || chr(4)) THEN 'zip'
  WHEN regexp_matches(path, '\\.pdf$') THEN 'pdf' WHEN regexp_matches(path, '\\.docx$') THEN 'docx' WHEN regexp_matches(path, '\\.(txt|md|text|log)$') THEN 'txt'
  WHEN regexp_matches(path, '\\.(bin|exe|dll|so|zip|gz|tar|jpg|jpeg|png|gif|bmp|mp3|mp4|xls|xlsx|ppt|pptx|doc)$') THEN 'unsupported' ELSE 'txt' END AS format FROM f""")
def s02(spark, sf):
    d = table(spark, sf, "documents")
    f = d.select("doc_id", F.expr(_PATHS).alias("path"), F.encode(F.expr(_HEADS.replace("chr(3)", "char(3)").replace("chr(4)", "char(4)")), "utf-8").alias("content"))
    return f.select("doc_id", S.detect_format(F.col("content"), F.col("path")).alias("format"))


@query("s03_titles", f"WITH {V.BLOCKS}, h AS (SELECT doc_id, arg_min(content, block_no) AS title FROM blocks WHERE block_type = 'heading' AND content <> '' GROUP BY doc_id), {V.DOCS} SELECT doc_id, coalesce(title, 'Part ' || doc_id) AS title FROM docs LEFT JOIN h USING (doc_id)")
def s03(spark, sf):
    docs = V.proc_docs(spark, sf).withColumn("source_file", F.concat(F.lit("/in/part_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return B.document_titles(docs, V.proc_blocks(spark, sf))


@query("s10_file_keys", r"SELECT p_partkey AS part, regexp_replace(regexp_replace(p_name || ' (v' || p_partkey || ')', '[^\w\-]', '_', 'g'), '^_+|_+$', '', 'g') AS file_key FROM part")
def s10(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("part"), X.file_key(F.concat("p_name", F.lit(" (v"), F.col("p_partkey").cast("string"), F.lit(")"))).alias("file_key"))


# ---- documents to blocks ----
@query("t01_lines", r"""
WITH x AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '(?:\r\n|\n|\r)$', ''), '\r\n|\n|\r')) AS raw FROM documents WHERE length(text) > 0)
SELECT doc_id, count(*) AS n_lines, sum(length(raw))::BIGINT AS n_chars FROM x GROUP BY doc_id""")
def t01(spark, sf):
    return B.split_lines(table(spark, sf, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("raw")).alias("n_chars"))


@query("t02_fences", f"WITH {V.BLOCKS} SELECT doc_id, line_no, fence_no::BIGINT AS fence_no, (fence_no % 2 = 1 AND NOT is_fence) AS in_fence, last_fence > fence_no AS closed FROM lasts")
def t02(spark, sf):
    return B.fence_state(V.proc_lines(spark, sf)).select("doc_id", "line_no", "fence_no", "in_fence", "closed")


@query("t03_blocks", f"WITH {V.BLOCKS} SELECT * FROM blocks")
def t03(spark, sf):
    return V.proc_blocks(spark, sf)


@query("t04_list_levels", f"WITH {V.BLOCKS} SELECT doc_id, count(*) AS n_items, max(level) AS deepest, sum(level)::BIGINT AS levels FROM blocks WHERE block_type = 'list_item' GROUP BY doc_id")
def t04(spark, sf):
    return V.proc_blocks(spark, sf).where("block_type = 'list_item'").groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max("level").alias("deepest"), F.sum("level").alias("levels"))


_PL = f"{V.LINES}, pl AS (SELECT doc_id, line_no, {sql_strip('raw')} AS text, CASE WHEN (doc_id + line_no) % 11 = 0 THEN 16.0 ELSE 10.5 END AS font_size FROM lines)"
_PCLEAN = sql_strip(f"regexp_replace(regexp_replace(text, {sql_text(B.PAGE_NUMBERED)}, ''), {sql_text(P.BULLET)}, '')")
_LISTED = f"(regexp_matches(text, {sql_text(B.PAGE_NUMBERED)}) OR regexp_matches(text, {sql_text(P.BULLET)}))"


def _page_lines(spark, sf):
    d = V.proc_lines(spark, sf)
    return d.select("doc_id", "line_no", X.strip(F.col("raw")).alias("text"), F.when((F.col("doc_id") + F.col("line_no")) % 11 == 0, 16.0).otherwise(10.5).alias("font_size"))


@query("t05_page_lines", f"""WITH {_PL} SELECT doc_id, line_no, CASE WHEN {_LISTED} THEN 'list_item' WHEN font_size >= 14 OR (length(text) < 80 AND text = upper(text) AND text <> lower(text) AND len(string_split_regex({V.sql_squeeze('text')}, ' ')) >= 2) THEN 'heading' ELSE 'paragraph' END AS block_type,
  CASE WHEN regexp_matches(text, '^\\s*\\d+\\.\\d+') THEN 2 WHEN {_LISTED} THEN 1 ELSE 0 END AS level, {_PCLEAN} AS content FROM pl""")
def t05(spark, sf):
    return B.classify_page_lines(_page_lines(spark, sf)).select("doc_id", "line_no", "block_type", "level", "content")


@query("t05_scanned_lines", f"""WITH {_PL} SELECT doc_id, line_no, CASE WHEN {_LISTED} THEN 'list_item' WHEN regexp_matches(text, '^[A-Z][A-Z\\s\\-–:]{{5,}}$') AND length(text) < 80 THEN 'heading' ELSE 'paragraph' END AS block_type,
  CASE WHEN regexp_matches(text, '^\\s*\\d+\\.\\d+') THEN 2 WHEN {_LISTED} THEN 1 ELSE 0 END AS level FROM pl""")
def t05b(spark, sf):
    return B.classify_page_lines(_page_lines(spark, sf), scanned=True).select("doc_id", "line_no", "block_type", "level")


@query("t06_scanned", f"""WITH {V.LINES}, {V.DOCS}, p AS (SELECT doc_id, line_no // 3 AS page, sum(length(raw)) AS n FROM lines GROUP BY ALL), g AS (SELECT doc_id, count(*) AS n_pages, count(*) FILTER (WHERE n >= 20) AS text_pages FROM p GROUP BY doc_id)
SELECT doc_id, coalesce(n_pages, 0) AS n_pages, coalesce(text_pages, 0) AS text_pages, coalesce(n_pages, 0) = 0 OR text_pages / greatest(n_pages, 1) < 0.1 AS scanned FROM docs LEFT JOIN g USING (doc_id)""")
def t06(spark, sf):
    pages = V.proc_lines(spark, sf).select("doc_id", F.expr("line_no div 3").alias("page"), F.col("raw").alias("text"))
    return B.is_scanned(V.proc_docs(spark, sf), pages)


_REBUILT = """rebuilt AS (SELECT doc_id, string_agg(CASE block_type WHEN 'heading' THEN chr(10) || '## ' || content || chr(10) WHEN 'list_item' THEN repeat('  ', greatest(0, level - 1)::BIGINT) || '- ' || content
  WHEN 'table_row' THEN '| ' || content || ' |' ELSE content END, chr(10) ORDER BY block_no) AS text FROM blocks GROUP BY doc_id)"""


@query("t07_rebuilt_text", f"WITH {V.BLOCKS}, {_REBUILT} SELECT * FROM rebuilt")
def t07(spark, sf):
    return B.rebuild_text(V.proc_blocks(spark, sf))


STRUCTURES = f"""counts AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE block_type = '{k}') AS {k}" for k in B.KINDS)}, count(*) AS total, count(*) FILTER (WHERE regexp_matches(content, '^\\d+\\.')) AS numbered FROM blocks GROUP BY doc_id),
structures AS (SELECT doc_id, CASE WHEN table_row / greatest(total, 1) > 0.4 THEN 'table' WHEN list_item / greatest(total, 1) > 0.5 THEN CASE WHEN numbered > 0.3 * list_item THEN 'numbered_list' ELSE 'bulleted_list' END
  WHEN paragraph / greatest(total, 1) > 0.7 THEN 'prose' WHEN {' + '.join(f'({k} > 2)::INT' for k in B.KINDS)} >= 2 THEN 'mixed' ELSE 'unknown' END AS structure FROM counts)"""


@query("t08_structure", f"WITH {V.BLOCKS}, {STRUCTURES}, {V.DOCS} SELECT doc_id, coalesce(structure, 'unknown') AS structure FROM docs LEFT JOIN structures USING (doc_id)")
def t08(spark, sf):
    return B.document_structure(V.proc_docs(spark, sf), V.proc_blocks(spark, sf))


@query("t09_numbered", f"WITH {V.BLOCKS}, {STRUCTURES} SELECT doc_id, numbered, numbered > 0.3 * list_item AS is_numbered FROM counts")
def t09(spark, sf):
    return B.block_counts(V.proc_blocks(spark, sf)).select("doc_id", "numbered", (F.col("numbered") > 0.3 * F.col("list_item")).alias("is_numbered"))


@query("t10_list_steps", f"""WITH {V.BLOCKS},
a AS (SELECT *, last_value(CASE WHEN block_type = 'heading' THEN content END IGNORE NULLS) OVER w AS section, sum((block_type = 'heading')::INT) OVER w AS h, sum((block_type = 'list_item')::INT) OVER w AS items,
  min(CASE WHEN block_type <> 'heading' THEN block_no END) OVER (PARTITION BY doc_id) AS early FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
b AS (SELECT *, last_value(CASE WHEN block_type = 'list_item' AND level = 1 THEN content END IGNORE NULLS) OVER (PARTITION BY doc_id, h ORDER BY block_no) AS parent FROM a),
c AS (SELECT *, block_type = 'list_item' OR (block_no = early AND items = 0) AS opens FROM b WHERE block_type <> 'heading'),
d AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY block_no) AS step_no FROM c)
SELECT doc_id, step_no::BIGINT AS step_no, string_agg(CASE WHEN block_type = 'list_item' THEN CASE WHEN coalesce(section, '') <> '' THEN '[' || section || '] ' ELSE '' END || CASE WHEN level <> 1 AND coalesce(parent, '') <> '' THEN '(sub-step of: ' || parent || ') ' ELSE '' END || content
  WHEN opens THEN content ELSE chr(10) || '  ' || content END, '' ORDER BY block_no) AS text FROM d GROUP BY doc_id, step_no""")
def t10(spark, sf):
    return B.list_steps(V.proc_blocks(spark, sf, V.line_texts(spark, sf)))


_BOILER = f"(length(content) < 3 OR regexp_matches(content, {sql_text(P.BOILERPLATE)}))"


@query("t11_prose_steps", f"""WITH {V.BLOCKS}, a AS (SELECT *, sum((block_type = 'heading')::INT) OVER w AS group_no, last_value(CASE WHEN block_type = 'heading' THEN content END IGNORE NULLS) OVER w AS heading FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY block_no))
SELECT doc_id, group_no::BIGINT AS group_no, any_value(heading) AS heading, string_agg(content, ' ' ORDER BY block_no) AS text FROM a WHERE block_type IN ('paragraph', 'code_block') AND NOT {_BOILER} GROUP BY doc_id, group_no""")
def t11(spark, sf):
    return B.prose_steps(V.proc_blocks(spark, sf))


@query("t12_boilerplate", f"WITH {V.BLOCKS} SELECT doc_id, block_no, content FROM blocks WHERE NOT {_BOILER}")
def t12(spark, sf):
    return B.drop_boilerplate(V.proc_blocks(spark, sf)).select("doc_id", "block_no", "content")


# tables: rows of an order are the rows of a table, with a header and merged (empty) cells
_HEADERS = ("Step | Action | Expected Result | Rollback | Notes", "Seq | Procedure | Verification | Backout", "Task | Output", "Alpha | Beta")
_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
_CELLS = "l_linenumber || ' | ' || CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 'configure unit ' || l_partkey END || ' | ' || CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'state is up on ' || l_suppkey END || ' | ' || CASE WHEN l_quantity < 20 THEN 'no unit ' || l_partkey ELSE '' END"
TABLE_ROWS = f"""rows0 AS (SELECT l_orderkey::BIGINT AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ORDER}) AS n, {_CELLS} AS cells FROM lineitem),
trows AS (SELECT doc_id, n + 1 AS block_no, cells AS content, n AS row_index FROM rows0 UNION ALL SELECT DISTINCT doc_id, 1, ({V.sql_list(_HEADERS)})[1 + doc_id % {len(_HEADERS)}], 0 FROM rows0)"""


def table_rows(spark, sf):
    li = dealt(table(spark, sf, "lineitem"), "l_orderkey")
    n = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_ORDER.split(", ")))
    rows = li.select(F.col("l_orderkey").cast("long").alias("doc_id"), n.alias("n"), F.expr(_CELLS).alias("content"))
    heads = rows.select("doc_id").distinct().select("doc_id", F.lit(1).alias("block_no"), F.element_at(F.array(*map(F.lit, _HEADERS)), (F.col("doc_id") % len(_HEADERS) + 1).cast("int")).alias("content"), F.lit(0).alias("row_index"))
    return rows.select("doc_id", (F.col("n") + 1).alias("block_no"), "content", F.col("n").alias("row_index")).unionByName(heads)


@query("t13_table_headers", f"WITH {TABLE_ROWS} SELECT doc_id, arg_max(content, block_no) AS header FROM trows WHERE row_index = 0 GROUP BY doc_id")
def t13(spark, sf):
    return B.table_headers(table_rows(spark, sf)).select("doc_id", "header")


_COLS = "CASE doc_id % 4 WHEN 0 THEN 'step=0,action=1,expected=2,rollback=3,notes=4' WHEN 1 THEN 'step=0,action=1,expected=2,rollback=3' WHEN 2 THEN 'action=0,expected=1' ELSE '' END"


@query("t14_column_map", f"SELECT DISTINCT l_orderkey::BIGINT AS doc_id, {_COLS.replace('doc_id', 'l_orderkey')} AS cols FROM lineitem")
def t14(spark, sf):
    h = B.table_headers(table_rows(spark, sf)).withColumn("m", B.column_map(F.split("header", r" \| ")))
    return h.select("doc_id", F.array_join(F.transform(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.struct(e["value"], e["key"]))), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("cols"))


_CELL = lambda i: f"nullif(coalesce(cells[{i + 1}], ''), '')"
_JOINED = {
    0: f"concat_ws(' | ', 'Step ' || {_CELL(0)} || ':', {_CELL(1)}, 'Expected: ' || {_CELL(2)}, 'Rollback: ' || {_CELL(3)}, 'Notes: ' || {_CELL(4)})",
    1: f"concat_ws(' | ', 'Step ' || {_CELL(0)} || ':', {_CELL(1)}, 'Expected: ' || {_CELL(2)}, 'Rollback: ' || {_CELL(3)})",
    2: f"concat_ws(' | ', {_CELL(0)}, 'Expected: ' || {_CELL(1)})",
}


@query("t15_table_steps", f"""WITH {TABLE_ROWS}, c AS (SELECT doc_id, block_no, list_transform(string_split(content, ' | '), lambda x: trim(x)) AS cells FROM trows WHERE row_index > 0)
SELECT doc_id, block_no, CASE doc_id % 4 WHEN 0 THEN {_JOINED[0]} WHEN 1 THEN {_JOINED[1]} WHEN 2 THEN {_JOINED[2]} ELSE array_to_string(list_filter(cells, lambda x: x <> ''), ' — ') END AS text FROM c""")
def t15(spark, sf):
    return B.table_steps(table_rows(spark, sf))


SECTIONS = """sec0 AS (SELECT *, block_type = 'heading' AND level <= 2 AS starts FROM blocks),
sec1 AS (SELECT *, sum(starts::INT) OVER w AS no, coalesce(last_value(CASE WHEN starts THEN content END IGNORE NULLS) OVER w, '_preamble') AS section FROM sec0 WINDOW w AS (PARTITION BY doc_id ORDER BY block_no)),
sections AS (SELECT * EXCLUDE (starts, no), dense_rank() OVER (PARTITION BY doc_id ORDER BY no) AS section_index FROM sec1 WHERE NOT starts)"""


@query("t16_sections", f"WITH {V.BLOCKS}, {SECTIONS} SELECT doc_id, block_no, section, section_index FROM sections")
def t16(spark, sf):
    return B.sections(V.proc_blocks(spark, sf)).select("doc_id", "block_no", "section", "section_index")


@query("t17_suitability", f"WITH {V.BLOCKS} SELECT doc_id, avg((block_type = 'list_item')::INT) > 0.4 AS suits_list, avg((block_type = 'paragraph')::INT) > 0.6 AS suits_prose, avg((block_type = 'table_row')::INT) > 0.3 AS suits_table FROM blocks GROUP BY doc_id")
def t17(spark, sf):
    return B.normalizer_suitability(V.proc_blocks(spark, sf))


_LINE_OF = "CASE WHEN a.line = 0 OR abs(x.t - a.y) > 3 THEN a.line + 1 ELSE a.line END"


@query("t18_words_to_lines", f"""
WITH w AS (SELECT l_orderkey::BIGINT AS doc_id, 1 + l_linenumber // 4 AS page, 'w' || l_partkey AS text, (l_suppkey % 50)::DOUBLE AS x0, (l_partkey % 23)::DOUBLE AS top FROM lineitem),
p AS (SELECT doc_id, page, list(text ORDER BY round(top / 3), x0, text, top) AS words, list(struct_pack(y := 0::DOUBLE, t := round(top), line := 0::BIGINT, ls := []::BIGINT[]) ORDER BY round(top / 3), x0, text, top) AS xs FROM w GROUP BY doc_id, page),
f AS (SELECT doc_id, page, words, list_reduce(list_prepend(struct_pack(y := 0::DOUBLE, t := 0::DOUBLE, line := 0::BIGINT, ls := []::BIGINT[]), xs),
  lambda a, x: struct_pack(y := CASE WHEN a.line = 0 OR abs(x.t - a.y) > 3 THEN x.t ELSE a.y END, t := x.t, line := {_LINE_OF}, ls := list_append(a.ls, {_LINE_OF}))).ls AS ls FROM p),
u AS (SELECT doc_id, page, unnest(ls) AS line_no, unnest(words) AS word, unnest(range(len(words))) AS place FROM f)
SELECT doc_id, page, line_no::INT AS line_no, string_agg(word, ' ' ORDER BY place) AS text FROM u GROUP BY doc_id, page, line_no""")
def t18(spark, sf):
    """Words placed on pages by their keys."""
    li = table(spark, sf, "lineitem")
    words = li.select(F.col("l_orderkey").cast("long").alias("doc_id"), F.expr("1 + l_linenumber div 4").alias("page"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("text"), (F.col("l_suppkey") % 50).cast("double").alias("x0"), (F.col("l_partkey") % 23).cast("double").alias("top"))
    return B.page_words_to_lines(words)


# ---- commands ----
@query("g01_prompts", f"WITH {V.LINES} SELECT doc_id, line_no, {V.sql_strip_prompt(sql_strip('raw'))} AS stripped FROM lines")
def g01(spark, sf):
    return V.proc_lines(spark, sf).select("doc_id", "line_no", C.strip_prompt(X.strip(F.col("raw"))).alias("stripped"))


@query("g02_vendor_mode", f"WITH {V.LINES} SELECT doc_id, line_no, {V.sql_vendor_mode('raw')} AS vendor_mode FROM lines")
def g02(spark, sf):
    return V.proc_lines(spark, sf).select("doc_id", "line_no", C.vendor_mode(F.col("raw")).alias("vendor_mode"))


@query("g03_generic", f"WITH {V.LINES} SELECT doc_id, line_no, regexp_matches(raw, {sql_text(P.anchored(P.GENERIC))}) AS generic FROM lines")
def g03(spark, sf):
    return V.proc_lines(spark, sf).select("doc_id", "line_no", C.is_generic(F.col("raw")).alias("generic"))


@query("g04_protocol", f"WITH {V.LINES} SELECT doc_id, line_no, {V.sql_protocol('lower(raw)')} AS protocol FROM lines")
def g04(spark, sf):
    return V.proc_lines(spark, sf).select("doc_id", "line_no", C.protocol(F.col("raw")).alias("protocol"))


@query("g05_confidence", f"WITH {V.COMMANDS} SELECT vendor, protocol, confidence, count(*) AS n FROM cmds GROUP BY ALL")
def g05(spark, sf):
    return V.proc_commands(spark, sf).groupBy("vendor", "protocol", "confidence").agg(F.count("*").alias("n"))


@query("g06_normalized", f"WITH {V.COMMANDS} SELECT normalized, count(*) AS n FROM cmds GROUP BY normalized")
def g06(spark, sf):
    return V.proc_commands(spark, sf).groupBy("normalized").agg(F.count("*").alias("n"))


@query("g07_commands", f"WITH {V.COMMANDS} SELECT doc_id, line_no, raw, normalized, vendor, protocol, mode, confidence FROM cmds")
def g07(spark, sf):
    return V.proc_commands(spark, sf)


@query("g07_documents", f"WITH lines AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|\\n|\\r')) AS raw FROM documents), {V.sql_commands('lines')} SELECT doc_id, vendor, count(*) AS n FROM cmds GROUP BY ALL")
def g07b(spark, sf):
    """The same over the documents as they are: hardly any of their lines are commands."""
    return G.extract_commands(B.split_lines(table(spark, sf, "documents"))).groupBy("doc_id", "vendor").agg(F.count("*").alias("n"))


# commands are told by distinct line and joined back: the patterns run once a line text
_BY_LINE = f"{V.LINES}, given AS MATERIALIZED (SELECT DISTINCT raw, raw AS own FROM lines), {V.sql_commands('given')}, told AS MATERIALIZED (SELECT * FROM cmds)"


@query("g08_enriched", f"WITH {_BY_LINE} SELECT l.doc_id, l.line_no, coalesce(c.raw, l.raw) AS raw, coalesce(c.normalized, {V.sql_squeeze('lower(l.raw)')}) AS normalized, coalesce(c.vendor, 'generic') AS vendor, coalesce(c.confidence, 0.1) AS confidence FROM lines l LEFT JOIN told c ON c.own = l.raw")
def g08(spark, sf):
    return G.enrich_commands(V.proc_lines(spark, sf)).select("doc_id", "line_no", "raw", "normalized", "vendor", "confidence")


@query("g09_is_command", f"WITH {_BY_LINE} SELECT l.doc_id, l.line_no, c.own IS NOT NULL AS is_command FROM lines l LEFT JOIN told c ON c.own = l.raw")
def g09(spark, sf):
    return V.proc_lines(spark, sf).select("doc_id", "line_no", C.is_command(F.col("raw")).alias("is_command"))


@query("g10_baseline_counts", f"WITH {V.BLOCKS}, {_REBUILT}, tl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM rebuilt), {V.sql_commands('tl')}, {V.DOCS}, n AS (SELECT doc_id, count(*) AS n FROM cmds GROUP BY doc_id) SELECT doc_id, coalesce(n, 0) AS n_commands FROM docs LEFT JOIN n USING (doc_id)")
def g10(spark, sf):
    """Commands are counted on the rebuilt text, where list items and table rows carry their marks."""
    lines = B.split_lines(B.rebuild_text(V.proc_blocks(spark, sf)))
    return G.command_counts(V.proc_docs(spark, sf), G.extract_commands(lines))


# ---- steps ----
@query("m01_phase_by_place", f"WITH {V.STEPS} SELECT doc_id, line_no, idx, section0 AS section FROM phased")
def m01(spark, sf):
    order = W.partitionBy("doc_id").orderBy("line_no")
    d = V.proc_commands(spark, sf).withColumn("idx", F.row_number().over(order) - 1).withColumn("total", F.count("*").over(W.partitionBy("doc_id")))
    return d.select("doc_id", "line_no", "idx", M.phase(F.col("raw"), F.col("idx"), F.col("total")).alias("section"))


@query("m02_dedup", f"WITH {V.STEPS} SELECT doc_id, line_no, section0 AS section, normalized FROM firsts")
def m02(spark, sf):
    return M.dedup_commands(V.proc_commands(spark, sf)).select("doc_id", "line_no", "section", "normalized")


@query("m03_renumbered", f"WITH {V.STEPS} SELECT doc_id, sequence, section, step_type, action_type FROM steps")
def m03(spark, sf):
    return V.proc_steps(spark, sf).select("doc_id", "sequence", "section", "step_type", "action_type")


@query("m04_descriptions", f"WITH {V.STEPS} SELECT step_id, description FROM steps")
def m04(spark, sf):
    return V.proc_steps(spark, sf).select("step_id", "description")


@query("m05_expected", f"WITH {V.STEPS} SELECT step_id, expected_output FROM steps")
def m05(spark, sf):
    return V.proc_steps(spark, sf).select("step_id", "expected_output")


@query("m06_tags", f"WITH {V.STEPS} SELECT step_id, array_to_string(tags, ',') AS tags FROM steps")
def m06(spark, sf):
    return V.proc_steps(spark, sf).select("step_id", F.array_join("tags", ",").alias("tags"))


@query("m07_placeholders", f"WITH {V.STEPS}, alldocs AS (SELECT doc_id::BIGINT AS doc_id FROM documents UNION SELECT l_partkey FROM lineitem) SELECT doc_id, step_type, count(*) AS n FROM (SELECT doc_id, step_type FROM steps UNION ALL SELECT doc_id, 'info' FROM alldocs WHERE doc_id NOT IN (SELECT doc_id FROM steps)) GROUP BY ALL")
def m07(spark, sf):
    docs = V.proc_docs(spark, sf).union(table(spark, sf, "documents").select("doc_id"))
    return M.with_placeholders(docs, V.proc_steps(spark, sf)).groupBy("doc_id", "step_type").agg(F.count("*").alias("n"))


@query("m08_phase_summary", f"WITH {V.STEPS}, a AS (SELECT doc_id, count(*) AS detected FROM cmds GROUP BY doc_id), b AS (SELECT doc_id, count(*) AS kept FROM steps GROUP BY doc_id) SELECT doc_id, detected, coalesce(kept, 0) AS kept FROM a LEFT JOIN b USING (doc_id)")
def m08(spark, sf):
    return M.phase_summary(V.proc_commands(spark, sf), V.proc_steps(spark, sf))


# ---- checks: steps with faults put in by their keys ----
def faulty_steps(spark, sf):
    d = V.proc_steps(spark, sf)
    k = F.col("doc_id") + F.col("sequence")
    return (
        d.withColumn("position", F.col("sequence"))
        .withColumn("description", F.when(k % 13 == 0, "ab ").otherwise(F.col("description")))
        .withColumn("is_rollback", F.when(k % 7 == 0, F.lit(False)).when(k % 19 == 0, F.lit(True)).otherwise(F.col("is_rollback")))
        .withColumn("step_type", F.when(k % 23 == 0, "info").otherwise(F.col("step_type")))
        .withColumn("commands", F.when(k % 17 == 0, F.transform("commands", lambda c: c.withField("raw", F.lit(" ")))).when(k % 3 == 0, F.array_repeat(F.get("commands", F.lit(0)), F.lit(0))).otherwise(F.col("commands")))
        .withColumn("sequence", F.when(k % 11 == 0, F.greatest(F.lit(1), F.col("sequence") - 1)).otherwise(F.col("sequence")))
    )


FAULTY = (
    V.STEPS
    + """, f0 AS (SELECT *, doc_id + sequence AS k FROM steps),
faulty AS (SELECT doc_id, step_id, sequence AS position, CASE WHEN k % 13 = 0 THEN 'ab ' ELSE description END AS description, CASE WHEN k % 7 = 0 THEN false WHEN k % 19 = 0 THEN true ELSE is_rollback END AS is_rollback,
  CASE WHEN k % 23 = 0 THEN 'info' ELSE step_type END AS step_type, CASE WHEN k % 17 = 0 THEN ' ' WHEN k % 3 = 0 THEN NULL ELSE raw END AS cmd, CASE WHEN k % 11 = 0 THEN greatest(1, sequence - 1) ELSE sequence END AS sequence FROM f0)"""
)


@query("q01_no_steps", f"WITH {V.STEPS} SELECT doc_id::BIGINT AS doc_id, 'no_steps' AS rule FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM steps)")
def q01(spark, sf):
    return Q.no_steps(table(spark, sf, "documents"), V.proc_steps(spark, sf)).select("doc_id", "rule")


@query("q02_descriptions", f"WITH {FAULTY} SELECT doc_id, step_id FROM faulty WHERE length(trim(description)) < 5")
def q02(spark, sf):
    return Q.short_descriptions(faulty_steps(spark, sf)).select("doc_id", "step_id")


@query("q03_duplicates", f"WITH {FAULTY} SELECT doc_id, step_id, 'sequence also used by ' || b AS message FROM (SELECT *, lag(step_id) OVER (PARTITION BY doc_id, sequence ORDER BY step_id) AS b FROM faulty) WHERE b IS NOT NULL")
def q03(spark, sf):
    return Q.duplicate_sequences(faulty_steps(spark, sf)).select("doc_id", "step_id", "message")


@query("q04_blank_commands", f"WITH {FAULTY} SELECT doc_id, step_id FROM faulty WHERE trim(cmd) = ''")
def q04(spark, sf):
    return Q.blank_commands(faulty_steps(spark, sf)).select("doc_id", "step_id")


_MISMATCH = "((step_type = 'rollback' AND NOT is_rollback) OR (is_rollback AND step_type NOT IN ('rollback', 'action', 'verification')))"


@query("q05_rollback", f"WITH {FAULTY} SELECT doc_id, step_id, is_rollback OR step_type = 'rollback' AS corrected FROM faulty WHERE {_MISMATCH}")
def q05(spark, sf):
    d = faulty_steps(spark, sf)
    return Q.rollback_mismatches(d).select("doc_id", "step_id").join(Q.correct_rollback(d).select("step_id", F.col("is_rollback").alias("corrected")), "step_id")


_COVER = f"""{FAULTY}, {V.DOCS}, nb AS (SELECT doc_id, count(*) AS n FROM cmds GROUP BY doc_id), na AS (SELECT doc_id, count(cmd) AS n FROM faulty GROUP BY doc_id),
cover AS (SELECT doc_id, coalesce(nb.n, 0) AS n_before, coalesce(na.n, 0) AS n_after, CASE WHEN nb.n > 0 THEN round(coalesce(na.n, 0) / nb.n, 4) END AS coverage FROM docs LEFT JOIN nb USING (doc_id) LEFT JOIN na USING (doc_id))"""


@query("q06_coverage", f"WITH {_COVER} SELECT * FROM cover")
def q06(spark, sf):
    docs = V.proc_docs(spark, sf)
    return Q.command_coverage(docs, G.command_counts(docs, V.proc_commands(spark, sf)), faulty_steps(spark, sf))


@query("q07_guardrails", f"""WITH {_COVER}, found AS (SELECT doc_id, 'short_description:' || step_id AS f FROM faulty WHERE length(trim(description)) < 5
  UNION ALL SELECT doc_id, 'duplicate_sequence:' || step_id FROM (SELECT *, lag(step_id) OVER (PARTITION BY doc_id, sequence ORDER BY step_id) AS b FROM faulty) WHERE b IS NOT NULL
  UNION ALL SELECT doc_id, 'blank_command:' || step_id FROM faulty WHERE trim(cmd) = '' UNION ALL SELECT doc_id, 'rollback_mismatch:' || step_id FROM faulty WHERE {_MISMATCH}
  UNION ALL SELECT doc_id, 'low_coverage' FROM cover WHERE coverage < 0.5), w AS (SELECT doc_id, string_agg(f, ',' ORDER BY f) AS warnings FROM found GROUP BY doc_id)
SELECT doc_id, doc_id IN (SELECT doc_id FROM faulty) AS passed, n_before, n_after, coverage, coalesce(warnings, '') AS warnings FROM cover LEFT JOIN w USING (doc_id)""")
def q07(spark, sf):
    docs = V.proc_docs(spark, sf)
    g = Q.guardrails(docs, faulty_steps(spark, sf), G.command_counts(docs, V.proc_commands(spark, sf)))
    return g.select("doc_id", "passed", "n_before", "n_after", "coverage", F.array_join("warnings", ",").alias("warnings"))


_MODELS = "models AS (SELECT DISTINCT l_partkey::BIGINT AS doc_id, CASE WHEN l_partkey % 9 = 0 THEN ' ' ELSE 'Part ' || l_partkey END AS document_title, ['pdf', 'docx', 'txt', 'odt'][1 + l_partkey % 4] AS source_format, ['abort', 'continue', 'rollback_group', 'rollback_all'][1 + l_partkey % 4] AS failure_strategy FROM lineitem)"


def models(spark, sf):
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("doc_id") % 4 + 1).cast("int"))
    return V.proc_docs(spark, sf).select("doc_id", F.when(F.col("doc_id") % 9 == 0, " ").otherwise(F.concat(F.lit("Part "), F.col("doc_id").cast("string"))).alias("document_title"), pick("pdf", "docx", "txt", "odt").alias("source_format"), pick("abort", "continue", "rollback_group", "rollback_all").alias("failure_strategy"))


@query("v01_schema_checks", f"""WITH {FAULTY}, {_MODELS}, dn AS (SELECT doc_id, bool_or(coalesce(p > sequence, false)) AS down FROM (SELECT *, lag(sequence) OVER (PARTITION BY doc_id ORDER BY position) AS p FROM faulty) GROUP BY doc_id)
SELECT doc_id, NOT coalesce(down, false) AS ascending, trim(document_title) <> '' AS has_title, source_format IN ('pdf', 'docx', 'txt') AS known_format, NOT coalesce(down, false) AND trim(document_title) <> '' AND source_format IN ('pdf', 'docx', 'txt') AS valid FROM models LEFT JOIN dn USING (doc_id)""")
def v01(spark, sf):
    return Q.schema_checks(models(spark, sf), faulty_steps(spark, sf))


@query("v02_enums", f"WITH {_MODELS} SELECT doc_id, 'source_format' AS violations FROM models WHERE source_format NOT IN ('pdf', 'docx', 'txt')")
def v02(spark, sf):
    return Q.enum_violations(models(spark, sf), {"source_format": Q.FORMATS}).select("doc_id", F.array_join("violations", ",").alias("violations"))


SCORES = f"""agg AS (SELECT doc_id, count(*) AS n_commands, count(*) FILTER (WHERE is_rollback) AS n_rollback, bool_or(lower(section) IN ('pre-checks', 'pre checks', 'pre_checks')) AS has_pre, bool_or(lower(section) IN ('verification', 'post-checks', 'post checks')) AS has_post,
  count(*) FILTER (WHERE NOT is_rollback) AS n_own, count(expected_output) FILTER (WHERE NOT is_rollback) AS n_expected, round(sum(confidence) / count(*), 6) AS mean_c, count(DISTINCT section) AS n_sections FROM steps GROUP BY doc_id),
pts AS (SELECT doc_id, failure_strategy, n_commands, n_rollback, CASE WHEN n_commands = 0 THEN 0 WHEN n_commands <= 5 THEN 1 WHEN n_commands <= 15 THEN 2 ELSE 3 END AS p1, CASE WHEN n_rollback > 0 THEN 2 ELSE 0 END AS p2, has_pre::INT AS p3, has_post::INT AS p4,
  CASE WHEN n_own = 0 THEN 0 WHEN n_expected / n_own > 0.5 THEN 2 WHEN n_expected / n_own > 0.2 THEN 1 ELSE 0 END AS p5, (mean_c >= 0.85)::INT AS p6, (n_sections >= 3)::INT AS p7, (failure_strategy <> 'abort')::INT AS p8 FROM agg JOIN models USING (doc_id)),
scores AS (SELECT *, p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8 AS score, CASE WHEN p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8 >= 8 THEN 'HIGH' WHEN p1 + p2 + p3 + p4 + p5 + p6 + p7 + p8 >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM pts)"""


@query("qs1_quality_points", f"WITH {V.STEPS}, {_MODELS}, {SCORES} SELECT doc_id, score, p1 AS commands_detected, p2 AS rollback_steps, p3 AS pre_checks, p4 AS verification_section, p5 AS expected_output_coverage, p6 AS command_confidence, p7 AS section_diversity, p8 AS failure_strategy_set FROM scores")
def qs1(spark, sf):
    return Q.quality_score(V.proc_steps(spark, sf), models(spark, sf)).select("doc_id", "score", "commands_detected", "rollback_steps", "pre_checks", "verification_section", "expected_output_coverage", "command_confidence", "section_diversity", "failure_strategy_set")


@query("qs2_bands", f"WITH {V.STEPS}, {_MODELS}, {SCORES} SELECT doc_id, band, round_even(score::DOUBLE / 12 * 100, 0)::INT AS percentage, repeat('#', round_even(score::DOUBLE / 12 * 20, 0)::BIGINT) || repeat('.', 20 - round_even(score::DOUBLE / 12 * 20, 0)::BIGINT) AS bar FROM scores")
def qs2(spark, sf):
    return Q.quality_score(V.proc_steps(spark, sf), models(spark, sf)).select("doc_id", "band", "percentage", "bar")


@query("qs3_warnings", f"""WITH {V.STEPS}, {_MODELS}, {SCORES} SELECT doc_id, concat_ws(',', CASE WHEN n_commands > 0 AND n_commands <= 5 THEN 'few commands' END, CASE WHEN n_rollback = 0 THEN 'no rollback' END, CASE WHEN p5 = 0 THEN 'expected outputs scarce' END) AS warnings,
  concat_ws(',', CASE WHEN n_rollback = 0 THEN 'add a rollback section' END, CASE WHEN p3 = 0 THEN 'add pre-checks' END, CASE WHEN p4 = 0 THEN 'add verification' END, CASE WHEN p5 < 2 THEN 'define expected outputs' END, CASE WHEN p6 = 0 THEN 'review uncertain commands' END, CASE WHEN p7 = 0 THEN 'use more sections' END, CASE WHEN p8 = 0 THEN 'set a failure strategy' END) AS recommendations FROM scores""")
def qs3(spark, sf):
    return Q.quality_score(V.proc_steps(spark, sf), models(spark, sf)).select("doc_id", F.array_join("warnings", ",").alias("warnings"), F.array_join("recommendations", ",").alias("recommendations"))


@query("qs4_distribution", f"WITH {V.STEPS}, {_MODELS}, {SCORES}, {V.BLOCKS.replace('lines AS', 'lines2 AS', 1).replace('FROM lines)', 'FROM lines2)', 1)}, {STRUCTURES} SELECT band, coalesce(structure, 'unknown') AS structure, count(*) AS n FROM scores LEFT JOIN structures USING (doc_id) GROUP BY ALL")
def qs4(spark, sf):
    texts = V.line_texts(spark, sf)
    b = V.proc_blocks(spark, sf, texts)
    return Q.quality_distribution(Q.quality_score(V.proc_steps(spark, sf, texts), models(spark, sf)), B.document_structure(V.proc_docs(spark, sf), b))


def flagship(spark, sf):
    """Commands per vendor, protocol and phase of every procedure, with its quality band."""
    steps = V.proc_steps(spark, sf)
    bands = Q.quality_score(steps, models(spark, sf)).select("doc_id", "band")
    c = steps.select("doc_id", "section", F.col("commands")[0]["vendor"].alias("vendor"), F.col("commands")[0]["protocol"].alias("protocol"))
    return c.groupBy("doc_id", "vendor", "protocol", "section").agg(F.count("*").alias("n")).join(bands, "doc_id")


query("flagship", f"WITH {V.STEPS}, {_MODELS}, {SCORES} SELECT doc_id, vendor, protocol, section, count(*) AS n, any_value(band) AS band FROM steps JOIN scores USING (doc_id) GROUP BY doc_id, vendor, protocol, section")(flagship)
