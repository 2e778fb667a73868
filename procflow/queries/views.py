"""Procedure lines, steps and logs derived from the given tables, by the same arithmetic in Spark and in SQL.

The tables hold orders and invented prose, hardly any commands. Each line of an order therefore picks one of a
fixed list of lines by its keys; a part is a document, its lines in the order of its orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from procflow.functions import patterns as P
from procflow.operators import blocks as B
from procflow.operators import commands as G
from procflow.operators import steps as M
from procflow.session import dealt, repeated, table

TEMPLATES = (
    "# Core Router Upgrade",
    "## Pre-checks",
    "## Implementation",
    "## Verification",
    "## Rollback",
    "### Notes for operators",
    "1. Please ensure that the maintenance window is open.",
    "2. PE1# show ip bgp summary",
    "2.1. Confirm that all neighbors are Established on 10.0.0.1.",
    "3) show version",
    "Step 4 - configure the interface GigabitEthernet0/1 in order to carry vlan 120",
    "- show mpls ldp neighbor",
    "* verify that the interface state is up and stable",
    "    install add file disk0:image.smu",
    "```",
    "PE1# show interfaces brief",
    "show install active summary",
    "configure terminal",
    "router bgp 65001",
    "no neighbor 10.1.1.1 shutdown",
    "RP/0/RP0/CPU0:PE2# ping 10.2.2.2 count 100",
    "set routing-options autonomous-system 65001",
    "delete protocols ospf area 0",
    "display ip routing-table",
    "undo shutdown",
    "tmsh show ltm virtual",
    "fw stat",
    "bgp 65100",
    "commit",
    "",
    "Page 3 of 12",
    "17",
    "ok",
    "The operator should make sure to notify the duty desk prior to the change.",
    "Expected: all neighbors reach the Established state within two minutes.",
    "Note: if applicable, once completed, save the running configuration of PE12.",
    "Output should be 'Established' and the AS 65001 prefix 10.20.0.0/16 is present.",
    "It is recommended that traffic on Loopback0 is drained for the purpose of safety, kindly confirm with the network operations center before any further action is taken on the device.",
    "user@edge-1> monitor traffic interface ge-0/0/1",
    "[edit protocols] set isis level 2 disable",
)


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


#: Trimming as strip() does it.
def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_squeeze(x: str) -> str:
    return sql_strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


LINE_ORDER = "l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate"


def proc_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, line_no, raw``: one document a part."""
    li = table(spark, sf, "lineitem")
    order = LINE_ORDER.split(", ")
    li = dealt(li.select(F.col("l_partkey").cast("long").alias("doc_id"), *order), "doc_id")
    no = F.row_number().over(W.partitionBy("doc_id").orderBy(*order))
    return li.select("doc_id", no.alias("line_no"), _raw().alias("raw"))


def _raw():
    pick = F.pmod(F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + F.col("l_suppkey"), F.lit(len(TEMPLATES)))
    return F.element_at(F.array(*map(F.lit, TEMPLATES)), (pick + 1).cast("int"))


def line_texts(spark: SparkSession, sf: str) -> DataFrame | None:
    """Every text of proc_lines(), each once, where many lines repeat few; else None."""
    li = table(spark, sf, "lineitem")
    return repeated(li.select(_raw().alias("raw")), "raw", li.count())


LINES = f"""lines AS (
  SELECT l_partkey::BIGINT AS doc_id, row_number() OVER (PARTITION BY l_partkey ORDER BY {LINE_ORDER}) AS line_no,
         ({sql_list(TEMPLATES)})[1 + (l_orderkey * 7 + l_linenumber * 3 + l_suppkey) % {len(TEMPLATES)}] AS raw
  FROM lineitem)"""

DOCS = "docs AS (SELECT DISTINCT l_partkey::BIGINT AS doc_id FROM lineitem)"


def proc_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_partkey").cast("long").alias("doc_id")).distinct()


def block_texts(texts: DataFrame | None) -> DataFrame | None:
    return None if texts is None else B.block_texts(texts)


def proc_blocks(spark: SparkSession, sf: str, texts: DataFrame | None = None) -> DataFrame:
    return B.parse_blocks(proc_lines(spark, sf), texts)


_T = sql_strip("raw")
_NUMBERED = f"(regexp_matches(t, {sql_text(P.NUMBERED)}) OR regexp_matches(t, {sql_text(P.STEP)}))"
BLOCKS = (
    LINES
    + rf""",
fences AS (SELECT *, starts_with(raw, '```') AS is_fence, {_T} AS t,
                  sum(starts_with(raw, '```')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS fence_no FROM lines),
lasts AS (SELECT *, max(fence_no) OVER (PARTITION BY doc_id) AS last_fence FROM fences),
kinds AS (SELECT *, CASE WHEN fence_no % 2 = 1 THEN 'fence' WHEN t = '' THEN NULL WHEN regexp_matches(t, {sql_text(P.HEADING)}) THEN 'heading'
                         WHEN regexp_matches(raw, '^    .+') THEN 'code_block' WHEN {_NUMBERED} THEN 'numbered'
                         WHEN regexp_matches(t, {sql_text(P.BULLET)}) THEN 'bullet' ELSE 'paragraph' END AS kind
          FROM lasts WHERE NOT is_fence AND (fence_no % 2 = 0 OR last_fence > fence_no)),
parts AS (SELECT doc_id, line_no, kind, CASE WHEN kind = 'fence' THEN -fence_no ELSE line_no END AS g,
                 CASE kind WHEN 'heading' THEN {sql_strip(f"regexp_extract(t, {sql_text(P.HEADING)}, 2)")}
                           WHEN 'numbered' THEN {sql_strip(f"regexp_replace(regexp_replace(t, {sql_text(P.NUMBERED)}, ''), {sql_text(P.STEP)}, '')")}
                           WHEN 'bullet' THEN {sql_strip(f"regexp_replace(t, {sql_text(P.BULLET)}, '')")} WHEN 'fence' THEN raw ELSE t END AS content,
                 CASE kind WHEN 'heading' THEN length(regexp_extract(t, {sql_text(P.HEADING)}, 1)) WHEN 'bullet' THEN 1
                           WHEN 'numbered' THEN CASE WHEN regexp_extract(t, '^\s*((?:\d+\.)+)', 1) = '' THEN 1
                                ELSE length(regexp_extract(t, '^\s*((?:\d+\.)+)', 1)) - length(replace(regexp_extract(t, '^\s*((?:\d+\.)+)', 1), '.', '')) END
                           ELSE 0 END AS level
          FROM kinds WHERE kind IS NOT NULL),
joined AS (SELECT doc_id, g, min(line_no) AS line_no, any_value(kind) AS kind, max(level) AS level, string_agg(content, chr(10) ORDER BY line_no) AS content FROM parts GROUP BY doc_id, g),
blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS block_no,
                  CASE kind WHEN 'fence' THEN 'code_block' WHEN 'numbered' THEN 'list_item' WHEN 'bullet' THEN 'list_item' ELSE kind END AS block_type,
                  CASE WHEN kind = 'fence' THEN {sql_strip("content")} ELSE content END AS content, level
           FROM joined WHERE kind <> 'fence' OR {sql_strip("content")} <> '')"""
)


def proc_commands(spark: SparkSession, sf: str, texts: DataFrame | None = None) -> DataFrame:
    return G.extract_commands(proc_lines(spark, sf), texts=texts)


def sql_strip_prompt(x: str) -> str:
    for p in P.PROMPTS:
        x = f"regexp_replace({x}, {sql_text(p)}, '')"
    return sql_strip(x)


def sql_vendor_mode(x: str) -> str:
    cases = [f"WHEN regexp_matches({x}, {sql_text(P.anchored(m[k]))}) THEN '{v}/{k}'" for v, m in P.VENDORS.items() for k in ("exec", "config") if m[k]]
    return "CASE " + " ".join(cases) + " END"


def sql_protocol(x: str) -> str:
    first = [f"WHEN regexp_matches({x}, {sql_text('^(?:' + '|'.join(p['commands']) + ')')}) THEN '{n}'" for n, p in P.PROTOCOLS.items()]
    then = [f"WHEN regexp_matches({x}, {sql_text(P.keyword(p['keywords']))}) THEN '{n}'" for n, p in P.PROTOCOLS.items()]
    return "CASE " + " ".join(first + then) + " END"


def sql_commands(source: str, name: str = "cmds") -> str:
    """CTEs that classify the rows of ``source (raw, ...)``; those that are no commands go."""
    return f"""{name}_t AS (SELECT * EXCLUDE (raw), {sql_strip("raw")} AS raw FROM {source}),
{name}_p AS (SELECT *, {sql_strip_prompt("raw")} AS txt FROM {name}_t WHERE length(raw) >= 3),
{name}_v AS (SELECT *, {sql_vendor_mode("txt")} AS vm, {sql_protocol("lower(txt)")} AS protocol, regexp_matches(txt, {sql_text(P.anchored(P.GENERIC))}) AS gen FROM {name}_p WHERE txt <> ''),
{name} AS (SELECT * EXCLUDE (txt, vm, gen, protocol), {sql_squeeze("lower(txt)")} AS normalized, coalesce(split_part(vm, '/', 1), 'generic') AS vendor, protocol,
                  CASE WHEN vm IS NULL THEN NULL ELSE split_part(vm, '/', 2) END AS mode,
                  round(least(1.0, CASE WHEN vm IS NULL THEN 0.5::DOUBLE WHEN starts_with(vm, 'generic') THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END + CASE WHEN protocol IS NULL THEN 0 ELSE 0.1::DOUBLE END), 2) AS confidence
           FROM {name}_v WHERE vm IS NOT NULL OR gen)"""


COMMANDS = LINES + ",\n" + sql_commands("lines")


def sql_phase(raw: str, place: str, total: str) -> str:
    part = f"(({place})::DOUBLE / greatest({total}, 1))"
    return f"""CASE WHEN regexp_matches({raw}, {sql_text(P.ROLLBACK_WORDS)}) THEN 'Rollback'
      WHEN {part} <= 0.20 AND regexp_matches({raw}, {sql_text(P.PRE_CHECK_WORDS)}) THEN 'Pre-checks'
      WHEN {part} >= 0.75 AND regexp_matches({raw}, {sql_text(P.VERIFY_WORDS)}) THEN 'Verification'
      WHEN regexp_matches({raw}, {sql_text(P.VERIFY_WORDS)}) AND contains(lower({raw}), 'show') THEN CASE WHEN {part} < 0.4 THEN 'Pre-checks' ELSE 'Verification' END
      ELSE 'Implementation' END"""


def proc_steps(spark: SparkSession, sf: str, texts: DataFrame | None = None) -> DataFrame:
    return M.build_steps(proc_commands(spark, sf, texts), texts)


STEPS = (
    COMMANDS
    + f""",
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS idx, count(*) OVER (PARTITION BY doc_id) AS total FROM cmds),
phased AS (SELECT *, {sql_phase("raw", "idx", "total")} AS section0 FROM placed),
firsts AS (SELECT * FROM phased QUALIFY row_number() OVER (PARTITION BY doc_id, section0, normalized ORDER BY idx) = 1),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS sequence, count(*) OVER (PARTITION BY doc_id) AS n FROM firsts),
again AS (SELECT *, {sql_phase("raw", "sequence - 1", "n")} AS section FROM numbered),
acts AS (SELECT *, CASE section WHEN 'Rollback' THEN 'rollback' WHEN 'Implementation' THEN 'execute' ELSE 'verify' END AS action_type FROM again),
steps AS (SELECT doc_id, doc_id || '-' || sequence AS step_id, sequence, CASE section WHEN 'Rollback' THEN 'rollback' WHEN 'Implementation' THEN 'action' ELSE 'verification' END AS step_type, action_type,
    CASE action_type WHEN 'verify' THEN 'Verify' WHEN 'rollback' THEN 'Rollback' ELSE 'Execute' END || CASE WHEN protocol IS NULL THEN '' ELSE ' (' || upper(protocol) || ')' END
      || CASE WHEN vendor = 'generic' THEN '' ELSE ' [' || vendor || ']' END || ': ' || substr(raw, 1, 60) || CASE WHEN length(raw) > 60 THEN '…' ELSE '' END AS description,
    raw, normalized, vendor, protocol, mode, confidence,
    CASE WHEN action_type <> 'verify' THEN NULL WHEN contains(lower(raw), 'bgp') THEN 'BGP neighbors in Established state' WHEN contains(lower(raw), 'ospf') THEN 'OSPF neighbors in FULL state'
         WHEN contains(lower(raw), 'isis') THEN 'IS-IS adjacencies in UP state' WHEN contains(lower(raw), 'interface') OR contains(lower(raw), 'ip int') THEN 'Interface state: up/up'
         WHEN contains(lower(raw), 'install') AND contains(lower(raw), 'active') THEN 'SMU listed in active packages' WHEN contains(lower(raw), 'install') THEN 'Install operation completed successfully'
         WHEN contains(lower(raw), 'ping') THEN 'Success rate 100% (no packet loss)' WHEN contains(lower(raw), 'version') THEN 'Expected software version shown' ELSE 'Command completes without errors' END AS expected_output,
    section, section = 'Rollback' AS is_rollback,
    list_filter([CASE WHEN vendor <> 'generic' THEN vendor END, protocol, CASE WHEN contains(lower(raw), 'install') THEN 'smu' END,
      CASE WHEN contains(lower(raw), 'rollback') OR contains(lower(raw), 'undo') OR contains(lower(raw), 'no ') THEN 'rollback' END,
      CASE WHEN contains(lower(raw), 'show') OR contains(lower(raw), 'display') THEN 'read-only' END], lambda x: x IS NOT NULL) AS tags
  FROM acts)"""
)
