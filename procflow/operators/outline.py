"""Outline compression: sections and nodes instead of prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from procflow.functions import commands as C
from procflow.functions import patterns as P
from procflow.functions import text as X
from procflow.operators.blocks import KINDS, column_map, sectioned, sections, structure_of
from procflow.session import checkpointed, computed, tasks


def route(structure: Column) -> Column:
    """outline for lists and tables, mixed for mixed documents, text for prose and the unknown."""
    return F.when(structure.isin("numbered_list", "bulleted_list", "table"), "outline").when(structure == "mixed", "mixed").otherwise("text")


def section_modes(blocks: DataFrame, least: float = 0.4) -> DataFrame:
    """``doc_id, section_index, section, structured_share, mode, is_rollback`` of each section: outline if at least
    ``least`` of its blocks are list items, table rows or code."""
    share = F.count_if(_structured()) / F.count("*")
    g = sections(blocks).groupBy("doc_id", "section_index").agg(F.first("section").alias("section"), F.round(share, 6).alias("structured_share"), (share >= least).alias("__ok"))
    return g.select("doc_id", "section_index", "section", "structured_share", F.when(F.col("__ok"), "outline").otherwise("text").alias("mode"), F.col("section").rlike(P.ROLLBACK_SECTION).alias("is_rollback"))


def _structured() -> Column:
    return F.col("block_type").isin("list_item", "table_row", "code_block")


def commands_in(content: Column) -> Column:
    """The lines of a content that are commands, trimmed."""
    return F.transform(F.filter(F.split(content, r"\r\n|\n|\r"), C.is_command), X.strip)


def block_nodes(blocks_in_sections: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Nodes of list items, code blocks and paragraphs: description, commands, expected output; blocks that say
    nothing are dropped. Needs doc_id, section_index, section, block_no, block_type, content. ``texts``: contents that many
    blocks have (blocks.block_texts), which are looked through once a text."""
    d = blocks_in_sections.where(F.col("block_type").isin("list_item", "code_block", "paragraph"))
    return _with_nodes(d, texts=texts).where("__node").select("doc_id", "section_index", "section", "block_no", "block_type", "description", "commands", "expected_output", F.col("section").rlike(P.ROLLBACK_SECTION).alias("is_rollback"))


def _with_nodes(blocks: DataFrame, wanted: Column | None = None, texts: DataFrame | None = None) -> DataFrame:
    """Blocks plus ``__node``, whether one is a node, and its description, commands and expected_output. Nothing is
    looked for in blocks that are not ``wanted``; what ``texts`` hold is found once a text, the rest once a block."""
    t, c, own = F.col("block_type"), F.col("content"), blocks.columns
    found = {"some": X.is_significant(c), "commands": commands_in(c), "short": X.compress(c), "expected": X.expectation(c)}
    if texts is not None:
        known = computed(texts.select("content"), **found).select(F.col("content").alias("__content"), F.struct(*found).alias("__told"))
        blocks = blocks.join(F.broadcast(known), c == F.col("__content"), "left")
        found = {k: F.when(F.col("__told").isNotNull(), F.col(f"__told.{k}")).otherwise(v) for k, v in found.items()}
    may = F.when(t == "paragraph", found["some"]).otherwise(t.isin("list_item", "code_block"))
    d = computed(blocks, __may=may if wanted is None else F.when(wanted, may).otherwise(False))
    # computed once a row: what tells nodes and what is made of them read each of these more than once
    d = computed(d, commands=F.when(F.col("__may"), found["commands"]), __short=F.when(F.col("__may") & (t != "code_block"), found["short"]))
    keep = F.when(t == "list_item", F.length("__short") >= 5).when(t == "code_block", F.size("commands") > 0).otherwise(True)
    description = F.when(t == "code_block", F.concat(F.lit("Execute "), F.size("commands").cast("string"), F.lit(" command(s)"))).otherwise(X.truncate(F.col("__short")))
    d = d.withColumn("__node", F.coalesce(F.col("__may") & keep, F.lit(False)))
    node = F.col("__node")
    return d.select(*own, "__node", F.when(node, description).alias("description"), F.when(node, F.col("commands")).alias("commands"), F.when(node & (t != "code_block"), found["expected"]).alias("expected_output"))


def table_nodes(rows_in_sections: DataFrame, extract_table_commands: bool = False) -> DataFrame:
    """Nodes of table rows. Consecutive rows are a table; an empty cell takes the value above it in its column;
    without known columns, the first three are action, expected and rollback."""
    run = F.col("block_no") - F.row_number().over(W.partitionBy("doc_id", "section_index").orderBy("block_no"))
    d = rows_in_sections.where("block_type = 'table_row'").withColumn("run", run)
    table = W.partitionBy("doc_id", "section_index", "run")
    zero = F.max(F.when(F.col("row_index") == 0, F.col("block_no"))).over(table)
    d = d.withColumn("head", F.coalesce(zero, F.min("block_no").over(table)))
    # what the columns mean is found in the header alone, and told to the rows of its table
    d = d.withColumn("__cols", F.when(F.col("block_no") == F.col("head"), _places(F.split("content", r" \| "))))
    d = d.withColumn("cols", F.first("__cols", ignorenulls=True).over(table)).where("block_no <> head")
    e = d.select("doc_id", "section_index", "section", "run", "block_no", "cols", F.posexplode(F.split("content", r" \| ")).alias("i", "cell"))
    above = W.partitionBy("doc_id", "section_index", "run", "i").orderBy("block_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    e = e.withColumn("cell", X.strip(F.col("cell"))).withColumn("cell", F.coalesce(F.last(F.nullif("cell", F.lit("")), ignorenulls=True).over(above), F.lit("")))
    g = e.groupBy("doc_id", "section_index", "run", "block_no").agg(F.first("section").alias("section"), F.first("cols").alias("cols"), F.sort_array(F.collect_list(F.struct("i", "cell")))["cell"].alias("cells"))
    get = lambda m: F.coalesce(F.get("cells", F.col(f"cols.{m}")), F.lit(""))
    joined = F.array_join(F.array_remove("cells", ""), " | ")
    g = computed(g, action=F.coalesce(F.nullif(get("action"), F.lit("")), joined)).where(X.strip(F.col("action")) != "")
    none = F.array().cast("array<string>")
    d = computed(g, rollback_command=F.nullif(get("rollback"), F.lit("")), __short=X.compress(F.col("action")))
    return d.select(
        "doc_id",
        "section_index",
        "section",
        "block_no",
        F.lit("table_row").alias("block_type"),
        X.truncate(F.col("__short")).alias("description"),
        (commands_in(F.col("action")) if extract_table_commands else none).alias("commands"),
        F.coalesce(F.nullif(get("expected"), F.lit("")), X.expectation(F.col("action"))).alias("expected_output"),
        (F.col("section").rlike(P.ROLLBACK_SECTION) | F.col("rollback_command").isNotNull()).alias("is_rollback"),
        "rollback_command",
    )


def _places(head: Column) -> Column:
    """Where action, expected and rollback stand in a header: by its names, or, if none is known, the first three."""
    names = ("action", "expected", "rollback")
    first = F.struct(*[F.when(F.size(head) > i, F.lit(i)).alias(n) for i, n in enumerate(names)])
    return F.transform(F.array(column_map(head)), lambda m: F.when(F.size(m) > 0, F.struct(*[F.try_element_at(m, F.lit(n)).alias(n) for n in names])).otherwise(first))[0]


def node_ids(nodes: DataFrame) -> DataFrame:
    """Nodes numbered within their section, after drops: ``s<section>.<n>``."""
    n = F.row_number().over(W.partitionBy("doc_id", "section_index").orderBy("block_no"))
    return nodes.withColumn("step_index", n).withColumn("node_id", F.concat(F.lit("s"), F.col("section_index").cast("string"), F.lit("."), n.cast("string")))


def document_commands(nodes: DataFrame) -> DataFrame:
    """``doc_id, commands``: every command of a document once, in the order of first appearance."""
    c = nodes.select("doc_id", "block_no", F.posexplode("commands").alias("n", "command"))
    first = c.groupBy("doc_id", "command").agg(F.min(F.struct("block_no", "n")).alias("at"))
    return first.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("at", "command")))["command"].alias("commands"))


def render_node() -> Column:
    """One line: id and description, commands, expected output, rollback mark."""
    tagged = F.lower("section").startswith("rollback")
    return F.concat_ws(
        " | ",
        F.concat(F.lit("["), "node_id", F.lit("] "), "description"),
        F.when(F.size("commands") > 0, F.concat(F.lit("CMD: "), F.array_join("commands", " ▸ "))),
        F.concat(F.lit("EXPECT: "), "expected_output"),
        F.when(F.col("is_rollback") & ~tagged, F.lit("[ROLLBACK]")),
    )


def outline_nodes(placed: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """All nodes of blocks in sections, those of table rows among the others, numbered together. ``row_index`` tells
    a table's header; without that column the first row of a table is it. ``placed`` is read twice and checkpointed when
    this is called."""
    placed = checkpointed(placed)
    rows = placed if "row_index" in placed.columns else placed.withColumn("row_index", F.lit(None).cast("int"))
    return node_ids(block_nodes(placed, texts).unionByName(table_nodes(rows), allowMissingColumns=True))


def outline_sections(blocks: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """``doc_id, section_index, route, part``: each section as it stands in the outline: its heading, then nodes
    or, in text mode, its blocks' text, indented."""
    return _parts(blocks, texts).where("section_index IS NOT NULL").select("doc_id", "section_index", "route", "part")


def _routed(blocks: DataFrame, least: float = 0.4) -> DataFrame:
    """All blocks in their sections, plus the document's structure, route and raw tokens and the section's mode."""
    t, whole = F.col("block_type"), W.partitionBy("doc_id")
    d = sectioned(blocks)
    counts = {f"__{k}": F.count_if(t == k).over(whole) for k in KINDS}
    counts |= {"__total": F.count_if(t.isin(*KINDS)).over(whole), "__numbered": F.count_if(F.col("content").rlike(r"^\d+\.")).over(whole), "__chars": F.sum(F.length("content") + 1).over(whole)}
    d = d.withColumns(counts)
    d = d.withColumn("structure", structure_of(lambda k: F.col(f"__{k}"))).withColumn("route", route(F.col("structure"))).withColumn("raw_tokens", F.greatest(F.lit(1), F.floor(F.col("__chars") / X.CHARS_PER_TOKEN).cast("int"))).drop(*counts)
    inside = W.partitionBy("doc_id", "section_index")
    by_share = F.when(F.count_if(_structured()).over(inside) / F.count("*").over(inside) >= least, "outline").otherwise("text")
    return d.withColumn("mode", F.when(F.col("route") == "mixed", by_share).otherwise(F.col("route")))


def _parts(blocks: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """``doc_id, section_index, structure, route, raw_tokens, part``; the headings that open sections are a row without an index and
    part. Documents are dealt once: whatever is asked of them is a window or an aggregate that keeps to that. Where
    there are tables, the blocks are cut from what made them, as their rows are read twice."""
    d = _routed(blocks)
    tables = "row_index" in blocks.columns
    if tables:
        d = checkpointed(d)
    outlined = F.col("section_index").isNotNull() & (F.col("mode") == "outline")
    said = ["doc_id", "section_index", "section", "block_no", "structure", "route", "raw_tokens", "__node", "description", "commands", "expected_output"]
    n = _with_nodes(d, outlined, texts).select(*said, F.when(F.col("section_index").isNotNull() & (F.col("mode") == "text"), F.concat(F.lit("  "), "content")).alias("__text"), F.lit(False).alias("is_rollback"))
    if tables:
        rows = table_nodes(d.where(outlined & (F.col("block_type") == "table_row")))
        n = n.unionByName(rows.select("doc_id", "section_index", "section", "block_no", F.lit(True).alias("__node"), "description", "commands", "expected_output", "is_rollback"), allowMissingColumns=True)
        n = n.repartition(max(d.rdd.getNumPartitions(), tasks(d.sparkSession, 0)), "doc_id")
    upto = W.partitionBy("doc_id", "section_index").orderBy("block_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    n = n.withColumn("__n", F.count_if(F.col("__node")).over(upto))
    n = n.withColumn("node_id", F.concat(F.lit("s"), F.col("section_index").cast("string"), F.lit("."), F.col("__n").cast("string")))
    n = n.withColumn("is_rollback", F.when(F.col("__node"), F.col("is_rollback") | F.col("section").rlike(P.ROLLBACK_SECTION)))
    n = computed(n, __line=F.when(F.col("__node"), render_node()).otherwise(F.col("__text")))
    lines = F.sort_array(F.collect_list(F.when(F.col("__line").isNotNull(), F.struct("block_no", "__line"))))["__line"]
    s = n.groupBy("doc_id", "section_index").agg(F.first("section", ignorenulls=True).alias("section"), F.max("structure").alias("structure"), F.max("route").alias("route"), F.max("raw_tokens").alias("raw_tokens"), lines.alias("lines"))
    title = F.concat(F.lit("SECTION: "), "section", F.when(F.col("section").rlike(P.ROLLBACK_SECTION), "  [ROLLBACK]").otherwise(""))
    part = F.when(F.size("lines") > 0, F.concat_ws("\n", title, F.array_join("lines", "\n"))).otherwise(title)
    return s.select("doc_id", "section_index", "structure", "route", "raw_tokens", F.when(F.col("section_index").isNotNull(), part).alias("part"))


def outlines(docs: DataFrame, blocks: DataFrame, texts: DataFrame | None = None, structure: bool = False) -> DataFrame:
    """``doc_id, route, outline, raw_tokens, outline_tokens, ratio`` for each document with blocks.

    Prose documents have no outline. The ratio is what the outline saves of the raw tokens, 0 at least.
    ``texts`` as in block_nodes(). With ``structure``, that of the document, as in document_structure(), is a column, too.
    """
    text = F.array_join(F.sort_array(F.collect_list(F.when(F.col("section_index").isNotNull(), F.struct("section_index", "part"))))["part"], "\n")
    route_ = F.max(F.when(F.col("section_index").isNotNull(), F.col("route")))
    g = _parts(blocks, texts).groupBy("doc_id").agg(F.coalesce(route_, F.lit("text")).alias("route"), text.alias("outline"), F.max("raw_tokens").alias("raw_tokens"), F.max("structure").alias("structure"))
    d = g.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "raw_tokens", "route", "outline", *(["structure"] if structure else []))
    d = d.withColumn("outline", F.when(F.col("route") == "text", "").otherwise(F.coalesce("outline", F.lit(""))))
    d = d.withColumn("outline_tokens", X.tokens(F.col("outline")))
    return d.withColumn("ratio", F.when(F.col("route") == "text", 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - F.col("outline_tokens") / F.col("raw_tokens")), 3)))


def compression_report(outlined: DataFrame, structures: DataFrame) -> DataFrame:
    """By structure: documents, those with an outline, raw and outline tokens, mean ratio of those."""
    used = F.col("route") != "text"
    return outlined.join(structures, "doc_id").groupBy("structure").agg(F.count("*").alias("n_docs"), F.count_if(used).alias("n_outlined"), F.sum("raw_tokens").alias("raw_tokens"), F.sum("outline_tokens").alias("outline_tokens"), F.round(F.avg(F.when(used, F.col("ratio"))), 4).alias("mean_ratio"))
