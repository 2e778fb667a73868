"""Documents into lines and typed blocks. Everything here is keyed by doc_id: partition by it once, and all the
windows and aggregates below reuse that partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from procflow.functions import patterns as P
from procflow.functions.text import is_boilerplate, squeeze, strip
from procflow.operators import ordered
from procflow.session import computed

LINE_BREAK = r"\r\n|\n|\r"


def split_lines(docs: DataFrame, column: str = "text") -> DataFrame:
    """``doc_id, line_no (from 1), raw`` of every line; a final line break starts no line."""
    text = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"(?:\r\n|\n|\r)\z", "")
    return docs.where(F.length(column) > 0).select("doc_id", F.posexplode(F.split(text, LINE_BREAK)).alias("line_no", "raw")).withColumn("line_no", F.col("line_no") + 1)


def _by_line(*more: str):
    return W.partitionBy("doc_id", *more).orderBy("line_no")


def fence_state(lines: DataFrame, hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """``lines`` plus ``is_fence``, ``fence_no`` (fences so far), ``in_fence`` and ``closed`` (of this fence).

    With ``hot_rows`` of zero or more, documents of more lines are counted in spans of lines, and lines are counted
    when this is called; None takes all documents as ordinary ones."""
    upto = _by_line().rowsBetween(W.unboundedPreceding, W.currentRow)
    fence = F.col("is_fence")

    def usual(d: DataFrame) -> DataFrame:
        d = d.withColumn("fence_no", F.sum(fence.cast("int")).over(upto))
        return d.withColumn("__last", F.max("fence_no").over(W.partitionBy("doc_id")))

    def hot(d: DataFrame) -> DataFrame:
        d = ordered.running_count(d, ["doc_id"], "line_no", fence, "fence_no")
        return d.join(F.broadcast(d.groupBy("doc_id").agg(F.max("fence_no").alias("__last"))), "doc_id")  # a row a hot document

    d = lines.withColumn("is_fence", F.col("raw").startswith("```"))
    d = usual(d) if hot_rows is None else ordered.by_heat(d, "doc_id", hot_rows, usual, hot)
    d = d.withColumn("in_fence", (F.col("fence_no") % 2 == 1) & ~fence)
    return d.withColumn("closed", F.col("__last") > F.col("fence_no")).drop("__last")


def list_level(c: Column) -> Column:
    """Nesting depth of leading numbering: its dots; 1 without numbering."""
    number = F.regexp_extract(c, r"^\s*((?:\d+\.)+)", 1)
    return F.when(number == "", 1).otherwise(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))))


def _read(d: DataFrame) -> DataFrame:
    """Lines (``raw``, ``in_fence``) plus kind (null for blank ones, which go), content and level."""
    text = strip(F.col("raw"))
    numbered = text.rlike(P.NUMBERED) | text.rlike(P.STEP)
    kind = (
        F.when(F.col("in_fence"), "fence")
        .when(text == "", None)
        .when(text.rlike(P.HEADING), "heading")
        .when(F.col("raw").rlike("^    .+"), "code_block")
        .when(numbered, "numbered")
        .when(text.rlike(P.BULLET), "bullet")
        .otherwise("paragraph")
    )
    content = (
        F.when(F.col("kind") == "heading", strip(F.regexp_extract(text, P.HEADING, 2)))
        .when(F.col("kind") == "numbered", strip(F.regexp_replace(F.regexp_replace(text, P.NUMBERED, ""), P.STEP, "")))
        .when(F.col("kind") == "bullet", strip(F.regexp_replace(text, P.BULLET, "")))
        .when(F.col("kind") == "fence", F.col("raw"))
        .otherwise(text)
    )
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract(text, P.HEADING, 1))).when(F.col("kind") == "numbered", list_level(text)).when(F.col("kind") == "bullet", 1).otherwise(0)
    return computed(d, kind=kind).where("kind is not null").withColumn("content", content).withColumn("level", level.cast("int"))


def block_texts(texts: DataFrame) -> DataFrame:
    """``content``, each once, of the blocks that single lines (``raw``) make."""
    return _read(texts.select("raw", F.lit(False).alias("in_fence"))).select("content").distinct()


def parse_blocks(lines: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """``doc_id, block_no, block_type, content, level`` from ``doc_id, line_no, raw``.

    Lines between two fences join to one code block; an empty fence gives none, an unclosed one loses its lines.
    Other lines are headings, indented code, list items or paragraphs, in that order; blank lines are dropped.
    ``texts``: every ``raw`` of the lines, each once (session.repeated); lines are then read once a text.
    """
    d = fence_state(lines, hot_rows=None).where("not is_fence and (not in_fence or closed)")
    if texts is None:
        d = _read(d)
    else:
        known = _read(texts.select("raw", F.lit(False).alias("in_fence"))).select(F.col("raw").alias("__raw"), F.struct("kind", "content", "level").alias("__read"))
        fence = lambda c, name: F.when(F.col("in_fence"), c).otherwise(F.col(f"__read.{name}")).alias(name)
        d = d.join(F.broadcast(known), F.col("raw") == F.col("__raw"), "left").where("in_fence or __read is not null")
        d = d.select("doc_id", "line_no", "fence_no", fence(F.lit("fence"), "kind"), fence(F.col("raw"), "content"), fence(F.lit(0), "level"))
    # lines of one fence share a group; any other line is its own
    group = F.when(F.col("kind") == "fence", -F.col("fence_no")).otherwise(F.col("line_no"))
    g = d.groupBy("doc_id", group.alias("g")).agg(
        F.min("line_no").alias("line_no"),
        F.first("kind").alias("kind"),
        F.max("level").alias("level"),
        F.array_join(F.sort_array(F.collect_list(F.struct("line_no", "content")))["content"], "\n").alias("content"),
    )
    names = F.when(F.col("kind") == "fence", "code_block").when(F.col("kind").isin("numbered", "bullet"), "list_item").otherwise(F.col("kind"))
    g = g.withColumn("content", F.when(F.col("kind") == "fence", strip(F.col("content"))).otherwise(F.col("content")))
    g = g.where((F.col("kind") != "fence") | (F.col("content") != ""))
    return g.select("doc_id", F.row_number().over(_by_line()).alias("block_no"), names.alias("block_type"), "content", "level")


def document_titles(docs: DataFrame, blocks: DataFrame, path: str = "source_file") -> DataFrame:
    """``doc_id, title``: the first heading that is not blank, else the file's stem in title case."""
    from procflow.functions.text import stem_title

    first = blocks.where((F.col("block_type") == "heading") & (strip(F.col("content")) != "")).groupBy("doc_id").agg(F.min_by("content", "block_no").alias("heading"))
    return docs.join(first, "doc_id", "left").select("doc_id", F.coalesce("heading", stem_title(F.col(path))).alias("title"))


# ---- Fixed values: numbered lines and headings of extracted pages ----
PAGE_NUMBERED = r"(?i)^\s*(\d+[\.\)]\s+|\d+\.\d+[\.\)]\s+|Step\s+\d+\s*[-:.]?\s*)"
SCAN_HEADING = r"^[A-Z][A-Z\s\-–:]{5,}$"


def classify_page_lines(lines: DataFrame, scanned: bool = False) -> DataFrame:
    """Lines of extracted pages (``text``, ``font_size``) plus block_type, level and content.

    Without Markdown, large type or a short line in capitals marks a heading; recognised text has no type size.
    """
    t = F.col("text")
    listed = t.rlike(PAGE_NUMBERED) | t.rlike(P.BULLET)
    if scanned:
        heading = t.rlike(SCAN_HEADING) & (F.length(t) < 80)
        deep = t.rlike(r"^\s*\d+\.\d+")
    else:
        capitals = (F.length(t) < 80) & (t == F.upper(t)) & (t != F.lower(t)) & (F.size(F.split(squeeze(t), " ")) >= 2)
        heading = F.coalesce(F.col("font_size") >= 14, F.lit(False)) | capitals
        deep = t.rlike(r"^\s*\d+\.\d+")
    return lines.withColumn("block_type", F.when(listed, "list_item").when(heading, "heading").otherwise("paragraph")).withColumn("level", F.when(deep, 2).when(listed, 1).otherwise(0)).withColumn(
        "content", strip(F.regexp_replace(F.regexp_replace(t, PAGE_NUMBERED, ""), P.BULLET, ""))
    )


def is_scanned(docs: DataFrame, page_text: DataFrame, min_chars: int = 20, min_share: float = 0.10) -> DataFrame:
    """``doc_id, n_pages, text_pages, scanned``: a page has text from ``min_chars`` on; scanned if the share of
    such pages is below ``min_share``, or nothing was extracted."""
    pages = page_text.groupBy("doc_id", "page").agg(F.sum(F.length("text")).alias("n"))
    g = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if(F.col("n") >= min_chars).alias("text_pages"))
    d = docs.select("doc_id").distinct().join(g, "doc_id", "left").na.fill(0, ["n_pages", "text_pages"])
    return d.withColumn("scanned", (F.col("n_pages") == 0) | (F.col("text_pages") / F.greatest("n_pages", F.lit(1)) < min_share))


def rebuild_text(blocks: DataFrame) -> DataFrame:
    """``doc_id, text``: blocks as lines again, headings as ``## h``, items as ``- i``, rows between bars."""
    t, c = F.col("block_type"), F.col("content")
    part = F.when(t == "heading", F.concat(F.lit("\n## "), c, F.lit("\n"))).when(t == "list_item", F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(0), F.col("level") - 1)), F.lit("- "), c)).when(t == "table_row", F.concat(F.lit("| "), c, F.lit(" |"))).otherwise(c)
    rows = F.sort_array(F.collect_list(F.struct("block_no", part.alias("p"))))
    return blocks.groupBy("doc_id").agg(F.array_join(rows["p"], "\n").alias("text"))


KINDS = ("table_row", "list_item", "paragraph", "heading", "code_block")


def block_counts(blocks: DataFrame) -> DataFrame:
    """``doc_id``, the number of blocks of each kind, ``total``, and ``numbered`` (contents that start ``N.``)."""
    t = F.col("block_type")
    return blocks.groupBy("doc_id").agg(*[F.count_if(t == k).alias(k) for k in KINDS], F.count_if(t.isin(*KINDS)).alias("total"), F.count_if(F.col("content").rlike(r"^\d+\.")).alias("numbered"))


def structure_of(c) -> Column:
    """The structure that counts of blocks show; ``c`` gives the column of a name."""
    total = F.greatest(c("total"), F.lit(1))
    active = sum((c(k) > 2).cast("int") for k in KINDS)
    return (
        F.when(c("table_row") / total > 0.4, "table")
        .when(c("list_item") / total > 0.5, F.when(c("numbered") > 0.3 * c("list_item"), "numbered_list").otherwise("bulleted_list"))
        .when(c("paragraph") / total > 0.7, "prose")
        .when(active >= 2, "mixed")
        .otherwise("unknown")
    )


def document_structure(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """``doc_id, structure``; documents without blocks are unknown."""
    c = block_counts(blocks).select("doc_id", structure_of(F.col).alias("structure"))
    return docs.select("doc_id").distinct().join(c, "doc_id", "left").select("doc_id", F.coalesce("structure", F.lit("unknown")).alias("structure"))


def normalizer_suitability(blocks: DataFrame) -> DataFrame:
    """``doc_id, suits_list, suits_prose, suits_table`` by shares of all blocks."""
    n = F.count("*")
    share = lambda k: F.count_if(F.col("block_type") == k) / n
    return blocks.groupBy("doc_id").agg((share("list_item") > 0.4).alias("suits_list"), (share("paragraph") > 0.6).alias("suits_prose"), (share("table_row") > 0.3).alias("suits_table"))


def _by_block(*more: str):
    return W.partitionBy("doc_id", *more).orderBy("block_no")


def list_steps(blocks: DataFrame) -> DataFrame:
    """``doc_id, step_no, text``: one step a list item, under its section and parent item; paragraphs and code go
    to the latest step, or are a step of their own before the first item."""
    upto = _by_block().rowsBetween(W.unboundedPreceding, W.currentRow)
    t = F.col("block_type")
    d = blocks.where(t.isin("heading", "list_item", "paragraph", "code_block"))
    d = d.withColumn("section", F.last(F.when(t == "heading", F.col("content")), ignorenulls=True).over(upto))
    d = d.withColumn("h", F.count_if(t == "heading").over(upto))
    d = d.withColumn("items", F.count_if(t == "list_item").over(upto))
    d = d.withColumn("early", F.min(F.when(t != "heading", F.col("block_no"))).over(W.partitionBy("doc_id")))
    inside = W.partitionBy("doc_id", "h").orderBy("block_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    d = d.withColumn("parent", F.last(F.when((t == "list_item") & (F.col("level") == 1), F.col("content")), ignorenulls=True).over(inside))
    d = d.where(t != "heading")
    # before the first item, the first paragraph opens a step that takes the others
    opens = (F.col("block_type") == "list_item") | ((F.col("block_no") == F.col("early")) & (F.col("items") == 0))
    d = d.withColumn("step_no", F.sum(opens.cast("int")).over(upto)).withColumn("opens", opens)
    prefix = F.when(F.coalesce(F.col("section"), F.lit("")) != "", F.concat(F.lit("["), "section", F.lit("] "))).otherwise("")
    under = F.when((F.col("level") != 1) & (F.coalesce(F.col("parent"), F.lit("")) != ""), F.concat(F.lit("(sub-step of: "), "parent", F.lit(") "))).otherwise("")
    text = F.when(F.col("block_type") == "list_item", F.concat(prefix, under, F.col("content"))).when(F.col("opens"), F.col("content")).otherwise(F.concat(F.lit("\n  "), F.col("content")))
    rows = F.sort_array(F.collect_list(F.struct("block_no", text.alias("p"))))
    return d.groupBy("doc_id", "step_no").agg(F.array_join(rows["p"], "").alias("text"))


def prose_steps(blocks: DataFrame) -> DataFrame:
    """``doc_id, group_no, heading, text``: paragraphs and code under one heading joined by spaces, boilerplate
    left out."""
    upto = _by_block().rowsBetween(W.unboundedPreceding, W.currentRow)
    t = F.col("block_type")
    d = blocks.withColumn("group_no", F.count_if(t == "heading").over(upto)).withColumn("heading", F.last(F.when(t == "heading", F.col("content")), ignorenulls=True).over(upto))
    d = d.where(t.isin("paragraph", "code_block") & ~is_boilerplate(F.col("content")))
    rows = F.sort_array(F.collect_list(F.struct("block_no", "content")))
    return d.groupBy("doc_id", "group_no").agg(F.first("heading").alias("heading"), F.array_join(rows["content"], " ").alias("text"))


def drop_boilerplate(blocks: DataFrame) -> DataFrame:
    return blocks.where(~is_boilerplate(F.col("content")))


def table_headers(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, header, header_block``: the last row with row_index 0, else the first row."""
    zero = F.col("row_index") == 0
    g = rows.groupBy(*keys).agg(F.max(F.when(zero, F.col("block_no"))).alias("z"), F.max_by("content", F.when(zero, F.col("block_no"))).alias("zc"), F.min("block_no").alias("f"), F.min_by("content", "block_no").alias("fc"))
    return g.select(*keys, F.when(F.col("z").isNotNull(), F.col("zc")).otherwise(F.col("fc")).alias("header"), F.coalesce("z", "f").alias("header_block"))


def meaning_of(cell: Column, synonyms: dict = P.COLUMN_SYNONYMS) -> Column:
    """All meanings whose synonyms stand in a header cell, in the order of the table."""
    return F.filter(F.array(*[F.when(_any_of(cell, words), F.lit(name)) for name, words in synonyms.items()]), lambda x: x.isNotNull())


def _any_of(cell: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(cell, F.lit(w))
    return out


def column_map(header_cells: Column) -> Column:
    """Map of meaning to column index (from 0): columns from left to right each take the first meaning that fits
    and is not taken yet."""
    start = F.create_map().cast("map<string,int>")
    indexed = F.transform(header_cells, lambda c, i: F.struct(i.alias("i"), meaning_of(F.lower(strip(c))).alias("m")))

    def add(acc: Column, x: Column) -> Column:
        free = F.filter(x["m"], lambda m: ~F.map_contains_key(acc, m))
        return F.when(F.size(free) > 0, F.map_concat(acc, F.map_from_arrays(F.array(F.get(free, F.lit(0))), F.array(x["i"])))).otherwise(acc)

    return F.aggregate(indexed, start, add)


def table_steps(rows: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, block_no, text`` of the data rows of each table, cells named by the header's meanings."""
    h = table_headers(rows, keys).withColumn("cols", column_map(F.split(F.col("header"), r" \| ")))
    d = rows.join(h, list(keys)).where("block_no <> header_block").withColumn("cells", F.transform(F.split("content", r" \| "), strip))
    get = lambda m: F.nullif(F.coalesce(F.get("cells", F.try_element_at("cols", F.lit(m))), F.lit("")), F.lit(""))
    named = F.concat_ws(
        " | ",
        F.concat(F.lit("Step "), get("step"), F.lit(":")),
        get("action"),
        F.concat(F.lit("Expected: "), get("expected")),
        F.concat(F.lit("Rollback: "), get("rollback")),
        F.concat(F.lit("Notes: "), get("notes")),
    )
    plain = F.array_join(F.filter("cells", lambda c: c != ""), " — ")
    return d.select(*keys, "block_no", F.when(F.size("cols") == 0, plain).otherwise(named).alias("text"))


def sections(blocks: DataFrame) -> DataFrame:
    """Blocks (headings of level 1 and 2 left out) plus ``section`` (``_preamble`` before the first) and
    ``section_index``, dense from 1 over sections that have blocks."""
    return sectioned(blocks).where("section_index IS NOT NULL")


def sectioned(blocks: DataFrame) -> DataFrame:
    """All blocks plus ``section`` and ``section_index`` as of sections(), without an index for headings of level 1 and
    2. All of it keeps the one order of blocks."""
    upto = _by_block().rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = (F.col("block_type") == "heading") & (F.col("level") <= 2)
    own = F.coalesce(~starts, F.lit(False))
    d = blocks.withColumn("__no", F.count_if(starts).over(upto)).withColumn("section", F.coalesce(F.last(F.when(starts, F.col("content")), ignorenulls=True).over(upto), F.lit("_preamble")))
    before = F.last(F.when(own, F.col("__no")), ignorenulls=True).over(_by_block().rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("__first", own & ~before.eqNullSafe(F.col("__no")))
    return d.withColumn("section_index", F.when(own, F.count_if(F.col("__first")).over(upto)).cast("int")).drop("__no", "__first")


def page_words_to_lines(words: DataFrame, tolerance: int = 3) -> DataFrame:
    """``doc_id, page, line_no, text`` from placed words: sorted by rounded height and place, a new line wherever
    the rounded height is over ``tolerance`` from the line's first word. A fold over one page's words."""
    entry = F.struct(F.round(F.col("top") / 3).alias("band"), F.col("x0"), F.col("text"), F.col("top"))
    g = words.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(entry)).alias("ws"))
    start = F.struct(F.lit(None).cast("double").alias("y"), F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def add(acc: Column, w: Column) -> Column:
        y = F.round(w["top"])
        new = acc["y"].isNull() | (F.abs(y - acc["y"]) > tolerance)
        return F.struct(
            F.when(new, y).otherwise(acc["y"]).alias("y"),
            F.when(new & acc["open"].isNotNull(), F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(new, w["text"]).otherwise(F.concat(acc["open"], F.lit(" "), w["text"])).alias("open"),
        )

    folded = F.aggregate("ws", start, add, lambda a: F.concat(a["done"], F.array(a["open"])))
    return g.select("doc_id", "page", F.posexplode(folded).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)
