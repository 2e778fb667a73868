"""Documents in chunks that fit a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from procflow.functions.text import tokens
from procflow.session import checkpointed

BUDGET = 80_000
#: Commands named in a request, at most.
HINTS = 50


def needs_chunking(n_tokens: Column, budget: int = BUDGET) -> Column:
    return n_tokens > budget


def chunk_text(block_type: Column, content: Column, level: Column) -> Column:
    return (
        F.when(block_type == "heading", F.concat(F.lit("\n## "), content, F.lit("\n")))
        .when(block_type == "list_item", F.concat(F.repeat(F.lit("  "), F.greatest(F.lit(0), level - 1)), F.lit("- "), content))
        .when(block_type == "table_row", F.concat(F.lit("| "), content, F.lit(" |")))
        .when(block_type == "code_block", F.concat(F.lit("    "), content))
        .otherwise(content)
    )


def chunk_sections(blocks: DataFrame) -> DataFrame:
    """Blocks with the section they stand in: a heading of level 1 or 2 starts one and is its first block."""
    upto = W.partitionBy("doc_id").orderBy("block_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = (F.col("block_type") == "heading") & (F.col("level") <= 2)
    d = blocks.withColumn("section_no", F.count_if(starts).over(upto))
    d = d.withColumn("section", F.coalesce(F.last(F.when(starts, F.col("content")), ignorenulls=True).over(upto), F.lit("_preamble")))
    return d.withColumn("part", chunk_text(F.col("block_type"), F.col("content"), F.col("level"))).where("part <> ''")


def section_texts(blocks: DataFrame) -> DataFrame:
    """``doc_id, section_no, section, text, n_tokens``."""
    g = chunk_sections(blocks).groupBy("doc_id", "section_no").agg(F.first("section").alias("section"), F.array_join(F.sort_array(F.collect_list(F.struct("block_no", "part")))["part"], "\n").alias("text"))
    return g.withColumn("n_tokens", tokens(F.col("text")))


def greedy_groups(sizes: Column, budget: int) -> Column:
    """For an array of sizes, the group (from 1) of each when consecutive ones are packed into groups of at most
    ``budget``; one that is larger stands alone. A fold, as the sum starts anew with each group."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(1).alias("group"), F.array().cast("array<int>").alias("out"))

    def add(a: Column, n: Column) -> Column:
        over = (a["sum"] > 0) & (a["sum"] + n > budget)
        group = F.when(over, a["group"] + 1).otherwise(a["group"])
        return F.struct(F.when(over, n.cast("long")).otherwise(a["sum"] + n).alias("sum"), group.alias("group"), F.concat(a["out"], F.array(group)).alias("out"))

    return F.aggregate(sizes, start, add, lambda a: a["out"])


def pack(rows: DataFrame, order: str, size: str, budget: int, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, order, group_no`` of consecutive rows packed by budget."""
    g = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.col(size).alias("n")))).alias("xs"))
    g = g.withColumn("gs", greedy_groups(F.col("xs")["n"], budget))
    return g.select(*keys, F.explode(F.arrays_zip(F.transform("xs", lambda x: x[order]).alias("o"), F.col("gs"))).alias("z")).select(*keys, F.col("z.o").alias(order), F.col("z.gs").alias("group_no"))


def split_oversized(blocks: DataFrame, budget: int) -> DataFrame:
    """``doc_id, section_no, piece, section, text, n_tokens``: sections over the budget are cut between blocks; the
    heading is repeated and later pieces are labelled as continued."""
    d = checkpointed(chunk_sections(blocks).withColumn("n", tokens(F.col("part"))))  # read three times
    total = F.sum(F.length("part") + 1).over(W.partitionBy("doc_id", "section_no"))
    d = d.withColumn("big", F.floor(total / 3.5) > budget)
    small = d.where("not big").groupBy("doc_id", "section_no").agg(F.lit(1).alias("piece"), F.first("section").alias("section"), F.array_join(F.sort_array(F.collect_list(F.struct("block_no", "part")))["part"], "\n").alias("text"))
    big = d.where("big")
    placed = big.join(pack(big, "block_no", "n", budget, ("doc_id", "section_no")), ["doc_id", "section_no", "block_no"])
    p = placed.groupBy("doc_id", "section_no", F.col("group_no").alias("piece")).agg(F.first("section").alias("section"), F.array_join(F.sort_array(F.collect_list(F.struct("block_no", "part")))["part"], "\n").alias("text"))
    p = p.withColumn("section", F.when(F.col("piece") > 1, F.concat("section", F.lit(" (continued "), F.col("piece").cast("string"), F.lit(")"))).otherwise(F.col("section")))
    p = p.withColumn("text", F.when((F.col("piece") > 1) & (F.col("section_no") > 0), F.concat(F.lit("\n## "), "section", F.lit("\n\n"), "text")).otherwise(F.col("text")))
    return small.unionByName(p).withColumn("n_tokens", tokens(F.col("text")))


def chunks(blocks: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``doc_id, chunk_index (from 0), total_chunks, headings, text, n_tokens``."""
    pieces = checkpointed(split_oversized(blocks, budget)).withColumn("o", F.struct("section_no", "piece"))
    placed = pieces.join(pack(pieces, "o", "n_tokens", budget), ["doc_id", "o"])
    rows = F.sort_array(F.collect_list(F.struct("o", "section", "text")))
    g = placed.groupBy("doc_id", (F.col("group_no") - 1).alias("chunk_index")).agg(rows.alias("rows"))
    g = g.withColumn("headings", F.filter(F.col("rows")["section"], lambda s: s != "_preamble")).withColumn("text", F.array_join(F.col("rows")["text"], "\n\n"))
    return g.select("doc_id", "chunk_index", F.count("*").over(W.partitionBy("doc_id")).alias("total_chunks"), "headings", "text", tokens(F.col("text")).alias("n_tokens"))


#: Characters of the pieces that commands are looked up by: the longer, if the command has a word of that length.
GRAMS = (5, 3)


def _grams(text: Column, n: int) -> Column:
    """The distinct pieces of ``n`` characters without white space, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(rf"(?=(\S{{{n}}}))"), 1))


def command_candidates(chunked: DataFrame, commands: DataFrame) -> DataFrame:
    """``doc_id, chunk_index, raw``: pairs of a command and a chunk that holds the rarest piece of it, a superset of
    those whose text stands in the chunk. ``chunked``: doc_id, chunk_index, text; ``commands``: doc_id, raw, each once.

    An inverted index of pieces of words: whatever chunk holds a command's text holds its pieces, so none is lost. Of a
    command's pieces the one in the fewest chunks of the document is joined; of the chunks' pieces only those that a
    command has are kept. Commands without a word of three characters go with all chunks of their document.
    """
    long, short = GRAMS
    size = F.when(F.regexp_like("raw", F.lit(rf"\S{{{long}}}")), long).when(F.regexp_like("raw", F.lit(rf"\S{{{short}}}")), short).otherwise(0)
    c = commands.select("doc_id", "raw", size.alias("n"))
    blank = c.where("n = 0").select("doc_id", "raw")
    pieces = c.where("n > 0").select("doc_id", "raw", F.explode(F.when(F.col("n") == long, _grams(F.col("raw"), long)).otherwise(_grams(F.col("raw"), short))).alias("gram"))
    wanted = pieces.select("doc_id", "gram").distinct()
    few = chunked.join(c.where(F.col("n") == short).select("doc_id").distinct(), "doc_id", "left_semi")
    of = lambda d, n: d.select("doc_id", "chunk_index", F.explode(_grams(F.col("text"), n)).alias("gram"))
    index = of(chunked, long).unionByName(of(few, short)).join(wanted, ["doc_id", "gram"], "left_semi")
    rarest = pieces.join(index.groupBy("doc_id", "gram").agg(F.count("*").alias("held")), ["doc_id", "gram"], "left")
    # a piece that no chunk holds tells that the command stands nowhere
    rarest = rarest.groupBy("doc_id", "raw").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram"))["gram"].alias("gram"))
    pairs = rarest.join(index, ["doc_id", "gram"]).select("doc_id", "chunk_index", "raw")
    return pairs.unionByName(chunked.select("doc_id", "chunk_index").join(blank, "doc_id"))


#: Commands of a document up to which each of its chunks is searched for all of them; those of more go by the index.
SEARCHED = 200


def chunk_commands(chunked: DataFrame, commands: DataFrame, searched: int = SEARCHED) -> DataFrame:
    """``doc_id, chunk_index, raw, n, first_line``: commands (with their number and first line) whose text stands in a
    chunk, any case. A chunk is searched for the commands of its document, which go to it as one row, if they are at most
    ``searched``. In documents of more, commands are looked up in an index of the chunks' words first, so that only
    those pairs are compared that share a rare piece. Commands are checkpointed when this is called, and so are the
    chunks if there are such documents."""
    c = checkpointed(commands.where("raw IS NOT NULL").groupBy("doc_id", "raw").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line")))
    count = c.groupBy("doc_id").agg(F.count("*").alias("n"))
    chunked = chunked.select("doc_id", "chunk_index", "text")
    if count.where(F.col("n") > searched).isEmpty():
        return _searched(chunked, c)
    chunked = checkpointed(chunked)
    many = checkpointed(count.where(F.col("n") > searched).select("doc_id"))
    part = lambda d, how: d.join(many, "doc_id", how)
    return _searched(part(chunked, "left_anti"), part(c, "left_anti")).unionByName(_indexed(part(chunked, "left_semi"), part(c, "left_semi")))


def _searched(chunked: DataFrame, c: DataFrame) -> DataFrame:
    lists = c.groupBy("doc_id").agg(F.collect_list(F.struct("raw", "n", "first_line", F.lower("raw").alias("low"))).alias("cs"))
    d = chunked.join(lists, "doc_id").select("doc_id", "chunk_index", F.lower("text").alias("low"), "cs")
    d = d.select("doc_id", "chunk_index", F.explode(F.filter("cs", lambda x: F.contains(F.col("low"), x["low"]))).alias("c"))
    return d.select("doc_id", "chunk_index", "c.raw", "c.n", "c.first_line")


def _indexed(chunked: DataFrame, c: DataFrame) -> DataFrame:
    pairs = command_candidates(chunked, c.select("doc_id", "raw")).join(c, ["doc_id", "raw"])
    d = chunked.join(pairs, ["doc_id", "chunk_index"])
    return d.where(F.contains(F.lower("text"), F.lower("raw"))).select("doc_id", "chunk_index", "raw", "n", "first_line")


def processing_route(outline_route: Column, raw_tokens: Column, budget: int = BUDGET) -> Column:
    """outline where there is one, else chunked above the budget, else single."""
    return F.when(outline_route != "text", "outline").when(needs_chunking(raw_tokens, budget), "chunked").otherwise("single")


def requests(chunked: DataFrame, titles: DataFrame, structures: DataFrame, hints: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """``doc_id, chunk_index, request``: the text that asks for one chunk's steps, with at most 50 command hints, the
    first ones that the document has."""
    order = W.partitionBy("doc_id", "chunk_index").orderBy("first_line", "raw")
    h = hints.withColumn("place", F.row_number().over(order)).where(f"place <= {HINTS}").groupBy("doc_id", "chunk_index")
    h = h.agg(F.sort_array(F.collect_list(F.struct("place", "raw")))["raw"].alias("hints"))
    d = chunked.join(titles, "doc_id", "left").join(structures, "doc_id", "left").join(h, ["doc_id", "chunk_index"], "left")
    d = d.join(starts, ["doc_id", "chunk_index"], "left") if starts is not None else d.withColumn("sequence_start", F.lit(1))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), F.coalesce("title", F.lit("Untitled"))),
        F.concat(F.lit("Structure: "), F.coalesce("structure", F.lit("unknown"))),
        F.concat(F.lit("Part: "), F.when(F.size("headings") > 0, F.array_join("headings", " → ")).otherwise("Document")),
        F.concat(F.lit("First step: "), F.coalesce("sequence_start", F.lit(1)).cast("string")),
        F.concat(F.lit("Commands seen: "), F.array_join("hints", "; ")),
        F.lit("---"),
        F.col("text"),
    )
    return d.select("doc_id", "chunk_index", text.alias("request"))
