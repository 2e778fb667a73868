"""Merkle manifest of a dataset: levels stored as parent-linked node rows, proofs by a recursive query that climbs.

A leaf is the digest of one row. Leaves of a source, ascending by doc_id, are joined 16 at a time into nodes, these
again, until one is left: the source's subroot. Subroots, by source, are joined likewise into the root. ``build``
stores what it makes in the shared folder, digests as 32 bytes: *runs* (the 256 leaves below one node of the second
level, with the digests of the first) and *nodes* (a row for each node above: its children's digests). Each row links
to its parent. ``climb`` starts at the runs and ascends the links with a recursive common table expression: each step
appends the siblings of a node to the proof and folds the digest of every leaf of the run with them. All leaves of a
run have the same siblings above it, so that they climb in one row and the text of a proof is held once for them;
leaves whose digests have become the same on the way to the top of their run (those that were not tampered with)
climb as one.

Nothing here meets in one task: positions are counted over range partitions, not by a window over a source, and a
node that many runs climb through is repeated, once for RUNS_PER_COPY of the runs below it.

Null doc_ids come first; rows of equal doc_id follow each other by leaf digest, and rows equal in all five columns
are leaves of their own, in either order, as they are interchangeable. Null sources form one source, the first one.
Empty tables give no rows. Columns other than doc_id, source, lang, n_chars and text are not part of a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from procflow.llm.common import cut, table

FAN = 16
#: Leaves of a run: two levels.
RUN = FAN * FAN
#: Bytes of a digest.
WIDTH = 32
#: A node row is repeated so that each copy serves about so many runs.
RUNS_PER_COPY = 256
#: Rows of the table of offsets (one for each source and range partition) up to which it is broadcast.
BROADCAST_OFFSETS = 100_000
#: The tree of the subroots; those of sources begin with another letter.
ROOT = "r"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(c: Column) -> Column:
    """A value in a leaf: its UTF-8 byte count, a colon and itself; - where it is null."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def text_of(digests: str) -> str:
    """SQL for digests, as bytes one after the other, as hex text."""
    return f"lower(hex({digests}))"


def joined(digests: str) -> str:
    """SQL for an array of digests one after the other, as bytes (array_join takes texts only)."""
    return f"unhex(array_join(transform({digests}, d -> hex(d)), ''))"


def h(digests: str) -> str:
    """SQL for the digest, as bytes, of some digests' hex texts."""
    return f"unhex(sha2({text_of(digests)}, 256))"


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def lower_cased(doc_id: Column, text: Column) -> Column:
    """The tampering of the query: A-Z in lower case where 5 divides the checksum of the id."""
    hit = F.crc32(doc_id.cast("string")) % 5 == 0
    return F.when(hit, F.translate(text, LETTERS, LETTERS.lower())).otherwise(text)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` plus ``pos`` (from 0 within ``group``, by ``order``) and ``size`` (rows of the group).

    Rows are dealt to ranges of (group, order) and sorted there; a group's place in a range is the number of its rows
    in the ranges before. The window runs over one row for each group and range. A random last key splits equal rows.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order, "__r"]
    placed = rows.withColumn("__r", F.rand(1)).repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("__r")
    placed = cut(placed.withColumn("__at", F.monotonically_increasing_id()), "placed").withColumn("__range", F.shiftright("__at", 33))
    before = W.partitionBy(group).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    parts = placed.groupBy(group, "__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    parts = cut(parts.select(group, "__range", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(W.partitionBy(group)).alias("size")), "offsets")
    few = parts.count() <= BROADCAST_OFFSETS
    out = placed.join(F.broadcast(parts) if few else parts, [group, "__range"])
    return out.withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before")).drop("__range", "__at", "__first", "__before")


def height(size: Column) -> Column:
    """Levels above the leaves of a tree of so many leaves."""
    out = F.when(size <= 1, 0)
    for k in range(1, 16):
        out = out.when(size <= FAN**k, k)
    return out


def _ascend(level_rows: DataFrame, level: int) -> DataFrame:
    """The nodes above ``tree, size, idx, digest, runs`` of trees that still have several."""
    several = level_rows.where(F.col("size") > FAN ** (level - 1))
    kids = F.array_sort(F.collect_list(F.struct("idx", "digest")))
    g = several.groupBy("tree", F.expr(f"idx div {FAN}").alias("up")).agg(F.first("size").alias("size"), F.unhex(F.array_join(F.transform(kids, lambda k: F.hex(k["digest"])), "")).alias("children"), F.sum("runs").alias("runs"))
    return g.select("tree", "size", F.lit(level).alias("level"), F.col("up").alias("idx"), F.expr(h("children")).alias("digest"), "children", "runs")


def _levels(rows: DataFrame, first: int) -> list[DataFrame]:
    """Level after level above ``rows`` (of level ``first - 1``), each written, until no tree has several nodes."""
    most = rows.agg(F.max("size")).first()[0] or 0
    out = []
    while FAN ** (first - 1) < most:
        rows = cut(_ascend(rows, first), f"level-{first}")
        out.append(rows)
        first += 1
    return out


def _linked(rows: DataFrame, places: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` (tree, size, level, idx, ...) plus the link to the parent: up_tree, up_level, up_idx, up_copies, slot
    (up_tree is null at the root). Parents have at most 16 children, so no key of these joins is hot."""
    top = (F.col("level") == height(F.col("size"))) & (F.col("tree") != ROOT)
    inner = rows.where(~top).withColumn("at", F.col("idx"))
    inner = inner.withColumn("up_tree", F.when(F.col("level") < height(F.col("size")), F.col("tree"))).withColumn("up_level", F.col("level") + 1)
    tops = rows.where(top).join(places.select("tree", F.col("pos").alias("at"), F.when(F.col("size") > 1, ROOT).alias("up_tree")), "tree").withColumn("up_level", F.lit(1))
    d = inner.unionByName(tops).withColumn("up_idx", F.expr(f"at div {FAN}")).withColumn("slot", (F.col("at") % FAN).cast("int")).drop("at")
    parents = nodes.select(F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), F.ceil(F.col("runs") / RUNS_PER_COPY).alias("up_copies"))
    return d.join(parents, ["up_tree", "up_level", "up_idx"], "left")


def build(docs: DataFrame, presented: Column | None = None) -> tuple[DataFrame, DataFrame, str | None]:
    """``(runs, nodes, root)`` of ``docs``, stored in the shared folder.

    runs: tree, size, level (of the run's node: 0 for the leaf of a source of one row, 1 up to 16 rows, else 2), idx,
    digest, firsts (digests of the first level), leaves (array of pos, doc_id, leaf, start), folds (the different digests
    that the leaves' starts give at the run's node) and at (of each leaf, its place in folds). nodes: tree, level, idx,
    digest, children, runs and the link to the parent. root is null if there are no rows. ``presented`` is the text that
    is shown for checking, instead of ``text``: ``start`` is its leaf, null where that is the stored one.
    """
    c = [F.col(x) for x in ("doc_id", "source", "lang", "n_chars")]
    start = F.lit(None).cast("binary")
    if presented is not None:
        start = F.when(~presented.eqNullSafe(F.col("text")), F.unhex(leaf_digest(*c, presented)))
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    leaves = cut(docs.select(c[0].alias("doc_id"), tree.alias("tree"), F.unhex(leaf_digest(*c, F.col("text"))).alias("leaf"), start.alias("start")), "leaves")
    placed = numbered(leaves, "tree", "doc_id", "leaf")
    run = placed.groupBy("tree", F.expr(f"pos div {RUN}").alias("idx")).agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("pos", "doc_id", "leaf", "start"))).alias("leaves"))
    run = run.withColumn("level", F.least(height(F.col("size")), F.lit(2)))
    run = run.withColumn("firsts", F.expr(f"transform(sequence(0, (size(leaves) - 1) div {FAN}), j -> {h(joined(f'slice(leaves.leaf, {FAN} * j + 1, {FAN})'))})"))
    run = run.withColumn("digest", F.expr(f"CASE level WHEN 0 THEN leaves[0].leaf WHEN 1 THEN firsts[0] ELSE {h(joined('firsts'))} END"))
    runs = cut(run.select("tree", "size", "level", "idx", "digest", "firsts", "leaves"), "bare-runs")
    runs = cut(runs.select("*", F.expr(_folded()).alias("f")).select("tree", "size", "level", "idx", "digest", "firsts", "leaves", "f.folds", "f.at"), "runs")
    slim = runs.select("tree", "size", "level", "idx", "digest", F.lit(1).cast("long").alias("runs"))
    levels = _levels(slim, 3)
    subroots = None
    for x in (slim, *levels):
        top = x.where(F.col("level") == height(F.col("size"))).select("tree", "digest", F.lit(0).alias("all"), "runs")
        subroots = top if subroots is None else subroots.union(top)
    places = cut(numbered(subroots, "all", "tree").select("tree", "digest", "size", "pos", "runs"), "subroots")
    crown = _levels(places.select(F.lit(ROOT).alias("tree"), "size", F.col("pos").alias("idx"), "digest", "runs"), 1)
    last = (crown[-1] if crown else places).select(F.expr(text_of("digest"))).first()
    nodes = slim.where("false").withColumn("children", F.lit(None).cast("binary"))
    for x in (*levels, *crown):
        nodes = nodes.unionByName(x)
    links = nodes.unionByName(slim.withColumn("children", F.lit(None).cast("binary")))
    links = cut(_linked(links, places, nodes), "nodes")
    return runs, links, last[0] if last else None


def _others(children: str, slot: str) -> tuple[str, str]:
    """SQL for what stands left and right of a child."""
    return f"substring({children}, 1, {WIDTH} * {slot})", f"substring({children}, {WIDTH} * {slot} + {WIDTH + 1})"


def let(name: str, value: str, body: str) -> str:
    """SQL that computes ``value`` once for all its uses in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _folded() -> str:
    """SQL for folds and at of a run."""
    left, right = f"slice(b, {FAN} * (i div {FAN}) + 1, i % {FAN})", f"slice(b, i + 2, {FAN} - 1 - i % {FAN})"
    start = "coalesce(x.start, x.leaf)"
    first = h(f"concat({joined(left)}, {start}, {joined(right)})")
    second = h(f"concat({joined(f'slice(firsts, 1, i div {FAN})')}, {first}, {joined(f'slice(firsts, i div {FAN} + 2, {FAN})')})")
    own = let("b", "leaves.leaf", f"transform(leaves, (x, i) -> CASE level WHEN 0 THEN {start} WHEN 1 THEN {first} ELSE {second} END)")
    return let("o", own, let("k", "array_distinct(o)", "named_struct('folds', k, 'at', transform(o, x -> CAST(array_position(k, x) - 1 AS INT)))"))


def climb(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``tree, idx, folds, proof, subroot`` for each run: its folds at the root, the siblings above it, and its source's
    subroot. A recursive query over the stored nodes."""
    spark = runs.sparkSession
    left, right = _others("p.children", "c.slot")
    copy = lambda idx, n: f"pmod(xxhash64({idx}), {n})"
    fold = h(f"concat({left}, x, {right})")
    sql = f"""
    WITH RECURSIVE climb(tree, idx, up_tree, up_level, up_idx, up_copy, slot, folds, proof, subroot) AS (
      SELECT tree, idx, up_tree, up_level, up_idx, {copy("idx", "up_copies")}, slot, folds, CAST('' AS BINARY),
             CASE WHEN up_tree IS NULL OR up_tree <> tree THEN digest END
      FROM {{starts}}
      UNION ALL
      SELECT c.tree, c.idx, p.up_tree, p.up_level, p.up_idx, {copy("c.idx", "p.up_copies")}, p.slot,
             transform(c.folds, x -> {fold}), concat(c.proof, {left}, {right}),
             coalesce(c.subroot, CASE WHEN p.up_tree IS NULL OR p.up_tree <> p.tree THEN p.digest END)
      FROM climb c JOIN {{nodes}} p ON c.up_tree = p.tree AND c.up_level = p.level AND c.up_idx = p.idx AND c.up_copy = p.copy)
    SELECT tree, idx, folds, proof, subroot FROM climb WHERE up_tree IS NULL"""
    link = nodes.where("children IS NULL").select("tree", "idx", "up_tree", "up_level", "up_idx", "up_copies", "slot", "digest")
    starts = cut(runs.select("tree", "idx", "folds").join(link, ["tree", "idx"]), "starts")
    above = nodes.where("children IS NOT NULL").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("runs") / RUNS_PER_COPY) - 1)))
    limit = "spark.sql.cteRecursionRowLimit"  # meant for queries that never end; the tree is as deep as its rows need
    was = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        return cut(spark.sql(sql, starts=starts, nodes=above), "climb")
    finally:
        spark.conf.set(limit, was)


def prove(docs: DataFrame, presented: Column | None = None) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof, folded_root, verified`` for every row, digests as hex text.

    proof is the text of all siblings from the leaf to the root. folded_root is what the leaf of ``presented`` (a text
    column; without one, the stored text) and the siblings give, verified whether that is the root.
    """
    runs, nodes, root = build(docs, presented)
    up = climb(runs, nodes).select("tree", "idx", F.col("folds").alias("ends"), F.col("proof").alias("above"), F.col("subroot").alias("top"))
    first = f"CASE WHEN level >= 1 THEN concat(array_join(slice(n, {FAN} * (i div {FAN}) + 1, i % {FAN}), ''), array_join(slice(n, i + 2, {FAN} - 1 - i % {FAN}), '')) ELSE '' END"
    second = f"CASE WHEN level >= 2 THEN concat(array_join(slice(f, 1, i div {FAN}), ''), array_join(slice(f, i div {FAN} + 2, {FAN}), '')) ELSE '' END"
    row = f"named_struct('doc_id', x.doc_id, 'leaf', n[i], 'subroot', t, 'proof', concat({first}, {second}, a), 'folded_root', e[at[i]])"
    rows = f"transform(leaves, (x, i) -> {row})"
    texts = {"t": text_of("top"), "a": text_of("above"), "e": "transform(ends, d -> lower(hex(d)))", "f": "transform(firsts, d -> lower(hex(d)))", "n": "transform(leaves.leaf, d -> lower(hex(d)))"}
    for name, value in texts.items():
        rows = let(name, value, rows)
    d = runs.drop("folds").join(up, ["tree", "idx"]).select(F.expr(f"inline({rows})"))
    return d.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    proofs = prove(docs, lower_cased(docs["doc_id"], docs["text"]))
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


def _sql() -> str:
    """The same by fixed levels: 6 of a source (16.7 million rows), 4 of the subroots (65,536 sources)."""
    f = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(f(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = _crc_sql("doc_id::VARCHAR")
    parts = [
        f"t AS (SELECT *, {crc} % 5 = 0 AS hit FROM documents)",
        f"d AS (SELECT doc_id, coalesce('s' || source, 'n') AS tree, {leaf('text')} AS leaf, CASE WHEN hit THEN {leaf('tampered')} ELSE {leaf('text')} END AS start FROM (SELECT *, translate(text, '{LETTERS}', '{LETTERS.lower()}') AS tampered FROM t))",
        "p0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM d)",
        "n0 AS (SELECT tree, pos AS idx, leaf AS digest FROM p0)",
    ]
    up = lambda old, new: [
        f"c{new} AS (SELECT tree, idx // 16 AS idx, string_agg(digest, '' ORDER BY idx) AS children FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS m FROM n{old}) WHERE m > 1 GROUP BY tree, idx // 16)",
        f"n{new} AS (SELECT tree, idx, sha256(children) AS digest FROM c{new} UNION ALL SELECT tree, idx, digest FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS m FROM n{old}) WHERE m = 1)",
    ]
    left, right = "substr(children, 1, (64 * ({at} % 16))::BIGINT)", "substr(children, (64 * ({at} % 16) + 65)::BIGINT)"
    step = (
        "p{new} AS (SELECT p.* REPLACE ({at} // 16 AS {at}, CASE WHEN children IS NULL THEN fold ELSE sha256(" + left + " || fold || " + right + ") END AS fold, "
        "CASE WHEN children IS NULL THEN proof ELSE proof || " + left + " || " + right + " END AS proof) FROM p{old} p LEFT JOIN c{level} c ON c.tree = {tree} AND c.idx = p.{at} // 16)"
    )
    for k in range(1, 7):
        parts += up(k - 1, k)
    parts.append("sub AS (SELECT tree AS name, digest AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM n6)")
    parts.append("n10 AS (SELECT 'r' AS tree, place AS idx, subroot AS digest FROM sub)")
    for k in range(11, 15):
        parts += up(k - 1, k)
    parts.append("p100 AS (SELECT doc_id, tree, pos, leaf, start AS fold, '' AS proof, subroot, place FROM p0 JOIN sub ON tree = name)")
    last = 100
    for k in (*range(1, 7), *range(11, 15)):
        parts.append(step.format(new=100 + k, old=last, level=k, at="pos" if k < 10 else "place", tree="p.tree" if k < 10 else "'r'"))
        last = 100 + k
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, (SELECT digest FROM n14) AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = (SELECT digest FROM n14) AS verified FROM p{last}"


def _crc_sql(text: str) -> str:
    """CRC-32 of an ASCII text in DuckDB: each character is added, then shifted out bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    fold = "lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) WHEN acc & 1 = 1 THEN xor(acc >> 1, 3988292384) ELSE acc >> 1 END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), {fold}), 4294967295)"


OP12_SQL = _sql()
