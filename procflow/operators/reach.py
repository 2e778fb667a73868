"""Steps of many walks at once: nodes are sets by page, and a block of walks meets one page of nodes at a time.

A set is a row ``key, page, nodes, n``: those of PAGE neighbouring nodes that belong to the key, as 16-bit places where
they are few, else as bits, and their number. The walks that end in a page, of a block of neighbouring keys, are united
in one task as rows of bits, so what is moved is the links once a block and the fronts once a page, whatever number of
walks there is between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procflow.session import kept

#: Nodes of a page (places have 16 bits at most), bytes of its bits, and the nodes from which a set is held as bits.
PAGE_BITS = 14
PAGE = 1 << PAGE_BITS
BYTES = PAGE // 8
MANY = BYTES // 2
#: The page of the null node; whole numbers have none so high.
NONE = 1 << 62
#: Neighbouring keys of a block (as a power of two) and nodes of their fronts, at most.
BLOCK_BITS, BLOCK_NODES = 13, 6_000_000
#: Walks go by pages where they are so many times the sets that are moved for it; else they are rows.
GAIN = 50
#: Pairs of block and page up to which they are broadcast; beyond, walks are rows.
GOALS = 1_000_000

SET = "key long, page long, nodes binary, n int"


def _bits_of_places(b: bytes) -> np.ndarray:
    one = np.zeros(PAGE, dtype=np.uint8)
    one[np.frombuffer(b, "<u2")] = 1
    return np.packbits(one, bitorder="little")


def _bits_of(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8) if len(b) == BYTES else _bits_of_places(b)


def _places(b: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")) if len(b) == BYTES else np.frombuffer(b, "<u2")


def _packed(places: np.ndarray) -> bytes:
    few = places.astype("<u2").tobytes()
    return few if len(places) < MANY else _bits_of_places(few).tobytes()


def _numpy(batch: pa.RecordBatch, *columns: int) -> list[np.ndarray]:
    return [batch.column(k).to_numpy(zero_copy_only=False) for k in columns]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the one before them."""
    new = np.zeros(len(columns[0]), dtype=bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _set_rows(key: np.ndarray, page: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    some = _changes(key, page, at)
    key, page, at = key[some], page[some], at[some].astype("<u2")
    start = np.flatnonzero(_changes(key, page))
    bound = np.append(start, len(key))
    n = np.diff(bound)
    if n.max(initial=0) < MANY:
        nodes = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer((bound * 2).astype(np.int32)), pa.py_buffer(at)])
    else:
        nodes = pa.array([_packed(at[a:b]) for a, b in zip(bound, bound[1:])], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(key[start]), pa.array(page[start]), nodes, pa.array(n.astype(np.int32))], names=["key", "page", "nodes", "n"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets of sorted rows; the last one of a batch waits for the next."""
    held = [np.empty(0, dtype=np.int64)] * 3
    for b in batches:
        if not b.num_rows:
            continue
        rows = [np.concatenate([h, c]) for h, c in zip(held, _numpy(b, 0, 1, 2))]
        last = np.flatnonzero(_changes(*rows[:2]))[-1]
        if last:
            yield _set_rows(*(c[:last] for c in rows))
        at = np.unique(rows[2][last:])
        held = [rows[0][last : last + len(at)], rows[1][last : last + len(at)], at]
    if len(held[0]):
        yield _set_rows(*held)


def sets(pairs: DataFrame, key: str, node: str) -> DataFrame:
    """The sets of nodes of each key of ``pairs``, which may repeat. Rows of null keys go; the null node has a page."""
    n = F.col(node).cast("long")
    d = pairs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.coalesce(F.shiftright(n, PAGE_BITS), F.lit(NONE)).alias("page"), F.coalesce(n.bitwiseAND(F.lit(PAGE - 1)), F.lit(0)).cast("long").alias("at"))
    return d.repartition("key", "page").sortWithinPartitions("key", "page", "at").mapInArrow(_runs, SET)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(keys, pages, places):
        n = [len(p) for p in places]
        page = np.repeat(np.array(pages), n)
        node = pa.array((np.where(page == NONE, 0, page) << PAGE_BITS) + np.concatenate(places), mask=page == NONE)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(keys), n)), node], names=["key", "node"])

    for b in batches:
        keys, pages, places, n = [], [], [], 0
        for k, p, x in zip(*_numpy(b, 0, 1), b.column(2)):
            keys.append(k), pages.append(p), places.append(_places(x.as_py()).astype(np.int64))
            n += len(places[-1])
            if n >= 2 * PAGE:
                yield rows(keys, pages, places)
                keys, pages, places, n = [], [], [], 0
        if n:
            yield rows(keys, pages, places)


def spread(d: DataFrame) -> DataFrame:
    """``key, node`` of each node of the sets."""
    return d.select("key", "page", "nodes").mapInArrow(_spread, "key long, node long")


def _any(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``block, page, nodes``: the nodes that any row of a block has; a block and page may come again."""
    held: dict[tuple[int, int], np.ndarray] = {}

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([k[j] for k in held], pa.int64()) for j in (0, 1)] + [pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["key", "page", "nodes"])

    for b in batches:
        for k, p, x in zip(*_numpy(b, 0, 1), b.column(2)):
            bits = _bits_of(x.as_py())
            held[(k, p)] = held[(k, p)] | bits if (k, p) in held else bits
        if len(held) > 4000:
            yield rows()
            held.clear()
    if held:
        yield rows()


class _Group:
    """A block's walks into a page: sets found before, fronts, then the links one by one."""

    def __init__(self) -> None:
        self.old: list[tuple[int, bytes]] = []
        self.front: list[tuple[int, np.ndarray]] = []
        self.state = None

    def add(self, kind: int, key: int, at: int, nodes: bytes) -> None:
        if kind == 0:
            self.old.append((key, nodes))
        elif kind == 1:
            self.front.append((key, (at << PAGE_BITS) + _places(nodes).astype(np.int64)))
        else:
            if self.state is None:
                self._begin()
            i = np.searchsorted(self.nodes, key)
            if i < len(self.nodes) and self.nodes[i] == key:
                self.state[self.walker[self.bound[i] : self.bound[i + 1]]] |= _bits_of(nodes)

    def _begin(self) -> None:
        self.keys = np.unique([k for k, _ in self.front])
        walker = np.repeat(np.searchsorted(self.keys, [k for k, _ in self.front]).astype(np.int32), [len(n) for _, n in self.front])
        node = np.concatenate([n for _, n in self.front])
        self.front.clear()
        order = np.argsort(node, kind="stable")
        self.walker, node = walker[order], node[order]
        start = np.flatnonzero(_changes(node))
        self.nodes, self.bound = node[start], np.append(start, len(node))
        self.state = np.zeros((len(self.keys), BYTES), dtype=np.uint8)

    def rows(self, page: int, step: int = 2000) -> Iterator[pa.RecordBatch]:
        if self.state is None:
            return
        for key, nodes in self.old:
            i = np.searchsorted(self.keys, key)
            if i < len(self.keys) and self.keys[i] == key:
                self.state[i] &= ~_bits_of(nodes)
        n = np.bitwise_count(self.state).sum(axis=1, dtype=np.int32)
        some = np.flatnonzero(n)
        for j in range(0, len(some), step):
            at = some[j : j + step]
            nodes = [x.tobytes() if c >= MANY else _places(x.tobytes()).astype("<u2").tobytes() for x, c in zip(self.state[at], n[at])]
            yield pa.RecordBatch.from_arrays([pa.array(self.keys[at]), pa.array(np.full(len(at), page)), pa.array(nodes, pa.binary()), pa.array(n[at])], names=["key", "page", "nodes", "n"])


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, group = None, _Group()
    for b in batches:
        for block, page, kind, key, at, nodes in zip(*_numpy(b, 0, 1, 2, 3, 4), b.column(5)):
            if (block, page) != now:
                if now is not None:
                    yield from group.rows(now[1])
                now, group = (block, page), _Group()
            group.add(kind, key, at, nodes.as_py())
    if now is not None:
        yield from group.rows(now[1])


def _block(bits: int):
    return F.shiftright("key", bits)


def step(front: DataFrame, links: DataFrame, found: list[DataFrame], name: str) -> DataFrame:
    """The sets, kept, of what the links lead to from each key's front and none of its ``found`` sets has. All are kept
    sets; runs jobs while it is called."""
    ends = front.where(F.col("page") != NONE)
    size = ends.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = BLOCK_BITS
    while bits and (ends.groupBy(_block(bits).alias("block")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) > BLOCK_NODES:
        bits -= 1
    any_of = lambda d: d.mapInArrow(_any, "key long, page long, nodes binary")
    wanted = any_of(any_of(ends.select(_block(bits).alias("key"), "page", "nodes")).repartition("key", "page"))
    wanted = kept(spread(wanted).select(F.col("key").alias("block"), F.col("node").alias("key")).distinct(), f"{name}-wanted")
    goals = kept(links.select("key", "page").join(wanted.hint("merge"), "key").groupBy("block", "page").agg(F.count("*").alias("links")), f"{name}-goals")
    n, moved = goals.agg(F.count("*"), F.coalesce(F.sum("links"), F.lit(0))).first()
    moved += goals.groupBy("block").agg(F.count("*").alias("pages")).join(ends.groupBy(_block(bits).alias("block")).agg(F.count("*").alias("rows")), "block").agg(F.coalesce(F.sum(F.col("pages") * F.col("rows")), F.lit(0))).first()[0]
    degree = links.agg(F.coalesce(F.sum("n") / F.count_distinct("key"), F.lit(0.0))).first()[0]
    if n > GOALS or size * degree < GAIN * moved:
        return kept(_by_rows(ends, links, found), name)
    pages = F.broadcast(goals.select("block", F.col("page").alias("to")))
    old = [d.select(_block(bits).alias("block"), "page", F.lit(0).alias("kind"), "key", F.col("page").alias("at"), "nodes") for d in found]
    fronts = ends.select(_block(bits).alias("block"), F.lit(1).alias("kind"), "key", F.col("page").alias("at"), "nodes").join(pages, "block").select("block", F.col("to").alias("page"), "kind", "key", "at", "nodes")
    led = links.join(wanted.hint("merge"), "key").select("block", "page", F.lit(2).alias("kind"), "key", F.col("page").alias("at"), "nodes")
    d = fronts.unionByName(led)
    for o in old:
        d = d.unionByName(o)
    tasks = max(int(front.sparkSession.conf.get("spark.sql.shuffle.partitions")), n)
    return kept(d.repartition(tasks, "block", "page").sortWithinPartitions("block", "page", "kind", "key").mapInArrow(_unite, SET), name)


def _by_rows(front: DataFrame, links: DataFrame, found: list[DataFrame]) -> DataFrame:
    """step() with a row a walk."""
    led = spread(front).withColumnRenamed("key", "seed").join(spread(links).select(F.col("key").alias("node"), F.col("node").alias("to")).hint("merge"), "node")
    new = led.select("seed", "to").distinct()
    for d in found:
        old = spread(d).select(F.col("key").alias("__seed"), F.col("node").alias("__node")).hint("merge")
        new = new.join(old, (F.col("seed") == F.col("__seed")) & F.col("to").eqNullSafe(F.col("__node")), "left_anti")
    return sets(new, "seed", "to")
