"""Benchmark decontamination: short test items inside long documents.

Containment of an item's shingle set Q in a document D is |Q & D| / |Q|. Items are partitioned by |Q|; each
partition has one sketch size, k = floor((1 - t) * largest |Q|) + 1, and an item's sketch is its k shingles of the
smallest hashes (bottom-k MinHash, all of Q if there are fewer). A document that contains at least t of Q lacks
at most (1 - t) |Q| < k of its shingles, so it has one of the sketch: no contained item is missed. Each document
is scanned once against all sketches of a block of items; the items it meets are verified by the exact
containment of their whole shingle sets.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
THRESHOLD = 0.8
#: Upper bounds of the size partitions (number of shingles), doubling; the last is open.
SIZES = tuple(4 << i for i in range(14))
#: UTF-8 bytes of item texts in one block, a bound on what is sent to each task. More items make more blocks.
BLOCK_BYTES = 16 << 20

_WORD = re.compile(r"\w+")


def normal_words(text: str | None) -> list[str]:
    """Case-folded runs of letters, digits and underscores."""
    return _WORD.findall(text.lower()) if text else []


def shingles(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    """Distinct word n-grams; of fewer words, the whole sequence; of none, nothing."""
    if len(words) <= n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(n))))


def sketch(q: set[tuple[str, ...]], threshold: float = THRESHOLD) -> list[tuple[str, ...]]:
    """The bottom-k MinHash sketch of an item, k by its size partition."""
    top = next((s for s in SIZES if len(q) <= s), len(q))
    k = math.floor((1 - threshold) * top + 1e-9) + 1
    return sorted(q, key=lambda s: (xxhash.xxh64_intdigest(" ".join(s).encode("utf-8", "surrogatepass"), 0), s))[:k]


class Index:
    """Sketches and shingle sets of one block of items."""

    def __init__(self, items: list[tuple[int, str | None]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.sets: dict[int, set] = {}
        self.by_shingle: dict[tuple, list[int]] = {}
        for n, (item_id, text) in enumerate(items):
            q = shingles(normal_words(text))
            self.sets[n] = q
            for s in sketch(q, threshold):
                self.by_shingle.setdefault(s, []).append(n)
        self.ids = [i for i, _ in items]
        self.pairs = {s[:2] for s in self.by_shingle}
        self.short = {len(s) for s in self.by_shingle if len(s) < SHINGLE}

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item_id, shared shingles, item's shingles) of every item contained in the text."""
        w = normal_words(text)
        if not w:
            return []
        pairs, met = self.pairs, set()
        starts = [i for i, p in enumerate(zip(w, w[1:])) if p in pairs]
        for i in starts:
            met.update(self.by_shingle.get(tuple(w[i : i + SHINGLE]), ()))
        for n in self.short:
            for i in range(len(w) - n + 1) if n == 1 else starts:
                met.update(self.by_shingle.get(tuple(w[i : i + n]), ()))
        if not met:
            return []
        out = []
        own = set(zip(*(w[i:] for i in range(SHINGLE))))
        for n in sorted(met):
            q = self.sets[n]
            size = len(next(iter(q)))
            have = own if size == SHINGLE else set(zip(*(w[i:] for i in range(size))))
            shared = len(q & have)
            if shared >= self.threshold * len(q) - 1e-9:
                out.append((self.ids[n], shared, len(q)))
        return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The items, block by block, each of bounded size on average and whole."""
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / BLOCK_BYTES))
    for k in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        rows = [(r["item_id"], r["text"]) for r in block.select("item_id", "text").orderBy("item_id", "text").collect()]
        if rows:
            yield rows


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, shared, item_shingles, containment``: every item that a document's whole text contains
    to at least ``threshold``.

    Words are case-folded runs of letters and digits, shingles have five; an item of fewer words is one shingle;
    items and documents without words match nothing. Rows of docs may repeat and give repeated results.
    """
    schema = "doc_id long, item_id long, shared int, item_shingles int, containment double"
    out = None
    for rows in _blocks(items):
        handle = docs.sparkSession.sparkContext.broadcast(rows)

        def scan(batches: Iterator[pa.RecordBatch], handle=handle, threshold=threshold) -> Iterator[pa.RecordBatch]:
            index = Index(handle.value, threshold)
            for b in batches:
                found = [(d.as_py(), *m) for d, t in zip(b.column(0), b.column(1)) for m in index.matches(t.as_py())]
                cols = list(zip(*found)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array([s / q for s, q in zip(cols[2], cols[3])], pa.float64())],
                    names=["doc_id", "item_id", "shared", "item_shingles", "containment"],
                )

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, schema)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text contains an item; no shuffle, as each row is judged by itself."""
    for rows in _blocks(items):
        handle = docs.sparkSession.sparkContext.broadcast(rows)
        held: dict[str, Index] = {}

        def clean(texts, handle=handle, held=held, threshold=threshold):
            import pandas as pd

            if "index" not in held:
                held["index"] = Index(handle.value, threshold)
            return pd.Series([not held["index"].matches(t) for t in texts], dtype=bool)

        docs = docs.where(F.pandas_udf(clean, "boolean")(docs["text"]))
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
