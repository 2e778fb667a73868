"""SimHash near-duplicate detection with Golay-code fuzzy keys.

A fingerprint's 64 bits are cut into three segments (22, 21, 21 bits), each read as a vector of the perfect
binary Golay code [23, 12, 7]. Every vector lies within 3 bits of exactly one codeword, and within 4 bits of
that one and at most five more. Hence, for vectors u and v of one segment:

* distance 0 or 1: the nearest codeword of u is one of the codewords within 4 bits of v;
* distance 2: some codeword lies within 4 bits of both.

Pigeonhole over 4 differing bits in three segments leaves two cases: two segments with at most one difference
each (key: both codewords, one side nearest only, the other all within 4 bits), or one equal segment and two
with exactly two differences (key: the equal segment and a codeword within 4 bits). A join on these keys
therefore meets every pair of fingerprints at 4 bits or fewer; the exact distance is checked in the join.
Only distinct fingerprints enter it, so groups of copies of any size cost one row.

The two codewords are 24 bits, which is little for very many fingerprints: strangers meet in proportion to the square
of their number. From FINE_FROM fingerprints on that case is taken apart. Either one of the two segments is equal
(key: its bits and the other's codeword, 33 bits or more), or both differ in one bit and the third in at most two, so
that one of its three parts is equal, too (key: both codewords and that part, 31 bits). The links are the same.

Components need reachability, not every link, of which a dense group of n near fingerprints has up to n^2 / 2. So
``groups`` first links each fingerprint to the smallest one under each of its keys, where near, and joins what that
leaves apart: only pairs of different groups leave that join, and under a dense key the largest group's own do not
even meet in it.

Spark takes a table of keys to be as large as the fingerprints it is made from, of which each has up to 126 keys. It
would broadcast keys that the driver cannot hold, so joins of keys are told to go by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procflow.llm.common import components, cut, modest_batches, words_of

SHINGLE = 4
MAX_BITS = 4
#: Generator polynomial of the [23, 12, 7] Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1 (a fixed value).
GOLAY_POLY = 0b110001110101
#: First bit and width of the three segments, and the width of a part of one (the first part of the first has a bit more).
SEGMENTS = ((42, 22), (21, 21), (0, 21))
PART = 7
#: Number of fingerprints from which keys are longer; the links are the same.
FINE_FROM = 1 << 25
#: A key is dense from so many rows of the nearer side on; the groups are the same.
DENSE = 64
#: So many dense keys are broadcast at most; more are joined by shuffle.
BROADCAST_KEYS = 100_000


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of one whole text: bit i is 1 if it is set in over half the shingle hashes."""
    w = words_of(text.lower() if text is not None and text.isascii() else text)
    if not w:
        return 0
    if not text.isascii():
        w = [x.lower() for x in w]  # bytes.lower() changes A-Z alone
    digest = xxhash.xxh64_intdigest
    if len(w) <= SHINGLE:
        return digest(b" ".join(w), 42)
    join = b" ".join
    h = np.fromiter((digest(join(x), 42) for x in zip(w, w[1:], w[2:], w[3:])), dtype="<u8", count=len(w) - SHINGLE + 1)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 8192):  # bounded memory for very long texts
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((fingerprint(t.as_py()) for t in b.column(1)), dtype="<u8", count=b.num_rows).view("<i8")
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, type=pa.int64()), b.column(2)], names=["doc_id", "fp", "digest"])


@lru_cache(maxsize=1)
def _leaders() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error patterns of weight 4 or less (nearest first, -1 where there are no more).

    Built from the generator polynomial by rule; 2048 x 6 entries.
    """

    def syndrome(v: np.ndarray) -> np.ndarray:
        v = v.copy()
        for bit in range(22, 10, -1):
            v = np.where(v >> bit & 1, v ^ (GOLAY_POLY << (bit - 11)), v)
        return v

    ones = 1 << np.arange(23)
    weights = [np.zeros(1, dtype=np.int64)]
    for k in range(1, 5):
        idx = np.array(np.meshgrid(*[np.arange(23)] * k, indexing="ij")).reshape(k, -1)
        idx = idx[:, (np.diff(idx, axis=0) > 0).all(axis=0)]
        weights.append(ones[idx].sum(axis=0))
    patterns = np.concatenate(weights)
    s = syndrome(patterns)
    table = np.full((2048, 6), -1, dtype=np.int64)
    fill = np.zeros(2048, dtype=np.int64)
    for p, k in zip(patterns, s):
        table[k, fill[k]] = p
        fill[k] += 1
    unit = syndrome(ones)  # the syndrome is linear: xor of these over the set bits
    low, high = np.zeros(1 << 12, dtype=np.int64), np.zeros(1 << 11, dtype=np.int64)
    for i in range(12):
        low ^= np.where(np.arange(1 << 12) >> i & 1, unit[i], 0)
    for i in range(11):
        high ^= np.where(np.arange(1 << 11) >> i & 1, unit[12 + i], 0)
    return table, np.concatenate([low, high])


def golay_keys(v: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within 4 bits of each 23-bit vector, nearest first; -1 pads."""
    table, syn = _leaders()
    err = table[syn[v & 0xFFF] ^ syn[4096 + (v >> 12)]]
    return np.where(err >= 0, (v[:, None] ^ err) >> 11, -1)  # the code is systematic in its upper 12 bits


def _segments(u: np.ndarray) -> list[np.ndarray]:
    return [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def _key(case: int, *parts: tuple[np.ndarray, int]) -> np.ndarray:
    """Keys (n, ...) of a case from columns (n, k) of values and their bits, in all combinations; -1 if one is."""
    key, ok = np.full((len(parts[0][0]), 1), case, dtype=np.int64), True
    for value, bits in parts:
        ok = (ok & np.ones_like(key, dtype=bool))[:, :, None] & (value >= 0)[:, None, :]
        key = (key[:, :, None] << bits) | np.maximum(value, 0)[:, None, :]
        key, ok = key.reshape(len(key), -1), ok.reshape(len(key), -1)
    return np.where(ok, key, -1)


#: The pairs of segments of which each differs in at most one bit, by case.
_PAIRS = ((0, 1), (0, 2), (1, 2))


def _keys(side: str, fine: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        root = b.column(1).to_numpy(zero_copy_only=False) if b.num_columns > 1 else fp
        u = fp.view("<u8")
        step = 5_000
        for i in range(0, len(u), step):
            seg = _segments(u[i : i + step])
            wide = [golay_keys(s) for s in seg]
            code = [c[:, :1] if side == "near" else c for c in wide]
            own = np.arange(i, i + len(seg[0]))
            keys = [_key(3 + k, (seg[k][:, None], 22), (wide[(k + 1) % 3], 12)) for k in range(3)]  # one equal, two differences in the next
            for k, (x, y) in enumerate(_PAIRS):  # at most one difference in each of two segments
                if not fine:
                    keys.append(_key(k, (code[x], 12), (code[y], 12)))
                    continue
                for j, (same, other) in enumerate(((x, y), (y, x))):
                    keys.append(_key(6 + 2 * k + j, (seg[same][:, None], 22), (code[other], 12)))
                third = seg[3 - x - y]
                for j in range(3):
                    part = third >> (2 * PART) if j == 2 else (third >> (j * PART)) & ((1 << PART) - 1)
                    keys.append(_key(64 + 3 * k + j, (part[:, None], 8), (code[x], 12), (code[y], 12)))
            flat = np.concatenate(keys, axis=1)
            row, col = np.nonzero(flat >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(flat[row, col]), pa.array(fp[own[row]]), pa.array(root[own[row]])], names=["key", "fp", "root"])


def _keyed(rooted: DataFrame, side: str, fine: bool) -> DataFrame:
    """``key, fp, root`` for every key of every row of ``rooted (fp, root)``."""
    return rooted.select("fp", "root").mapInArrow(partial(_keys, side, fine), "key long, fp long, root long")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp, digest)`` for every row; fp is the fingerprint as a signed long, digest tells texts of an id
    apart. Null and empty texts give 0."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(_fingerprints, "doc_id long, fp long, digest long")


def _is_fine(fps: DataFrame, max_bits: int) -> bool:
    if max_bits > MAX_BITS:
        raise ValueError(f"the keys meet pairs up to {MAX_BITS} bits apart")
    return fps.count() >= FINE_FROM


def links(fps: DataFrame, max_bits: int = MAX_BITS, fine: bool | None = None) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of the distinct values of ``fp`` that differ in at most ``max_bits`` (<= 4) bits.

    All of them: a dense group gives pairs in the square of its number. ``groups`` does without.
    """
    fine = _is_fine(fps, max_bits) if fine is None else fine
    own = fps.select("fp", F.col("fp").alias("root"))
    near = _keyed(own, "near", fine).select("key", F.col("fp").alias("x"))
    wide = _keyed(own, "wide", fine).select("key", F.col("fp").alias("y"))
    diff = F.col("x").bitwiseXOR(F.col("y"))
    met = near.join(wide.hint("merge"), "key").where((F.col("x") < F.col("y")) & (F.bit_count(diff) <= max_bits))
    if not fine:
        # Each pair counts under one case only, that which pigeonhole gives first, so that it leaves the join once
        # for each shared key of that case: once, as the nearer side of a pair is its smaller member.
        e = [F.bit_count(F.shiftrightunsigned(diff, at).bitwiseAND(F.lit((1 << n) - 1))) for at, n in SEGMENTS]
        case = F.when((e[0] <= 1) & (e[1] <= 1), 0).when((e[0] <= 1) & (e[2] <= 1), 1).when((e[1] <= 1) & (e[2] <= 1), 2).when(e[0] == 0, 3).when(e[1] == 0, 4).otherwise(5)
        met = met.where(F.when(case < 3, F.shiftright("key", 24)).otherwise(F.shiftright("key", 34)) == case)
    return met.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def stars(fps: DataFrame, max_bits: int, fine: bool) -> DataFrame:
    """Pairs ``(a, b)`` of a fingerprint and the smallest one under one of its nearer keys, where near. There are at
    most as many as keys, however dense a group is."""
    near = _keyed(fps.select("fp", F.col("fp").alias("root")), "near", fine).select("key", "fp")
    least = near.groupBy("key").agg(F.min("fp").alias("a"))
    met = near.join(least.hint("merge"), "key").where((F.col("a") < F.col("fp")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= max_bits))
    return met.select("a", F.col("fp").alias("b")).distinct()


def bridges(rooted: DataFrame, max_bits: int, fine: bool) -> DataFrame:
    """Pairs ``(a, b)`` of different roots of ``rooted (fp, root)`` that a link joins; all of them.

    Under most keys few rows meet (kind 2). Under a key of over DENSE rows of the nearer side one root is at home, that
    of most of them, and its own do not meet each other: a row of the nearer side that is at home meets only foreign
    rows of the other (kind 1), a foreign one meets both kinds. Runs jobs while the plan is built.
    """
    near, wide = (_keyed(rooted, side, fine) for side in ("near", "wide"))
    by_root = near.groupBy("key", "root").count()
    home = by_root.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("home"), F.sum("count").alias("rows"))
    home = cut(home.where(F.col("rows") > DENSE).select("key", "home"), "home")
    home = F.broadcast(home) if home.count() <= BROADCAST_KEYS else home.hint("merge")
    ordinary, foreign = F.col("home").isNull(), F.col("root") != F.col("home")
    kinds = F.when(ordinary, F.array(F.lit(2))).when(foreign, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    left = near.join(home, "key", "left").select("key", F.explode(kinds).alias("kind"), F.col("fp").alias("x"), F.col("root").alias("rx"))
    right = wide.join(home, "key", "left").select("key", F.when(ordinary, 2).otherwise(foreign.cast("int")).alias("kind"), F.col("fp").alias("y"), F.col("root").alias("ry"))
    met = left.join(right.hint("merge"), ["key", "kind"]).where((F.col("rx") != F.col("ry")) & (F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits))
    return met.select(F.least("rx", "ry").alias("a"), F.greatest("rx", "ry").alias("b")).distinct()


def groups(fps: DataFrame, max_bits: int = MAX_BITS, fine: bool | None = None) -> DataFrame:
    """``fp, root`` for every row of ``fps (fp)``, whose values are distinct: root is the smallest fingerprint
    reachable over links, as if all links were followed. Runs jobs while the plan is built."""
    fine = _is_fine(fps, max_bits) if fine is None else fine
    own = F.coalesce("root", "fp").alias("root")
    first = components(cut(stars(fps, max_bits, fine), "stars"))
    rooted = cut(fps.select("fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", own), "rooted")
    second = components(cut(bridges(rooted, max_bits, fine), "bridges")).select(F.col("node").alias("root"), F.col("root").alias("end"))
    return rooted.join(second, "root", "left").select("fp", F.coalesce("end", "root").alias("root"))


def fp_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _grouped(docs: DataFrame, max_bits: int) -> DataFrame:
    """``doc_id, fp, digest, component_id, root`` for every row; root is a fingerprint of the component."""
    modest_batches(docs.sparkSession)
    each = cut(fingerprints(docs), "fingerprints")
    distinct = cut(each.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    with_root = cut(distinct.join(groups(distinct, max_bits), "fp"), "groups")
    named = with_root.groupBy("root").agg(F.min("low").alias("component_id"))
    by_fp = with_root.join(named, "root").select("fp", "component_id", "root")
    # files of rows that repeat are far smaller than the rows, so each is not broadcast by their size
    return each.hint("merge").join(by_fp, "fp").select("doc_id", "fp", "digest", "component_id", "root")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs (doc_id, text, ...)``.

    component_id is the smallest doc_id reachable over links, itself included. Texts without words share the
    fingerprint 0 and link like any other. Rows may repeat; null doc_ids never become a component's id unless
    all of it is null. Other columns are not read. An empty table gives an empty result.
    """
    return _grouped(docs, max_bits).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest doc_id (null last), and of the smallest
    digest of its text where several texts share that id. Equal rows of id and text are one; which of their other
    columns stays is open."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    kept = _grouped(docs, max_bits).groupBy("root").agg(first).select(F.col("first.doc_id").alias("__id"), F.col("first.digest").alias("__digest"))
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col("doc_id").alias("__own_id"), F.xxhash64("text").alias("__own_digest"))
    left = own.join(kept, own["__own_id"].eqNullSafe(kept["__id"]) & (own["__own_digest"] == kept["__digest"]), "left_semi")
    return left.dropDuplicates(["__own_id", "__own_digest"]).select("__row.*")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", fp_hex(F.col("fp")).alias("fingerprint"), "component_id")
