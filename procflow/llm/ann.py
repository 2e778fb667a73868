"""Approximate nearest neighbours by cosine: stable projections in a kd-tree, verified until a chi-square test holds.

Vectors are brought to length one and projected on M Gaussian directions. A projected squared distance divided by the
true one then follows a chi-square law with M degrees of freedom, so that a row as near as the k-th best found so far
lies inside the projected radius sqrt(q * d_k^2) with probability CONFIDENCE, q being that law's quantile. A search
takes projected neighbours nearest first, verifies them by their exact cosine, which lowers d_k, and stops once the
next one lies beyond the radius.

A kd-tree, fitted on a bounded sample of projections, cuts space into regions; every row is filed under its region,
and a region of too many rows, such as copies that no cut tells apart, under several pieces of it. A piece is
what one search sees at a time: it is read into memory, cut further into leaves, and searched leaf by leaf. A query
first searches its home piece, then all other pieces of the regions that still meet its radius. No more than one
piece of rows is ever held, and queries stream past it; a piece that very many queries visit is searched in several
tasks.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do those of another length
than most rows have (the shorter of two equally common lengths). Equal vectors are all candidates, ties go to the
smaller vec_id; rows of one vec_id are candidates of each other's queries only under another id. Queries with null
vec_id do not exist; such rows are no candidates either, as they could not be named. A repeated vec_id is one
candidate, by the nearest of its rows; each distinct vector of a repeated query id searches, and the id's result is
the best of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from procflow.llm.common import cut, smallest_hashes, table

K = 5
#: Dimensions of the projection, and the probability with which a nearer row lies inside the radius.
M = 8
CONFIDENCE = 0.97
#: Rows on whose projections the tree is fitted, at most.
SAMPLE_ROWS = 32_768
#: Numbers in the vectors of a piece, about: 65,536 rows of 64. There are at least LEAST_REGIONS regions (while the
#: sample allows), so that small tables use all cores, and at most a quarter of the sample's rows.
PIECE_VALUES = 1 << 22
LEAST_REGIONS = 32
#: Visits of a piece that one task answers, about.
VISITS_PER_COPY = 50_000
#: Rows of a leaf within a piece.
LEAF_ROWS = 512
#: Rounding of a cosine by another order of sums, and of a squared distance.
SLACK = 1e-9


def chi_square_cdf(x: float, m: int) -> float:
    """The probability that a sum of ``m`` squared normal values is at most ``x`` (series of the gamma function)."""
    a, h = m / 2, x / 2
    if h <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= h / n
        total += term
    return min(1.0, total * exp(a * log(h) - h - lgamma(a)))


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, float(m)
    while chi_square_cdf(high, m) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, m) < p else (low, mid)
    return high


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows by a power of two that brings their largest entry near one (exact, so that nothing overflows), then
    divided by their length."""
    v = scaled(vectors)
    return v / norms(v)[:, None]


def scaled(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(axis=1)
    return np.ldexp(vectors, -np.frexp(top)[1][:, None])


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt(dots(v, v))


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added from the first component to the last: equal rows give equal sums wherever they stand."""
    out = np.zeros(max(len(a), len(b)))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def directions(dim: int, m: int = M) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, m))


def kd_tree(points: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """``(axis, value)`` of each inner node, by its heap number: the median of the widest axis of what is in it."""
    tree: list[tuple[int, float]] = [(0, 0.0)] * ((1 << depth) - 1)
    parts = {0: points}
    for node in range(len(tree)):
        p = parts.pop(node)
        axis = int(np.ptp(p, axis=0).argmax()) if len(p) else 0
        at = float(np.median(p[:, axis])) if len(p) else 0.0
        right = p[:, axis] > at
        tree[node] = (axis, at)
        parts[2 * node + 1], parts[2 * node + 2] = p[~right], p[right]
    return tree


def file_under(tree: list[tuple[int, float]], points: np.ndarray) -> np.ndarray:
    """The region of each point: its place among the tree's leaves."""
    axes, values = np.array([t[0] for t in tree], dtype=int), np.array([t[1] for t in tree])
    node = np.zeros(len(points), dtype=np.int64)
    rows = np.arange(len(points))
    for _ in range((len(tree) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[rows, axes[node]] > values[node])
    return node - len(tree)


def outside(low: np.ndarray, high: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distance of a point to each box."""
    gap = np.maximum(np.maximum(low - y, y - high), 0)
    return np.einsum("ij,ij->i", gap, gap)


class Piece:
    """Rows of one piece of a region, cut into leaves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, project: np.ndarray):
        v = scaled(vectors)
        length = norms(v)
        p = (v / length[:, None]) @ project
        order, ends = leaves_of(p)
        self.ids, self.v, self.length, self.p = ids[order], v[order], length[order], p[order]
        self.unit = self.v / self.length[:, None]
        self.ends = list(zip([0, *ends[:-1]], ends, strict=True))
        self.low = np.array([self.p[a:b].min(axis=0) for a, b in self.ends])
        self.high = np.array([self.p[a:b].max(axis=0) for a, b in self.ends])

    def search(self, query_id: int, vector: np.ndarray, y: np.ndarray, worst: float, k: int, quantile: float) -> list[tuple[float, int]]:
        """The piece's best ``(-cosine, vec_id)``, k at most: all that could be among the k nearest of a query whose
        k-th best cosine so far is ``worst``, but for those the stopping test gives up."""
        length = norms(vector[None])[0]
        unit = vector / length
        best: list[tuple[float, int]] = []
        away = outside(self.low, self.high, y)
        for leaf in np.argsort(away, kind="stable"):
            reach = quantile * 2 * (1 - worst) + SLACK
            if away[leaf] > reach:
                break  # the next projected neighbour lies beyond the radius: the test holds
            a, b = self.ends[leaf]
            near = self.p[a:b] - y
            inside = np.flatnonzero(np.einsum("ij,ij->i", near, near) <= reach)
            inside = a + inside[(self.unit[a:b][inside] @ unit) >= worst - SLACK]
            inside = inside[self.ids[inside] != query_id]
            if not len(inside):
                continue
            exact = dots(self.v[inside], vector[None]) / (self.length[inside] * length)
            found = {}
            for score, vec_id in [*((s, i) for s, i in best), *zip(-exact, self.ids[inside].tolist(), strict=True)]:
                if vec_id not in found or score < found[vec_id]:
                    found[vec_id] = float(score)
            best = sorted((s, i) for i, s in found.items())[:k]
            if len(best) == k:
                worst = max(worst, -best[-1][0])
        return best


def leaves_of(points: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """An order of the rows and the ends of the leaves in it, by medians of the widest axis."""
    order: list[np.ndarray] = []
    ends: list[int] = []
    todo = [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF_ROWS:
            order.append(rows)
            ends.append((ends[-1] if ends else 0) + len(rows))
            continue
        axis = np.ptp(points[rows], axis=0).argmax()
        half = len(rows) // 2
        rows = rows[np.argpartition(points[rows, axis], half)]
        todo += [rows[half:], rows[:half]]
    return np.concatenate(order), ends


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(embeddings: DataFrame) -> tuple[DataFrame, int, int]:
    """``vec_id, embedding`` of the rows that take part, the length of their vectors and their number."""
    d = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding")).where("vec_id is not null and embedding is not null")
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    d = d.where(sound)
    common = d.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").first()
    dim, n = (common["dim"], common["n"]) if common else (0, 0)
    return d.where(F.size("embedding") == dim), dim, n


def _filed(rows: DataFrame, project: np.ndarray, tree: list[tuple[int, float]]) -> DataFrame:
    """``vec_id, embedding, region``, the projection ``y``, and a random number that deals a region's rows to pieces
    (kept in the table, as rows may be equal)."""
    dim = len(project)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = units(_matrix(b.column(1), dim)) @ project
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(file_under(tree, y), pa.int32()), pa.array(list(y), pa.list_(pa.float64()))], ["vec_id", "embedding", "region", "y"])

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.mapInArrow(file, f"vec_id long, embedding {kind}, region int, y array<double>").withColumn("deal", (F.rand(dim) * (1 << 30)).cast("int"))


def _search(points: DataFrame, visits: DataFrame, project: np.ndarray, k: int, quantile: float) -> DataFrame:
    """``query_id, vec_id, score``: what ``visits`` (region, piece, query_id, embedding, worst) find in their pieces
    of ``points`` (region, piece, vec_id, embedding). Rows of a piece come first in its task, its visits after them."""
    dim = len(project)
    p = points.select("region", "piece", F.lit(0).alias("visit"), F.col("vec_id").alias("id"), "embedding", F.lit(None).cast("double").alias("worst"))
    v = visits.select("region", "piece", F.lit(1).alias("visit"), F.col("query_id").alias("id"), "embedding", "worst")
    task = ["region", "piece", "copy"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        where, piece = None, None
        for b in batches:
            keys = np.stack([b.column(j).to_numpy(zero_copy_only=False) for j in range(4)], axis=1)
            ids, vectors, worst = b.column(4).to_numpy(zero_copy_only=False), _matrix(b.column(5), dim), b.column(6).to_numpy(zero_copy_only=False)
            out: list[tuple[int, int, float]] = []
            cuts = [0, *(1 + np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))).tolist(), len(keys)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                at = tuple(keys[a, :3])
                if at != where:
                    where, held, piece = at, [], None
                if keys[a, 3] == 0:
                    held.append((ids[a:z], vectors[a:z]))
                    continue
                if piece is None:
                    if not held:
                        continue
                    piece = Piece(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), project)
                    held = []
                own = scaled(vectors[a:z])
                ys = units(vectors[a:z]) @ project
                for i in range(z - a):
                    out += [(int(ids[a + i]), vec_id, -s) for s, vec_id in piece.search(int(ids[a + i]), own[i], ys[i], float(worst[a + i]), k, quantile)]
            q, r, s = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.float64())], ["query_id", "vec_id", "score"])

    load = cut(visits.groupBy("region", "piece").agg(F.ceil(F.count("*") / VISITS_PER_COPY).cast("int").alias("copies")), "visits").where("copies > 1")
    if load.limit(1).count():  # a hot piece is repeated, and its visits are dealt to the copies
        p, v = (x.join(load, ["region", "piece"], "left").withColumn("copies", F.coalesce("copies", F.lit(1))) for x in (p, v))
        p = p.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        v = v.withColumn("copy", F.pmod(F.xxhash64("id", "embedding"), "copies").cast("int"))
    else:
        p, v = p.withColumn("copy", F.lit(0)), v.withColumn("copy", F.lit(0))
    columns = [*task, "visit", "id", "embedding", "worst"]
    both = p.select(columns).union(v.select(columns)).repartition(*task).sortWithinPartitions(*task, "visit")
    return both.mapInArrow(search, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, each vec_id once."""
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("rank") <= k)


def nearest(embeddings: DataFrame, queries: str, k: int = K, m: int = M, confidence: float = CONFIDENCE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows found of each row that meets ``queries`` (SQL over vec_id).

    ``embeddings``: vec_id, embedding (array of numbers); other columns are left alone.
    """
    spark = embeddings.sparkSession
    rows, dim, n = usable(embeddings)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    project, quantile = directions(dim, m), chi_square_quantile(confidence, m)
    sample = smallest_hashes(rows, "vec_id", SAMPLE_ROWS).select("embedding").toArrow()
    seen = units(_matrix(sample.column(0), dim)) @ project
    most = max(LEAF_ROWS, PIECE_VALUES // dim)
    depth = max(0, int(np.ceil(np.log2(min(max(LEAST_REGIONS, n / most), max(1, len(seen) / 4))))))
    tree = kd_tree(seen, depth)
    filed = cut(_filed(rows, project, tree), "filed")
    # the boxes of the regions, a quarter of SAMPLE_ROWS at most, and how many pieces each has
    ends = [f(F.get("y", F.lit(j))).alias(f"{name}{j}") for j in range(m) for f, name in ((F.min, "low"), (F.max, "high"))]
    boxes = sorted(filed.groupBy("region").agg(F.count("*").alias("n"), *ends).collect(), key=lambda r: r["region"])
    names = np.array([r["region"] for r in boxes])
    low, high = (np.array([[r[f"{e}{j}"] for j in range(m)] for r in boxes]) for e in ("low", "high"))
    pieces = {r["region"]: -(-r["n"] // most) for r in boxes}
    filed = filed.join(F.broadcast(spark.createDataFrame(list(pieces.items()), "region int, pieces int")), "region")
    piece_of = F.col("deal") % F.col("pieces")
    points = filed.select("region", piece_of.alias("piece"), "vec_id", "embedding")
    asked = filed.where(queries).select("region", piece_of.alias("piece"), F.col("vec_id").alias("query_id"), "embedding", "y")
    home = asked.select("region", "piece", "query_id", "embedding", F.lit(-1.0).alias("worst"))
    first = cut(_search(points, home, project, k, quantile), "home")
    worst = _best(first, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(-1.0).alias("worst"))
    rest = asked.join(worst, "query_id", "left").select("query_id", "embedding", "region", "piece", "y", F.coalesce("worst", F.lit(-1.0)).alias("worst"))
    kind = rest.schema["embedding"].dataType.simpleString()

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ys, worst = _matrix(b.column(4), m), b.column(5).to_numpy(zero_copy_only=False)
            at: list[tuple[int, int, int]] = []
            for i, (region, piece) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                near = names[outside(low, high, ys[i]) <= quantile * 2 * (1 - worst[i]) + SLACK]
                at += [(i, int(r), p) for r in near for p in range(pieces[int(r)]) if (int(r), p) != (region, piece)]
            row, region, piece = (pa.array(x, pa.int32()) for x in (zip(*at, strict=True) if at else ((), (), ())))
            yield pa.RecordBatch.from_arrays([region, piece, b.column(0).take(row), b.column(1).take(row), b.column(5).take(row)], ["region", "piece", "query_id", "embedding", "worst"])

    visits = rest.mapInArrow(visit, f"region int, piece int, query_id long, embedding {kind}, worst double")
    found = first.union(_search(points, visits, project, k, quantile))
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")
