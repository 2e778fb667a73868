"""Whitening of embeddings: principal components by contour integration of the covariance's resolvent (FEAST).

Spark sums the covariance, exactly: entries are whole numbers, moved by the rounded mean before they are multiplied,
so that sums of products stay whole, hang on no order, and are rounded once. What follows runs on the d x d
covariance alone, whatever the number of rows (d is MAX_DIM at most):

* inertia: the signs of the pivots of a symmetric factorisation of V - s I count the eigenvalues below s. Bisection on
  s finds intervals that hold the components wanted, and cuts them into intervals of few eigenvalues in open gaps;
* for each interval, quadrature around a circle through its ends: solves with the complex shifted covariance,
  (z_j I - V) X = Y, weighted and summed, project a random block on the interval's eigenvectors;
* Rayleigh-Ritz in the projected space extracts them; the Ritz block is projected again until residuals are at
  rounding;
* the Ritz values inside an interval must be as many as its inertia counts say, else the block grows and the
  quadrature is refined; no component is missed unseen.

Rows then are projected where they lie. Rows of null vectors, or of vectors with null or non-finite entries, are left
out; so are vectors of another length than most (the shorter of two equally common ones), empty vectors, and entries
beyond 2^40 / 64, which have no exact place in these whole numbers. Repeated vectors count once in the fit and are
all returned; null and repeated vec_ids are kept. Components whose eigenvalue is zero (to rounding) do not exist:
equal rows, or one row, give no rows. Empty tables give none either.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procflow.llm.common import cut, table

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Largest |64 c| that takes part.
LARGEST = 1 << 40
#: Dimensions, at most: the driver factors a matrix of d x d.
MAX_DIM = 2048
#: Eigenvalues of an interval, about; nodes of the quadrature on the upper half circle; rounds before they grow.
INTERVAL = 6
NODES = 8
ROUNDS = 12
#: Relative to the largest eigenvalue: what counts as zero, and the residual asked for.
ZERO = 1e-13
RESIDUAL = 5e-15


def below(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``v`` lie below ``shift``: the inertia of v - shift I, by a factorisation
    with symmetric pivots of one or two rows (Bunch and Parlett)."""
    a = v - shift * np.eye(len(v))
    alpha, count = (1 + 17**0.5) / 8, 0
    while len(a):
        n = len(a)
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        r, s = divmod(int(off.argmax()), n)
        if max(diagonal[p], off[r, s]) == 0:
            return count  # eigenvalues equal to the shift are not below it
        if diagonal[p] >= alpha * off[r, s]:
            count += a[p, p] < 0
            rest = np.delete(np.arange(n), p)
            x = a[rest, p]
            a = a[np.ix_(rest, rest)] - np.outer(x, x) / a[p, p]
        else:  # an indefinite block of two rows: one eigenvalue on each side
            count += 1
            rest = np.delete(np.arange(n), [r, s])
            x = a[np.ix_(rest, [r, s])]
            a = a[np.ix_(rest, rest)] - x @ np.linalg.solve(a[np.ix_([r, s], [r, s])], x.T)
    return int(count)


def _split(v: np.ndarray, low: float, high: float, want: int, width: float) -> tuple[float, int]:
    """``(s, eigenvalues at or above s)`` of a shift between ``low`` and ``high`` that leaves ``want`` above it, or of
    the nearest to that count that bisection down to ``width`` finds from above (more of them, where they are equal)."""
    n = len(v)
    while high - low > width:
        mid = (low + high) / 2
        above = n - below(v, mid)
        if above == want:
            # move into the middle of the gap, as far as a few more halvings tell
            return _centred(v, mid, low, high, above), above
        low, high = (mid, high) if above > want else (low, mid)
    return low, n - below(v, low)


def _centred(v: np.ndarray, s: float, low: float, high: float, above: int) -> float:
    ends = []
    for far in (low, high):
        near = s
        for _ in range(8):
            mid = (near + far) / 2
            near, far = (mid, far) if len(v) - below(v, mid) == above else (near, mid)
        ends.append(near)
    return (ends[0] + ends[1]) / 2


def intervals(v: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """``(low, high, eigenvalues inside)``, from the top, that together hold the ``k`` largest eigenvalues (more, where
    the last is not alone)."""
    n, k = len(v), min(k, len(v))
    high = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-6)  # Gershgorin: all lie below
    floor, width = -high, high * 1e-13
    low = floor
    while high - low > 0.01 * high:  # a circle not much wider than what is in it filters better
        mid = (low + high) / 2
        low, high = (mid, high) if below(v, mid) < n else (low, mid)
    out, done = [], 0
    while done < k:
        low, above = _split(v, floor, high, min(done + INTERVAL, k), width)
        if above <= done:
            break
        out.append((low, high, above - done))
        high, done = low, above
    return out


def contour(v: np.ndarray, low: float, high: float, block: np.ndarray, nodes: int) -> np.ndarray:
    """The block projected on the eigenvectors of eigenvalues between ``low`` and ``high``: the integral of the
    resolvent around the circle through both, by the midpoint rule; the lower half is the upper one's conjugate."""
    centre, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(block)
    for j in range(nodes):
        turn = np.exp(1j * np.pi * (j + 0.5) / nodes)
        out += np.real(turn * np.linalg.solve((centre + radius * turn) * np.eye(len(v)) - v, block.astype(complex))) * radius / nodes
    return out


def feast(v: np.ndarray, low: float, high: float, inside: int, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors of ``v`` between ``low`` and ``high``, of which there are ``inside``."""
    n, nodes = len(v), NODES
    size = min(n, inside + max(4, inside // 2))
    rng = np.random.default_rng(n)
    for _ in range(4):
        block, best = rng.standard_normal((n, size)), None
        for _ in range(ROUNDS):
            q = np.linalg.qr(contour(v, low, high, block, nodes))[0]
            q = np.linalg.qr(q)[0]
            ritz, turn = np.linalg.eigh(q.T @ v @ q)
            block = q @ turn
            found = (ritz > low) & (ritz < high)
            if found.sum() == inside:
                x = block[:, found]
                worst = np.linalg.norm(v @ x - x * ritz[found], axis=0).max() / norm
                stalled = best is not None and worst > best[0] / 2
                if best is None or worst < best[0]:
                    best = (worst, ritz[found], x)
                if worst <= RESIDUAL or stalled and best[0] <= 1e-10:
                    break
        if best is not None and best[0] <= 1e-10:
            return best[1], best[2]
        size, nodes = min(n, 2 * size), 2 * nodes
    raise RuntimeError(f"{inside} eigenvalues lie between {low} and {high}, but not all were found")


def principal(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a covariance that are not zero, falling, and their unit vectors (columns)."""
    norm = float(np.abs(v).sum(axis=1).max()) if len(v) else 0.0
    if norm == 0:
        return np.zeros(0), np.zeros((len(v), 0))
    values, vectors = [], []
    for low, high, inside in intervals(v, k):
        if high <= ZERO * norm:
            break
        e, x = feast(v, low, high, inside, norm)
        values.append(e)
        vectors.append(x)
    e, x = np.concatenate(values), np.concatenate(vectors, axis=1)
    order = np.argsort(-e, kind="stable")[:k]
    order = order[e[order] > ZERO * norm]
    return e[order], x[:, order]


def whole(c):
    """floor(64 c) + 1000000 of an entry, as a whole number."""
    return (F.floor(c.cast("double") * SCALE) + SHIFT).cast("long")


def quantised(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id, x`` of the rows that take part, and the length of their vectors."""
    e = F.col("embedding")
    sound = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < LARGEST / SCALE))
    d = embeddings.select("vec_id", e).where(e.isNotNull() & (F.size(e) > 0)).where(sound)
    common = d.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").first()
    dim = common["dim"] if common else 0
    if dim > MAX_DIM:
        raise ValueError(f"vectors have {dim} entries; the covariance is factored for {MAX_DIM} at most")
    return d.where(F.size("embedding") == dim).select("vec_id", F.transform("embedding", whole).alias("x")), dim


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _product(d: np.ndarray) -> list:
    """The entries of d' d, exactly."""
    most = int(np.abs(d).max()) if d.size else 0
    if most * most * len(d) < 1 << 53:
        f = d.astype(np.float64)
        return (f.T @ f).astype(np.int64).ravel().tolist()
    o = d.astype(object)
    return (o.T @ o).ravel().tolist()


def exact_moments(fit: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """The covariance of the vectors ``x`` of ``fit`` (divisor n), each entry rounded once from whole numbers."""
    mean = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[int] | None = None
        for b in batches:
            part = _product(_rows(b.column(0), dim) - mean)
            total = part if total is None else [p + q for p, q in zip(total, part, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([[Decimal(p) for p in total[i * dim : (i + 1) * dim]] for i in range(dim)], pa.list_(pa.decimal128(38, 0)))], ["i", "row"])

    rows = fit.select("x").mapInArrow(products, "i int, row array<decimal(38,0)>")
    # one row of dim entries for each task and line of the matrix; lines are summed apart
    cells = rows.select("i", F.posexplode("row").alias("j", "p")).groupBy("i", "j").agg(F.sum("p").cast("decimal(38,0)").alias("p"))
    lines = cells.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "p"))).alias("r")).collect()
    moved = [s - n * int(m) for s, m in zip(sums, mean, strict=True)]
    v = np.zeros((dim, dim))
    for line in lines:
        for j, p in line["r"]:
            v[line["i"], j] = (n * int(p) - moved[line["i"]] * moved[j]) / (n * n)
    return v


def whiten(embeddings: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each row that takes part and each
    of the ``k`` largest components; deviation is decimal(38, 0).

    ``embeddings``: vec_id, embedding (array of numbers); other columns are left alone.
    """
    spark = embeddings.sparkSession
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows, dim = quantised(embeddings)
    if not dim:
        return spark.createDataFrame([], schema)
    rows = cut(rows, "whole")
    fit = cut(rows.select("x").distinct(), "fit")
    total = fit.agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(j)).cast("decimal(38,0)")).alias(f"s{j}") for j in range(dim)]).first()
    n, sums = total["n"], [int(total[f"s{j}"]) for j in range(dim)]
    v = exact_moments(fit, dim, n, sums)
    e, axes = principal(v, k)
    if not len(e):
        return spark.createDataFrame([], schema)
    mean = np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(sums, mean, strict=True)], dtype=object)
    turn = axes / np.sqrt(e)

    def deviations(x: np.ndarray) -> np.ndarray:
        """n x - S, exactly."""
        d = x - mean
        most = (int(np.abs(d).max()) if d.size else 0) * n + int(np.abs(rest).max())
        if most * most * dim < 1 << 63:
            return d * n - rest.astype(np.int64)
        return d.astype(object) * n - rest

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = (deviations(_rows(b.column(0), dim)) / n).astype(np.float64) @ turn
            yield pa.RecordBatch.from_arrays([pa.array([w.sum(axis=0).tolist()]), pa.array([(w.T @ w).ravel().tolist()])], ["s", "p"])

    m = len(e)
    parts = fit.select("x").mapInArrow(moments, "s array<double>, p array<double>")
    sums_of = parts.agg(*[F.sum(F.get("s", F.lit(i))).alias(f"s{i}") for i in range(m)], *[F.sum(F.get("p", F.lit(i * m + j))).alias(f"p{i}_{j}") for i in range(m) for j in range(i, m)]).first()
    error = max(abs(sums_of[f"p{i}_{j}"] / n - sums_of[f"s{i}"] * sums_of[f"s{j}"] / n / n - (i == j)) for i in range(m) for j in range(i, m))
    explained = e / np.trace(v)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = deviations(_rows(b.column(1), dim))
            w = (d / n).astype(np.float64) @ turn
            square = [Decimal(int(s)) for s in (d * d).sum(axis=1)]
            at = np.repeat(np.arange(len(d)), m)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(d))), pa.array(np.full(len(at), n)), pa.array(square, pa.decimal128(38, 0)).take(pa.array(at)), pa.array(w.ravel()), pa.array(np.tile(explained, len(d))), pa.array(np.full(len(at), error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(project, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation as a long; beyond its range (which needs tens of millions of distinct rows) it is null."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))
