"""Quality rules with an isolation forest on rule statistics.

Statistics of each whole text (counts, shares, repetition) place it in a small numeric space. A forest of random
splits is grown on a sample of labelled good rows; anomalous documents end on short paths. The threshold on the
anomaly score is calibrated on labelled rows of both kinds that the forest did not see, by a histogram of scores each.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from procflow.llm.common import smallest_hashes, words_of

#: Labelled good rows that the forest is fitted on, at most; chosen by hash of doc_id.
FIT_ROWS = 6000
TREES = 128
SUBSAMPLE = 256
#: Share of labelled good rows that the threshold may cost.
MAX_LOSS = 0.01
#: Bins of the histograms of scores that the threshold is set by.
BINS = 1 << 16
SYMBOLS = "#*$%&|<>"
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER, _DIGIT, _PUNCT = (bytes(range(a, b)) for a, b in ((65, 91), (97, 123), (48, 58), (33, 48)))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("mean_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share", "distinct_share")
#: Margin by which a node's range is widened for its split, in standard deviations and in absolute terms.
MARGIN = (0.5, 0.02)


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of one whole text; null is empty."""
    text = text or ""
    w = words_of(text)
    n = len(w)
    chars = len(text) - sum(map(text.count, _BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    dup_lines = len(lines) - len(set(lines))
    repeat = 0
    if n >= 3:
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) < len(windows):
            often = {k for k, c in Counter(windows).items() if c > 1}
            upto = 0  # first word not yet counted
            for i, k in enumerate(windows):
                if k in often:
                    repeat += i + 3 - max(i, upto)
                    upto = i + 3
    raw = text.encode("utf-8", "surrogatepass")
    upper, lower, digit, punct = (len(raw) - len(raw.translate(None, t)) for t in (_UPPER, _LOWER, _DIGIT, _PUNCT))
    one = max(chars, 1)
    features = [
        chars / max(n, 1),
        symbols / one,
        dup_lines / max(len(lines), 1),
        repeat / max(n, 1),
        upper / max(upper + lower, 1),
        digit / one,
        punct / one,
        len(set(w)) / max(n, 1),
    ]
    return [n, chars, symbols, dup_lines, repeat], features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


class IsolationForest:
    """Random binary trees over a subsample each (Liu, Ting and Zhou, 2008), in flat arrays.

    Good rows have no spread at all in some statistics (no symbols, say), where plain splits within a node's
    range would never fall. So the range is widened by a margin, and values outside of what was seen end early.
    """

    def __init__(self, x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(x))
        self.limit = max(1, math.ceil(math.log2(max(self.size, 2))))
        self.margin = np.maximum(MARGIN[0] * x.std(axis=0), MARGIN[1])
        nodes = 2 ** (self.limit + 1) - 1
        self.feature = np.full((trees, nodes), -1, dtype=np.int16)
        self.split = np.zeros((trees, nodes))
        self.depth = np.zeros((trees, nodes))
        for t in range(trees):
            self._grow(t, 0, 0, x[rng.choice(len(x), self.size, replace=False)], rng)

    @staticmethod
    def usual(n: int) -> float:
        """Mean path length of an unsuccessful search among n points."""
        return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0

    def _grow(self, t: int, node: int, depth: int, x: np.ndarray, rng: np.random.Generator) -> None:
        if depth >= self.limit or len(x) <= 1:
            self.depth[t, node] = depth + self.usual(len(x))
            return
        f = int(rng.integers(x.shape[1]))
        s = rng.uniform(x[:, f].min() - self.margin[f], x[:, f].max() + self.margin[f])
        left = x[:, f] <= s
        self.feature[t, node], self.split[t, node] = f, s
        self._grow(t, 2 * node + 1, depth + 1, x[left], rng)
        self._grow(t, 2 * node + 2, depth + 1, x[~left], rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores, 0 to 1; about 0.5 and less is usual."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.limit):
                f = self.feature[t, node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] > self.split[t, node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += self.depth[t, node]
        return 2.0 ** (-total / len(self.feature) / max(self.usual(self.size), 1e-9))


def calibrate(good: np.ndarray, bad: np.ndarray, max_loss: float = MAX_LOSS) -> float:
    """The threshold above which rows are dropped, from the numbers of good and bad rows by bin of the score (BINS of
    0 to 1): of those that cost at most ``max_loss`` of the good rows, the one that best tells the two kinds apart;
    without rows of both kinds, one above every score seen."""
    seen = np.flatnonzero(good + bad)
    if not len(seen):
        return 1.0
    at = int(seen[-1])
    if good.any() and bad.any():
        lost, caught = (1 - np.cumsum(n)[seen] / n.sum() for n in (good, bad))
        gain = np.where(lost <= max_loss, caught - lost, -np.inf)
        at = int(seen[len(seen) - 1 - int(gain[::-1].argmax())])  # the highest of equals
    higher = seen[seen > at]
    # between the bins; a bin's rows are all kept or all dropped
    return (at + 1 + (int(higher[0]) if len(higher) else at + 1)) / 2 / len(good)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[IsolationForest | None, float]:
    """Forest from at most ``rows`` labelled good rows (those of the smallest hash of doc_id in one half), and the
    threshold from every other labelled row that passes the base rules: the good ones of the other half, and all bad.

    An id that is labelled both good and bad counts as bad. Without labelled good rows there is no forest, and only the
    base rules decide.
    """
    labelled = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0  # good rows of one half make the forest, those of the other the threshold
    chosen = smallest_hashes(labelled.where("quality = 1").where(half), "doc_id", rows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [x for c, x in (statistics(t.as_py()) for t in b.column(0)) if not base_failed(c[0], c[4])]
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.list_(pa.float64()))], names=["features"])

    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text").mapInArrow(each, "features array<double>").toPandas()
    if not len(got):
        return None, 1.0
    x = np.array(got["features"].tolist())
    forest = IsolationForest(x[np.lexsort(x.T[::-1])])  # it must not depend on the order in which rows arrive
    handle = docs.sparkSession.sparkContext.broadcast(forest)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [(i, x) for i, (c, x) in ((i, statistics(t.as_py())) for i, t in zip(b.column(0), b.column(1))) if not base_failed(c[0], c[4])]
            score = handle.value.score(np.array([x for _, x in f]).reshape(len(f), len(FEATURES)))
            yield pa.RecordBatch.from_arrays([pa.array([i.as_py() for i, _ in f], pa.int64()), pa.array(np.minimum(score * BINS, BINS - 1).astype(int), pa.int32())], names=["doc_id", "bin"])

    # texts become bins before the join, so that of every labelled row only an id and a number are shuffled
    scored = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(bins, "doc_id long, bin int")
    counts = scored.join(labelled.where((F.col("quality") != 1) | ~half), "doc_id").groupBy((F.col("quality") == 1).alias("good"), "bin").agg(F.count("*").alias("n")).toPandas()
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for g, k, n in counts.itertuples(index=False):
        (good if g else bad)[k] = n
    return forest, calibrate(good, bad)


def quality(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id``, COUNTS, ``base_failed, anomaly, kept`` for every row of ``docs (doc_id, text, ...)``.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged alike; of the
    labelled rows ids and scores are shuffled, nothing else.
    """
    handle = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, rows))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, threshold = handle.value
        for b in batches:
            stats = [statistics(t.as_py()) for t in b.column(1)]
            counts = list(zip(*(c for c, _ in stats))) or [()] * len(COUNTS)
            failed = np.array([base_failed(c[0], c[4]) for c, _ in stats], dtype=bool)
            x = np.array([f for _, f in stats]).reshape(len(stats), len(FEATURES))
            anomaly = forest.score(x) if forest is not None else np.zeros(len(stats))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(failed), pa.array(anomaly), pa.array(~failed & (anomaly <= threshold))],
                names=["doc_id", *COUNTS, "base_failed", "anomaly", "kept"],
            )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, anomaly double, kept boolean"
    return docs.select("doc_id", "text").mapInArrow(each, schema)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
