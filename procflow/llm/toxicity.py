"""Toxicity by class-conditional Kneser-Ney models.

Each class (toxic, ordinary) has a model of words in their order. A word is predicted from the word before it; where a
class knows too little of that pair, from the class's spelling of words, letter by letter, each from the LETTERS
letters before it inside the word; where a class knows too little of a spelling, from the spellings of all documents.
All three levels are interpolated with absolute discounting, and all their counts are continuation counts:

* a pair counts once for each different word before it, a word once for each different word before it, so that
  copies of texts and repeated passages add nothing;
* a spelling in the shared counts counts once for each different word of all documents, and a letter by itself once
  for each different beginning that it follows.

The discount is large (DISCOUNT), so that an expression rare in a class falls back on the shared counts and cancels in
the comparison, while a stem or a pair that one class keeps using does not. A text's evidence is the difference of
its two log-likelihoods word by word, as far as it goes beyond THRESHOLD, summed and divided by the number of words.
A logistic curve turns it into a score; it is fitted on documents that the compared models did not see (two folds).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procflow.llm.common import cut, modest_batches, smallest_hashes

#: Labelled rows of each class that the models are counted on, at most; chosen by hash of doc_id.
FIT_ROWS = 4000
#: Labelled rows whose crc32(doc_id as text) leaves this remainder by 5 are held out.
HELD_OUT = (5, 0)
#: A count n of a class keeps n - DISCOUNT, one of all documents n - SHARED_DISCOUNT.
DISCOUNT, SHARED_DISCOUNT = 4.0, 0.75
#: Letters (and the mark of the beginning) that a letter is predicted from.
LETTERS = 8
#: A word tells something if its log-likelihoods differ by more.
THRESHOLD = 1.5
BEGIN, END = "^", "$"
#: Scripts that do not part words by spaces: each of their letters is a word.
_SINGLE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
#: Letters are told by the cheapest test first.
_WORD = rf"[a-zß-öø-ÿ[\p{{L}}\p{{M}}&&[^{_SINGLE}]]]+|[\p{{L}}\p{{M}}&&[{_SINGLE}]]"
#: The models that are counted: on all sampled rows, and on those of each fold.
VARIANTS = ("all", "fold0", "fold1")


def words(text: Column) -> Column:
    """The lower-cased words of a text in order; null is empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_WORD), F.lit(0))


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(HELD_OUT[0])) == HELD_OUT[1], F.lit(False))


def spelling(word: str) -> list[str]:
    """For each letter of a word and its end: the letters before it (LETTERS at most), and itself."""
    s = BEGIN + word + END
    return [s[max(0, i - LETTERS) : i + 1] for i in range(1, len(s))]


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each letter: column ``w`` becomes ``g``, the other columns are repeated."""
    for b in batches:
        at, step = b.schema.get_field_index("w"), 5000
        for i in range(0, b.num_rows, step):
            part = b.slice(i, step)
            g = [spelling(w) for w in part.column(at).to_pylist()]
            parent = pa.array(np.repeat(np.arange(len(g)), [len(x) for x in g]))
            flat = pa.array([x for xs in g for x in xs], pa.string())
            yield pa.RecordBatch.from_arrays([flat if k == at else part.column(k).take(parent) for k in range(part.num_columns)], names=["g" if k == at else n for k, n in enumerate(part.schema.names)])


def spelled(df: DataFrame) -> DataFrame:
    schema = ", ".join(f"{'g' if n == 'w' else n} {t}" for n, t in df.dtypes)
    return df.mapInArrow(_spell, schema)


#: What of a spelling comes before, and its last letter.
_CTX, _LETTER = "substring(g, 1, length(g) - 1)", "right(g, 1)"


def shared_spellings(docs: DataFrame) -> DataFrame:
    """``g, ctx, x, n``: how many different words of all documents spell ``g``, its letters before and its last one."""
    distinct = docs.select(F.explode(words(F.col("text"))).alias("w")).distinct()
    return spelled(distinct).groupBy("g").agg(F.count("*").alias("n")).selectExpr("g", f"{_CTX} as ctx", f"{_LETTER} as x", "n")


def shared_probabilities(shared: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` plus ``ps``, the probability that all documents give the last letter of ``g`` after the others."""
    by_ctx = shared.groupBy("ctx").agg(F.sum("n").alias("m"), F.count("*").alias("kinds"))
    by_letter = shared.groupBy("x").agg(F.count("*").alias("q"))
    total = by_letter.agg(F.sum("q").alias("total"))  # one row
    alone = by_letter.join(F.broadcast(total)).select("x", (F.col("q") / F.col("total")).alias("q"))
    d = SHARED_DISCOUNT
    ps = ((F.col("n") - d) / F.col("m") + d * F.col("kinds") / F.col("m") * F.col("q")).alias("ps")
    # there are no more letters than Unicode has, so they are broadcast
    return wanted.join(shared.select("g", "x", "n"), "g").join(F.broadcast(alone), "x").join(by_ctx, "ctx").select(wanted["*"], ps)


def pair_counts(sample: DataFrame) -> DataFrame:
    """``toxic, p, w`` (as hashes) and a count for each of VARIANTS: the different words that stand before the pair."""
    w, start = F.col("w"), F.array(F.lit(""))
    z = F.explode(F.arrays_zip(F.concat(start, start, w).alias("o"), F.concat(start, w).alias("p"), w.alias("w"))).alias("z")
    rows = sample.select("toxic", "fold", z).where("z.w is not null").selectExpr("toxic", "fold", *(f"xxhash64(z.{c}) as {c}" for c in "opw"))
    seen = rows.groupBy("toxic", "o", "p", "w").agg(*(F.max((F.col("fold") == k).cast("int")).alias(f"fold{k}") for k in (0, 1)))
    return seen.groupBy("toxic", "p", "w").agg(F.count("*").cast("int").alias("all"), *(F.sum(f"fold{k}").cast("int").alias(f"fold{k}") for k in (0, 1)))


def _by_class(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of both classes in a row: ``t_<variant>``, ``o_<variant>``."""
    each = [F.sum(F.when(F.col("toxic") == (c == "t"), F.col(v)).otherwise(0)).alias(f"{c}_{v}") for c in "to" for v in VARIANTS]
    return df.groupBy(*keys).agg(*each)


def _kept(n: Column) -> Column:
    return F.greatest(n - DISCOUNT, F.lit(0.0))


def _with_totals(counts: DataFrame, ctx: str) -> DataFrame:
    """Adds what each class has counted after ``ctx`` (``n_``) and the share of it that is discounted (``b_``)."""
    names = [f"{c}_{v}" for c in "to" for v in VARIANTS]
    sums = counts.groupBy(ctx).agg(*(F.sum(n).alias(f"n_{n}") for n in names), *(F.sum(_kept(F.col(n))).alias(f"k_{n}") for n in names))
    left = [F.when(F.col(f"n_{n}") > 0, 1 - F.col(f"k_{n}") / F.col(f"n_{n}")).otherwise(1.0).alias(f"b_{n}") for n in names]
    return counts.join(sums.select(ctx, *(f"n_{n}" for n in names), *left), ctx)


def _probability(n: str, below: Column) -> Column:
    return F.when(F.col(f"n_{n}") > 0, _kept(F.col(n)) / F.col(f"n_{n}")).otherwise(0.0) + F.col(f"b_{n}") * below


_ANY_KEPT = " or ".join(f"{c}_{v} > {DISCOUNT}" for c in "to" for v in VARIANTS)


def _ratios(value: Callable[[str], Column]) -> list[Column]:
    """The log-ratio of both classes for each variant."""
    return [(value(f"t_{v}") - value(f"o_{v}")).alias(v) for v in VARIANTS]


# --- the model as sorted arrays of hashes -------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points (plus one), and the length of each string."""
    n = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1), n


def gram_hash(strings: list[str]) -> np.ndarray:
    """Hashes of short strings."""
    c, n = _codes(strings)
    start, h = np.cumsum(n) - n, np.zeros(len(n), dtype=np.uint64)
    for k in range(int(n.max(initial=0))):
        ok = k < n
        h[ok] = h[ok] * _BASE + c[start[ok] + k]
    return h


def word_hash(strings: list[str]) -> np.ndarray:
    """Hashes of whole words of any length, as Spark's xxhash64 gives them."""
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 42) for w in strings), dtype=np.uint64, count=len(strings))


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return before * _PAIR + word


@dataclass
class Table:
    """Values by hash."""

    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> Table:
        order = np.argsort(keys, kind="stable")
        return Table(keys[order], values[order])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none) and whether there is one."""
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.where(hit, self.values[at], 0.0), hit


@dataclass
class Model:
    """Log-ratios of both classes: of letters after letters and of words after words that a class keeps, and of the
    mass that the classes leave to the level below."""

    grams: Table
    gram_backs: Table
    pairs: Table
    pair_backs: Table

    def spell(self, strings: list[str]) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) by spelling, for each word."""
        c, n = _codes([BEGIN + w + END for w in strings])
        start = np.cumsum(n) - n
        inner = np.arange(len(c)) - np.repeat(start, n)  # place in the word
        at = np.flatnonzero(inner > 0)
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(LETTERS, 0, -1):
            ok = inner[at] >= k
            h[ok] = h[ok] * _BASE + c[at[ok] - k]
        value, hit = self.grams.find(h * _BASE + c[at])
        back, _ = self.gram_backs.find(h[~hit])
        value[~hit] = back
        return np.add.reduceat(value, np.cumsum(n - 1) - (n - 1)) if len(value) else np.zeros(len(strings))

    def evidence(self, texts: pa.ListArray, step: int = 1 << 18) -> np.ndarray:
        """For each list of words: the mean of what their log-ratios have beyond THRESHOLD; 0 for no words."""
        n = np.asarray(texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        row, words_ = np.repeat(np.arange(len(n)), n), texts.flatten()
        total = np.zeros(len(n))
        for i in range(0, len(words_), step):  # bounded memory for long texts; the word before comes along
            lead = int(i > 0 and row[i] == row[i - 1])
            r = row[i : i + step]
            total += np.bincount(r, np.maximum(self._ratios(words_[i - lead : i + step], row[i - lead : i + step])[lead:] - THRESHOLD, 0.0), len(n))
        return total / np.maximum(n, 1)

    def _ratios(self, words_: pa.Array, row: np.ndarray) -> np.ndarray:
        """The log-ratio of each word after the one before it in its row; a row's first word follows no word."""
        coded = words_.dictionary_encode()
        vocabulary, w = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
        ratio, name = self.spell(vocabulary), word_hash([*vocabulary, ""])
        back, opens = self.pair_backs.find(name)
        before = np.where(np.diff(row, prepend=-1) > 0, len(vocabulary), np.concatenate([w[:1], w[:-1]]))
        value = ratio[w] + back[before]
        look = np.flatnonzero(opens[before])
        pair, hit = self.pairs.find(pair_hash(name[before[look]], name[w[look]]))
        value[look[hit]] = pair[hit]
        return value


def models(sample: DataFrame, docs: DataFrame) -> dict[str, Model]:
    """The models of VARIANTS from ``sample (toxic, fold, w)`` and the spellings of all documents. What classes keep,
    so at most what the sample holds, comes to the driver, as log-ratios."""
    counts = cut(pair_counts(sample), "pairs")
    by_hash = counts.groupBy("toxic", F.col("w").alias("h")).agg(F.count("*").cast("int").alias("all"), *(F.sum((F.col(v) > 0).cast("int")).cast("int").alias(v) for v in VARIANTS[1:]))
    vocabulary = cut(sample.select(F.explode("w").alias("w")).distinct().select("w", F.xxhash64("w").alias("h")), "vocabulary")
    letters = _by_class(spelled(by_hash.join(vocabulary, "h").drop("h")), ["g"]).withColumn("ctx", F.expr(_CTX))
    shared = cut(shared_spellings(docs), "spellings")
    g = cut(shared_probabilities(shared, _with_totals(letters, "ctx")), "letters")
    gram_log = lambda n: F.log(_probability(n, F.col("ps")))
    grams = g.where(_ANY_KEPT).select("g", *_ratios(gram_log)).toArrow()
    left = lambda n: F.log(F.first(f"b_{n}"))
    some = " or ".join(f"b_{c}_{v} < 1" for c in "to" for v in VARIANTS)
    gram_backs = g.where(some).groupBy("ctx").agg(*_ratios(left)).toArrow()

    p = cut(_with_totals(_by_class(counts, ["p", "w"]), "p").where(some), "kept-pairs")
    kept = p.where(_ANY_KEPT)
    spelt = spelled(kept.select(F.col("w").alias("h")).distinct().join(vocabulary, "h")).join(g, "g")
    names = [f"{c}_{v}" for c in "to" for v in VARIANTS]
    alone = spelt.groupBy("h").agg(*(F.exp(F.sum(gram_log(n))).alias(f"w_{n}") for n in names)).withColumnRenamed("h", "w")
    pair_log = lambda n: F.log(_probability(n, F.greatest(F.col(f"w_{n}"), F.lit(1e-300))))
    pairs = kept.join(alone, "w").select("p", "w", *_ratios(pair_log)).toArrow()
    pair_backs = p.groupBy("p").agg(*_ratios(left)).toArrow()

    strings = lambda t, c: t.column(c).to_pylist()
    hashes = lambda t, c: t.column(c).to_numpy().view(np.uint64)
    keys = (gram_hash(strings(grams, "g")), gram_hash(strings(gram_backs, "ctx")), pair_hash(hashes(pairs, "p"), hashes(pairs, "w")), hashes(pair_backs, "p"))
    return {v: Model(*(Table.of(k, t.column(v).to_numpy()) for k, t in zip(keys, (grams, gram_backs, pairs, pair_backs)))) for v in VARIANTS}


# --- the score ----------------------------------------------------------------------------------------------------

#: Evidence is put on a logarithmic scale from here on.
FLOOR = 1e-3


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a slight ridge."""
    a, b = 0.0, 0.0
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    z = (x - mean) / scale
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = weight * (p * (1 - p) + 1e-9)
        g = np.array([(weight * (p - y) * z).sum() + 0.01 * a, (weight * (p - y)).sum() + 0.01 * b])
        h = np.array([[(w * z * z).sum() + 0.01, (w * z).sum()], [(w * z).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return a / scale, b - a * mean / scale


@dataclass
class Scorer:
    """A model and its logistic curve; without a model, all texts score alike."""

    model: Model | None
    slope: float
    intercept: float

    def score(self, texts: pa.ListArray) -> np.ndarray:
        x = np.zeros(len(texts)) if self.model is None else np.log(self.model.evidence(texts) + FLOOR)
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.intercept, -30, 30)))


def _udf(spark: SparkSession, scorer: Callable[[pa.ListArray], np.ndarray]) -> Callable:
    handle = spark.sparkContext.broadcast(scorer)  # of the size of the labelled sample at most

    @F.arrow_udf("double")
    def each(texts: pa.Array) -> pa.Array:
        return pa.array(handle.value(texts), pa.float64())

    return each


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Scorer:
    """Learn from at most ``rows`` labelled rows of each class that are not held out, equal texts taken once, and from
    the words of all documents. Counts and probabilities are made in Spark; the driver gets log-ratios and evidence.

    An id labelled both ways is toxic; of several rows of an id, one is taken.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    usable = labels.where(~is_held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    by_class = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(by_class) < 2:
        return Scorer(None, 0.0, 1.0 if True in by_class else -1.0)
    chosen = smallest_hashes(usable.where("toxic"), "doc_id", rows).union(smallest_hashes(usable.where("not toxic"), "doc_id", rows))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # 2 * rows ids at most
    texts = texts.groupBy("text").agg(F.max("toxic").alias("toxic"))
    sample = cut(texts.select("toxic", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("fold"), words(F.col("text")).alias("w")), "sample")
    if sample.groupBy("toxic").count().count() < 2:
        return Scorer(None, 0.0, -1.0)
    found = models(sample, docs)
    # each half is judged by the models of the other
    crossed = F.when(F.col("fold") == 0, _udf(spark, found["fold1"].evidence)("w")).otherwise(_udf(spark, found["fold0"].evidence)("w"))
    seen = sample.select("toxic", crossed.alias("e")).toArrow()
    y = seen.column("toxic").to_numpy().astype(float)
    n = {True: y.sum(), False: (1 - y).sum()}
    weight = np.where(y == 1, by_class[True] / n[True], by_class[False] / n[False])  # as common as among the labels
    x = np.log(seen.column("e").to_numpy() + FLOOR)
    order = np.lexsort((y, x))  # sums must not depend on the order in which rows arrive
    return Scorer(found["all"], *_logistic(x[order], y[order], weight[order] / weight.mean()))


def scores(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``doc_id, score`` for every row of ``docs (doc_id, text, ...)``; 0 to 1, higher if likelier toxic.

    Only texts enter a score. Null and empty texts get the score of no evidence; repeated rows score alike.
    Without labelled rows of both classes all scores are alike.
    """
    score = _udf(docs.sparkSession, fit(docs, labels, rows).score)
    return docs.select("doc_id", score(words(docs["text"])).alias("score"))


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``docs`` without the rows scored 0.5 or more; rows are judged in place, without a shuffle."""
    score = _udf(docs.sparkSession, fit(docs, labels, rows).score)
    return docs.where(score(words(docs["text"])) < 0.5)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return s.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
