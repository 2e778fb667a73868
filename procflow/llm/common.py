"""What the training-data operators share: words, tables cut from their lineage, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: everything that is not ASCII white space (used by JVM-side regular expressions).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8. ``bytes.split`` splits at exactly the six ASCII blanks of WORD."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own if all
    of Spark runs on this machine, else an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path


#: Rows of an Arrow batch, at most. Texts may be long, and a worker, like the executor beside it, holds whole batches.
BATCH_ROWS = 1000


def modest_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows if they are larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a (narrow) table to the shared folder and read it back: later plans start from files that
    survive a lost executor, and nothing above is computed twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/procflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what ``cut`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def smallest_hashes(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most ``limit`` rows of ``df``, those of the smallest hash of ``key``: the same ones on every run.

    A count tells which hashes are small enough for about twice the rows asked for; only those are sorted, so what
    reaches the last task is bounded by ``limit`` however many partitions there are.
    """
    h = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    n = df.count()
    if n > 4 * limit:
        df = df.where(h < int((1 << 40) * 2 * limit / n))
    return df.orderBy(h, key).limit(limit)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges (a, b)``: ``(node, root)``, root being the smallest node reachable.

    Each round hooks nodes and their roots to the smallest label next to them, then jumps pointers, so the
    number of rounds grows with the logarithm of a component's diameter. Labels and edges stay distributed;
    the driver sees one count a round. Edges that repeat few nodes make small files, by which Spark would broadcast many
    of them; they are joined by shuffle. Raises if the labels still move after ``rounds`` rounds.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"), "labels")
    for _ in range(rounds):
        with_a = both.hint("merge").join(labels.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        near = with_a.groupBy("b").agg(F.min("ra").alias("low"))
        hooked = labels.join(near.withColumnRenamed("b", "node"), "node").select("node", "root", F.least("root", "low").alias("low"))
        # both the node and its old root learn the smaller label
        offers = hooked.select("node", "low").union(hooked.where("low < root").select(F.col("root").alias("node"), "low"))
        first = offers.groupBy("node").agg(F.min("low").alias("up"))
        jumped = first.join(first.select(F.col("node").alias("up"), F.col("up").alias("root")), "up").select("node", "root")
        was = labels
        labels = cut(jumped.join(was.select("node", F.col("root").alias("was")), "node"), "labels")
        discard(was)
        if not labels.where("root <> was").limit(1).count():
            discard(both)
            return labels.select("node", "root")
    raise RuntimeError(f"components: labels still move after {rounds} rounds")
