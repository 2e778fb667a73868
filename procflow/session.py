"""Session defaults used by the bench, the tests and interactive work."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(app: str = "procflow", cores: str | int = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the library is written for (AQE, Arrow, UTC)."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One parquet table of the data folder, by whatever path scheme Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; a folder of our own is set only where the session has none
    and all of Spark runs on this machine."""
    import tempfile

    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder that is not there yet, below the shared one."""
    import uuid

    return f"{_shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df):
    """Cut a table from its lineage into the shared folder."""
    _shared_root(df.sparkSession)
    return df.checkpoint()


def kept(df, name: str):
    """A table written to the shared folder and read back: cut from its lineage as by checkpointed(), in less space."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task, about: tables that would give more are dealt to more tasks than the session's shuffle partitions.
TASK_ROWS = 250_000


def tasks(spark: SparkSession, rows: int, each: int = TASK_ROWS) -> int:
    """How many tasks so many rows are dealt to; as many as the session has for shuffles, at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def dealt(df, *keys: str, rows: int | None = None):
    """``df`` dealt by keys, so that the rows of a task do not grow with the table. What would be few rows a task on all
    cores stays as it is; more are dealt outright, as adaptive execution merges a shuffle's partitions down to one a core
    however many the session has. Without ``rows`` they are counted when this is called (of a Parquet table, by its
    footers)."""
    spark = df.sparkSession
    rows = df.count() if rows is None else rows
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(tasks(spark, rows), *keys) if -(-rows // TASK_ROWS) > min(cores, tasks(spark, 0)) else df


def computed(df, **columns):
    """``df`` with more columns, each evaluated once a row: what later steps select or filter by is read from them, as
    the optimizer moves no expression across the row generator. For dear expressions that a filter also needs."""
    from pyspark.sql import functions as F

    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


#: Distinct texts, and characters of them, up to which a column's texts are told apart from the rows that hold them.
TEXTS, TEXT_CHARS = 20_000, 8_000_000


def repeated(df, key: str, rows: int, least: int = TASK_ROWS):
    """All distinct values of a text column, each once, where many rows (over ``least``) repeat few of them: functions of
    the text are then evaluated on these and joined back by a broadcast. None where rows are few, or the texts are more or
    longer than TEXTS and TEXT_CHARS allow (by an approximate count). Jobs run when this is called."""
    from pyspark.sql import functions as F

    if rows <= least:
        return None
    n, longest = df.agg(F.approx_count_distinct(key), F.max(F.length(key))).first()
    return checkpointed(df.select(key).distinct()) if n <= TEXTS and n * (longest or 0) <= TEXT_CHARS else None


def ship(spark: SparkSession) -> None:
    """Send this package to the workers of a session that was started where they cannot import it."""
    import os
    import shutil
    import tempfile

    package = os.path.dirname(os.path.abspath(__file__))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="ship-"), "procflow"), "zip", os.path.dirname(package), os.path.basename(package))
    spark.sparkContext.addPyFile(made)
