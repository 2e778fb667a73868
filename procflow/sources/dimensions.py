"""Dimension tables from files: command patterns, block lists, device inventories and test catalogs.

Patterns become column expressions, so they are read into the driver; ``MOST`` bounds them. Inventories and catalogs
stay tables that are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Patterns of one file, at most; more is an error.
MOST = 10_000
PATTERN = "vendor string, vendor_no int, mode string, pattern_no int, pattern string"
BLOCKED = "pattern_no int, pattern string"
DEVICE = "device string, vendor string, os string, model_key string, version string, role string, host string, port int, protocols array<string>, features array<string>"
TEST = "protocol string, test_type string, test_id string, intent string, severity string, threshold_pct double"


def _bounded(rows: DataFrame) -> list:
    """All rows of a small table; an error where there are more than a plan can hold."""
    got = rows.limit(MOST + 1).collect()
    if len(got) > MOST:
        raise ValueError(f"more than {MOST} patterns")
    return got


def pattern_rows(spark: SparkSession, vendors: dict[str, dict[str, tuple[str, ...]]]) -> DataFrame:
    """Vendors' patterns as rows, the form in which load_patterns() reads them."""
    rows = [(v, i, mode, k, p) for i, (v, modes) in enumerate(vendors.items()) for mode, ps in modes.items() for k, p in enumerate(ps)]
    return spark.createDataFrame(rows, PATTERN)


def load_patterns(spark: SparkSession, path: str) -> dict[str, dict[str, tuple[str, ...]]]:
    """Command patterns by vendor and mode from JSON lines, in the order of their numbers, as vendor_mode() takes
    them. Rows without a vendor, mode or pattern are left out."""
    rows = spark.read.schema(PATTERN).option("mode", "DROPMALFORMED").json(path).where("vendor is not null and mode in ('exec', 'config') and pattern is not null")
    out: dict[str, dict[str, tuple[str, ...]]] = {}
    for r in sorted(_bounded(rows), key=lambda r: (r.vendor_no or 0, r.vendor, r.pattern_no or 0)):
        modes = out.setdefault(r.vendor, {"exec": (), "config": ()})
        modes[r.mode] += (r.pattern,)
    return out


def load_block_list(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Patterns of commands that may not run, in the order of their numbers."""
    rows = _bounded(spark.read.schema(BLOCKED).json(path).where("pattern is not null"))
    return tuple(r.pattern for r in sorted(rows, key=lambda r: r.pattern_no or 0))


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Device instances from JSON lines, as resolve_devices() takes them; rows without a name are left out."""
    return spark.read.schema(DEVICE).json(path).where(F.col("device").isNotNull())


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Tests from JSON lines, as test_plan() takes them."""
    return spark.read.schema(TEST).json(path).where(F.col("test_id").isNotNull())
