"""Completion markers: what was written, for what, and from which rows; and tables built only where none fits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.checks import CheckFailed

MARKER = "identity string, rows long, digest string"


def content_digest(rows: DataFrame) -> tuple[int, str]:
    """Count and order-free digest of all rows: sums of two 64-bit hashes, so that no task gathers them."""
    every = F.struct(*[F.col(c) for c in sorted(rows.columns)])
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(every, F.lit(seed)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    n, a, b = rows.agg(F.count("*"), total(1), total(2)).first()
    return n, f"{int(a) % (1 << 64):016x}{int(b) % (1 << 64):016x}"


def write_marker(table: DataFrame, path: str, identity: str) -> None:
    """Marks ``table``, read back from where it lies, as complete for ``identity``."""
    n, digest = content_digest(table)
    table.sparkSession.createDataFrame([(identity, n, digest)], MARKER).coalesce(1).write.mode("overwrite").json(path)


def check_marker(table: DataFrame, path: str, identity: str) -> DataFrame:
    """``table``, if its marker is of this identity and its rows are those that were marked."""
    marker = table.sparkSession.read.schema(MARKER).json(path).collect()
    if len(marker) != 1 or marker[0]["identity"] != identity:
        raise CheckFailed(f"no completion marker for {identity}")
    if (marker[0]["rows"], marker[0]["digest"]) != content_digest(table):
        raise CheckFailed(f"rows of {identity} are not those that were marked")
    return table


def materialised(spark: SparkSession, path: str, identity: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, if it is complete for ``identity``; else built, written, marked and read."""
    try:
        return check_marker(spark.read.parquet(f"{path}/rows"), f"{path}/marker", identity)
    except Exception as e:  # absent, of another identity or changed: build anew
        if not isinstance(e, CheckFailed) and "PATH_NOT_FOUND" not in str(e):
            raise
    build().write.mode("overwrite").parquet(f"{path}/rows")
    table = spark.read.parquet(f"{path}/rows")
    write_marker(table, f"{path}/marker", identity)
    return table
