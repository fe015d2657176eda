"""Shared pieces: shared-folder tables that cut lineage, checked broadcasts, connected components.

Intermediate tables go to the folder that every executor shares
(``spark.checkpoint.dir``); a lost executor never takes part of them along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, DecimalType, MapType, StringType, StructType

from quern.operators import graph
from quern.sources.shared import drop_table, shared_folder, stage_table

__all__ = ["BROADCAST_BYTES", "BROADCAST_ROWS", "Scratch", "ascii_lower", "components", "drop_table", "labelled_fold", "read_table", "settled_labels", "shared_folder", "small", "stage_table"]

#: Rows and bytes up to which a table may be broadcast; beyond either, joins shuffle.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 48 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Stages tables as ``stage_table`` does, and drops all of them once what was made from them is staged itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.held.append(stage_table(df, name))
        return self.held[-1]

    def free(self, *tables: DataFrame) -> None:
        """Drop tables that are no longer read, and let the shuffle files of steps that are over go: Spark keeps them until the driver collects its garbage."""
        for table in tables:
            self.held = [t for t in self.held if t is not table]
            drop_table(self.spark, table)
        self.spark.sparkContext._jvm.System.gc()

    def drop(self) -> None:
        while self.held:
            drop_table(self.spark, self.held.pop())


def _width(kind: DataType) -> float:
    """Bytes of a value of a fixed-width type; boundless for others."""
    if isinstance(kind, StructType):
        return sum(8 + _width(f.dataType) for f in kind.fields)
    if isinstance(kind, (ArrayType, MapType, StringType, BinaryType, DecimalType)):
        return float("inf")
    return 8


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: Column | None = None) -> DataFrame:
    """Mark a staged table for broadcast if its counted rows and their bytes are few enough, else leave the join to shuffle.

    Columns of no fixed width are measured: as JSON, or by ``size``, the bytes of a row.
    """
    width = _width(df.schema)
    size = size if size is not None else F.lit(width) if width < float("inf") else F.length(F.to_json(F.struct(*df.columns))) + 16 * len(df.columns)
    many, held = df.agg(F.count("*"), F.sum(size.cast("double"))).first()
    return F.broadcast(df) if many <= rows and (held or 0) <= BROADCAST_BYTES else df


def settled_labels(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label) of the documents outside the held-out fold whose rows in ``labels`` agree; nulls are skipped, and conflicting labels too."""
    known = labels.where(F.col(name).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(name).alias(name), F.max(name).alias("most"))
    return known.where((F.col(name) == F.col("most")) & (labelled_fold(F.col("doc_id")) != 1)).select("doc_id", name)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def labelled_fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; fold 1 is held out from every training step."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) edges, as (v, label): label is the least vertex reachable; vertices without an edge are absent."""
    return graph.components(edges).withColumnRenamed("component", "label")
