"""Per-user activity: counts by status, frequent labels, recent rows, pages of history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("healthy", "diseased", "uncertain", "no_leaf")


def own_rows(predictions: DataFrame, user_id: int) -> DataFrame:
    return predictions.where(F.col("user_id") == F.lit(user_id))


def dashboard(predictions: DataFrame) -> DataFrame:
    """Per user: all rows, rows by status, and mean confidence."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    return predictions.groupBy("user_id").agg(F.count("*").alias("total"), *counts, F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"))


def frequent(predictions: DataFrame, k: int = 3) -> DataFrame:
    """Each user's k most frequent diseased labels, ties by name."""
    counts = predictions.where("status = 'diseased'").groupBy("user_id", "disease").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "disease"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def recent(predictions: DataFrame, k: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id")))
    return predictions.withColumn("rank", rank).where(F.col("rank") <= k)


def page(predictions: DataFrame, number: int, size: int = 10) -> DataFrame:
    """A page of the rows, newest first; one past the end is empty."""
    return predictions.orderBy(F.desc("created_at"), F.desc("id")).offset(size * (number - 1)).limit(size)


def prefix_classes(labels: DataFrame, crops: DataFrame) -> DataFrame:
    """(crop, n): labels that begin with the crop and a blank; crops without any count zero.

    The first word of a label is its only possible one-word crop, so the join
    is on equality; crops of several words match through their first word.
    """
    keyed = labels.select("label", F.substring_index("label", " ", 1).alias("_k"))
    named = crops.select("crop", F.substring_index("crop", " ", 1).alias("_k"))
    hits = named.join(keyed, "_k").where(F.startswith(F.col("label"), F.concat(F.col("crop"), F.lit(" "))))
    return crops.select("crop").join(hits.groupBy("crop").agg(F.count("*").alias("n")), "crop", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def sampled_report(rows: DataFrame, key: str, order: str, k: int, critical: str) -> DataFrame:
    """The first k rows of each key, and all critical rows."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return rows.withColumn("place", rank).where((F.col("place") <= k) | F.col(critical))


def without_tombstones(rows: DataFrame, deleted: DataFrame, key: str = "id") -> DataFrame:
    """Append-only table less its deletions."""
    return rows.join(deleted.select(key), key, "left_anti")
