"""Class imbalance: counts, summaries, quantiles and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def class_counts(rows: DataFrame, label: str, classes: DataFrame | None = None) -> DataFrame:
    """(label, n); with ``classes``, absent ones count zero."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    return counts if classes is None else classes.select(label).join(counts, label, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def summary(counts: DataFrame, value: str = "n") -> DataFrame:
    """Least, most, mean, median and ratio of a column; an empty table gives nulls."""
    c = F.col(value)
    return counts.agg(F.count("*").alias("classes"), F.min(c).alias("least"), F.max(c).alias("most"), F.avg(c).alias("mean"), F.median(c).alias("median"), F.try_divide(F.max(c), F.min(c)).alias("ratio"))


def class_weights(rows: DataFrame, label: str, low: float = 0.5, high: float = 3.0) -> DataFrame:
    """sqrt(median / n), scaled to a row-weighted mean of one, then clipped."""
    counts = rows.groupBy(label).agg(F.count("*").alias("n"))
    median = counts.agg(F.median("n").alias("median"))
    raw = counts.crossJoin(F.broadcast(median)).withColumn("raw", F.sqrt(F.col("median") / F.col("n")))  # one row
    scale = raw.agg((F.sum("n") / F.sum(F.col("n") * F.col("raw"))).alias("scale"), F.sum("n").alias("total"))
    out = raw.crossJoin(F.broadcast(scale)).withColumn("weight", F.col("raw") * F.col("scale"))
    return out.select(label, "n", (F.col("n") / F.col("total")).alias("share"), F.sqrt(F.col("total") / F.col("n")).alias("inverse_sqrt"), "raw", "weight", F.greatest(F.lit(low), F.least(F.lit(high), F.col("weight"))).alias("clipped"))


def histogram_quantiles(values: DataFrame, value: str, quantiles: tuple[float, ...]) -> DataFrame:
    """(q, value): the least value with more than q * (n - 1) rows at or below it.

    Runs over the histogram, whose size is the number of distinct values.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    below = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = counts.withColumn("cum", F.sum("n").over(below))
    total = counts.agg(F.sum("n").alias("total"))
    wanted = counts.sparkSession.createDataFrame([(q,) for q in quantiles], "q double")
    return cumulative.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(wanted)).where(F.col("cum") > F.col("q") * (F.col("total") - 1)).groupBy("q").agg(F.min("value").alias("value"))


def upper_median(values: DataFrame, group: str, value: str) -> DataFrame:
    """Element n // 2 of each group in order: rank and count, no list of a group in memory."""
    window = Window.partitionBy(group)
    ranked = values.where(F.col(value).isNotNull()).select(group, value, F.row_number().over(window.orderBy(value)).alias("r"), F.count("*").over(window).alias("n"))
    return ranked.where(F.col("r") == F.floor(F.col("n") / 2) + 1).select(group, F.col(value).alias("upper_median"))


def combined_projection(a: DataFrame, b: DataFrame, label: str) -> DataFrame:
    """Rows of each class in two sources and together; classes of either side."""
    x = a.groupBy(label).agg(F.count("*").alias("n_a"))
    y = b.groupBy(label).agg(F.count("*").alias("n_b"))
    out = x.join(y, label, "full_outer")
    return out.select(label, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"), (F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))).alias("n"))


def joined_values(rows: DataFrame, key: str, value: str, separator: str = " | ") -> DataFrame:
    """Distinct non-empty values of each key, sorted and joined, and how many."""
    present = F.when(F.col(value) != "", F.col(value))
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(present)), separator).alias("joined"), F.countDistinct(present).alias("n_values"))
