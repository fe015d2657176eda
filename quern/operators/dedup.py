"""Exact duplicates: groups, canonical rows and the exclusion policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CANONICAL_ORDER = ("dataset", "source_version", "source_path", "record_id")


def exact_groups(records: DataFrame) -> DataFrame:
    """One row for each content hash that two records or more share.

    A conflict is more than one source label or more than one target. Only
    the hash and narrow columns are shuffled; partial aggregates absorb a
    hash that very many records share.
    """
    target = F.when(F.col("target_class") != "", F.col("target_class"))
    grouped = records.groupBy("sha256").agg(
        F.count("*").alias("member_count"),
        F.countDistinct("role").alias("roles"),
        F.bool_or(F.col("role") == "locked_test").alias("touches_locked_test"),
        F.countDistinct("source_label").alias("labels"),
        F.countDistinct(target).alias("targets"),
        F.min("record_id").alias("first_record_id"),
    )
    grouped = grouped.where("member_count > 1")
    return grouped.select(
        "sha256",
        F.concat(F.lit("exact_"), F.substring("sha256", 1, 20)).alias("group_id"),
        "member_count",
        (F.col("roles") > 1).alias("cross_role"),
        "touches_locked_test",
        ((F.col("labels") > 1) | (F.col("targets") > 1)).alias("label_conflict"),
        (F.col("targets") > 1).alias("target_conflict"),
        "first_record_id",
    )


def conflict_report(records: DataFrame) -> DataFrame:
    """Members of exact groups with a label conflict."""
    conflicts = exact_groups(records).where("label_conflict").select("sha256", "group_id")
    return records.join(conflicts, "sha256").select("group_id", "record_id", "dataset", "role", "source_label", "target_class", "source_path")


def first_by(df: DataFrame, key: str | list[str], *order: str | Column) -> DataFrame:
    """The first row of each key."""
    keys = [key] if isinstance(key, str) else key
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def apply_exact_policy(records: DataFrame) -> DataFrame:
    """Cleaning columns after exact duplicates: leakage, then conflict, then copies of the canonical record.

    Groups that touch the locked test exclude their training rows; else
    groups in conflict do; else every eligible row but the first goes.
    ``records`` carries cleaning_status and exclusion_reason.
    """
    groups = exact_groups(records).select("sha256", F.col("group_id").alias("exact_duplicate_group_id"), "touches_locked_test", "label_conflict")
    joined = records.join(groups, "sha256", "left")
    training = F.col("role") == "training_candidate"
    eligible = training & (F.col("mapping_status") == "MATCHED")
    plain = F.col("exact_duplicate_group_id").isNotNull() & ~F.col("touches_locked_test") & ~F.col("label_conflict") & eligible
    # the canonical row is a partial aggregate, so one very common hash is no single task
    order = F.struct(*CANONICAL_ORDER)
    canonical = joined.where(plain).groupBy("sha256").agg(F.min(order).alias("_first")).select("sha256", F.col("_first.record_id").alias("canonical_record_id"))
    joined = joined.join(canonical, "sha256", "left").withColumn("canonical_record_id", F.when(plain, F.col("canonical_record_id")))
    reason = (
        F.when(F.col("touches_locked_test") & training, "EXACT_BENCHMARK_LEAKAGE")
        .when(F.col("label_conflict") & ~F.col("touches_locked_test") & training, "EXACT_LABEL_CONFLICT")
        .when(plain & (F.col("canonical_record_id") != F.col("record_id")), "EXACT_DUPLICATE_COPY")
    )
    return (
        joined.withColumn("_reason", reason)
        .withColumn("cleaning_status", F.when(F.col("_reason").isNotNull(), "EXCLUDE").otherwise(F.col("cleaning_status")))
        .withColumn("exclusion_reason", F.coalesce("_reason", "exclusion_reason"))
        .withColumn("benchmark_leakage", F.coalesce(F.col("touches_locked_test") & training, F.lit(False)))
        .withColumn("label_conflict", F.coalesce("label_conflict", F.lit(False)))
        .drop("_reason", "touches_locked_test")
    )


def cross_overlap(left: DataFrame, right: DataFrame, key: str = "sha256") -> DataFrame:
    """All pairs of rows of two sources with equal content: (key, left_id, right_id)."""
    return left.select(key, F.col("record_id").alias("left_id")).join(right.select(key, F.col("record_id").alias("right_id")), key)


def overlap(left: DataFrame, right: DataFrame, key: str = "sha256") -> DataFrame:
    """Keys on both sides, once each."""
    return left.select(key).intersect(right.select(key))
