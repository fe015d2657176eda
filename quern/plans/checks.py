"""Fail-fast validation: many named counters in one pass, compared with zero."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class CheckFailed(ValueError):
    """A data set breaks a rule."""


def counters(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row that counts, for each rule, the rows that break it (null counts as broken)."""
    return df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])


def require(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``df``, if no row breaks a rule; else CheckFailed with the first broken rule."""
    row = counters(df, rules).first() if rules else None
    for name in rules:
        if row[name]:
            raise CheckFailed(f"{name}: {row[name]} rows")
    return df


def require_columns(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Fails before any job runs."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise CheckFailed(f"missing columns: {', '.join(missing)}")
    return df


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise CheckFailed("no rows")
    return df


def require_unique(df: DataFrame, *key: str) -> DataFrame:
    twice = df.groupBy(*key).count().where("count > 1")
    if not twice.isEmpty():
        raise CheckFailed(f"{', '.join(key)} is not unique")
    return df


def require_same(a: DataFrame, b: DataFrame) -> None:
    """Equal sets of rows."""
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise CheckFailed("the two sets of rows differ")


def looked_up(df: DataFrame, side: DataFrame, on: str, proof: str) -> DataFrame:
    """Left join in which a missing key is an error; ``proof`` is a column of ``side`` that is never null."""
    return require(df.join(side, on, "left"), {f"{on} is known": F.col(proof).isNotNull()})


def coverage(observed: DataFrame, declared: DataFrame, label: str) -> DataFrame:
    """Labels on one side alone: (label, side)."""
    seen, said = observed.select(label).distinct(), declared.select(label).distinct()
    undeclared = seen.join(said, label, "left_anti").withColumn("side", F.lit("observed"))
    return undeclared.unionByName(said.join(seen, label, "left_anti").withColumn("side", F.lit("declared")))


def merged_maps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Union of two mappings that must not share a key."""
    if not a.join(b, key, "left_semi").isEmpty():
        raise CheckFailed(f"{key} in both mappings")
    return a.unionByName(b)


def close(a: Column, b: Column, tolerance: float = 1e-7) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(tolerance), F.lit(tolerance) * F.greatest(F.abs(a), F.abs(b)))
