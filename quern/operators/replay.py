"""Ordered histories: audits, state replay and resume plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history_audit(history: DataFrame, key: str) -> DataFrame:
    """Per history: epochs, whether they are exactly 1..N and finite, and its first best F1 and loss epochs."""
    finite = F.lit(True)
    for c in ("val_macro_f1", "val_loss"):
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    out = history.groupBy(key).agg(
        F.count("*").alias("epochs"),
        F.countDistinct("epoch").alias("distinct_epochs"),
        F.min("epoch").alias("first"),
        F.max("epoch").alias("last"),
        F.bool_and(finite).alias("finite"),
        F.max_by("epoch", F.struct("val_macro_f1", (-F.col("epoch")).alias("e"))).alias("best_f1_epoch"),
        F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_loss_epoch"),
    )
    whole = (F.col("first") == 1) & (F.col("last") == F.col("epochs")) & (F.col("distinct_epochs") == F.col("epochs"))
    return out.select(key, "epochs", whole.alias("contiguous"), "finite", "best_f1_epoch", "best_loss_epoch")


def epoch_gaps(history: DataFrame, key: str) -> DataFrame:
    """Rows whose epoch is not their place in the history."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("epoch"))
    return history.withColumn("place", place).where("place != epoch")


def resume_plan(audit: DataFrame, max_epochs: int) -> DataFrame:
    """What may happen to each history: COMPLETE, RESUME or RESTART."""
    plan = (
        F.when(~F.col("contiguous") | ~F.col("finite"), "RESTART")
        .when(F.col("epochs") >= max_epochs, "COMPLETE")
        .when((F.col("best_f1_epoch") == F.col("epochs")) & (F.col("best_loss_epoch") == F.col("epochs")), "RESUME")
        .otherwise("RESTART")
    )
    return audit.withColumn("plan", plan)


def plateau_state(values: Column, rate: float, factor: float, patience: int, cooldown: int, least: float, delta: float = 1e-4) -> Column:
    """Folds a learning-rate plateau rule over an ordered array: struct(best, wait, cooldown, rate)."""
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(0).alias("wait"), F.lit(0).alias("cooldown"), F.lit(rate).alias("rate"))

    def step(s: Column, x: Column) -> Column:
        cooling = s["cooldown"] > 0
        left = F.when(cooling, s["cooldown"] - 1).otherwise(0)
        waited = F.when(cooling, 0).otherwise(s["wait"])
        better = x < s["best"] - F.lit(delta)
        counts = ~better & (left <= 0)
        waits = F.when(better, 0).when(counts, waited + 1).otherwise(waited)
        drops = counts & (waits >= patience) & (s["rate"] > F.lit(least))
        return F.struct(
            F.when(better, x).otherwise(s["best"]).alias("best"),
            F.when(drops, 0).otherwise(waits).alias("wait"),
            F.when(drops, F.lit(cooldown)).otherwise(left).alias("cooldown"),
            F.when(drops, F.greatest(s["rate"] * F.lit(factor), F.lit(least))).otherwise(s["rate"]).alias("rate"),
        )

    return F.aggregate(values, start, step)


def replay_plateau(history: DataFrame, key: str, order: str, value: str, rate: float = 1e-3, factor: float = 0.5, patience: int = 2, cooldown: int = 1, least: float = 1e-6) -> DataFrame:
    """The plateau state after each key's rows in order. A key's history must fit a row; histories are short by nature."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("x"))))
    folded = history.groupBy(key).agg(ordered.alias("h")).withColumn("s", plateau_state(F.col("h.x"), rate, factor, patience, cooldown, least))
    return folded.select(key, F.size("h").alias("steps"), "s.best", "s.wait", "s.cooldown", "s.rate")


def rate_faults(history: DataFrame, key: str, order: str, value: str, stored: str, rate: float = 1e-3, factor: float = 0.5, patience: int = 2, cooldown: int = 1, least: float = 1e-6) -> DataFrame:
    """Per key, the first step whose stored rate is not the one that the plateau rule had reached before it; keys without one are absent."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("x"), F.col(stored).alias("r"))))
    due = F.transform("h", lambda e, i: F.struct(e["o"].alias("o"), e["r"].alias("r"), plateau_state(F.transform(F.slice("h", F.lit(1), i), lambda p: p["x"]), rate, factor, patience, cooldown, least)["rate"].alias("due")))
    wrong = F.filter(due, lambda e: F.abs(e["r"] - e["due"]) > F.greatest(F.lit(1e-10), F.lit(1e-5) * F.greatest(F.abs(e["r"]), F.abs(e["due"]))))
    rows = history.groupBy(key).agg(ordered.alias("h")).select(key, F.get(wrong, 0).alias("w")).where("w is not null")
    return rows.select(key, F.col("w.o").alias("step"), F.col("w.r").alias("stored"), F.col("w.due").alias("due"))


def chained_phases(first: DataFrame, second: DataFrame) -> DataFrame:
    """Second-phase epochs go on where the first phase ended."""
    last = first.agg(F.coalesce(F.max("epoch"), F.lit(0)).alias("_last"))
    moved = second.crossJoin(F.broadcast(last)).withColumn("epoch", F.col("epoch") + F.col("_last")).drop("_last")  # one row
    return first.unionByName(moved)
