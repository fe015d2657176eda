"""Classifier evaluation: confusion counts, per-class metrics, paired comparison and bootstrap.

Predictions are rows (t, p) of true and predicted class, or (t, a, b) for two
models on the same rows. Everything after the first aggregate works on class
counts, whose size is bounded by the classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOOTSTRAP = 10_000
SEED = 20260810


def argmax(scores: Column) -> Column:
    """Index of the largest score, the least one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def top_k(scores: Column, k: int) -> Column:
    """The k best (index, score), larger scores first, then smaller indices."""
    pairs = F.transform(scores, lambda x, i: F.struct((-x).alias("neg"), i.alias("index")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct(s["index"].alias("index"), (-s["neg"]).alias("score")))


def confusion(rows: DataFrame) -> DataFrame:
    """(t, p, n) of the cells that occur."""
    return rows.groupBy("t", "p").agg(F.count("*").alias("n"))


def weighted_confusion(rows: DataFrame, weight: str) -> DataFrame:
    return rows.groupBy("t", "p").agg(F.sum(weight).alias("n"))


def confusion_grid(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """All cells over a class dimension (c), zeros included. The grid is classes squared, not rows."""
    grid = classes.select(F.col("c").alias("t")).crossJoin(classes.select(F.col("c").alias("p")))
    return grid.join(confusion(rows), ["t", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def per_class(rows: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(c, support, predicted, precision, recall, f1); a zero denominator gives zero."""
    cells = confusion(rows)
    ends = cells.select("n", F.inline(F.array(
        F.struct(F.col("t").alias("c"), F.lit(1).alias("is_true"), F.when(F.col("t") == F.col("p"), 1).otherwise(0).alias("hit"), F.lit(0).alias("is_pred")),
        F.struct(F.col("p").alias("c"), F.lit(0).alias("is_true"), F.lit(0).alias("hit"), F.lit(1).alias("is_pred")),
    )))
    sums = ends.groupBy("c").agg(*[F.sum(F.col("n") * F.col(k)).alias(a) for k, a in (("hit", "hits"), ("is_true", "support"), ("is_pred", "predicted"))])
    if classes is not None:
        sums = classes.select("c").join(sums, "c", "left").na.fill(0, ["hits", "support", "predicted"])
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = sums.withColumn("precision", zero(F.try_divide("hits", "predicted"))).withColumn("recall", zero(F.try_divide("hits", "support")))
    f1 = zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.withColumn("f1", f1).select("c", "support", "predicted", "precision", "recall", "f1")


def averages(scores: DataFrame, with_support: bool = True) -> DataFrame:
    """Macro and support-weighted means of ``per_class`` rows; macro over classes with support, or over all."""
    chosen = F.col("support") > 0 if with_support else F.lit(True)
    macro = [F.avg(F.when(chosen, F.col(m))).alias(f"macro_{m}") for m in ("precision", "recall", "f1")]
    weighted = [F.try_divide(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")]
    return scores.agg(F.count_if(chosen).alias("classes"), *macro, *weighted)


def sliced_metrics(rows: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """Accuracy and macro F1 of overlapping slices, in one pass: a row is counted once for each slice that it is in."""
    tags = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in slices.items()]))
    cells = rows.select("t", "p", F.explode(tags).alias("slice")).groupBy("slice", "t", "p").agg(F.count("*").alias("n"))
    true = cells.groupBy("slice", F.col("t").alias("c")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("hits"))
    pred = cells.groupBy("slice", F.col("p").alias("c")).agg(F.sum("n").alias("predicted"))
    both = true.join(pred, ["slice", "c"], "left").na.fill(0, ["predicted"])
    f1 = F.col("hits") * 2.0 / (F.col("support") + F.col("predicted"))
    return both.groupBy("slice").agg(F.sum("support").alias("n"), (F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def confidence_analysis(rows: DataFrame, threshold: float = 60.0, empty_class: int = 4) -> DataFrame:
    """One row about (t, p, confidence in percent): at and below the threshold, uncertain, empty."""
    sure, empty = F.col("confidence") >= threshold, F.col("p") == empty_class
    return rows.agg(
        F.count_if(sure).alias("n_sure"),
        F.avg(F.when(sure, (F.col("t") == F.col("p")).cast("double"))).alias("accuracy_sure"),
        F.count_if(~sure).alias("n_below"),
        F.count_if(~sure & ~empty).alias("n_uncertain"),
        F.count_if(empty).alias("n_empty"),
        F.count_if(empty & ~sure).alias("n_empty_below"),
        F.avg("confidence").alias("mean_confidence"),
        F.median("confidence").alias("median_confidence"),
    )


def two_class_confusion(rows: DataFrame, x: int, y: int) -> DataFrame:
    """How often two classes are taken for each other, both ways."""
    t, p = F.col("t"), F.col("p")
    out = rows.agg(F.count_if(t == x).alias("x_support"), F.count_if(t == y).alias("y_support"), F.count_if((t == x) & (p == y)).alias("x_to_y"), F.count_if((t == y) & (p == x)).alias("y_to_x"))
    both = (F.col("x_to_y") + F.col("y_to_x")).alias("both")
    return out.select("*", both, F.try_divide("x_to_y", "x_support").alias("x_to_y_rate"), F.try_divide("y_to_x", "y_support").alias("y_to_x_rate"), F.try_divide(F.col("x_to_y") + F.col("y_to_x"), F.col("x_support") + F.col("y_support")).alias("both_rate"))


def class_deltas(rows: DataFrame) -> DataFrame:
    """Per class with support: F1 of models a and b, and their difference."""
    a = per_class(rows.select("t", F.col("a").alias("p"))).select("c", "support", F.col("f1").alias("f1_a"))
    b = per_class(rows.select("t", F.col("b").alias("p"))).select("c", F.col("support").alias("support_b"), F.col("f1").alias("f1_b"))
    joined = a.join(b, "c", "full_outer").where("support > 0 or support_b > 0")
    return joined.select("c", "support", "f1_a", "f1_b", (F.col("f1_b") - F.col("f1_a")).alias("delta"))


def confusion_changes(rows: DataFrame) -> DataFrame:
    """Off-diagonal cells whose count differs between models a and b, with rates by true support."""
    cells = rows.select("t", F.inline(F.array(F.struct(F.col("a").alias("p"), F.lit(1).alias("in_a"), F.lit(0).alias("in_b")), F.struct(F.col("b").alias("p"), F.lit(0).alias("in_a"), F.lit(1).alias("in_b")))))
    cells = cells.groupBy("t", "p").agg(F.sum("in_a").alias("a_count"), F.sum("in_b").alias("b_count"))
    support = rows.groupBy("t").agg(F.count("*").alias("support"))
    out = cells.where("t != p and a_count != b_count").join(support, "t")
    delta = F.col("b_count") - F.col("a_count")
    return out.select("t", "p", "support", "a_count", "b_count", delta.alias("delta"), (delta / F.col("support")).alias("delta_rate"), F.when(delta > 0, "increased").otherwise("decreased").alias("direction"))


def ranked_changes(changes: DataFrame) -> list[Column]:
    return [F.abs("delta_rate").desc(), F.abs("delta").desc(), F.col("t"), F.col("p")]


def major_confusions(rows: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent wrong cells."""
    return confusion(rows).where("t != p").orderBy(F.desc("n"), "t", "p").limit(k)


def by_position(truth: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Joins arrays held in one row each by position: (pos, t, value)."""
    t = truth.select(F.posexplode("items").alias("pos", "t"))
    return t.join(values.select(F.posexplode("items").alias("pos", value)), "pos")


def paired_bootstrap(rows: DataFrame, replicates: int = BOOTSTRAP, seed: int = SEED) -> DataFrame:
    """Paired, true-class-stratified bootstrap of (t, a, b): one row of point deltas and 95 % intervals.

    Rows are first counted by cell, so a replicate draws each class's cells
    from a multinomial and the table that travels is bounded by classes
    cubed. Every replicate has a generator of its own and may run anywhere;
    the intervals are repeatable, and not those of one sequential generator.
    """
    spark = rows.sparkSession
    cells = [tuple(r) for r in rows.groupBy("t", "a", "b").agg(F.count("*").alias("n")).orderBy("t", "a", "b").collect()]
    table = np.array(cells, dtype=np.int64).reshape(-1, 4)

    def scores(n: np.ndarray) -> tuple[float, float]:
        t, a, b, _ = table.T
        out = []
        for p in (a, b):
            f1 = []
            for c in np.unique(t):
                hit, all_ = n[(t == c) & (p == c)].sum(), n[t == c].sum() + n[p == c].sum()
                f1.append(2 * hit / all_ if all_ else 0.0)
            out.append((np.mean(f1), n[t == p].sum() / n.sum()))
        return out[1][0] - out[0][0], out[1][1] - out[0][1]

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, _, _, n = table.T
        for pdf in frames:
            got = []
            for replicate in pdf["id"]:
                rng = np.random.default_rng((seed, int(replicate)))
                sampled = np.zeros(len(n), np.int64)
                for c in np.unique(t):
                    own = t == c
                    sampled[own] = rng.multinomial(n[own].sum(), n[own] / n[own].sum())
                got.append(scores(sampled))
            yield pd.DataFrame(got, columns=["macro", "accuracy"])

    if not len(table):
        return spark.createDataFrame([], "point_macro double, point_accuracy double, macro_ci array<double>, accuracy_ci array<double>")
    point = scores(table[:, 3])
    drawn = spark.range(replicates).mapInPandas(draw, "macro double, accuracy double")
    ends = F.array(F.lit(0.025), F.lit(0.975))
    return drawn.agg(F.percentile("macro", ends).alias("macro_ci"), F.percentile("accuracy", ends).alias("accuracy_ci")).select(
        F.lit(float(point[0])).alias("point_macro"), F.lit(float(point[1])).alias("point_accuracy"), "macro_ci", "accuracy_ci"
    )


def best_candidate(rows: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The row with the best val_macro_f1, then loss, then recall, then the earliest epoch."""
    order = F.struct("val_macro_f1", (-F.col("val_loss")).alias("l"), "macro_recall", (-F.col("epoch")).alias("e"))
    best = F.max_by(F.struct(*rows.columns), order).alias("best")
    return (rows.groupBy(*key).agg(best) if key else rows.agg(best)).select("best.*")
