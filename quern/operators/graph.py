"""Groups on pair graphs: connected components and anchor groups.

Edges are (a, b) of one orderable type. Loops cut their lineage with tables
in the folder that all executors share; nothing is collected.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.shared import drop_table, stage_table


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(v, component): the least vertex that each vertex of an edge reaches.

    Every round points each vertex to its least neighbour, follows the pointers
    (twice as far as the round before, so that long ascending chains take few
    rounds), and rewrites the edges between pointers until none is left.
    """
    spark = edges.sparkSession
    rest = stage_table(edges.select("a", "b").where("a != b").distinct(), "edges")
    labels, jumps = None, 1
    while not rest.isEmpty():
        nearest = both_ways(rest).groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("to"))
        step = stage_table(nearest, "nearest")
        for _ in range(jumps):
            onward = step.select(F.col("v").alias("to"), F.col("to").alias("next"))
            further = stage_table(step.join(onward, "to").select("v", F.col("next").alias("to")), "step")
            drop_table(spark, step)
            step = further
        jumps += 1
        moved = rest.join(step.select(F.col("v").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("v").alias("b"), F.col("to").alias("y")), "b")
        fresh = stage_table(moved.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        drop_table(spark, rest)
        rest = fresh
        if labels is None:
            labels = step.select("v", F.col("to").alias("component"))
        else:
            onward = step.select(F.col("v").alias("component"), "to")
            labels = labels.join(onward, "component", "left").select("v", F.coalesce("to", "component").alias("component"))
    return labels if labels is not None else rest.select(F.col("a").alias("v"), F.col("b").alias("component"))


def _fold(edges: DataFrame) -> DataFrame:
    """(v) of the representatives of whole components, each folded by one task; ``edges`` is (component, a, b), b < a."""

    def serial(part: pd.DataFrame) -> pd.DataFrame:
        smaller: dict = {}
        for a, b in zip(part["a"], part["b"]):
            smaller.setdefault(a, []).append(b)
            smaller.setdefault(b, [])
        chosen: set = set()
        for v in sorted(smaller):
            if chosen.isdisjoint(smaller[v]):
                chosen.add(v)
        return pd.DataFrame({"v": sorted(chosen)})

    return edges.groupBy("component").applyInPandas(serial, f"v {dict(edges.dtypes)['a']}")


def anchor_groups(edges: DataFrame, rounds: int = 4, fold_edges: int = 200_000) -> DataFrame:
    """(v, representative) of every vertex in an anchor group of two or more.

    In ascending order a vertex joins its least neighbour that represents a
    group, or else represents one itself, so a chain never merges groups. The
    parallel form: an undecided vertex without a smaller undecided neighbour
    represents; neighbours of representatives are members. A long ascending
    chain would take a round for every two of its vertices, so after every
    ``rounds`` rounds each component of what is undecided that has
    ``fold_edges`` edges at most is folded in order by one task; larger ones go
    on in rounds. There is no bound on rounds.
    """
    spark = edges.sparkSession
    sym = stage_table(both_ways(edges.where("a != b")).distinct(), "pairs")
    undecided = stage_table(sym.select(F.col("a").alias("v")).distinct(), "undecided")
    chosen = None
    done = 0

    def settle(new: DataFrame, undecided: DataFrame, chosen: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        new = stage_table(new, "representatives")
        near = sym.join(new.withColumnRenamed("v", "b"), "b", "left_semi").select(F.col("a").alias("v"))
        left = stage_table(undecided.join(new, "v", "left_anti").join(near, "v", "left_anti"), "undecided")
        drop_table(spark, undecided)
        return left, new if chosen is None else chosen.unionAll(new)

    while not undecided.isEmpty():
        down = sym.where("b < a").join(undecided.withColumnRenamed("v", "b"), "b", "left_semi").join(undecided.withColumnRenamed("v", "a"), "a", "left_semi").select("a", "b")
        if done and done % rounds == 0:
            down = stage_table(down, "down")
            parts = components(down)
            placed = stage_table(down.join(parts.withColumnRenamed("v", "a"), "a"), "placed")
            small = placed.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") <= fold_edges).select("component")
            folded = placed.join(small, "component", "left_semi").select("component", "a", "b")
            undecided, chosen = settle(_fold(folded), undecided, chosen)
            down = down.join(undecided.withColumnRenamed("v", "a"), "a", "left_semi")
        undecided, chosen = settle(undecided.join(down.select(F.col("a").alias("v")).distinct(), "v", "left_anti"), undecided, chosen)
        done += 1
    if chosen is None:
        return sym.select(F.col("a").alias("v"), F.col("b").alias("representative"))
    members = sym.join(chosen.withColumnRenamed("v", "b"), "b").join(chosen.withColumnRenamed("v", "a"), "a", "left_anti")
    members = members.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("representative"))
    own = members.select("representative").distinct().select(F.col("representative").alias("v"), "representative")
    return members.unionByName(own)
