"""What is decided on near pairs, worked out over hashes: no pair of records is formed.

Two records are a near pair if their hashes are within a distance and their
contents differ. All records of a hash have the same neighbours outside it, so
links between distinct hashes and counts within each hash say all that the
pairs do; a hash that very many records share costs one row for each record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import graph, similarity
from quern.sources.shared import stage_table

CELL = ("role", "target_class", "dataset")


def near_records(records: DataFrame, distance: int, columns: tuple[str, ...] = CELL) -> tuple[DataFrame, DataFrame]:
    """Staged rows (record_id, hash, sha256, columns, weight) and links (x, y, distance), x < y, of distinct hashes.

    Repeated rows are one, whose weight is the square of their number: a join
    of pairs to both records' columns meets each row that often.
    """
    rows = records.where(F.col("hash").isNotNull()).groupBy("record_id", "hash", "sha256", *columns).agg((F.count("*") * F.count("*")).alias("weight"))
    rows = stage_table(rows, "rows")
    return rows, stage_table(similarity.near_hashes(rows, distance), "links")


def _hashes(rows: DataFrame) -> DataFrame:
    """(hash, first, content, mixed): the least record, its content, and whether there are others."""
    return rows.groupBy("hash").agg(F.min("record_id").alias("first"), F.min_by("sha256", "record_id").alias("content"), (F.min("sha256") != F.max("sha256")).alias("mixed"))


def _reached(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(hash, component) of the hashes of all records in pairs; the component is the least record reached."""
    parts = graph.components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))).withColumnsRenamed({"v": "hash", "component": "part"})
    placed = _hashes(rows).join(parts, "hash", "left").where("mixed or part is not null")
    placed = stage_table(placed.select("hash", "first", F.coalesce("part", "hash").alias("part")), "placed")
    return placed.join(placed.groupBy("part").agg(F.min("first").alias("component")), "part").select("hash", "component")


def components(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(v, component) of every record in a pair: the least record that it reaches over pairs."""
    return rows.join(_reached(rows, links), "hash").select(F.col("record_id").alias("v"), "component").distinct()


def _category(a: str, b: str) -> Column:
    """``pair_category`` of two structs with the columns of a cell."""
    whole = F.struct(*[F.col(f"{side}.{c}").alias(f"{p}_{c}") for p, side in (("a", a), ("b", b)) for c in CELL])
    return F.get(F.transform(F.array(whole), lambda w: similarity.pair_category(of=lambda name: w[name])), 0)


def pair_cells(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(component, category, distance, n, first, second): how many pairs there are, and the least of them."""
    kind = F.struct(*CELL).alias("kind")
    contents = stage_table(rows.groupBy("hash", kind, "sha256").agg(F.sum("weight").alias("n"), F.min("record_id").alias("m")), "contents")
    two = Window.partitionBy("hash", "kind").orderBy("m")
    least = contents.withColumn("nth", F.row_number().over(two)).where("nth <= 2").groupBy("hash", "kind")
    # the least record of a cell, its content, and the least of another content
    least = least.agg(F.min("m").alias("m"), F.min_by("sha256", "m").alias("s"), F.max(F.when(F.col("nth") == 2, F.col("m"))).alias("other"))
    cells = stage_table(contents.groupBy("hash", "kind").agg(F.sum("n").alias("n")).join(least, ["hash", "kind"]), "cells")

    def side(df: DataFrame, name: str, **keys: str) -> DataFrame:
        return df.select(*[F.col(c).alias(k) for k, c in keys.items()], F.struct("kind", "n", *[c for c in ("m", "s", "other") if c in df.columns]).alias(name))

    sorted_pair = lambda p, q: F.when(p.isNotNull() & q.isNotNull(), F.struct(F.least(p, q).alias("first"), F.greatest(p, q).alias("second")))
    many = F.col("a.n") * F.col("b.n")
    across = links.join(side(cells, "a", x="hash"), "x").join(side(cells, "b", y="hash"), "y")
    across = across.select(F.col("x").alias("hash"), _category("a.kind", "b.kind").alias("category"), "distance", many.alias("n"), sorted_pair(F.col("a.m"), F.col("b.m")).alias("least"))

    # inside a hash: all pairs of two cells, less those of one content
    mixed = _hashes(rows).where("mixed").select("hash")
    ordered = F.col("a.kind") <= F.col("b.kind")
    same = F.col("a.kind") == F.col("b.kind")
    twice = F.when(same, many).otherwise(2 * many)
    found = F.when(same, sorted_pair(F.col("a.m"), F.col("a.other"))).when(F.col("a.s") != F.col("b.s"), sorted_pair(F.col("a.m"), F.col("b.m")))
    found = found.otherwise(F.least(sorted_pair(F.col("a.m"), F.col("b.other")), sorted_pair(F.col("a.other"), F.col("b.m"))))
    own = cells.join(mixed, "hash", "left_semi")
    inside = side(own, "a", hash="hash").join(side(own, "b", hash="hash"), "hash").where(ordered)
    inside = inside.select("hash", _category("a.kind", "b.kind").alias("category"), twice.alias("n"), found.alias("least"))
    own = contents.drop("m").join(mixed, "hash", "left_semi")
    alike = side(own, "a", hash="hash", sha256="sha256").join(side(own, "b", hash="hash", sha256="sha256"), ["hash", "sha256"]).where(ordered)
    alike = alike.select("hash", _category("a.kind", "b.kind").alias("category"), (-twice).alias("n"), F.lit(None).cast(inside.schema["least"].dataType).alias("least"))
    inside = inside.unionByName(alike).groupBy("hash", "category").agg(F.expr("sum(n) div 2").alias("n"), F.min("least").alias("least")).where("n > 0")

    cells = across.unionByName(inside.withColumn("distance", F.lit(0))).join(_reached(rows, links), "hash")
    out = cells.groupBy("component", "category", "distance").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    return out.select("component", "category", "distance", "n", "least.first", "least.second")


def component_summary(cells: DataFrame) -> DataFrame:
    """``similarity.group_pair_summary`` of the pairs that ``cells`` count."""
    count = lambda c: F.sum(F.when(F.col("category") == c, F.col("n")).otherwise(0))
    out = cells.groupBy("component").agg(
        F.sum("n").alias("n_pairs"),
        count("TRAIN_TO_LOCKED_BENCHMARK").alias("n_benchmark"),
        count("DIFFERENT_TARGET").alias("n_conflict"),
        F.min("distance").alias("min_distance"),
    )
    return out.withColumn("risk", similarity.component_risk())


def anchored(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(hash, first, content, mixed, anchor, in_group): the hashes, each with the record that represents its records.

    In ascending order the least record of a hash comes before all others of
    it. If it represents, so do the records of its content, whose neighbours
    are the same, and those of other contents join it; if not, a neighbour of
    another hash represents that is smaller than all of them. So the rule over
    records is the rule over the least records of hashes.
    """
    hashes = stage_table(_hashes(rows), "hashes")
    edges = links.join(hashes.select(F.col("hash").alias("x"), F.col("first").alias("a")), "x").join(hashes.select(F.col("hash").alias("y"), F.col("first").alias("b")), "y")
    groups = graph.anchor_groups(edges.select("a", "b")).withColumnsRenamed({"v": "first", "representative": "anchor"})
    out = hashes.join(groups, "first", "left").select("hash", "first", "content", "mixed", F.coalesce("anchor", "first").alias("anchor"), (F.col("anchor").isNotNull() | F.col("mixed")).alias("in_group"))
    return stage_table(out, "anchored")


def _joins() -> Column:
    """Whether a row, beside its hash's columns, joins another record's group."""
    return (F.col("anchor") != F.col("first")) | (F.col("sha256") != F.col("content"))


def members(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """(v, representative) of every record in an anchor group of two or more."""
    placed = rows.join(hashes, "hash").where(_joins() | F.col("in_group") & (F.col("record_id") == F.col("first")))
    return placed.select(F.col("record_id").alias("v"), F.col("anchor").alias("representative")).distinct()


def edge_summary(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """Per representative: its members' pairs with it, and the least and largest distance."""
    heads = rows.join(hashes.where("first = anchor").select("hash", F.col("first").alias("record_id")), ["hash", "record_id"])
    heads = heads.select(F.col("record_id").alias("representative"), F.col("hash").alias("at"), F.col("weight").alias("times"))
    own = rows.join(hashes, "hash").where(_joins()).select("hash", "weight", F.col("anchor").alias("representative")).join(heads, "representative")
    apart = F.bit_count(F.col("hash").bitwiseXOR(F.col("at")))
    return own.groupBy("representative").agg(F.sum(F.col("weight") * F.col("times")).alias("edges"), F.min(apart).alias("nearest"), F.max(apart).alias("farthest"))


def contracted(rows: DataFrame, links: DataFrame, hashes: DataFrame) -> DataFrame:
    """``policy.contract`` of all pairs: (entity_a, entity_b, n_pairs, min_distance).

    Records of a representative's content are entities of their own; every
    other hash is part of one entity. Links run from a hash that represents,
    and are summed by the other end's entity first, so that the rows are those
    of the result.
    """
    placed = rows.join(hashes, "hash").select("hash", "first", "anchor", "weight", _joins().alias("joins"), "record_id")
    entity = F.when(F.col("joins"), F.col("anchor")).otherwise(F.col("record_id"))
    cells = stage_table(placed.groupBy("hash", "first", "anchor", entity.alias("entity"), "joins").agg(F.sum("weight").alias("n")), "entities")
    heads = hashes.where("first = anchor").select(F.col("hash").alias("y"), F.lit(True).alias("head"))
    away = links.join(heads, "y", "left").select(F.when(F.col("head"), F.col("y")).otherwise(F.col("x")).alias("hash"), F.when(F.col("head"), F.col("x")).otherwise(F.col("y")).alias("to"), "distance")
    far = cells.groupBy("hash", "entity").agg(F.sum("n").alias("m")).select(F.col("hash").alias("to"), F.col("entity").alias("other"), "m")
    far = away.join(far, "to").groupBy("hash", "other").agg(F.sum("m").alias("m"), F.min("distance").alias("distance"))
    across = cells.groupBy("hash", "entity").agg(F.sum("n").alias("n")).join(far, "hash").where("entity != other").select("entity", "other", (F.col("n") * F.col("m")).alias("n"), "distance")
    rest = cells.where("joins and anchor = first").groupBy("hash").agg(F.sum("n").alias("m"))
    inside = cells.where("not joins and entity != first").join(rest, "hash").select("entity", F.col("first").alias("other"), (F.col("n") * F.col("m")).alias("n"), F.lit(0).alias("distance"))
    ends = across.unionByName(inside)
    return ends.groupBy(F.least("entity", "other").alias("entity_a"), F.greatest("entity", "other").alias("entity_b")).agg(F.sum("n").alias("n_pairs"), F.min("distance").alias("min_distance"))


def in_conflict(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(record_id) of the records that come first in a pair of training candidates of different targets."""
    own = rows.where((F.col("role") == "training_candidate") & (F.col("target_class") != ""))
    contents = own.groupBy("hash", "target_class", "sha256").agg(F.max("record_id").alias("m"))
    two = Window.partitionBy("hash", "target_class").orderBy(F.desc("m"))
    top = contents.withColumn("nth", F.row_number().over(two)).where("nth <= 2").groupBy("hash", F.col("target_class").alias("t"))
    # the largest record of a target, its content, and the largest of another content
    top = stage_table(top.agg(F.max("m").alias("m"), F.max_by("sha256", "m").alias("s"), F.min(F.when(F.col("nth") == 2, F.col("m"))).alias("other")), "tops")
    both = links.select(F.col("x").alias("hash"), F.col("y").alias("to")).unionAll(links.select(F.col("y").alias("hash"), F.col("x").alias("to")))
    near = both.join(top.select(F.col("hash").alias("to"), "t", "m"), "to").groupBy("hash", "t").agg(F.max("m").alias("m"))
    none = F.lit(None).cast("string")
    near = near.select("hash", "t", "m", none.alias("s"), none.alias("other")).unionByName(top)
    met = near.groupBy("hash").agg(F.collect_list(F.struct("t", "m", "s", "other")).alias("met"))
    later = lambda e: (e["t"] != F.col("target_class")) & (F.when(e["s"].eqNullSafe(F.col("sha256")), e["other"]).otherwise(e["m"]) > F.col("record_id"))
    return own.join(met, "hash").where(F.exists("met", lambda e: F.coalesce(later(e), F.lit(False)))).select("record_id").distinct()
