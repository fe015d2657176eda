"""Hamming-distance similarity joins over 64-bit hashes, and what is decided on their pairs."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.keys import hamming
from quern.operators.graph import both_ways, components
from quern.sources.shared import stage_table

# Fixed values of the refinement policy.
SAME_TARGET_MAX = 4
HIGH_RISK_MAX = 16
ASPECT_MAX = 0.03
VERIFIED = (40, 0.15, 0.60)
POSSIBLE = (15, 0.05, 0.50)
HIGH_RISK = ("DIFFERENT_TARGET", "TRAIN_TO_LOCKED_BENCHMARK")


def agreement_masks(distance: int, spare: int = 2, bits: int = 64) -> list[int]:
    """Signed 64-bit masks of which two hashes within the distance agree on one at least.

    The bits are cut into distance + spare blocks (wider ones first, from the
    low bit up), of which ``spare`` stay whole; each mask is one choice of
    ``spare`` blocks. More spare blocks mean more keys a hash, of more bits
    each: the spare is what to raise as a corpus grows.
    """
    blocks, out, ends = distance + spare, [], [0]
    for i in range(blocks):
        ends.append(ends[-1] + bits // blocks + (i < bits % blocks))
    for chosen in combinations(range(blocks), spare):
        mask = sum((1 << ends[i + 1]) - (1 << ends[i]) for i in chosen)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def banded(hashes: DataFrame, distance: int, spare: int = 2) -> DataFrame:
    """``hashes`` with one row for each mask: its number and the bits under it."""
    keys = [F.struct(F.lit(i).alias("band"), F.col("hash").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(agreement_masks(distance, spare))]
    return hashes.select("*", F.inline(F.array(*keys)))


def near_hashes(hashes: DataFrame, distance: int, spare: int = 2) -> DataFrame:
    """Pairs (x, y, distance), x < y, of distinct hashes within ``distance`` bits: all of them, each once.

    A pair is taken under its first common mask alone, so no distinct pass
    over the pairs is needed. Equal hashes are one row from the start.
    """
    each = banded(hashes.select("hash").distinct(), distance, spare)
    pairs = each.withColumnRenamed("hash", "x").join(each.withColumnRenamed("hash", "y"), ["band", "value"]).where("x < y")
    differ = F.col("x").bitwiseXOR(F.col("y"))
    pairs = pairs.withColumn("distance", F.bit_count(differ)).where(F.col("distance") <= distance)
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, i) for i, m in enumerate(agreement_masks(distance, spare))])
    return pairs.where(F.col("band") == first).select("x", "y", "distance")


def hamming_self_join(records: DataFrame, distance: int, key: str = "record_id") -> DataFrame:
    """Pairs (first, second, distance) of records within ``distance`` bits and of different content.

    ``records`` has (key, hash, sha256). first < second. Pairs under one hash
    differ in content too and have distance zero. All pairs of records are
    what this is for; where very many share a hash, use ``near_classes``.
    """
    rows = records.where(F.col("hash").isNotNull()).select(key, "hash", "sha256")
    near = near_hashes(rows, distance)
    links = near.unionByName(rows.select(F.col("hash").alias("x"), F.col("hash").alias("y"), F.lit(0).alias("distance")).distinct())
    a = rows.select(F.col(key).alias("r1"), F.col("hash").alias("x"), F.col("sha256").alias("s1"))
    b = rows.select(F.col(key).alias("r2"), F.col("hash").alias("y"), F.col("sha256").alias("s2"))
    joined = links.join(a, "x").join(b, "y").where("s1 != s2").where((F.col("x") != F.col("y")) | (F.col("r1") < F.col("r2")))
    return joined.select(F.least("r1", "r2").alias("first"), F.greatest("r1", "r2").alias("second"), "distance")


def near_classes(records: DataFrame, distance: int, key: str = "record_id") -> DataFrame:
    """(key, class_id, n_links): a row for each record, so that a hash that very many records share makes no pairs.

    class_id is the least key among all records whose hashes are reachable
    over steps of ``distance`` bits at most; n_links counts the other distinct
    hashes within one step. Records without a hash are left out.
    """
    rows = records.where(F.col("hash").isNotNull()).select(key, "hash")
    firsts = stage_table(rows.groupBy("hash").agg(F.min(key).alias("first")), "hashes")
    near = stage_table(near_hashes(firsts, distance).select(F.col("x").alias("a"), F.col("y").alias("b")), "near")
    links = both_ways(near).groupBy(F.col("a").alias("hash")).agg(F.count("*").alias("n_links"))
    placed = firsts.join(components(near).withColumnRenamed("v", "hash"), "hash", "left").withColumn("component", F.coalesce("component", "hash"))
    placed = stage_table(placed, "placed")
    named = placed.join(placed.groupBy("component").agg(F.min("first").alias("class_id")), "component").join(links, "hash", "left")
    return rows.join(named.select("hash", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), "hash").select(key, "class_id", "n_links")


def hamming_join(left: DataFrame, right: DataFrame, distance: int, key: str = "record_id") -> DataFrame:
    """Pairs (left_id, right_id, distance) of two sets within ``distance`` bits."""
    l = banded(left.select("hash").distinct().where("hash is not null"), distance).withColumnRenamed("hash", "x")
    r = banded(right.select("hash").distinct().where("hash is not null"), distance).withColumnRenamed("hash", "y")
    near = l.join(r, ["band", "value"]).select("x", "y").distinct().withColumn("distance", hamming(F.col("x"), F.col("y"))).where(F.col("distance") <= distance)
    named = near.join(left.select(F.col(key).alias("left_id"), F.col("hash").alias("x")), "x")
    return named.join(right.select(F.col(key).alias("right_id"), F.col("hash").alias("y")), "y").select("left_id", "right_id", "distance")


def with_ends(pairs: DataFrame, records: DataFrame, columns: tuple[str, ...], key: str = "record_id") -> DataFrame:
    """``pairs`` (first, second, ...) with columns of both records, prefixed a_ and b_."""
    a = records.select(F.col(key).alias("first"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = records.select(F.col(key).alias("second"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return pairs.join(a, "first").join(b, "second")


def pair_category(by_source: bool = True, of: Callable[[str], Column] = F.col) -> Column:
    """Risk of a pair from a_ and b_ columns role, target_class and dataset."""
    a, b = (lambda c: of(f"a_{c}")), (lambda c: of(f"b_{c}"))
    mixed = ((a("role") == "training_candidate") & (b("role") == "locked_test")) | ((a("role") == "locked_test") & (b("role") == "training_candidate"))
    training = (a("role") == "training_candidate") & (b("role") == "training_candidate")
    named = (a("target_class") != "") & (b("target_class") != "")
    same = named & (a("target_class") == b("target_class"))
    out = F.when(mixed, "TRAIN_TO_LOCKED_BENCHMARK").when(training & named & (a("target_class") != b("target_class")), "DIFFERENT_TARGET")
    if by_source:
        out = out.when(same & (a("dataset") == b("dataset")), "SAME_TARGET_SAME_SOURCE").when(same, "SAME_TARGET_CROSS_SOURCE")
    else:
        out = out.when(same, "SAME_TARGET")
    return out.otherwise("OTHER")


def needs_refinement(category: Column, distance: Column, aspect: Column) -> Column:
    """Benchmark pairs always; others by a bound for their risk, and like aspect."""
    bound = F.when(category == "DIFFERENT_TARGET", HIGH_RISK_MAX).otherwise(SAME_TARGET_MAX)
    return (category == "TRAIN_TO_LOCKED_BENCHMARK") | ((category != "OTHER") & (distance <= bound) & (aspect <= ASPECT_MAX))


def signal_band(risk: Column, good: Column, ratio: Column, inlier: Column, any_risk: bool = False) -> Column:
    """verified, possible (of high risk alone, unless ``any_risk``) or neither."""
    reaches = lambda t: (good >= t[0]) & (ratio >= t[1]) & (inlier >= t[2])
    possible = reaches(POSSIBLE) if any_risk else reaches(POSSIBLE) & risk.isin(*HIGH_RISK)
    return F.when(reaches(VERIFIED), "verified").when(possible, "possible").otherwise("neither")


def group_pair_summary(pairs: DataFrame) -> DataFrame:
    """Per component: pairs by category, least distance, and risk by precedence.

    ``pairs`` has (component, category, distance).
    """
    count = lambda c: F.count_if(F.col("category") == c)
    out = pairs.groupBy("component").agg(
        F.count("*").alias("n_pairs"),
        count("TRAIN_TO_LOCKED_BENCHMARK").alias("n_benchmark"),
        count("DIFFERENT_TARGET").alias("n_conflict"),
        F.min("distance").alias("min_distance"),
    )
    return out.withColumn("risk", component_risk())


def component_risk() -> Column:
    """Risk of a component by precedence, from n_benchmark and n_conflict."""
    return F.when(F.col("n_benchmark") > 0, "BENCHMARK_LEAKAGE").when(F.col("n_conflict") > 0, "LABEL_CONFLICT").otherwise("NEAR_DUPLICATE")


def direct_flags(pairs: DataFrame) -> DataFrame:
    """Per record: least distance of its own pairs, and whether one is to the benchmark or in conflict.

    ``pairs`` has (first, second, distance, category, a_role, b_role).
    """
    ends = F.array(
        F.struct(F.col("first").alias("record_id"), F.col("a_role").alias("role")),
        F.struct(F.col("second").alias("record_id"), F.col("b_role").alias("role")),
    )
    rows = pairs.select("distance", "category", F.inline(ends))
    return rows.groupBy("record_id").agg(
        F.min("distance").alias("min_distance"),
        F.bool_or((F.col("category") == "TRAIN_TO_LOCKED_BENCHMARK") & (F.col("role") == "training_candidate")).alias("near_benchmark"),
        F.bool_or(F.col("category") == "DIFFERENT_TARGET").alias("near_conflict"),
    )
