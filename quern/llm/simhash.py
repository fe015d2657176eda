"""SimHash near-duplicates: 64-bit fingerprints linked at two or fewer differing bits.

Distinct fingerprints are compared, so exact copies cost one row. Two
fingerprints within two bits agree on two of four 16-bit blocks at least, so
each is filed under its six block pairs. Inside a file the pivot distance
table does the search: every fingerprint carries its Hamming distances to
PIVOTS fixed reference fingerprints, pairs whose largest coordinate
difference exceeds the radius are discarded by the triangle inequality, and
survivors are verified bit by bit. Files with more than FILE_ROWS
fingerprints (one dense group of near copies) are not paired: their members
meet in midpoints, the 65 values within one bit of each. Two fingerprints
within two bits share a midpoint, and a midpoint has 65 members at most, so
neither way emits all pairs of a group, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import components, small, stage_table

RADIUS = 2
WORDS = 3
SEED = 42
PIVOTS = 16
FILE_ROWS = 64
BLOCK_PAIRS = tuple(combinations(range(4), 2))


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text; null and texts without words give zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > WORDS:
        starts, ends = starts[: len(words) - WORDS + 1], ends[WORDS - 1 :]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    else:
        hashes = np.array([xxhash.xxh64_intdigest(flat, SEED)], np.uint64)
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at : at + 65536]
        bits += np.unpackbits(block.byteswap().view(np.uint8).reshape(len(block), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``fp`` (the fingerprint as a signed long)."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn("fp", fp(F.col(text))).drop(text)


def references(count: int = PIVOTS) -> list[int]:
    """Fixed reference fingerprints, by rule."""
    return [xxhash.xxh64_intdigest(i.to_bytes(4, "little"), SEED) for i in range(count)]


def _as_long(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def pivot_table(fps: DataFrame) -> DataFrame:
    """Adds ``pivots``: Hamming distances from ``fp`` to each reference, one byte each."""
    return fps.withColumn("pivots", F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(_as_long(r)))).cast("tinyint") for r in references()]))


def _spanning(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning links of each file: pivot discard, bit check, then union-find inside the file."""
    for pdf in frames:
        a, b = [], []
        for fps, table in zip(pdf["fps"], pdf["tables"]):
            own = np.asarray(fps, np.int64)
            pivots = np.array([np.asarray(t, np.int8) for t in table])
            left, right = np.triu_indices(len(own), 1)
            near = np.abs(pivots[left] - pivots[right]).max(axis=1) <= RADIUS
            left, right = left[near], right[near]
            near = np.bitwise_count((own[left] ^ own[right]).view(np.uint64)) <= RADIUS
            root = list(range(len(own)))
            for i, j in zip(left[near].tolist(), right[near].tolist()):
                while root[i] != i:
                    i = root[i]
                while root[j] != j:
                    j = root[j]
                if i != j:
                    root[max(i, j)] = min(i, j)
                    a.append(own[max(i, j)])
                    b.append(own[min(i, j)])
        yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fp`` within RADIUS bits. ``fps`` holds distinct values."""
    blocks = [F.shiftrightunsigned(F.col("fp"), 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    files = F.array(*[F.lit(k * (1 << 32)) + blocks[i] * F.lit(1 << 16) + blocks[j] for k, (i, j) in enumerate(BLOCK_PAIRS)])
    filed = pivot_table(fps.select("fp")).select("fp", "pivots", F.explode(files).alias("file"))
    sizes = stage_table(filed.groupBy("file").agg(F.count("*").alias("n")).where("n > 1"), "files")
    shared = stage_table(filed.join(sizes, "file"), "filed")
    paired = (
        shared.where(F.col("n") <= FILE_ROWS)
        .groupBy("file")
        .agg(F.sort_array(F.collect_list(F.struct("fp", "pivots"))).alias("rows"))
        .select(F.col("rows.fp").alias("fps"), F.col("rows.pivots").alias("tables"))
        .mapInPandas(_spanning, "a long, b long")
    )
    dense = shared.where(F.col("n") > FILE_ROWS).select("fp").distinct()
    points = F.concat(F.array(F.col("fp")), F.array(*[F.col("fp").bitwiseXOR(F.lit(_as_long(1 << i))) for i in range(64)]))
    met = dense.select("fp", F.explode(points).alias("point")).groupBy("point").agg(F.collect_list("fp").alias("fps"))
    met = met.where(F.size("fps") > 1).select(F.array_min("fps").alias("b"), F.explode("fps").alias("a")).where("a != b").select("a", "b")
    return paired.unionByName(met)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its columns but the text, ``fp`` and ``component_id``.

    component_id is the least doc_id among all documents reachable over links
    of RADIUS or fewer differing bits, the row's own included. Null texts and
    texts without words have fingerprint zero and are linked like any other;
    rows with a null doc_id are grouped but never name a component unless all
    its ids are null. Repeated rows share their component; an empty table
    gives an empty result; other columns pass through.
    """
    marked = stage_table(fingerprints(docs.select(doc_id, text), text), "fingerprints")
    firsts = marked.groupBy("fp").agg(F.min(doc_id).alias("first_id"))
    firsts = stage_table(firsts, "distinct")
    parts = components(links(firsts))
    grouped = firsts.join(parts.select(F.col("v").alias("fp"), "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    grouped = stage_table(grouped, "grouped")
    least = grouped.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(least, "label").select("fp", "component_id")
    return marked.join(named, "fp")


def keep_first(docs: DataFrame) -> DataFrame:
    """Documents of which one of each near-duplicate group stays: the one with the least doc_id.

    Rows that share a doc_id count as one document, of which the row with the
    least text stays. Rows with a null doc_id can't be told apart and stay.
    The dropped ids travel, not the texts, unless they outgrow a broadcast.
    """
    marked = stage_table(near_duplicates(docs).select("doc_id", "component_id").where("doc_id is not null"), "marked")
    dropped = stage_table(marked.where("doc_id != component_id").select("doc_id").distinct(), "dropped")
    repeated = stage_table(marked.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    kept = docs.join(small(dropped), "doc_id", "left_anti")
    again = kept.join(small(repeated), "doc_id", "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    again = again.withColumn("_row", F.row_number().over(order)).where("_row = 1").drop("_row")
    return kept.join(small(repeated), "doc_id", "left_anti").unionByName(again).select(*docs.columns)
