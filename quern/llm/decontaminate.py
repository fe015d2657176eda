"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations alone.

Every benchmark item is cut into windows of WINDOW consecutive words (one
window for shorter items) and every window into shingles of up to SHINGLE
words. One pass over the documents finds all occurrences of benchmark
shingles and so their counts over the whole corpus. A window must be
contained whole, so its prefix is one token: its rarest shingle. Occurrences
of prefix shingles give candidates; length and position bounds discard those
that would leave the document; the rest are verified word for word, through
the shingles that tile the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import ascii_lower, stage_table

WINDOW = 10
SHINGLE = 3
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark shingles up to which their table is broadcast; beyond it, the corpus shingles are shuffled to it.
BROADCAST_SHINGLES = 500_000


def words(text: Column) -> Column:
    """Lower-cased (A-Z alone) runs of digits, letters and characters beyond ASCII; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows (window_id, len, item_id, words)."""
    cut = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    cut = cut.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s") + 1, window).alias("words"))
    cut = cut.distinct()
    return cut.select("item_id", "words", F.size("words").alias("len"), F.array_join("words", " ").alias("window_id"))


def occurrences(docs: DataFrame, windows: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Verified occurrences (key, start, len, item_id), and every row of ``docs`` as (key, n_words).

    ``docs`` has (key, text); equal keys must stand for equal texts.
    """
    size = F.least(F.col("len"), F.lit(shingle))
    places = F.transform(F.sequence(F.lit(0), F.col("len") - size), lambda i: F.struct(i.alias("off"), F.array_join(F.slice("words", i + 1, size), " ").alias("shingle")))
    pieces = stage_table(windows.select("window_id", "len", size.alias("size"), F.inline(places)).distinct(), "pieces")
    sizes = sorted(r[0] for r in pieces.select("size").distinct().limit(shingle).collect())
    wanted = pieces.select(F.col("shingle").alias("wanted")).distinct()
    wanted = stage_table(wanted, "wanted")
    if wanted.count() <= BROADCAST_SHINGLES:
        wanted = F.broadcast(wanted)

    cut = docs.select("key", words(F.col("text")).alias("w"))
    # one entry past the last word stands for the document itself; its shingle is no word sequence and differs from row to row
    cut = cut.select("key", "w", F.size("w").alias("n_words"), F.posexplode(F.concat("w", F.array(F.lit("\x01")))).alias("place", "head"))
    own = F.col("place") == F.col("n_words")
    cut = cut.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))) if len(sizes) > 1 else cut.withColumn("size", F.lit(sizes[0] if sizes else 1))
    rest = [F.when(F.col("size") > k, F.get("w", F.col("place") + k)) for k in range(1, max(sizes, default=1))]
    shingle_here = F.when(own, F.concat("head", F.to_json("key"))).when(F.col("place") + F.col("size") <= F.col("n_words"), F.concat_ws(" ", "head", *rest))
    cut = cut.select("key", "n_words", F.when(~own, F.col("place")).otherwise(-1).alias("place"), shingle_here.alias("shingle"), "size")
    cut = cut.where((F.col("shingle").isNotNull()) & ((F.col("place") >= 0) | (F.col("size") == max(sizes, default=1)))).drop("size")
    found = cut.join(wanted, F.col("shingle") == F.col("wanted"), "left").where("wanted is not null or place = -1")
    found = stage_table(found.select("key", "n_words", "place", "wanted"), "found")
    lengths = found.where("place = -1").select("key", "n_words")
    found = found.where("place >= 0").select("key", "n_words", "place", F.col("wanted").alias("shingle"))

    counts = found.groupBy("shingle").agg(F.count("*").alias("n"))
    rare = pieces.join(counts, "shingle", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rank = Window.partitionBy("window_id").orderBy("n", "off")
    prefix = rare.withColumn("rank", F.row_number().over(rank)).where("rank = 1 and n > 0").select("window_id", "len", "size", "off", "shingle")

    start = F.col("place") - F.col("off")
    candidates = found.join(prefix, "shingle").select("key", "n_words", start.alias("start"), "window_id", "len", "size").distinct()
    candidates = candidates.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.col("n_words")))

    tiles = pieces.where((F.col("off") % F.col("size") == 0) | (F.col("off") == F.col("len") - F.col("size"))).select("window_id", "off", "shingle")
    need = tiles.groupBy("window_id").agg(F.count("*").alias("need"))
    expected = candidates.join(tiles, "window_id").select("key", "start", "window_id", "len", (F.col("start") + F.col("off")).alias("place"), "shingle")
    there = found.select("key", "place", "shingle").distinct()
    verified = expected.join(there, ["key", "place", "shingle"]).groupBy("key", "start", "window_id", "len").agg(F.count("*").alias("have"))
    verified = verified.join(need, "window_id").where("have = need").select("key", "start", "len", "window_id")
    return verified.join(windows.select("window_id", "item_id"), "window_id").select("key", "start", "len", "item_id"), lengths


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the document's words inside any occurrence of a window,
    n_items the items with an occurring window. Null and empty texts have no
    words; null and empty items match nothing; repeated rows give repeated
    results, and two texts under one doc_id are judged apart; an empty
    benchmark leaves every document clean. Other columns are ignored.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("t1"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("t2"))
    hits, lengths = occurrences(docs.select(key.alias("key"), "text"), benchmark_windows(items, window=window), window)
    hits = stage_table(hits, "hits")
    before = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("key", "start", (F.col("start") + F.col("len")).alias("end")).distinct()
    spans = spans.withColumn("seen", F.coalesce(F.max("end").over(before), F.lit(0)))
    hit = spans.groupBy("key").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "seen"))).cast("long").alias("n_hit"))
    named = hits.select("key", F.col("item_id").cast("string").alias("item")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = lengths.join(hit, "key", "left").join(named, "key", "left")
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("key.doc_id").alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(items_found).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_found, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
