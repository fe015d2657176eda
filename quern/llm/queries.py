"""The queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import ann, decontaminate, html, lines, packing, pii, quality, secrets, simhash, toxicity
from quern.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


def _joined(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_crf_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    kinds = [_count(base, k) for k in ("assign", "access", "hex")]
    order = F.array(*[F.lit(k) for k in ("assign", "access", "hex", "crf")])
    by_start = F.array_sort("secrets", lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"]).cast("int")).otherwise((F.array_position(order, a["kind"]) - F.array_position(order, b["kind"])).cast("int")))
    return found.select("doc_id", *kinds, _sha(_joined(base)).alias("base_sha256"), _joined(by_start).alias("spans"))


def op5_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = [_count(base, k) for k in pii.BASE]
    return found.select("doc_id", *kinds, _sha(_joined(base)).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op6_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, its lines, those dropped as repeats, and the text that stays."""
    return lines.dedup_lines(read_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op7_host_suffix_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scored = toxicity.toxicity(docs, docs, read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def queries() -> dict[str, Query]:
    return {
        "op1_crf_secret_scan": op1_crf_secret_scan,
        "op2_simhash_near_dedup": op2_simhash_near_dedup,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_additive_quality": op4_additive_quality,
        "op5_weak_supervision_pii": op5_weak_supervision_pii,
        "op6_fuzzy_line_dedup": op6_fuzzy_line_dedup,
        "op7_host_suffix_html": op7_host_suffix_html,
        "op8_anisotropic_search": op8_anisotropic_search,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_toxicity": op10_toxicity,
    }


#: DuckDB has no word-by-word set join of its own: windows are compared as joined strings.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win
), places AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n
), hits AS (
  SELECT p.doc_id, p.s, p.n, win.item_id FROM places p JOIN win ON win.n = p.n AND win.win = array_to_string(p.w[p.s:p.s + p.n - 1], ' ')
), hit_words AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS word FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, cast(len(d.w) AS BIGINT) AS n_words, cast(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       cast(coalesce(n.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN named n ON n.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_benchmark_decontamination": OP3_SQL}
