"""Registered queries of the curation library, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import keys, text
from quern.operators import activity, composition, dedup, graph, metrics, near_groups, policy, replay, similarity, split, weights
from quern.plans import checks
from quern.plans import tables as T
from quern.sources.shared import stage_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


# Exact duplicates and canonical rows


@query("exact_duplicates", _with(T.RECORDS, T.GROUPS) + "SELECT sha256, 'exact_' || substr(sha256, 1, 20) AS group_id, member_count, cross_role, touches_locked_test, label_conflict, target_conflict, first_record_id FROM g")
def exact_duplicates(spark, sf):
    return dedup.exact_groups(T.records(spark, sf))


@query("label_conflicts", _with(T.RECORDS, T.GROUPS) + "SELECT 'exact_' || substr(sha256, 1, 20) AS group_id, record_id, dataset, role, source_label, target_class, source_path FROM records JOIN g USING (sha256) WHERE label_conflict")
def label_conflicts(spark, sf):
    return dedup.conflict_report(T.records(spark, sf))


@query("canonical_rows", _with(T.RECORDS) + "SELECT sha256, record_id, source_path FROM records QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY dataset, source_version, source_path, record_id) = 1")
def canonical_rows(spark, sf):
    return dedup.first_by(T.records(spark, sf), "sha256", *dedup.CANONICAL_ORDER).select("sha256", "record_id", "source_path")


@query("first_occurrences", _with(T.RECORDS) + "SELECT sha256, min(source_path) AS source_path FROM records GROUP BY sha256")
def first_occurrences(spark, sf):
    return dedup.first_by(T.records(spark, sf), "sha256", "source_path").select("sha256", "source_path")


POLICY = T.RECORDS + ", " + T.GROUPS + """, j AS (
  SELECT r.*, g.touches_locked_test AS locked, g.label_conflict AS conflict, g.sha256 IS NOT NULL AS grouped, role = 'training_candidate' AS tr FROM records r LEFT JOIN g USING (sha256)
), p AS (SELECT *, grouped AND NOT locked AND NOT conflict AND tr AND mapping_status = 'MATCHED' AS plain FROM j
), c AS (SELECT *, CASE WHEN plain THEN first_value(record_id) OVER (PARTITION BY sha256, plain ORDER BY dataset, source_version, source_path, record_id) END AS canonical_record_id FROM p
), decided AS (SELECT *, CASE WHEN locked AND tr THEN 'EXACT_BENCHMARK_LEAKAGE' WHEN conflict AND NOT locked AND tr THEN 'EXACT_LABEL_CONFLICT'
    WHEN plain AND canonical_record_id <> record_id THEN 'EXACT_DUPLICATE_COPY' WHEN NOT tr THEN 'LOCKED_BENCHMARK' WHEN mapping_status = 'AMBIGUOUS' THEN 'AMBIGUOUS_MAPPING'
    WHEN mapping_status = 'NOT_SUPPORTED' THEN 'UNSUPPORTED_CLASS' ELSE '' END AS exclusion_reason FROM c
), cleaned AS (SELECT *, CASE WHEN exclusion_reason = '' THEN 'INCLUDE' ELSE 'EXCLUDE' END AS cleaning_status FROM decided)"""


def _cleaned(spark, sf, with_hash=False):
    return dedup.apply_exact_policy(policy.initial_cleaning(T.records(spark, sf, with_hash)))


@query("exact_policy", _with(POLICY) + "SELECT record_id, cleaning_status, exclusion_reason, canonical_record_id FROM cleaned")
def exact_policy(spark, sf):
    return _cleaned(spark, sf).select("record_id", "cleaning_status", "exclusion_reason", "canonical_record_id")


@query("clean_manifest", _with(POLICY) + "SELECT record_id, sha256, target_class FROM cleaned WHERE cleaning_status = 'INCLUDE'")
def clean_manifest(spark, sf):
    return _cleaned(spark, sf).where("cleaning_status = 'INCLUDE'").select("record_id", "sha256", "target_class")


@query("decision_summary", _with(POLICY) + "SELECT cleaning_status, exclusion_reason, count(*) AS n, count(DISTINCT sha256) AS contents FROM cleaned GROUP BY ALL")
def decision_summary(spark, sf):
    return _cleaned(spark, sf).groupBy("cleaning_status", "exclusion_reason").agg(F.count("*").alias("n"), F.countDistinct("sha256").alias("contents"))


@query("cross_exact_overlap", _with(T.RECORDS) + "SELECT a.sha256, a.record_id AS left_id, b.record_id AS right_id FROM records a JOIN records b ON a.sha256 = b.sha256 WHERE a.source_domain = 'REAL_WORLD' AND b.source_domain <> 'REAL_WORLD'")
def cross_exact_overlap(spark, sf):
    r = T.records(spark, sf)
    return dedup.cross_overlap(r.where("source_domain = 'REAL_WORLD'"), r.where("source_domain != 'REAL_WORLD'"))


@query("overlap_keys", _with(T.RECORDS) + "SELECT sha256 FROM records WHERE source_domain = 'REAL_WORLD' INTERSECT SELECT sha256 FROM records WHERE source_domain <> 'REAL_WORLD'")
def overlap_keys(spark, sf):
    r = T.records(spark, sf)
    return dedup.overlap(r.where("source_domain = 'REAL_WORLD'"), r.where("source_domain != 'REAL_WORLD'"))


@query("set_difference", _with(T.RECORDS) + "SELECT sha256 FROM records WHERE source_domain = 'REAL_WORLD' EXCEPT SELECT sha256 FROM records WHERE source_domain <> 'REAL_WORLD'")
def set_difference(spark, sf):
    r = T.records(spark, sf)
    return r.where("source_domain = 'REAL_WORLD'").select("sha256").subtract(r.where("source_domain != 'REAL_WORLD'").select("sha256"))


@query("concatenated_sources", _with(T.RECORDS) + "SELECT side, count(*) AS n FROM (SELECT 'a' AS side FROM records WHERE source_domain = 'REAL_WORLD' UNION ALL SELECT 'b' FROM records WHERE source_domain <> 'REAL_WORLD') GROUP BY side")
def concatenated_sources(spark, sf):
    r = T.records(spark, sf)
    a, b = r.where("source_domain = 'REAL_WORLD'").select(F.lit("a").alias("side")), r.where("source_domain != 'REAL_WORLD'").select(F.lit("b").alias("side"))
    return a.unionByName(b).groupBy("side").agg(F.count("*").alias("n"))


@query("labelled_rows", "SELECT (SELECT count(*) FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS with_label, (SELECT count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)) AS without_label")
def labelled_rows(spark, sf):
    docs, labels = T.table(spark, sf, "documents").select("doc_id"), T.table(spark, sf, "labels").select("doc_id")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(docs.join(labels, "doc_id", "left_semi"), "with_label").crossJoin(n(docs.join(labels, "doc_id", "left_anti"), "without_label"))


# Keys and scalar functions


@query("stable_ids", _with(T.RECORDS) + """SELECT record_id, 'comp_' || substr(sha256(source_domain || chr(0) || dataset || chr(0) || record_id || chr(0) || '0' || chr(0) || sha256), 1, 24) AS comp_id,
  'split_group_' || substr(sha256(source_domain || chr(0) || 'exact' || chr(0) || sha256), 1, 24) AS by_content, 'split_single_' || substr(sha256(source_domain || chr(0) || 'singleton' || chr(0) || record_id), 1, 24) AS alone FROM records""")
def stable_ids(spark, sf):
    r = T.records(spark, sf)
    none = F.lit("")
    return r.select("record_id", keys.composition_id("source_domain", "dataset", "record_id", F.lit("0"), "sha256").alias("comp_id"), keys.split_group_id("source_domain", "record_id", "sha256", none).alias("by_content"), keys.split_group_id("source_domain", "record_id", none, none).alias("alone"))


@query("near_group_ids", _with(T.RECORDS, T.GROUPS) + "SELECT sha256, 'near_' || substr(sha256(string_agg(record_id, chr(10) ORDER BY record_id)), 1, 20) AS group_id FROM records WHERE sha256 IN (SELECT sha256 FROM g) GROUP BY sha256")
def near_group_ids(spark, sf):
    grouped = T.records(spark, sf).groupBy("sha256").agg(F.collect_list("record_id").alias("ids")).where(F.size("ids") > 1)
    return grouped.select("sha256", keys.group_id("near_", F.col("ids")).alias("group_id"))


@query("path_predicates", r"""SELECT page_id, lower(regexp_extract(url, '\.([^./\\]+)$', 1)) AS ext, regexp_matches(url, '^[/\\]|^[A-Za-z]:') AS rooted, contains(lower(url), 'page=') OR contains(lower(url), 'utm_') AS marked FROM pages""")
def path_predicates(spark, sf):
    url = F.col("url")
    return T.table(spark, sf, "pages").select("page_id", text.extension(url).alias("ext"), text.unsafe_path(url).alias("rooted"), text.has_marker(url, ("page=", "utm_")).alias("marked"))


@query("benchmark_paths", _with(T.RECORDS) + "SELECT record_id, lower(dataset) = 'src19' AND lower(string_split(source_path, '/')[1]) IN ('test', 'testing', 'test_split') AS plain, lower(dataset) = 'src19' AS moved FROM records")
def benchmark_paths(spark, sf):
    path = F.concat(F.lit("\\Test/"), F.col("source_path"))
    return T.records(spark, sf).select("record_id", text.is_benchmark_path(F.col("dataset"), F.col("source_path"), "SRC19").alias("plain"), text.is_benchmark_path(F.col("dataset"), path, "src19").alias("moved"))


@query("portable_names", r"""SELECT page_id, CASE WHEN s = '' THEN 'unnamed' WHEN upper(s) IN ('CON', 'NUL') THEN '_' || s ELSE s END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '^[ .]+|[ .]+$', '', 'g') AS s FROM pages)""")
def portable_names(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", text.portable_name(F.col("url")).alias("name"))


@query("label_parts", "SELECT p_partkey, string_split(p_name, ' ')[1] AS head, CASE WHEN strpos(p_name, ' ') > 0 THEN substr(p_name, strpos(p_name, ' ') + 1) ELSE p_name END AS tail FROM part")
def label_parts(spark, sf):
    return T.table(spark, sf, "part").select("p_partkey", text.first_word(F.col("p_name")).alias("head"), text.after_first_word(F.col("p_name")).alias("tail"))


@query("email_keys", "SELECT lower(trim('  ' || c_name || '@Example.COM ')) AS email, count(*) AS n FROM customer GROUP BY 1")
def email_keys(spark, sf):
    email = F.concat(F.lit("  "), F.col("c_name"), F.lit("@Example.COM "))
    return T.table(spark, sf, "customer").groupBy(text.email_key(email).alias("email")).agg(F.count("*").alias("n"))


@query("long_dates", "SELECT o_orderkey, strftime(o_orderdate, '%d %B %Y, %H:%M') AS shown FROM orders")
def long_dates(spark, sf):
    return T.table(spark, sf, "orders").select("o_orderkey", text.long_date(F.col("o_orderdate")).alias("shown"))


@query("scan_status", _with(T.PREDICTIONS) + "SELECT id, status FROM predictions")
def scan_status(spark, sf):
    return T.predictions(spark, sf).select("id", "status")


BACKFILL = """SELECT id, CASE WHEN disease = 'Leaf click' THEN 'no_leaf' WHEN confidence < 60 THEN 'uncertain' WHEN lower(disease) LIKE '%healthy%' THEN 'healthy' ELSE 'diseased' END AS status FROM predictions"""


@query("status_backfill", _with(T.PREDICTIONS) + BACKFILL)
def status_backfill(spark, sf):
    return spark.sql(BACKFILL.replace("predictions", "{predictions}"), predictions=T.predictions(spark, sf))


@query("translated_labels", _with(T.PREDICTIONS) + "SELECT id, CASE disease WHEN 'Leaf healthy' THEN 'Hoja sana' WHEN 'Leaf error' THEN 'Hoja mala' ELSE disease END AS shown FROM predictions")
def translated_labels(spark, sf):
    words = spark.createDataFrame([("Leaf healthy", "Hoja sana"), ("Leaf error", "Hoja mala")], "disease string, other string")
    return T.predictions(spark, sf).join(F.broadcast(words), "disease", "left").select("id", F.coalesce("other", "disease").alias("shown"))  # a fixed word list


@query("explicit_false", "SELECT doc_id, toxic = 0 AS is_false FROM labels")
def explicit_false(spark, sf):
    return T.table(spark, sf, "labels").select("doc_id", text.is_false(F.col("toxic") != 0).alias("is_false"))


@query("rows_digest", "SELECT lang, sha256(string_agg(doc_id || ':' || sha256(coalesce(text, '')), chr(10) ORDER BY doc_id || ':' || sha256(coalesce(text, '')))) AS digest FROM documents GROUP BY lang")
def rows_digest(spark, sf):
    row = F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))
    return T.table(spark, sf, "documents").groupBy("lang").agg(keys.rows_digest(row).alias("digest"))


@query("canonical_text_hash", "SELECT doc_id, sha256(replace(coalesce(text, ''), chr(10), chr(13) || chr(10))) AS crlf FROM documents")
def canonical_text_hash(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", F.sha2(keys.canonical_line_ends(F.coalesce("text", F.lit("")), "\r\n"), 256).alias("crlf"))


# Cleaning decisions


@query("cleaning_status", _with(T.RECORDS) + "SELECT record_id, CASE WHEN role = 'locked_test' THEN 'LOCKED_BENCHMARK' WHEN mapping_status = 'AMBIGUOUS' THEN 'AMBIGUOUS_MAPPING' WHEN mapping_status = 'NOT_SUPPORTED' THEN 'UNSUPPORTED_CLASS' ELSE '' END AS exclusion_reason, CASE WHEN role = 'locked_test' OR mapping_status <> 'MATCHED' THEN 'EXCLUDE' ELSE 'INCLUDE' END AS cleaning_status FROM records")
def cleaning_status(spark, sf):
    return policy.initial_cleaning(T.records(spark, sf)).select("record_id", "exclusion_reason", "cleaning_status")


@query("decision_severity", _with(T.RECORDS) + """, hits AS (SELECT record_id, 0 AS severity, 0 AS seq, 'APPROVED' AS status FROM records UNION ALL SELECT record_id, 2, 1, 'REVIEW' FROM records WHERE width > 250 UNION ALL
  SELECT record_id, 2, 2, 'DUPLICATE' FROM records WHERE height > 150 UNION ALL SELECT record_id, 5, 3, 'LOCKED' FROM records WHERE role = 'locked_test') SELECT record_id, arg_max(status, severity * 10 + seq) AS status FROM hits GROUP BY record_id""".replace(") , hits", "), hits", 1))
def decision_severity(spark, sf):
    r = T.records(spark, sf)
    rules = [(0, "APPROVED", F.lit(True)), (2, "REVIEW", F.col("width") > 250), (2, "DUPLICATE", F.col("height") > 150), (5, "LOCKED", F.col("role") == "locked_test")]
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(i).alias("seq"), F.lit(status).alias("status"), F.lit("").alias("reason"))) for i, (s, status, c) in enumerate(rules)]))
    return policy.strongest(r.select("record_id", F.inline(hits))).select("record_id", "status")


@query("label_mapping", _with(T.RECORDS) + "SELECT record_id, CASE source_label WHEN 'en' THEN 'MATCHED' WHEN 'de' THEN 'MATCHED' WHEN 'fr' THEN 'AMBIGUOUS' ELSE 'NOT_SUPPORTED' END AS mapping_status, CASE source_label WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE '' END AS target_class FROM records")
def label_mapping(spark, sf):
    mapping = spark.createDataFrame([("en", "MATCHED", "English"), ("de", "MATCHED", "German"), ("fr", "AMBIGUOUS", "")], "source_label string, mapping_status string, target_class string")
    return policy.map_labels(T.records(spark, sf).drop("mapping_status", "target_class"), mapping).select("record_id", "mapping_status", "target_class")


@query("mapping_faults", _with(T.RECORDS) + "SELECT count(*) FILTER (mapping_status NOT IN ('MATCHED', 'AMBIGUOUS', 'NOT_SUPPORTED')) AS bad_status, count(*) FILTER (mapping_status <> 'MATCHED') AS no_reason, count(*) FILTER ((mapping_status = 'MATCHED') <> (target_class <> '')) AS bad_target FROM records")
def mapping_faults(spark, sf):
    return policy.mapping_faults(T.records(spark, sf).withColumn("reason", F.lit("")))


@query("mapping_coverage", "SELECT lang AS label, 'observed' AS side FROM documents WHERE lang NOT IN ('en', 'de', 'it') GROUP BY lang UNION ALL SELECT l, 'declared' FROM (VALUES ('en'), ('de'), ('it')) v(l) WHERE l NOT IN (SELECT lang FROM documents)")
def mapping_coverage(spark, sf):
    declared = spark.createDataFrame([("en",), ("de",), ("it",)], "label string")
    return checks.coverage(T.table(spark, sf, "documents").select(F.col("lang").alias("label")), declared, "label")


@query("rule_counters", _with(POLICY) + "SELECT count(*) FILTER (cleaning_status = 'INCLUDE' AND role = 'locked_test') AS locked_included, count(*) FILTER (cleaning_status = 'INCLUDE' AND mapping_status <> 'MATCHED') AS unmatched_included, count(*) FILTER (cleaning_status = 'EXCLUDE' AND exclusion_reason = '') AS no_reason FROM cleaned")
def rule_counters(spark, sf):
    kept = F.col("cleaning_status") == "INCLUDE"
    return checks.counters(_cleaned(spark, sf), {"locked_included": ~(kept & (F.col("role") == "locked_test")), "unmatched_included": ~(kept & (F.col("mapping_status") != "MATCHED")), "no_reason": kept | (F.col("exclusion_reason") != "")})


@query("checked_lookup", "SELECT o.o_orderkey, c.c_mktsegment FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey")
def checked_lookup(spark, sf):
    customers = T.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return checks.looked_up(T.table(spark, sf, "orders"), customers, "o_custkey", "c_mktsegment").select("o_orderkey", "c_mktsegment")


@query("defaulted_lookup", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def defaulted_lookup(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id").join(T.table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"))


# Similarity pairs and graphs


def _pairs(spark, sf):
    r = T.records(spark, sf, True)
    near = similarity.hamming_self_join(r, 4)
    sides = ("role", "target_class", "dataset", "width", "height")
    return similarity.with_ends(near, r.select("record_id", *sides), sides).withColumn("category", similarity.pair_category())


@query("near_pairs_dhash", _with(T.HASHED) + "SELECT first, second, distance FROM near")
def near_pairs_dhash(spark, sf):
    return similarity.hamming_self_join(T.records(spark, sf, True), 4)


@query("near_classes", _with(T.HASHED.replace("records AS", "RECURSIVE records AS", 1), """steps AS (SELECT a.h AS x, b.h AS y FROM (SELECT DISTINCT h FROM hashed) a JOIN (SELECT DISTINCT h FROM hashed) b ON a.h <> b.h AND bit_count(xor(a.h, b.h)) <= 4)""",
    "reach AS (SELECT DISTINCT h AS v, h AS r FROM hashed UNION SELECT v, y FROM reach JOIN steps ON x = r)")
    + "SELECT h.record_id, c.class_id, coalesce(n.n_links, 0) AS n_links FROM hashed h JOIN (SELECT v, min(record_id) AS class_id FROM reach JOIN hashed ON r = h GROUP BY v) c ON c.v = h.h LEFT JOIN (SELECT x, count(*) AS n_links FROM steps GROUP BY x) n ON n.x = h.h")
def near_classes(spark, sf):
    return similarity.near_classes(T.records(spark, sf, True), 4)


@query("cross_near_pairs", _with(T.HASHED) + "SELECT a.record_id AS left_id, b.record_id AS right_id, bit_count(xor(a.h, b.h)) AS distance FROM hashed a JOIN hashed b ON a.source_domain = 'REAL_WORLD' AND b.source_domain <> 'REAL_WORLD' WHERE bit_count(xor(a.h, b.h)) <= 2")
def cross_near_pairs(spark, sf):
    r = T.records(spark, sf, True)
    return similarity.hamming_join(r.where("source_domain = 'REAL_WORLD'"), r.where("source_domain != 'REAL_WORLD'"), 2)


@query("pair_categories", _with(T.PAIRS) + "SELECT first, second, category FROM pairs")
def pair_categories(spark, sf):
    return _pairs(spark, sf).select("first", "second", "category")


@query("relation_counts", _with(T.PAIRS) + "SELECT category, distance, count(*) AS n FROM pairs GROUP BY ALL")
def relation_counts(spark, sf):
    return _pairs(spark, sf).groupBy("category", "distance").agg(F.count("*").alias("n"))


ASPECT = "abs(ln((a_width::DOUBLE / a_height) / (b_width::DOUBLE / b_height)))"


@query("aspect_pairs", _with(T.PAIRS) + f"SELECT first, second, round({ASPECT}, 9) AS aspect, round(exp(-{ASPECT}), 9) AS likeness FROM pairs")
def aspect_pairs(spark, sf):
    sizes = [F.col(c) for c in ("a_width", "a_height", "b_width", "b_height")]
    return _pairs(spark, sf).select("first", "second", F.round(text.aspect_difference(*sizes), 9).alias("aspect"), F.round(text.geometry_similarity(*sizes), 9).alias("likeness"))


@query("refinement_candidates", _with(T.PAIRS) + f"SELECT first, second FROM pairs WHERE category = 'TRAIN_TO_LOCKED_BENCHMARK' OR (category <> 'OTHER' AND distance <= CASE WHEN category = 'DIFFERENT_TARGET' THEN 16 ELSE 4 END AND {ASPECT} <= 0.03)")
def refinement_candidates(spark, sf):
    sizes = [F.col(c) for c in ("a_width", "a_height", "b_width", "b_height")]
    return _pairs(spark, sf).where(similarity.needs_refinement(F.col("category"), F.col("distance"), text.aspect_difference(*sizes))).select("first", "second")


@query("signal_bands", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_quantity >= 40 AND l_discount * 2 >= 0.15 AND l_tax * 10 >= 0.6 THEN 'verified' WHEN l_quantity >= 15 AND l_discount * 2 >= 0.05 AND l_tax * 10 >= 0.5 AND l_returnflag = 'R' THEN 'possible' ELSE 'neither' END AS band FROM lineitem")
def signal_bands(spark, sf):
    risk = F.when(F.col("l_returnflag") == "R", "DIFFERENT_TARGET").otherwise("SAME_TARGET")
    band = similarity.signal_band(risk, F.col("l_quantity"), F.col("l_discount") * 2, F.col("l_tax") * 10)
    return T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", band.alias("band"))


@query("direct_flags", _with(T.PAIRS) + "SELECT record_id, min(distance) AS min_distance, bool_or(category = 'TRAIN_TO_LOCKED_BENCHMARK' AND role = 'training_candidate') AS near_benchmark, bool_or(category = 'DIFFERENT_TARGET') AS near_conflict FROM (SELECT first AS record_id, a_role AS role, category, distance FROM pairs UNION ALL SELECT second, b_role, category, distance FROM pairs) GROUP BY record_id")
def direct_flags(spark, sf):
    return similarity.direct_flags(_pairs(spark, sf))


def _near(spark, sf):
    return near_groups.near_records(T.records(spark, sf, True), 4)


@query("components", _with(T.COMPONENTS) + "SELECT v, component FROM parts")
def components(spark, sf):
    return near_groups.components(*_near(spark, sf))


@query("component_summary", _with(T.COMPONENTS) + "SELECT component, count(*) AS n_pairs, count(*) FILTER (category = 'TRAIN_TO_LOCKED_BENCHMARK') AS n_benchmark, count(*) FILTER (category = 'DIFFERENT_TARGET') AS n_conflict, min(distance) AS min_distance, CASE WHEN n_benchmark > 0 THEN 'BENCHMARK_LEAKAGE' WHEN n_conflict > 0 THEN 'LABEL_CONFLICT' ELSE 'NEAR_DUPLICATE' END AS risk FROM pairs JOIN parts ON v = first GROUP BY component")
def component_summary(spark, sf):
    return near_groups.component_summary(near_groups.pair_cells(*_near(spark, sf)))


@query("largest_component", _with(T.COMPONENTS) + ", top AS (SELECT component FROM parts GROUP BY component ORDER BY count(*) DESC, component LIMIT 1) SELECT category, distance, count(*) AS n FROM pairs JOIN parts ON v = first WHERE component = (SELECT component FROM top) GROUP BY ALL")
def largest_component(spark, sf):
    rows, links = _near(spark, sf)
    top = near_groups.components(rows, links).groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return near_groups.pair_cells(rows, links).join(top.select("component"), "component", "left_semi").select("category", "distance", "n")


@query("representative_pairs", _with(T.COMPONENTS) + "SELECT component, category, first, second, count(*) OVER w AS pairs_in_group FROM pairs JOIN parts ON v = first WINDOW w AS (PARTITION BY component, category) QUALIFY row_number() OVER (PARTITION BY component, category ORDER BY distance, first, second) = 1")
def representative_pairs(spark, sf):
    best = F.min(F.struct("distance", "first", "second")).alias("best")
    found = near_groups.pair_cells(*_near(spark, sf)).groupBy("component", "category").agg(best, F.sum("n").alias("pairs_in_group"))
    return found.select("component", "category", "best.first", "best.second", "pairs_in_group")


def _anchored(spark, sf):
    rows, links = _near(spark, sf)
    return rows, links, near_groups.anchored(rows, links)


@query("anchor_groups", _with(T.ANCHORED) + "SELECT v, representative, 'refined_' || substr(sha256(representative), 1, 20) AS refined_group_id FROM members")
def anchor_groups(spark, sf):
    rows, _, hashes = _anchored(spark, sf)
    return near_groups.members(rows, hashes).withColumn("refined_group_id", keys.stable_id("refined_", 20, "representative"))


@query("group_risk", _with(T.ANCHORED) + "SELECT representative, members, risk FROM risk")
def group_risk(spark, sf):
    held, _, hashes = _anchored(spark, sf)
    members = near_groups.members(held, hashes)
    rows = T.records(spark, sf).select(F.col("record_id").alias("v"), "role", "target_class")
    return policy.group_risk(members.join(rows, "v"))


@query("contracted_pairs", _with(T.ANCHORED, """ends AS (SELECT coalesce(x.representative, p.first) AS x, coalesce(y.representative, p.second) AS y, distance FROM pairs p LEFT JOIN members x ON x.v = p.first LEFT JOIN members y ON y.v = p.second)""")
    + "SELECT least(x, y) AS entity_a, greatest(x, y) AS entity_b, count(*) AS n_pairs, min(distance) AS min_distance FROM ends WHERE x <> y GROUP BY ALL")
def contracted_pairs(spark, sf):
    return near_groups.contracted(*_anchored(spark, sf))


RESOLVED = T.ANCHORED + POLICY.removeprefix(T.RECORDS) + """, judged AS (
  SELECT cleaned.*, CASE WHEN role = 'locked_test' THEN 'LOCKED_BENCHMARK' WHEN cleaning_status = 'EXCLUDE' THEN 'ALREADY_EXCLUDED' WHEN risk = 'VERIFIED_BENCHMARK_LEAKAGE' THEN 'VERIFIED_PERCEPTUAL_LEAKAGE'
    WHEN risk = 'VERIFIED_LABEL_CONFLICT' THEN 'VERIFIED_PERCEPTUAL_LABEL_CONFLICT' WHEN record_id IN (SELECT first FROM pairs WHERE category = 'DIFFERENT_TARGET') THEN 'STILL_UNCERTAIN' ELSE 'INCLUDE' END AS resolution
  FROM cleaned LEFT JOIN members ON members.v = record_id LEFT JOIN risk ON risk.representative = members.representative)"""


@query("resolved_records", _with(RESOLVED) + """SELECT record_id, resolution, CASE WHEN resolution LIKE 'VERIFIED%' OR resolution = 'STILL_UNCERTAIN' THEN 'EXCLUDE' ELSE cleaning_status END AS cleaning_status,
  CASE WHEN resolution LIKE 'VERIFIED%' THEN resolution WHEN resolution = 'STILL_UNCERTAIN' THEN 'UNRESOLVED_PERCEPTUAL_IDENTITY' ELSE exclusion_reason END AS exclusion_reason FROM judged""")
def resolved_records(spark, sf):
    held, links, hashes = _anchored(spark, sf)
    members = near_groups.members(held, hashes)
    rows = _cleaned(spark, sf).select("record_id", "role", "target_class", "cleaning_status", "exclusion_reason")
    risk = policy.group_risk(members.join(rows.select(F.col("record_id").alias("v"), "role", "target_class"), "v"))
    doubt = near_groups.in_conflict(held, links)
    out = policy.finalise(policy.apply_resolution(policy.resolve(rows, members.join(risk, "representative"), doubt)))
    return out.select("record_id", "resolution", "cleaning_status", "exclusion_reason")


@query("anchor_edge_summary", _with(T.ANCHORED) + "SELECT representative, count(*) AS edges, min(distance) AS nearest, max(distance) AS farthest FROM (SELECT first AS x, second AS y, distance FROM pairs UNION ALL SELECT second, first, distance FROM pairs) e JOIN members ON v = x AND representative = y GROUP BY representative")
def anchor_edge_summary(spark, sf):
    rows, _, hashes = _anchored(spark, sf)
    return near_groups.edge_summary(rows, hashes)


@query("candidate_decisions", _with(T.HASHED) + "SELECT record_id, CASE WHEN mapping_status <> 'MATCHED' THEN 'REJECTED' WHEN count(*) OVER (PARTITION BY sha256) > 1 THEN 'EXACT_DUPLICATE' WHEN record_id IN (SELECT first FROM near UNION SELECT second FROM near) THEN 'NEEDS_REVIEW' ELSE 'APPROVED' END AS candidate_status FROM records")
def candidate_decisions(spark, sf):
    r = T.records(spark, sf, True)
    return policy.candidate_decisions(r.select("record_id", "sha256", "mapping_status"), similarity.hamming_self_join(r, 4)).select("record_id", "candidate_status")


# Counts, summaries and weights


@query("counts_by_key", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def counts_by_key(spark, sf):
    return weights.class_counts(T.table(spark, sf, "documents"), "source")


@query("zero_filled_counts", "SELECT c::INTEGER AS t, count(label) AS n FROM range(12) r(c) LEFT JOIN embeddings ON label = c AND embedding IS NOT NULL GROUP BY c")
def zero_filled_counts(spark, sf):
    return weights.class_counts(T.outputs(spark, sf), "t", T.classes(spark, 12).withColumnRenamed("c", "t"))


@query("two_level_counts", "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def two_level_counts(spark, sf):
    return T.table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("conditional_summary", _with(T.RECORDS) + "SELECT count(*) AS rows, count(*) FILTER (role = 'locked_test') AS locked, count(*) FILTER (mapping_status <> 'MATCHED') AS unmatched, count(DISTINCT sha256) AS contents, count(DISTINCT nullif(target_class, '')) AS targets FROM records")
def conditional_summary(spark, sf):
    return T.records(spark, sf).agg(F.count("*").alias("rows"), F.count_if(F.col("role") == "locked_test").alias("locked"), F.count_if(F.col("mapping_status") != "MATCHED").alias("unmatched"), F.countDistinct("sha256").alias("contents"), F.countDistinct(F.nullif("target_class", F.lit(""))).alias("targets"))


@query("joined_values", _with(T.RECORDS) + "SELECT dataset, coalesce(string_agg(DISTINCT nullif(target_class, ''), ' | ' ORDER BY nullif(target_class, '')), '') AS joined, count(DISTINCT nullif(target_class, '')) AS n_values FROM records GROUP BY dataset")
def joined_values(spark, sf):
    return weights.joined_values(T.records(spark, sf), "dataset", "target_class")


@query("class_summary", "SELECT count(*) AS classes, min(n) AS least, max(n) AS most, avg(n) AS mean, median(n) AS median, max(n) / min(n) AS ratio FROM (SELECT count(*) AS n FROM documents GROUP BY lang)")
def class_summary(spark, sf):
    return weights.summary(weights.class_counts(T.table(spark, sf, "documents"), "lang"))


@query("upper_median", "SELECT l_returnflag, l_extendedprice AS upper_median FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) = floor(count(*) OVER (PARTITION BY l_returnflag) / 2) + 1")
def upper_median(spark, sf):
    return weights.upper_median(T.table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice")


@query("histogram_quantiles", "SELECT q, min(value) AS value FROM (SELECT l_quantity AS value, sum(count(*)) OVER (ORDER BY l_quantity) AS cum, sum(count(*)) OVER () AS total FROM lineitem GROUP BY l_quantity), (VALUES (0.1::DOUBLE), (0.5), (0.9)) v(q) WHERE cum > q * (total - 1) GROUP BY q")
def histogram_quantiles(spark, sf):
    return weights.histogram_quantiles(T.table(spark, sf, "lineitem"), "l_quantity", (0.1, 0.5, 0.9))


@query("interpolated_quantiles", "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.025) AS low, quantile_cont(l_extendedprice, 0.975) AS high FROM lineitem GROUP BY l_returnflag")
def interpolated_quantiles(spark, sf):
    return T.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_extendedprice", 0.025).alias("low"), F.percentile("l_extendedprice", 0.975).alias("high"))


@query("cumulative_counts", "SELECT l_quantity, sum(count(*)) OVER (ORDER BY l_quantity)::BIGINT AS cum FROM lineitem GROUP BY l_quantity")
def cumulative_counts(spark, sf):
    from pyspark.sql import Window

    counts = T.table(spark, sf, "lineitem").groupBy("l_quantity").agg(F.count("*").alias("n"))
    return counts.select("l_quantity", F.sum("n").over(Window.orderBy("l_quantity").rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))


@query("class_weights", """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), m AS (SELECT median(n) AS m, sum(n) AS total FROM c), r AS (SELECT lang, n, total, sqrt(m / n) AS raw FROM c, m), s AS (SELECT sum(n) / sum(n * raw) AS s FROM r)
  SELECT lang, n, n / total AS share, sqrt(total / n) AS inverse_sqrt, raw, raw * s AS weight, greatest(0.5, least(3.0, raw * s)) AS clipped FROM r, s""")
def class_weights(spark, sf):
    return weights.class_weights(T.table(spark, sf, "documents"), "lang")


@query("combined_projection", "SELECT coalesce(a.lang, b.lang) AS lang, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(n_a, 0) + coalesce(n_b, 0) AS n FROM (SELECT lang, count(*) AS n_a FROM documents WHERE source < 'src15' GROUP BY lang) a FULL JOIN (SELECT lang, count(*) AS n_b FROM documents WHERE source >= 'src15' GROUP BY lang) b ON a.lang = b.lang")
def combined_projection(spark, sf):
    docs = T.table(spark, sf, "documents")
    return weights.combined_projection(docs.where("source < 'src15'"), docs.where("source >= 'src15'"), "lang")


@query("largest_classes", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 5")
def largest_classes(spark, sf):
    return weights.class_counts(T.table(spark, sf, "documents"), "source").orderBy(F.desc("n"), "source").limit(5)


@query("smallest_classes", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n, source LIMIT 5")
def smallest_classes(spark, sf):
    return weights.class_counts(T.table(spark, sf, "documents"), "source").orderBy("n", "source").limit(5)


@query("preview_ids", _with(T.RECORDS) + "SELECT mapping_status, list_slice(list_sort(list(record_id)), 1, 20)::VARCHAR AS ids FROM records WHERE mapping_status <> 'MATCHED' GROUP BY mapping_status".replace("list_slice(list_sort(list(record_id)), 1, 20)::VARCHAR", "array_to_string(list_slice(list_sort(list(record_id)), 1, 20), ',')"))
def preview_ids(spark, sf):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("mapping_status").orderBy("record_id"))
    first = T.records(spark, sf).where("mapping_status != 'MATCHED'").withColumn("r", rank).where("r <= 20")
    return first.groupBy("mapping_status").agg(F.array_join(F.array_sort(F.collect_list("record_id")), ",").alias("ids"))


# Splits


def _split_rows(spark, sf):
    r = T.records(spark, sf)
    return r.withColumn("split_group_id", keys.split_group_id("source_domain", "record_id", "sha256", F.lit(""))).withColumnRenamed("dataset", "source_dataset")


SPLIT_ROWS = T.RECORDS + ", srows AS (SELECT *, 'split_group_' || substr(sha256(source_domain || chr(0) || 'exact' || chr(0) || sha256), 1, 24) AS split_group_id FROM records)"


@query("split_group_stats", _with(SPLIT_ROWS) + "SELECT split_group_id, min(target_class) AS target_class, min(source_domain) AS source_domain, count(*) AS image_count, array_to_string(list_sort(list(DISTINCT dataset)), ',') AS sources, count(DISTINCT target_class) AS classes, count(DISTINCT source_domain) AS domains FROM srows GROUP BY split_group_id")
def split_group_stats(spark, sf):
    return split.split_groups(_split_rows(spark, sf)).withColumn("sources", F.array_join("sources", ","))


@query("split_targets", """WITH n AS (SELECT source, count(*) AS n FROM documents GROUP BY source), p AS (SELECT source, n, n * 0.8::DOUBLE AS a, n * 0.1::DOUBLE AS b FROM n), f AS (SELECT *, floor(a) AS fa, floor(b) AS fb, n - floor(a) - 2 * floor(b) AS rest FROM p)
  SELECT source, (fa + CASE WHEN (CASE WHEN b - fb > a - fa THEN 2 ELSE 0 END) < rest THEN 1 ELSE 0 END)::BIGINT AS train, (fb + CASE WHEN (CASE WHEN a - fa >= b - fb THEN 1 ELSE 0 END) < rest THEN 1 ELSE 0 END)::BIGINT AS validation,
  (fb + CASE WHEN (CASE WHEN a - fa >= b - fb THEN 1 ELSE 0 END) + 1 < rest THEN 1 ELSE 0 END)::BIGINT AS test, CASE WHEN n >= 20 THEN 2 WHEN n >= 10 THEN 1 ELSE 0 END::BIGINT AS least_held FROM f""")
def split_targets(spark, sf):
    n = weights.class_counts(T.table(spark, sf, "documents"), "source")
    got = n.withColumn("w", split.integer_targets(F.col("n"))).withColumn("m", split.minimum_groups(F.col("n")))
    return got.select("source", F.col("w.TRAIN").alias("train"), F.col("w.VALIDATION").alias("validation"), F.col("w.TEST").alias("test"), F.col("m.TEST").alias("least_held"))


def _cost_sql(to: str) -> str:
    """The squared relative errors of images and, a little, of groups if the group went to split ``to``."""
    errors = lambda have, want, more: " + ".join(f"pow(({have}{x}{f' + {more}' if x == to else ''} - {want}{x})::DOUBLE / greatest(1, {want}{x}), 2)" for x in "tve")
    return f"({errors('i', 'wi', 'size')}) + 0.05::DOUBLE * ({errors('g', 'wg', '1')})"


def _whole_sql(total: str, name: str) -> str:
    """Whole targets of a total, largest remainders up, as columns ``name``t, ``name``v and ``name``e."""
    a, b = f"({total} * 0.8::DOUBLE)", f"({total} * 0.1::DOUBLE)"
    first, rest = f"({a} - floor({a}) >= {b} - floor({b}))", f"({total} - floor({a}) - 2 * floor({b}))"
    return f"(floor({a}) + (CASE WHEN {first} THEN 0 ELSE 2 END < {rest})::INTEGER)::BIGINT AS {name}t, (floor({b}) + (CASE WHEN {first} THEN 1 ELSE 0 END < {rest})::INTEGER)::BIGINT AS {name}v, (floor({b}) + (CASE WHEN {first} THEN 2 ELSE 1 END < {rest})::INTEGER)::BIGINT AS {name}e"


#: The greedy rule as a recursion over each stratum's groups in hash order.
ALLOCATED = SPLIT_ROWS.replace("records AS", "RECURSIVE records AS", 1) + f""", sg AS (SELECT split_group_id, count(*) AS size, min(target_class) || chr(1) || min(source_domain) || chr(1) || array_to_string(list_sort(list(DISTINCT dataset)), chr(2)) AS stratum FROM srows GROUP BY split_group_id
), numbered AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('20260810' || chr(0) || split_group_id), split_group_id) AS k, count(*) OVER (PARTITION BY stratum) AS n, sum(size) OVER (PARTITION BY stratum)::BIGINT AS total FROM sg
), wanted AS (SELECT * REPLACE (greatest(wgt, 1) AS wgt, greatest(wgv, held) AS wgv, greatest(wge, held) AS wge) FROM (SELECT *, CASE WHEN n >= 20 THEN 2 ELSE 1 END AS held, {_whole_sql("total", "wi")}, {_whole_sql("n", "wg")} FROM numbered WHERE n >= 10)
), walked AS (SELECT DISTINCT stratum, 0::BIGINT AS k, 0::BIGINT AS it, 0::BIGINT AS iv, 0::BIGINT AS ie, 0::BIGINT AS gt, 0::BIGINT AS gv, 0::BIGINT AS ge, NULL::VARCHAR AS split_group_id, NULL::VARCHAR AS split FROM wanted
  UNION ALL SELECT stratum, k, it + size * (split = 'TRAIN')::INTEGER, iv + size * (split = 'VALIDATION')::INTEGER, ie + size * (split = 'TEST')::INTEGER, gt + (split = 'TRAIN')::INTEGER, gv + (split = 'VALIDATION')::INTEGER, ge + (split = 'TEST')::INTEGER, split_group_id, split
  FROM (SELECT *, list_sort(list_filter([{{'c': ct, 'h': sha256('20260810' || chr(0) || split_group_id || chr(0) || 'TRAIN'), 's': 'TRAIN', 'u': ut}}, {{'c': cv, 'h': sha256('20260810' || chr(0) || split_group_id || chr(0) || 'VALIDATION'), 's': 'VALIDATION', 'u': uv}}, {{'c': ce, 'h': sha256('20260810' || chr(0) || split_group_id || chr(0) || 'TEST'), 's': 'TEST', 'u': ue}}],
      lambda x: x.u > 0 OR ut + uv + ue <= n - k))[1].s AS split
    FROM (SELECT w.*, r.it, r.iv, r.ie, r.gt, r.gv, r.ge, greatest(0, 1 - r.gt) AS ut, greatest(0, w.held - r.gv) AS uv, greatest(0, w.held - r.ge) AS ue, {_cost_sql("t")} AS ct, {_cost_sql("v")} AS cv, {_cost_sql("e")} AS ce
      FROM walked r JOIN wanted w ON w.stratum = r.stratum AND w.k = r.k + 1))
), assigned AS (SELECT split_group_id, split FROM walked WHERE k > 0 UNION ALL SELECT split_group_id, 'TRAIN' FROM numbered WHERE n < 10)"""


@query("group_split", _with(ALLOCATED) + "SELECT split_group_id, split FROM assigned")
def group_split(spark, sf):
    return split.assign_splits(split.split_groups(_split_rows(spark, sf)))


@query("split_report", _with(ALLOCATED) + "SELECT split, count(*) AS groups, count(*) FILTER (size = 1) AS singletons, sum(size)::BIGINT AS images, arg_min(split_group_id, {'a': -size, 'b': split_group_id}) AS largest_group, max(size) AS largest_size FROM sg JOIN assigned USING (split_group_id) GROUP BY split")
def split_report(spark, sf):
    groups = stage_table(split.split_groups(_split_rows(spark, sf)), "groups")
    return split.group_report(groups, stage_table(split.assign_splits(groups), "assigned"))


@query("leakage_check", _with(T.RECORDS) + f", s AS (SELECT *, {T.SPLIT} AS split FROM records) SELECT 'group' AS kind, dataset AS key, count(DISTINCT split) AS splits FROM s GROUP BY dataset HAVING count(DISTINCT split) > 1 UNION ALL SELECT 'sha256', sha256, count(DISTINCT split) FROM s GROUP BY sha256 HAVING count(DISTINCT split) > 1")
def leakage_check(spark, sf):
    return split.leakage(T.records(spark, sf).withColumn("split", T.hash_split()).withColumn("split_group_id", F.col("dataset")))


QUALITY = T.RECORDS + f", s AS (SELECT *, {T.SPLIT} AS split FROM records), q AS (SELECT target_class, count(*) AS total, count(*) FILTER (split = 'TRAIN') AS train, count(*) FILTER (split = 'VALIDATION') AS validation, count(*) FILTER (split = 'TEST') AS test FROM s GROUP BY target_class)"


def _quality(spark, sf):
    return split.class_quality(T.records(spark, sf).withColumn("split", T.hash_split()))


@query("class_quality", _with(QUALITY) + "SELECT *, train * 100.0::DOUBLE / total AS train_percentage, train_percentage - 80 AS train_off, validation * 100.0::DOUBLE / total AS validation_percentage, validation_percentage - 10 AS validation_off, test * 100.0::DOUBLE / total AS test_percentage, test_percentage - 10 AS test_off FROM q")
def class_quality(spark, sf):
    return _quality(spark, sf)


@query("split_warnings", _with(QUALITY) + "SELECT 'FEW_VALIDATION_ROWS' AS kind, target_class FROM q WHERE validation < 10 UNION ALL SELECT 'FEW_TEST_ROWS', target_class FROM q WHERE test < 10 UNION ALL SELECT 'TRAIN_SHARE_OFF', target_class FROM q WHERE abs(train * 100.0::DOUBLE / total - 80) > 2")
def split_warnings(spark, sf):
    return split.warnings(_quality(spark, sf))


@query("split_distribution", _with(T.RECORDS) + f", s AS (SELECT *, {T.SPLIT} AS split FROM records) SELECT source_domain, count(*) AS total, count(*) FILTER (split = 'TRAIN') AS train, count(*) FILTER (split = 'VALIDATION') AS validation, count(*) FILTER (split = 'TEST') AS test, count(DISTINCT target_class) FILTER (split = 'TRAIN') AS train_classes, count(DISTINCT target_class) FILTER (split = 'VALIDATION') AS validation_classes, count(DISTINCT target_class) FILTER (split = 'TEST') AS test_classes FROM s GROUP BY source_domain")
def split_distribution(spark, sf):
    return split.distribution(T.records(spark, sf).withColumn("split", T.hash_split()), "source_domain")


@query("seeded_sample", "SELECT doc_id, sha256('20260810' || chr(0) || doc_id) AS order_key FROM documents ORDER BY order_key, doc_id LIMIT 50")
def seeded_sample(spark, sf):
    return split.seeded_sample(T.table(spark, sf, "documents").select("doc_id"), "doc_id", 50)


# Metrics


@query("argmax_class", _with(T.OUTPUTS) + "SELECT id, a, b FROM outputs")
def argmax_class(spark, sf):
    return T.outputs(spark, sf).select("id", "a", "b")


@query("top_scores", "SELECT vec_id, array_to_string(list_transform(list_slice(list_sort(list_transform(range(len(embedding)), lambda i: {'n': -embedding[i + 1], 'i': i})), 1, 3), lambda s: s.i), ',') AS top FROM embeddings WHERE embedding IS NOT NULL")
def top_scores(spark, sf):
    top = metrics.top_k(F.col("embedding"), 3)
    return T.table(spark, sf, "embeddings").where("embedding is not null").select("vec_id", F.array_join(F.transform(top, lambda s: s["index"].cast("string")), ",").alias("top"))


def _rows(spark, sf, model="a"):
    return T.outputs(spark, sf).select("id", "t", F.col(model).alias("p"), "confidence")


@query("confusion_matrix", _with(T.OUTPUTS) + "SELECT x.c::INTEGER AS t, y.c::INTEGER AS p, count(id) AS n FROM range(10) x(c) CROSS JOIN range(10) y(c) LEFT JOIN outputs ON t = x.c AND a = y.c GROUP BY ALL")
def confusion_matrix(spark, sf):
    return metrics.confusion_grid(_rows(spark, sf), T.classes(spark))


@query("weighted_confusion", _with(T.OUTPUTS) + "SELECT t, a AS p, sum(confidence) AS n FROM outputs GROUP BY ALL")
def weighted_confusion(spark, sf):
    return metrics.weighted_confusion(_rows(spark, sf), "confidence")


def _per_class_sql(model: str) -> str:
    return f"""pc_{model} AS (SELECT c::INTEGER AS c, count(*) FILTER (t = c) AS support, count(*) FILTER ({model} = c) AS predicted, count(*) FILTER (t = c AND {model} = c) AS hits,
  coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM outputs, range(10) r(c) GROUP BY c)"""


@query("per_class_metrics", _with(T.OUTPUTS, _per_class_sql("a")) + "SELECT c, support, predicted, precision, recall, f1 FROM pc_a")
def per_class_metrics(spark, sf):
    return metrics.per_class(_rows(spark, sf), T.classes(spark))


@query("macro_weighted", _with(T.OUTPUTS, _per_class_sql("a")) + "SELECT count(*) AS classes, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, sum(precision * support) / sum(support) AS weighted_precision, sum(recall * support) / sum(support) AS weighted_recall, sum(f1 * support) / sum(support) AS weighted_f1 FROM pc_a")
def macro_weighted(spark, sf):
    return metrics.averages(metrics.per_class(_rows(spark, sf), T.classes(spark)), with_support=False)


@query("sliced_metrics", _with(T.OUTPUTS) + """, s AS (SELECT 'all' AS slice, t, a AS p FROM outputs UNION ALL SELECT 'sure', t, a FROM outputs WHERE confidence >= 60 UNION ALL SELECT 'low', t, a FROM outputs WHERE t < 5),
  x AS (SELECT slice, t AS c, count(*) AS support, count(*) FILTER (p = t) AS hits FROM s GROUP BY ALL), y AS (SELECT slice, p AS c, count(*) AS predicted FROM s GROUP BY ALL)
  SELECT x.slice, sum(support)::BIGINT AS n, sum(hits) / sum(support) AS accuracy, avg(2.0::DOUBLE * hits / (support + coalesce(predicted, 0))) AS macro_f1 FROM x LEFT JOIN y ON x.slice = y.slice AND x.c = y.c GROUP BY x.slice""")
def sliced_metrics(spark, sf):
    return metrics.sliced_metrics(_rows(spark, sf), {"all": F.lit(True), "sure": F.col("confidence") >= 60, "low": F.col("t") < 5})


@query("confidence_analysis", _with(T.OUTPUTS) + "SELECT count(*) FILTER (confidence >= 60) AS n_sure, avg((t = a)::INTEGER) FILTER (confidence >= 60) AS accuracy_sure, count(*) FILTER (confidence < 60) AS n_below, count(*) FILTER (confidence < 60 AND a <> 4) AS n_uncertain, count(*) FILTER (a = 4) AS n_empty, count(*) FILTER (a = 4 AND confidence < 60) AS n_empty_below, avg(confidence) AS mean_confidence, median(confidence) AS median_confidence FROM outputs")
def confidence_analysis(spark, sf):
    return metrics.confidence_analysis(_rows(spark, sf))


@query("two_class_confusion", _with(T.OUTPUTS) + ", z AS (SELECT count(*) FILTER (t = 1) AS x_support, count(*) FILTER (t = 2) AS y_support, count(*) FILTER (t = 1 AND a = 2) AS x_to_y, count(*) FILTER (t = 2 AND a = 1) AS y_to_x FROM outputs) SELECT *, x_to_y + y_to_x AS both, x_to_y / nullif(x_support, 0) AS x_to_y_rate, y_to_x / nullif(y_support, 0) AS y_to_x_rate, (x_to_y + y_to_x) / nullif(x_support + y_support, 0) AS both_rate FROM z")
def two_class_confusion(spark, sf):
    return metrics.two_class_confusion(_rows(spark, sf), 1, 2)


@query("class_deltas", _with(T.OUTPUTS, _per_class_sql("a"), _per_class_sql("b")) + "SELECT pc_a.c, pc_a.support, pc_a.f1 AS f1_a, pc_b.f1 AS f1_b, pc_b.f1 - pc_a.f1 AS delta FROM pc_a JOIN pc_b ON pc_a.c = pc_b.c WHERE pc_a.support > 0")
def class_deltas(spark, sf):
    return metrics.class_deltas(T.outputs(spark, sf))


@query("generalisation_gap", _with(T.OUTPUTS) + "SELECT avg((t = a)::INTEGER) AS accuracy_a, avg((t = b)::INTEGER) AS accuracy_b, avg((t = b)::INTEGER) - avg((t = a)::INTEGER) AS delta FROM outputs")
def generalisation_gap(spark, sf):
    right = lambda c: F.avg((F.col("t") == F.col(c)).cast("double"))
    return T.outputs(spark, sf).agg(right("a").alias("accuracy_a"), right("b").alias("accuracy_b"), (right("b") - right("a")).alias("delta"))


CHANGES = T.OUTPUTS + """, k AS (SELECT t, p, sum(x)::BIGINT AS a_count, sum(y)::BIGINT AS b_count FROM (SELECT t, a AS p, 1 AS x, 0 AS y FROM outputs UNION ALL SELECT t, b, 0, 1 FROM outputs) GROUP BY ALL), sup AS (SELECT t, count(*) AS support FROM outputs GROUP BY t),
  ch AS (SELECT k.t, p, support, a_count, b_count, b_count - a_count AS delta, (b_count - a_count) / support AS delta_rate, CASE WHEN b_count > a_count THEN 'increased' ELSE 'decreased' END AS direction FROM k JOIN sup ON k.t = sup.t WHERE k.t <> p AND a_count <> b_count)"""


@query("confusion_changes", _with(CHANGES) + "SELECT * FROM ch")
def confusion_changes(spark, sf):
    return metrics.confusion_changes(T.outputs(spark, sf))


@query("top_increases", _with(CHANGES) + "SELECT * FROM ch WHERE direction = 'increased' ORDER BY abs(delta_rate) DESC, abs(delta) DESC, t, p LIMIT 15")
def top_increases(spark, sf):
    changes = metrics.confusion_changes(T.outputs(spark, sf)).where("direction = 'increased'")
    return changes.orderBy(*metrics.ranked_changes(changes)).limit(15)


@query("top_decreases", _with(CHANGES) + "SELECT * FROM ch WHERE direction = 'decreased' ORDER BY abs(delta_rate) DESC, abs(delta) DESC, t, p LIMIT 15")
def top_decreases(spark, sf):
    changes = metrics.confusion_changes(T.outputs(spark, sf)).where("direction = 'decreased'")
    return changes.orderBy(*metrics.ranked_changes(changes)).limit(15)


@query("major_confusions", _with(T.OUTPUTS) + "SELECT t, a AS p, count(*) AS n FROM outputs WHERE t <> a GROUP BY ALL ORDER BY n DESC, t, p LIMIT 15")
def major_confusions(spark, sf):
    return metrics.major_confusions(_rows(spark, sf))


@query("positional_join", "SELECT i AS pos, count(*) AS n, sum((embedding[i + 1] > 0)::INTEGER)::BIGINT AS positive FROM embeddings, range(64) r(i) WHERE embedding IS NOT NULL GROUP BY i")
def positional_join(spark, sf):
    values = T.table(spark, sf, "embeddings").where("embedding is not null").select(F.posexplode("embedding").alias("pos", "x"))
    return values.groupBy(F.col("pos").cast("long").alias("pos")).agg(F.count("*").alias("n"), F.count_if(F.col("x") > 0).alias("positive"))


@query("stored_metrics_check", _with(T.OUTPUTS, _per_class_sql("a")) + "SELECT c, true AS agrees FROM pc_a")
def stored_metrics_check(spark, sf):
    scores = metrics.per_class(_rows(spark, sf), T.classes(spark))
    again = metrics.per_class(_rows(spark, sf).repartition(4, "id"), T.classes(spark)).select("c", F.col("f1").alias("stored"))
    return scores.join(again, "c").select("c", checks.close(F.col("f1"), F.col("stored")).alias("agrees"))


@query("vector_checks", "SELECT vec_id, len(embedding) = 64 AS whole, len(list_filter(embedding, lambda x: x < -1 OR x > 1)) = 0 AS in_range FROM embeddings WHERE embedding IS NOT NULL")
def vector_checks(spark, sf):
    e = F.col("embedding")
    return T.table(spark, sf, "embeddings").where("embedding is not null").select("vec_id", (F.size(e) == 64).alias("whole"), F.forall(e, lambda x: x.between(-1, 1)).alias("in_range"))


@query("paired_bootstrap")
def paired_bootstrap(spark, sf):
    return metrics.paired_bootstrap(T.outputs(spark, sf), replicates=2000)


@query("best_candidate", _with(T.HISTORY) + "SELECT user_id, epoch, val_macro_f1, val_loss, macro_recall FROM history QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY val_macro_f1 DESC, val_loss, macro_recall DESC, epoch) = 1")
def best_candidate(spark, sf):
    return metrics.best_candidate(T.history(spark, sf), ["user_id"])


# Composition, decisions and look-ups

TAXONOMY = "taxonomy AS (SELECT target_class, row_number() OVER (ORDER BY target_class) - 1 AS target_index FROM (SELECT DISTINCT target_class FROM records WHERE target_class <> ''))"
COMBINED = POLICY + ", " + TAXONOMY + """, inc AS (SELECT c.*, t.target_index::VARCHAR AS ti, CASE WHEN grouped THEN 'exact_' || substr(c.sha256, 1, 20) ELSE '' END AS eg,
    'comp_' || substr(sha256(source_domain || chr(0) || dataset || chr(0) || record_id || chr(0) || t.target_index || chr(0) || c.sha256), 1, 24) AS comp FROM cleaned c JOIN taxonomy t USING (target_class) WHERE cleaning_status = 'INCLUDE')"""


@query("combined_records", _with(COMBINED) + """SELECT comp AS composition_record_id, source_domain, dataset AS source_dataset, record_id AS source_record_id, ti AS target_index, eg AS exact_group_id,
  CASE WHEN eg <> '' THEN 'split_group_' || substr(sha256(source_domain || chr(0) || 'exact' || chr(0) || eg), 1, 24) ELSE 'split_single_' || substr(sha256(source_domain || chr(0) || 'singleton' || chr(0) || comp), 1, 24) END AS split_group_id,
  CASE source_domain WHEN 'REAL_WORLD' THEN 'AUDITED_REAL_WORLD_CLEAN' ELSE 'AUDITED_HISTORICAL_CLEAN' END AS provenance_status FROM inc""")
def combined_records(spark, sf):
    every = T.records(spark, sf)
    taxonomy = every.where("target_class != ''").select("target_class").distinct().withColumn("target_index", F.row_number().over(Window.orderBy("target_class")) - 1)  # one row a class
    groups = dedup.exact_groups(every).select("sha256", F.col("group_id").alias("exact_group_id"))
    rows = _cleaned(spark, sf).where("cleaning_status = 'INCLUDE'").join(groups, "sha256", "left").withColumn("exact_group_id", F.coalesce("exact_group_id", F.lit(""))).withColumn("refined_group_id", F.lit(""))
    rules = {"is matched": F.col("mapping_status") == "MATCHED", "is no test row": F.col("role") == "training_candidate", "is included": F.col("cleaning_status") == "INCLUDE"}
    sides = [composition.combined_records(rows.where(F.col("source_domain") == d), d, taxonomy, rules, p) for d, p in ((composition.HISTORICAL, "AUDITED_HISTORICAL_CLEAN"), (composition.REAL_WORLD, "AUDITED_REAL_WORLD_CLEAN"))]
    return sides[0].unionByName(sides[1]).select("composition_record_id", "source_domain", "source_dataset", "source_record_id", "target_index", "exact_group_id", "split_group_id", "provenance_status")


#: Signals of a pair of records, made from their sizes: good matches, match ratio, inlier ratio.
SIGNALS = "(a_width + b_width) % 50 AS good, (a_height % 20) / 40 AS ratio, (b_height % 10) / 10 AS inlier"


def _signals(spark, sf):
    near = _pairs(spark, sf)
    size = lambda c: F.col(c).cast("double")
    return near.select("*", ((F.col("a_width") + F.col("b_width")) % 50).alias("good"), (size("a_height") % 20 / 40).alias("ratio"), (size("b_height") % 10 / 10).alias("inlier"))


VERIFIED = "good >= 40 AND ratio >= 0.15 AND inlier >= 0.6"
POSSIBLE = "good >= 15 AND ratio >= 0.05 AND inlier >= 0.5"


@query("benchmark_decisions", _with(T.PAIRS, f"s AS (SELECT *, {SIGNALS} FROM pairs WHERE category = 'TRAIN_TO_LOCKED_BENCHMARK')") + f"""SELECT CASE WHEN a_role = 'training_candidate' THEN first ELSE second END AS training_record_id, CASE WHEN a_role = 'training_candidate' THEN second ELSE first END AS locked_test_record_id, distance,
  CASE WHEN {VERIFIED} THEN 'LIKELY_SAME_OBSERVATION' WHEN {POSSIBLE} THEN 'UNCERTAIN' ELSE 'CLEAR_FALSE_POSITIVE' END AS decision,
  CASE WHEN {VERIFIED} THEN 'EXCLUDE_TRAINING_SIDE' WHEN {POSSIBLE} THEN 'REVIEW_TRAINING_SIDE' ELSE 'INCLUDE_TRAINING_SIDE' END AS action FROM s""")
def benchmark_decisions(spark, sf):
    return composition.benchmark_decisions(_signals(spark, sf).where("category = 'TRAIN_TO_LOCKED_BENCHMARK'"))


@query("perceptual_policy", _with(T.PAIRS, f"""s AS (SELECT p.*, {SIGNALS}, a.target_class AS a_target, b.target_class AS b_target FROM pairs p JOIN records a ON a.record_id = first JOIN records b ON b.record_id = second
), u AS (SELECT *, {VERIFIED} AS sure, a_role <> b_role AS bench FROM s WHERE ({VERIFIED}) OR ({POSSIBLE})
), hits AS (SELECT record_id, CASE WHEN bench AND sure THEN 3 ELSE 2 END AS severity, CASE WHEN bench AND sure THEN 0 WHEN sure THEN 1 WHEN NOT bench THEN 2 ELSE 3 END AS seq
  FROM (SELECT first AS record_id, a_role AS role, * FROM u UNION ALL SELECT second, b_role, * FROM u) WHERE role = 'training_candidate' AND (bench OR a_target <> b_target)
), best AS (SELECT record_id, arg_max(seq, severity * 10 + seq) AS seq FROM hits GROUP BY record_id)""") + """SELECT record_id, CASE seq WHEN 0 THEN 'EXCLUDE_BENCHMARK_LEAKAGE' ELSE 'REVIEW_PERCEPTUAL_CONFLICT' END AS status,
  CASE seq WHEN 0 THEN 'HISTORICAL_BENCHMARK_LEAKAGE_PERCEPTUAL' WHEN 1 THEN 'VERIFIED_CROSS_CLASS_PERCEPTUAL_CONFLICT' WHEN 2 THEN 'POSSIBLE_CROSS_CLASS_PERCEPTUAL_CONFLICT' ELSE 'POSSIBLE_HISTORICAL_BENCHMARK_LEAKAGE' END AS reason FROM best""")
def perceptual_policy(spark, sf):
    targets = T.records(spark, sf).select("record_id", F.col("target_class"))
    s = _signals(spark, sf).join(targets.withColumnsRenamed({"record_id": "first", "target_class": "a_target"}), "first").join(targets.withColumnsRenamed({"record_id": "second", "target_class": "b_target"}), "second")
    band = similarity.signal_band(F.lit("DIFFERENT_TARGET"), F.col("good"), F.col("ratio"), F.col("inlier"))
    status = F.when(band == "verified", "VERIFIED_NEAR_DUPLICATE").when(band == "possible", "POSSIBLE_NEAR_DUPLICATE")
    risk = F.when(F.col("a_role") != F.col("b_role"), "HISTORICAL_TO_PLANTDOC_TEST").otherwise("INTERNAL_HISTORICAL")
    historical = lambda c: (F.col(c) == "training_candidate")
    return composition.perceptual_policy(s.select("first", "second", "a_target", "b_target", historical("a_role").alias("a_historical"), historical("b_role").alias("b_historical"), status.alias("status"), risk.alias("risk")).where("status is not null"))


@query("record_audit", _with(T.RECORDS) + "SELECT source_path, source_label, sha256, strlen(coalesce(text, ''))::INTEGER AS bytes, mapping_status, target_class, CASE mapping_status WHEN 'MATCHED' THEN 'APPROVED_CANDIDATE' ELSE mapping_status END AS candidate_status FROM (SELECT * REPLACE (source_label || '@' || dataset AS source_label) FROM records)")
def record_audit(spark, sf):
    r = T.records(spark, sf).withColumn("source_label", F.concat_ws("@", "source_label", "dataset"))
    body = T.table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    entries = r.join(body, "doc_id").select("source_path", "source_label", "content", F.col("sha256").alias("stored_sha256"))
    return composition.audited(entries, r.select("source_label", "mapping_status", "target_class").distinct())


@query("preparation_report", _with(T.HASHED, "kept AS (SELECT min(record_id) AS r FROM records WHERE mapping_status = 'MATCHED' GROUP BY sha256)") + "SELECT (SELECT count(*) FROM near WHERE first IN (SELECT r FROM kept) AND second IN (SELECT r FROM kept)) AS n_near, count(*) AS n_rows, count(DISTINCT source_label) AS n_labels, count(*) FILTER (mapping_status = 'MATCHED') AS n_mapped, count(DISTINCT sha256) FILTER (mapping_status = 'MATCHED') AS n_kept, count(*) FILTER (mapping_status = 'MATCHED') - count(DISTINCT sha256) FILTER (mapping_status = 'MATCHED') AS n_copies FROM records")
def preparation_report(spark, sf):
    r = T.records(spark, sf, True)
    return composition.preparation_report(r, similarity.hamming_self_join(r, 4))


@query("historical_records", _with(T.RECORDS) + "SELECT 'hist_' || substr(sha256('archive' || chr(0) || '2' || chr(0) || source_path), 1, 20) AS record_id, source_path, source_label, target_class, sha256, bytes, 'VALID' AS integrity_status, 'INCLUDE_CANDIDATE' AS candidate_status, 'false' AS benchmark_leakage FROM (SELECT *, strlen(coalesce(text, '')) AS bytes FROM records)")
def historical_records(spark, sf):
    size = T.table(spark, sf, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    files = T.records(spark, sf).join(size, "doc_id").withColumn("target_index", F.lit(0))
    return composition.initial_records(files, "archive", "2").select("record_id", "source_path", "source_label", "target_class", "sha256", "bytes", "integrity_status", "candidate_status", "benchmark_leakage")


@query("comparable_rows", _with(T.RECORDS) + "SELECT CASE WHEN role = 'locked_test' THEN record_id ELSE 'ext_' || substr(sha256(dataset || chr(0) || source_version || chr(0) || role || chr(0) || source_path), 1, 20) END AS record_id, 'V2' AS origin, sha256 FROM records")
def comparable_rows(spark, sf):
    r = T.records(spark, sf)
    return composition.comparable(r.withColumn("record_id", F.when(F.col("role") == "locked_test", F.col("record_id")).otherwise("")), "V2").select("record_id", "origin", "sha256")


@query("composition_faults", _with(COMBINED) + "SELECT (SELECT count(*) FROM (SELECT sha256 FROM inc GROUP BY sha256 HAVING count(DISTINCT source_domain) > 1)) AS collisions, (SELECT count(*) FROM (SELECT comp FROM inc GROUP BY comp HAVING count(*) > 1)) AS repeated_ids, (SELECT count(*) FROM taxonomy WHERE target_class NOT IN (SELECT target_class FROM inc)) AS missing_classes, (SELECT count(*) FROM inc WHERE contains(lower(split_part(source_path, '/', 1)), 'test')) AS test_paths")
def composition_faults(spark, sf):
    rows = _cleaned(spark, sf).where("cleaning_status = 'INCLUDE'").withColumn("composition_record_id", F.col("record_id"))
    return composition.composition_faults(rows, T.records(spark, sf).where("target_class != ''").select("target_class").distinct())


@query("policy_summary", _with(T.RECORDS) + f", s AS (SELECT *, {T.SPLIT} AS split FROM records), k AS (SELECT count(*) AS n FROM s WHERE split = 'TRAIN' GROUP BY source_label) SELECT count(*) FILTER (split = 'TRAIN') AS train_count, count(*) FILTER (split = 'VALIDATION') AS validation_count, count(*) FILTER (split = 'TRAIN' AND source_domain = 'HISTORICAL_CONTROLLED') AS historical_train_count, count(*) FILTER (split = 'TRAIN' AND source_domain = 'REAL_WORLD') AS real_world_train_count, (SELECT count(*) FROM k) AS class_count, (SELECT min(n) FROM k) AS least, (SELECT max(n) FROM k) AS most, (SELECT median(n) FROM k) AS median, (SELECT avg(n) FROM k) AS mean, (SELECT max(n) / min(n) FROM k) AS ratio FROM s")
def policy_summary(spark, sf):
    return composition.policy_summary(T.records(spark, sf).withColumn("split", T.hash_split()), "source_label")


@query("label_overrides", "SELECT d.doc_id, coalesce(l.toxic::VARCHAR, 'unlabelled') AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id UNION ALL SELECT doc_id, toxic::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def label_overrides(spark, sf):
    base = T.table(spark, sf, "documents").select("doc_id", F.lit("unlabelled").alias("label"))
    return composition.overrides(base, T.table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("string").alias("label")), "doc_id")


@query("scan_guidance", _with(T.PREDICTIONS) + """SELECT id, CASE WHEN label = 'Background without leaves' THEN 'Unknown' ELSE split_part(label, ' ', 1) END AS plant,
  CASE WHEN label = 'Background without leaves' THEN 'No leaf detected' WHEN r_name IS NOT NULL THEN r_name WHEN lower(label) LIKE '%healthy%' THEN 'Healthy plant' ELSE substr(label, strpos(label, ' ') + 1) END AS disease,
  CASE WHEN label = 'Background without leaves' THEN 'none' WHEN r_name IS NOT NULL THEN 'reference' WHEN lower(label) LIKE '%healthy%' THEN 'healthy' ELSE 'general' END AS kind
  FROM (SELECT *, CASE WHEN status = 'no_leaf' THEN 'Background without leaves' ELSE disease END AS label FROM predictions) LEFT JOIN region ON r_regionkey = class_index AND r_regionkey < 2""")
def scan_guidance(spark, sf):
    scans = T.predictions(spark, sf).select("id", "class_index", F.when(F.col("status") == "no_leaf", "Background without leaves").otherwise(F.col("disease")).alias("label"))
    metadata = T.table(spark, sf, "region").where("r_regionkey < 2").select(F.col("r_regionkey").cast("int").alias("class_index"), F.col("r_name").alias("disease_name"))
    return composition.guidance(scans, F.broadcast(metadata))  # one row a class


@query("changed_sections", "SELECT coalesce(a.section, b.section) AS section, CASE WHEN b.section IS NULL THEN 'added' WHEN a.section IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT source AS section, count(*) AS value FROM documents WHERE lang <> 'en' GROUP BY source) a FULL JOIN (SELECT source AS section, count(*) AS value FROM documents WHERE lang <> 'de' GROUP BY source) b ON a.section = b.section WHERE a.value IS DISTINCT FROM b.value")
def changed_sections(spark, sf):
    docs = T.table(spark, sf, "documents")
    side = lambda c: docs.where(c).groupBy(F.col("source").alias("section")).agg(F.count("*").alias("value"))
    return composition.changed_sections(side("lang != 'en'"), side("lang != 'de'"))


# Histories


@query("history_audit", _with(T.HISTORY) + "SELECT user_id, count(*) AS epochs, min(epoch) = 1 AND max(epoch) = count(*) AND count(DISTINCT epoch) = count(*) AS contiguous, true AS finite, arg_max(epoch, val_macro_f1 * 1e9 - epoch * 1e-3) AS best_f1_epoch, arg_min(epoch, val_loss * 1e9 + epoch * 1e-3) AS best_loss_epoch FROM history GROUP BY user_id")
def history_audit(spark, sf):
    return replay.history_audit(T.history(spark, sf), "user_id")


@query("resume_plan", _with(T.HISTORY) + ", a AS (SELECT user_id, count(*) AS epochs, arg_max(epoch, val_macro_f1 * 1e9 - epoch * 1e-3) AS f, arg_min(epoch, val_loss * 1e9 + epoch * 1e-3) AS l FROM history GROUP BY user_id) SELECT user_id, CASE WHEN epochs >= 70 THEN 'COMPLETE' WHEN f = epochs AND l = epochs THEN 'RESUME' ELSE 'RESTART' END AS plan FROM a")
def resume_plan(spark, sf):
    return replay.resume_plan(replay.history_audit(T.history(spark, sf), "user_id"), 70).select("user_id", "plan")


@query("epoch_gaps", _with(T.DAILY) + "SELECT user_id, epoch, place FROM (SELECT user_id, epoch, row_number() OVER (PARTITION BY user_id ORDER BY epoch) AS place FROM daily) WHERE place <> epoch")
def epoch_gaps(spark, sf):
    return replay.epoch_gaps(T.daily_history(spark, sf), "user_id").select("user_id", "epoch", "place")


@query("daily_audit", _with(T.DAILY) + ", a AS (SELECT user_id, count(*) AS epochs, min(epoch) = 1 AND max(epoch) = count(*) AND count(DISTINCT epoch) = count(*) AS contiguous, arg_max(epoch, val_macro_f1 * 1e9 - epoch * 1e-3) AS f, arg_min(epoch, val_loss * 1e9 + epoch * 1e-3) AS l FROM daily GROUP BY user_id) SELECT user_id, epochs, contiguous, CASE WHEN NOT contiguous THEN 'RESTART' WHEN epochs >= 28 THEN 'COMPLETE' WHEN f = epochs AND l = epochs THEN 'RESUME' ELSE 'RESTART' END AS plan FROM a")
def daily_audit(spark, sf):
    return replay.resume_plan(replay.history_audit(T.daily_history(spark, sf), "user_id"), 28).select("user_id", "epochs", "contiguous", "plan")


@query("stored_rates", _with(T.PLATEAU) + "SELECT user_id, min(epoch) AS step, 0.001::DOUBLE AS stored, arg_min(due, epoch) AS due FROM (SELECT user_id, epoch + 1 AS epoch, rate AS due FROM folded f WHERE epoch < (SELECT max(epoch) FROM history h WHERE h.user_id = f.user_id)) WHERE due <> 0.001 GROUP BY user_id")
def stored_rates(spark, sf):
    """Histories that kept the first rate throughout: the rule finds where it should have dropped."""
    rows = T.history(spark, sf).withColumn("learning_rate", F.lit(0.001))
    return replay.rate_faults(rows, "user_id", "epoch", "val_loss", "learning_rate")


@query("plateau_replay", _with(T.PLATEAU) + "SELECT user_id, epoch::INTEGER AS steps, best, wait, cooldown, rate FROM folded WHERE epoch > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY epoch DESC) = 1")
def plateau_replay(spark, sf):
    return replay.replay_plateau(T.history(spark, sf), "user_id", "epoch", "val_loss")


@query("chained_phases", _with(T.HISTORY) + ", o AS (SELECT max(epoch) AS m FROM history WHERE user_id < 75) SELECT epoch, count(*) AS n FROM (SELECT epoch FROM history WHERE user_id < 75 UNION ALL SELECT epoch + m FROM history, o WHERE user_id >= 75) GROUP BY epoch")
def chained_phases(spark, sf):
    h = T.history(spark, sf).select("user_id", "epoch")
    return replay.chained_phases(h.where("user_id < 75"), h.where("user_id >= 75")).groupBy("epoch").agg(F.count("*").alias("n"))


# Activity


@query("dashboard_counts", _with(T.PREDICTIONS) + "SELECT user_id, count(*) AS total, count(*) FILTER (status = 'healthy') AS healthy, count(*) FILTER (status = 'diseased') AS diseased, count(*) FILTER (status = 'uncertain') AS uncertain, count(*) FILTER (status = 'no_leaf') AS no_leaf, coalesce(avg(confidence), 0) AS mean_confidence FROM predictions GROUP BY user_id")
def dashboard_counts(spark, sf):
    return activity.dashboard(T.predictions(spark, sf))


@query("frequent_top3", _with(T.PREDICTIONS) + "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, disease) AS rank FROM (SELECT user_id, disease, count(*) AS n FROM predictions WHERE status = 'diseased' GROUP BY user_id, disease)) WHERE rank <= 3")
def frequent_top3(spark, sf):
    return activity.frequent(T.predictions(spark, sf))


@query("recent_rows", _with(T.PREDICTIONS) + "SELECT user_id, id, rank FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rank FROM predictions) WHERE rank <= 5")
def recent_rows(spark, sf):
    return activity.recent(T.predictions(spark, sf)).select("user_id", "id", "rank")


@query("history_page", _with(T.PREDICTIONS) + "SELECT id, created_at FROM predictions WHERE user_id = 7 ORDER BY created_at DESC, id DESC LIMIT 10 OFFSET 10")
def history_page(spark, sf):
    return activity.page(activity.own_rows(T.predictions(spark, sf), 7), 2).select("id", "created_at")


@query("prefix_join", "SELECT c AS crop, count(p_name) AS n FROM (SELECT DISTINCT string_split(p_name, ' ')[1] AS c FROM part UNION SELECT 'nothing') LEFT JOIN part ON starts_with(p_name, c || ' ') GROUP BY c")
def prefix_join(spark, sf):
    part = T.table(spark, sf, "part").select(F.col("p_name").alias("label"))
    crops = part.select(F.substring_index("label", " ", 1).alias("crop")).distinct().unionByName(spark.createDataFrame([("nothing",)], "crop string")).distinct()
    return activity.prefix_classes(part, crops)


@query("sampled_report", _with(T.PREDICTIONS) + "SELECT user_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY id) AS place FROM predictions) WHERE place <= 25 OR status = 'no_leaf'")
def sampled_report(spark, sf):
    rows = T.predictions(spark, sf).withColumn("critical", F.col("status") == "no_leaf")
    return activity.sampled_report(rows, "user_id", "id", 25, "critical").select("user_id", "id", "place")


@query("ordered_records", _with(T.RECORDS) + "SELECT record_id, dataset, source_path FROM records")
def ordered_records(spark, sf):
    return T.records(spark, sf).select("record_id", "dataset", "source_path").orderBy("record_id")


@query("split_counts", _with(T.RECORDS) + f"SELECT {T.SPLIT} AS split, count(*) AS n FROM records GROUP BY 1")
def split_counts(spark, sf):
    return T.records(spark, sf).groupBy(T.hash_split().alias("split")).agg(F.count("*").alias("n"))
