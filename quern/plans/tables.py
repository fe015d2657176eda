"""The library's entities over the supplied tables: records, predictions and model outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.keys import record_id, step_hash
from quern.functions.text import scan_status
from quern.operators.metrics import argmax


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str, with_hash: bool = False) -> DataFrame:
    """Documents as records of a data set; columns of the text are computed only where a plan uses them."""
    text = F.coalesce("text", F.lit(""))
    source = F.col("source")
    status = F.when(source == "src3", "AMBIGUOUS").when(source == "src7", "NOT_SUPPORTED").otherwise("MATCHED")
    out = table(spark, sf_dir, "documents").select(
        "doc_id",
        source.alias("dataset"),
        F.lit("1").alias("source_version"),
        F.when(source == "src19", "locked_test").otherwise("training_candidate").alias("role"),
        F.when(source.isin("src1", "src2"), F.concat_ws("/", "lang", source)).otherwise(F.col("lang")).alias("source_label"),
        status.alias("mapping_status"),
        F.when(status == "MATCHED", F.col("lang")).otherwise("").alias("target_class"),
        F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_path"),
        F.when(source.isin("src0", "src1", "src2", "src3", "src4"), "REAL_WORLD").otherwise("HISTORICAL_CONTROLLED").alias("source_domain"),
        F.sha2(text, 256).alias("sha256"),
        (F.length(text) % 400 + 50).alias("width"),
        (F.size(F.split(text, " ")) % 300 + 50).alias("height"),
        *([step_hash(F.transform(F.split(text, " "), lambda w: F.length(w))).alias("hash")] if with_hash else []),
    )
    return out.withColumn("record_id", record_id("dataset", "source_version", "role", "source_path"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as classified scans of a user."""
    index, confidence = F.length("event_type") % 6, F.least(F.col("value"), F.lit(100.0))
    label = F.when(F.col("event_type") == "view", "Leaf healthy").otherwise(F.concat_ws(" ", F.lit("Leaf"), "event_type"))
    status = scan_status(index, label, confidence)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"), label.alias("disease"), index.alias("class_index"), confidence.alias("confidence"), status.alias("status"))


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as score vectors: (id, t, a, b, confidence) of two models over ten classes."""
    scores = F.col("embedding")
    worst = (F.array_position(scores, F.array_min(scores)) - 1).cast("int")
    confidence = F.round(F.least(F.lit(100.0), F.array_max(scores).cast("double") * 250), 6)
    return table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null").select(F.col("vec_id").alias("id"), F.col("label").alias("t"), (argmax(scores) % 10).alias("a"), (worst % 10).alias("b"), confidence.alias("confidence"))


def classes(spark: SparkSession, n: int = 10) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("c"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as training histories: one per user, an epoch per event in order of time."""
    epoch = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("user_id", epoch.alias("epoch"), (F.col("value") / 500).alias("val_macro_f1"), F.col("value").alias("val_loss"), (F.col("value") / 1000).alias("macro_recall"))


def daily_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as histories with holes: a user's epochs are the days on which something happened, counted from the first."""
    day = F.to_date("ts")
    days = table(spark, sf_dir, "events").groupBy("user_id", day.alias("day")).agg(F.max("value").alias("val_loss"), (F.max("value") / 500).alias("val_macro_f1"))
    first = Window.partitionBy("user_id")
    return days.select("user_id", (F.datediff("day", F.min("day").over(first)) + 1).cast("long").alias("epoch"), "val_macro_f1", "val_loss")


def hash_split() -> Column:
    """A repeatable split by the content hash."""
    digit = F.substring("sha256", 1, 1)
    return F.when(digit == "0", "TEST").when(digit == "1", "VALIDATION").otherwise("TRAIN")


# The same entities for DuckDB.
RECORDS = """records AS (
  SELECT *, 'rec_' || substr(sha256(dataset || chr(0) || source_version || chr(0) || role || chr(0) || source_path), 1, 20) AS record_id FROM (
    SELECT doc_id, text, source AS dataset, '1' AS source_version,
      CASE WHEN source = 'src19' THEN 'locked_test' ELSE 'training_candidate' END AS role,
      CASE WHEN source IN ('src1', 'src2') THEN lang || '/' || source ELSE lang END AS source_label,
      CASE WHEN source = 'src3' THEN 'AMBIGUOUS' WHEN source = 'src7' THEN 'NOT_SUPPORTED' ELSE 'MATCHED' END AS mapping_status,
      CASE WHEN source IN ('src3', 'src7') THEN '' ELSE lang END AS target_class,
      lang || '/' || doc_id || '.txt' AS source_path,
      CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN 'REAL_WORLD' ELSE 'HISTORICAL_CONTROLLED' END AS source_domain,
      sha256(coalesce(text, '')) AS sha256, length(coalesce(text, '')) % 400 + 50 AS width,
      len(string_split(coalesce(text, ''), ' ')) % 300 + 50 AS height
    FROM documents))"""

HASHED = RECORDS + """, hashed AS (
  SELECT * FROM (SELECT *, CASE WHEN len(l) >= 65 THEN list_sum(list_transform(range(64), lambda i: CASE WHEN l[i + 2] > l[i + 1] THEN (1::HUGEINT << i) ELSE 0::HUGEINT END))::UBIGINT END AS h
    FROM (SELECT *, list_transform(string_split(coalesce(text, ''), ' '), lambda w: length(w)) AS l FROM records)) WHERE h IS NOT NULL
), near AS (
  SELECT least(a.record_id, b.record_id) AS first, greatest(a.record_id, b.record_id) AS second, bit_count(xor(a.h, b.h)) AS distance
  FROM hashed a JOIN hashed b ON a.record_id < b.record_id AND a.sha256 <> b.sha256 WHERE bit_count(xor(a.h, b.h)) <= 4
)"""

CATEGORY = """CASE WHEN a.role <> b.role THEN 'TRAIN_TO_LOCKED_BENCHMARK'
  WHEN a.role = 'training_candidate' AND a.target_class <> '' AND b.target_class <> '' AND a.target_class <> b.target_class THEN 'DIFFERENT_TARGET'
  WHEN a.target_class <> '' AND a.target_class = b.target_class AND a.dataset = b.dataset THEN 'SAME_TARGET_SAME_SOURCE'
  WHEN a.target_class <> '' AND a.target_class = b.target_class THEN 'SAME_TARGET_CROSS_SOURCE' ELSE 'OTHER' END"""

PAIRS = HASHED + f""", pairs AS (
  SELECT n.*, a.role AS a_role, b.role AS b_role, a.width AS a_width, a.height AS a_height, b.width AS b_width, b.height AS b_height, {CATEGORY} AS category
  FROM near n JOIN records a ON a.record_id = n.first JOIN records b ON b.record_id = n.second)"""

COMPONENTS = PAIRS.replace("records AS", "RECURSIVE records AS", 1) + """, sym AS (SELECT first AS a, second AS b FROM near UNION SELECT second, first FROM near
), walk AS (SELECT a AS v, a AS r FROM sym UNION SELECT w.v, s.b FROM walk w JOIN sym s ON s.a = w.r
), parts AS (SELECT v, min(r) AS component FROM walk GROUP BY v)"""

#: In ascending order, a vertex represents a group unless a smaller neighbour does; others join their least representative.
ANCHORED = PAIRS.replace("records AS", "RECURSIVE records AS", 1) + """, sym AS (SELECT first AS a, second AS b FROM near UNION SELECT second, first FROM near
), numbered AS (SELECT a AS v, row_number() OVER (ORDER BY a) AS k, list(b) FILTER (WHERE b < a) AS smaller FROM sym GROUP BY a
), chosen_walk AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS chosen
  UNION ALL SELECT n.k, CASE WHEN coalesce(list_has_any(n.smaller, w.chosen), false) THEN w.chosen ELSE list_append(w.chosen, n.v) END FROM chosen_walk w JOIN numbered n ON n.k = w.k + 1
), chosen AS (SELECT unnest(chosen) AS c FROM chosen_walk WHERE k = (SELECT max(k) FROM chosen_walk)
), joined AS (SELECT a AS v, min(b) AS representative FROM sym JOIN chosen ON c = b WHERE a NOT IN (SELECT c FROM chosen) GROUP BY a
), members AS (SELECT * FROM joined UNION ALL SELECT DISTINCT representative, representative FROM joined
), risk AS (SELECT representative, count(*) AS members, CASE WHEN bool_or(role = 'locked_test') THEN 'VERIFIED_BENCHMARK_LEAKAGE'
    WHEN count(DISTINCT CASE WHEN role = 'training_candidate' AND target_class <> '' THEN target_class END) > 1 THEN 'VERIFIED_LABEL_CONFLICT' ELSE 'VERIFIED_NEAR_DUPLICATE' END AS risk
  FROM members JOIN records ON record_id = v GROUP BY representative)"""

GROUPS = """g AS (SELECT sha256, count(*) AS member_count, count(DISTINCT role) > 1 AS cross_role, bool_or(role = 'locked_test') AS touches_locked_test,
  (count(DISTINCT source_label) > 1 OR count(DISTINCT nullif(target_class, '')) > 1) AS label_conflict,
  count(DISTINCT nullif(target_class, '')) > 1 AS target_conflict, min(record_id) AS first_record_id FROM records GROUP BY sha256 HAVING count(*) > 1)"""

PREDICTIONS = """predictions AS (
  SELECT event_id AS id, user_id, ts AS created_at, CASE WHEN event_type = 'view' THEN 'Leaf healthy' ELSE 'Leaf ' || event_type END AS disease,
    length(event_type) % 6 AS class_index, least(value, 100.0) AS confidence,
    CASE WHEN length(event_type) % 6 = 4 THEN 'no_leaf' WHEN least(value, 100.0) < 60 THEN 'uncertain' WHEN event_type = 'view' THEN 'healthy' ELSE 'diseased' END AS status
  FROM events)"""

OUTPUTS = """outputs AS (
  SELECT vec_id AS id, label AS t, (list_position(embedding, list_max(embedding)) - 1) % 10 AS a, (list_position(embedding, list_min(embedding)) - 1) % 10 AS b,
    round(least(100.0, list_max(embedding)::DOUBLE * 250), 6) AS confidence FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)"""

HISTORY = """history AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value / 500 AS val_macro_f1, value AS val_loss, value / 1000 AS macro_recall FROM events)"""

DAILY = """daily AS (SELECT user_id, (date_diff('day', min(day) OVER (PARTITION BY user_id), day) + 1)::BIGINT AS epoch, val_macro_f1, val_loss
  FROM (SELECT user_id, ts::DATE AS day, max(value) AS val_loss, max(value) / 500 AS val_macro_f1 FROM events GROUP BY ALL))"""

#: The plateau rule as a recursion over each history: the state after every epoch.
PLATEAU = HISTORY.replace("history AS", "RECURSIVE history AS", 1) + """, folded AS (
  SELECT user_id, 0::BIGINT AS epoch, 'inf'::DOUBLE AS best, 0 AS wait, 0 AS cooldown, 1e-3::DOUBLE AS rate FROM (SELECT DISTINCT user_id FROM history)
  UNION ALL SELECT user_id, epoch, CASE WHEN better THEN val_loss ELSE best END, CASE WHEN better OR drops THEN 0 ELSE waits END, CASE WHEN drops THEN 1 ELSE left_ END, CASE WHEN drops THEN greatest(rate * 0.5, 1e-6) ELSE rate END
  FROM (SELECT *, counts AND waits >= 2 AND rate > 1e-6 AS drops FROM (SELECT *, NOT better AND left_ <= 0 AS counts, waited + (NOT better AND left_ <= 0)::INTEGER AS waits FROM (
    SELECT h.user_id, h.epoch, h.val_loss, f.best, f.rate, h.val_loss < f.best - 1e-4 AS better, CASE WHEN f.cooldown > 0 THEN f.cooldown - 1 ELSE 0 END AS left_, CASE WHEN f.cooldown > 0 THEN 0 ELSE f.wait END AS waited
    FROM folded f JOIN history h ON h.user_id = f.user_id AND h.epoch = f.epoch + 1))))"""

SPLIT = "CASE substr(sha256, 1, 1) WHEN '0' THEN 'TEST' WHEN '1' THEN 'VALIDATION' ELSE 'TRAIN' END"
