"""File sources and sinks: strict CSV, JSON and label mappings, checked caches, partitioned tables."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import IMAGE_FORMATS
from quern.plans.checks import CheckFailed, require, require_columns, require_rows, require_same, require_unique

MAPPING_VALUE = "struct<status:string,target_class:string,reason:string>"
DISEASE_FIELDS = ("index", "disease_name", "description", "possible_steps", "image_url")


def text_schema(fields: tuple[str, ...]) -> T.StructType:
    """All columns as text: hashes and ids are never read as numbers."""
    return T.StructType([T.StructField(f, T.StringType()) for f in fields])


def read_csv(spark: SparkSession, path: str, fields: tuple[str, ...], encoding: str = "UTF-8") -> DataFrame:
    """A CSV file with a header, columns as text by name, missing values as empty text; other columns are carried along."""
    found = spark.read.option("header", True).option("encoding", encoding).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    require_columns(found, fields)
    return found.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in found.columns])


def read_inventory(spark: SparkSession, path: str, fields: tuple[str, ...], identity: tuple[str, ...], record_id: Column) -> DataFrame:
    """A CSV inventory with rows, unique identities, an id and a total order."""
    rows = require_unique(require_rows(read_csv(spark, path, fields)), *identity)
    return rows.withColumn("record_id", record_id).orderBy("record_id")


def read_manifest(spark: SparkSession, path: str, fields: tuple[str, ...], rules: Mapping[str, Column], key: str = "record_id") -> DataFrame:
    """A CSV manifest whose rows all keep the rules: one pass counts what breaks them."""
    return require(require_unique(require_rows(read_csv(spark, path, fields)), key), rules)


def write_csv(df: DataFrame, path: str, fields: tuple[str, ...], order: str, single: bool = True) -> None:
    """Fixed columns in a fixed order; other columns are left out. ``single`` gathers one file, for small reports only."""
    rows = require_columns(df, fields).select(*fields, *([] if order in fields else [order]))
    rows = rows.orderBy(order) if not single else rows.coalesce(1).sortWithinPartitions(order)
    rows.select(*fields).write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document or array of a known shape; anything else fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def write_json(row: Mapping[str, object], path: str) -> None:
    """A small summary as sorted, indented JSON on the driver."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(row, f, indent=2, sort_keys=True, ensure_ascii=False)
        f.write("\n")


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of label -> (status, target_class, reason) as rows; broken entries fail."""
    body = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{MAPPING_VALUE}>", {"mode": "FAILFAST"}).alias("m"))
    rows = body.select(F.explode("m").alias("source_label", "v")).select("source_label", F.col("v.status").alias("mapping_status"), F.coalesce("v.target_class", F.lit("")).alias("target_class"), F.coalesce("v.reason", F.lit("")).alias("reason"))
    matched = F.col("mapping_status") == "MATCHED"
    return require(rows, {"known status": F.col("mapping_status").isin("MATCHED", "AMBIGUOUS", "NOT_SUPPORTED"), "target of a match": matched == (F.col("target_class") != ""), "reason": matched | (F.col("reason") != "")})


def read_reference_table(spark: SparkSession, path: str, rows: int, encoding: str = "windows-1252") -> DataFrame:
    """A small trimmed lookup table in a legacy encoding, with an exact number of rows."""
    table = read_csv(spark, path, DISEASE_FIELDS, encoding).select(*[F.trim(c).alias(c) for c in DISEASE_FIELDS])
    if table.count() != rows:
        raise CheckFailed(f"expected {rows} rows")
    return table


def scan_folder(spark: SparkSession, path: str, with_content: bool = False) -> DataFrame:
    """Image files below a folder: path, label (the first part of the path below it), format, size, time, and a content hash on demand."""
    pattern = "*.{" + ",".join(sorted(IMAGE_FORMATS)) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    known = F.create_map(*[F.lit(x) for p in IMAGE_FORMATS.items() for x in p])
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    root = path.split(":", 1)[-1].strip("/")
    below = F.split(F.substring_index(F.col("path"), f"{root}/", -1), "/")
    out = files.select("path", F.when(F.size(below) > 1, F.get(below, 0)).otherwise("").alias("label"), F.try_element_at(known, extension).alias("format"), "length", F.col("modificationTime").alias("modified"), *([F.sha2("content", 256).alias("sha256")] if with_content else []))
    return out.orderBy("path")


def cached(spark: SparkSession, path: str, keys: DataFrame, build, key: str, value: str, width: int = 16) -> DataFrame:
    """A key -> value table kept at ``path``: reused only if its keys are exactly ``keys`` and all values have the width."""
    try:
        held = spark.read.parquet(path)
        require_same(held.select(key), keys.select(key))
        return require(held, {"width": F.length(value) == width})
    except Exception as e:  # absent, unreadable or stale: build anew
        if not isinstance(e, CheckFailed) and "PATH_NOT_FOUND" not in str(e):
            raise
    build(keys).select(key, value).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """One folder for each split."""
    rows.repartition("split").write.mode("overwrite").partitionBy("split").parquet(path)


def resolved_paths(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Local file of each row where an alias names one; unsafe paths and aliases in conflict fail."""
    one = aliases.groupBy("source_path").agg(F.min("local_file").alias("local_file"), F.countDistinct("local_file").alias("_n"))
    one = require(one, {"one file an alias": F.col("_n") == 1}).drop("_n")
    path = F.coalesce("local_file", "source_path")
    safe = ~path.rlike(r"^[/\\]|^[A-Za-z]:") & ~F.exists(F.split(F.translate(path, "\\", "/"), "/"), lambda p: p == "..")
    return require(rows.join(one, "source_path", "left").withColumn("resolved", path), {"safe path": safe})


def read_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A relational table over JDBC, read in ranges of a numeric key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options)
    return reader.load()


def append_table(rows: DataFrame, url: str, table: str, **options: str) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
