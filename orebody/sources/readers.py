"""Sources: JSON lines, CSV pairs and points, word lists, and stored models."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REVIEW = "review_id string, user_id string, business_id string, stars double, text string, date string"
BUSINESS = "business_id string, name string, categories string, city string, state string"
USER = "user_id string, useful bigint, friends string"
PAIRS = "user_id string, business_id string"
CONTENT_MODEL = "business array<struct<business_id string, feature_vector array<string>>>, user array<struct<user_id string, feature_vector array<string>>>"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of one JSON object per line; a missing field is null, a broken line a row of nulls."""
    return spark.read.schema(schema).json(path)


def csv_pairs(spark: SparkSession, path: str, schema: str = PAIRS) -> DataFrame:
    """A CSV with a header."""
    return spark.read.option("header", True).schema(schema).csv(path)


def csv_points(spark: SparkSession, folder: str) -> DataFrame:
    """(round, id, vec) from headerless CSV files of id and coordinates. What lies in the folder, files or folders of part
    files, is a round each, in the order of names."""
    parts = F.split("value", ",")
    name = F.regexp_extract("_metadata.file_path", "/" + re.escape(folder.rstrip("/").rpartition("/")[2]) + "/([^/]+)", 1)
    lines = spark.read.option("recursiveFileLookup", True).text(folder).select(name.alias("file"), parts[0].cast("bigint").alias("id"), F.transform(F.slice(parts, 2, 1 << 20), lambda x: x.cast("double")).alias("vec"))
    files = lines.select("file").distinct().withColumn("round", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("file")) - 1)  # one row per round
    return lines.join(F.broadcast(files), "file").select("round", "id", "vec")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines without blanks at the ends."""
    return spark.read.text(path).select(F.trim("value").alias("value"))


def content_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(users, businesses) with one row per word of a profile, from one document of two lists."""
    doc = spark.read.schema(CONTENT_MODEL).option("multiLine", True).json(path)
    sides = []
    for side, key in (("user", "user_id"), ("business", "business_id")):
        rows = doc.select(F.explode(side).alias("r")).select(f"r.{key}", F.explode("r.feature_vector").alias("word"))
        sides.append(rows)
    return sides[0], sides[1]


def similarity_model(spark: SparkSession, path: str, a: str = "b1", b: str = "b2") -> DataFrame:
    return spark.read.schema(f"{a} string, {b} string, sim double").json(path)


def average_map(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, avg) from one JSON object of averages."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,double>").alias("m"))
    return whole.select(F.explode("m").alias(key, "avg"))


def itemset_text(spark: SparkSession, path: str) -> DataFrame:
    """(items) from lines of items joined by commas."""
    return spark.read.text(path).where("trim(value) <> ''").select(F.array_sort(F.transform(F.split("value", ","), lambda x: F.trim(x))).alias("items"))
