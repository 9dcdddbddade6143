"""Tables of a data folder, as the review-, rating-, basket-, graph-, point- and event-shaped inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def reviews(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Reviews, each review_id once: rows delivered again are equal but for the time they were loaded."""
    return table(spark, d, "train_review").select("review_id", *columns).dropDuplicates(["review_id"])


REVIEWS_SQL = """reviews AS (
    SELECT review_id, max(user_id) AS user_id, max(business_id) AS business_id, max(stars) AS stars, max(text) AS text, max(date) AS date
    FROM train_review GROUP BY review_id)"""


def businesses(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The given columns (by default all) of the record of each business that was added last."""
    columns = columns or ("name", "categories", "city", "state")
    last = F.max(F.struct("added_at", *columns)).alias("r")
    return table(spark, d, "business").where("business_id is not null").groupBy("business_id").agg(last).select("business_id", *(f"r.{c}" for c in columns))


BUSINESSES_SQL = """businesses AS (
    SELECT * EXCLUDE (k) FROM (SELECT business_id, name, categories, city, state, row_number() OVER (PARTITION BY business_id
        ORDER BY added_at DESC, name DESC NULLS LAST, categories DESC NULLS LAST, city DESC NULLS LAST, state DESC NULLS LAST) AS k
        FROM business WHERE business_id IS NOT NULL) WHERE k = 1)"""


def users(spark: SparkSession, d: str) -> DataFrame:
    """The record of each user that was added last."""
    last = F.max(F.struct("added_at", "useful", "friends")).alias("r")
    return table(spark, d, "user_info").where("user_id is not null").groupBy("user_id").agg(last).select("user_id", "r.useful", "r.friends")


USERS_SQL = """users AS (
    SELECT user_id, useful, friends FROM (SELECT *, row_number() OVER (PARTITION BY user_id
        ORDER BY added_at DESC, useful DESC NULLS LAST, friends DESC NULLS LAST) AS k FROM user_info WHERE user_id IS NOT NULL) WHERE k = 1)"""


def order_ratings(spark: SparkSession, d: str, test: bool | None = None) -> DataFrame:
    """Ratings (u, b, stars) of parts by customers, 1 to 5; a pair rated several times counts once with its most stars.

    test splits off every order whose key ends in 0 (True: those orders, False: all others)."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("u"))
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("b"), ((F.col("l_quantity").cast("int") - 1) % 5 + 1).cast("double").alias("stars"))
    if test is not None:
        lines = lines.where(F.col("l_orderkey") % 10 == 0 if test else F.col("l_orderkey") % 10 != 0)
    return lines.join(o, "l_orderkey").groupBy("u", "b").agg(F.max("stars").alias("stars"))


def order_ratings_sql(name: str, where: str = "true") -> str:
    return f"""{name} AS (
        SELECT o_custkey AS u, l_partkey AS b, max((l_quantity::INT - 1) % 5 + 1)::DOUBLE AS stars
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE {where} GROUP BY ALL)"""
