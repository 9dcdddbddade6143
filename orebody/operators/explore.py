"""Exploration of reviews: counts, top users and words, averages per category, partition reports, extracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.operators.packed import explode_packed

# The signs that are taken out of words.
PUNCTUATION = "([,.!?:;])"


def strip_punctuation(word: Column) -> Column:
    return F.translate(word, PUNCTUATION, "")


def review_counts(reviews: DataFrame, year: str, date: str = "date", user: str = "user_id") -> DataFrame:
    """One row: reviews, reviews whose date contains the year, distinct non-null users; zeros for an empty table."""
    return reviews.agg(F.count("*").alias("n_reviews"), F.count_if(F.col(date).contains(year)).alias("n_year"), F.countDistinct(user).alias("n_users"))


def top_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent non-null keys with their counts, equal counts by key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(n)


def top_words(reviews: DataFrame, text: str, stopwords: DataFrame, n: int) -> DataFrame:
    """The n most frequent words: lower case, split at single blanks, stop words dropped before punctuation is taken out
    (so a stop word with a comma stays), and what is left may be empty. Null texts have no words."""
    stops = stopwords.select(F.trim(stopwords[stopwords.columns[0]]).alias("w")).where("w is not null").distinct()
    raw = reviews.where(F.col(text).isNotNull()).select(F.explode(F.split(F.lower(text), " ")).alias("w"))
    words = raw.groupBy("w").agg(F.count("*").alias("n")).join(stops, "w", "left_anti")
    return words.groupBy(strip_punctuation(F.col("w")).alias("word")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(n)


def category_averages(reviews: DataFrame, businesses: DataFrame) -> DataFrame:
    """(category, avg, n): average stars over all reviews of the businesses in a category, to one decimal, half up.

    Sums per business come first, so what meets the categories is one row per business. A category that a business names
    twice counts twice. Businesses without categories, reviews without stars or business, count for nothing."""
    per = reviews.where("stars is not null and business_id is not null").groupBy("business_id").agg(F.sum(F.col("stars").cast("decimal(18,4)")).alias("s"), F.count("*").alias("c"))
    named = explode_packed(businesses, "categories", ["business_id"], "category")
    sums = named.join(per, "business_id").groupBy("category").agg(F.sum("s").alias("s"), F.sum("c").alias("n"))
    tenths = F.floor((F.col("s") * 20 + F.col("n")) / (F.col("n") * 2)).cast("double")
    return sums.select("category", (tenths / 10).alias("avg"), "n")


def comma_averages(reviews: DataFrame, businesses: DataFrame) -> DataFrame:
    """As category_averages where commas alone separate the categories and blanks around them are trimmed."""
    per = reviews.where("stars is not null and business_id is not null").groupBy("business_id").agg(F.sum(F.col("stars").cast("decimal(18,4)")).alias("s"), F.count("*").alias("c"))
    named = businesses.where("categories is not null").select("business_id", F.explode(F.split("categories", ",")).alias("c0")).select("business_id", F.regexp_replace(F.regexp_replace("c0", r"(?U)^\s+", ""), r"(?U)\s+$", "").alias("category"))
    sums = named.join(per, "business_id").groupBy("category").agg(F.sum("s").alias("s"), F.sum("c").alias("n"))
    tenths = F.floor((F.col("s") * 20 + F.col("n")) / (F.col("n") * 2)).cast("double")
    return sums.select("category", (tenths / 10).alias("avg"), "n")


def first_letter_partition(key: str, n: int) -> Column:
    """The partition of a key by its first character's code; a null or empty key is in partition 0."""
    return F.coalesce(F.ascii(F.substring(F.col(key), 1, 1)), F.lit(0)) % n


def custom_partitioned(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.repartitionById(n, first_letter_partition(key, n))


def partition_report(df: DataFrame, n: int) -> DataFrame:
    """(partition, n_rows) of df as it lies, with zeros for partitions without rows."""
    counted = df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("c"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("partition"))
    return every.join(F.broadcast(counted), "partition", "left").select("partition", F.coalesce("c", F.lit(0)).alias("n_rows"))


def keys_above(df: DataFrame, key: str, n: int) -> DataFrame:
    """(key, n) of non-null keys with strictly more than n rows."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > n)


def extract(reviews: DataFrame, businesses: DataFrame, condition: Column) -> DataFrame:
    """(user_id, business_id) of reviews of the businesses that meet the condition."""
    return reviews.join(businesses.where(condition).select("business_id"), "business_id", "left_semi").select("user_id", "business_id")


def report(parts: dict[str, DataFrame]) -> DataFrame:
    """One row (name, value) for each small result, as a JSON list of its rows."""
    each = [df.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*df.columns)))).alias("value")).select(F.lit(k).alias("name"), "value") for k, df in parts.items()]
    return reduce(DataFrame.unionByName, each)
