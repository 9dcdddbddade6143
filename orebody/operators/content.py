"""Content-based recommendation: term weights per business, profiles of businesses and users, and their similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebody.operators.skew import TASK, fragment, plan_load, skew_join
from orebody.plans.session import materialise


def term_weights(reviews: DataFrame, stopwords: DataFrame) -> DataFrame:
    """(business_id, word, score): max-normalised frequency times log2(businesses / businesses with the word), six decimals.

    A business's document is all its reviews; words are runs of a-z in lower case without stop words. The number of
    businesses counts all of the input, those without words too, which have no rows. Null texts and businesses are left out."""
    stops = stopwords.select(F.trim(stopwords[stopwords.columns[0]]).alias("word")).where("word is not null").distinct()
    rows = reviews.where("business_id is not null")
    n = rows.agg(F.countDistinct("business_id")).scalar()
    texts = rows.where("text is not null").select("business_id", "review_id", "text")
    plan = plan_load(texts, ["business_id"])
    words = fragment(texts, plan, ["review_id"]).select(TASK, "business_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''").join(stops, "word", "left_anti")
    # one exchange by business serves the merge of shards and the maximum; a business has at most one row per word and shard
    parts = words.groupBy(TASK, "business_id", "word").agg(F.count("*").alias("c")).repartition("business_id")
    counts = parts.groupBy("business_id", "word").agg(F.sum("c").alias("c"))
    frequency = F.col("c") / F.max("c").over(Window.partitionBy("business_id"))
    spread = counts.groupBy("word").agg(F.count("*").alias("d"))
    return counts.withColumn("tf", frequency).join(spread, "word").select("business_id", "word", F.round(F.col("tf") * F.log2(n / F.col("d")), 6).alias("score"))


def _best(df: DataFrame, group: str, n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "word"))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def business_profiles(weights: DataFrame, n: int = 200) -> DataFrame:
    """(business_id, word, score, rank): the n words of the highest weight, equal weights by word."""
    return _best(weights, "business_id", n)


def user_profiles(reviews: DataFrame, profiles: DataFrame, n: int = 600) -> DataFrame:
    """(user_id, word, score, rank): the n best of the distinct (word, score) pairs of the businesses a user reviewed; a
    word may come with several scores."""
    seen = materialise(reviews.select("user_id", "business_id").dropna().distinct(), "seen")
    words = skew_join(seen, profiles.select("business_id", "word", "score"), plan_load(seen, ["business_id"]), ["user_id"])
    return _best(words.select("user_id", "word", "score").distinct(), "user_id", n)


def content_similarity(pairs: DataFrame, users: DataFrame, businesses: DataFrame, least: float = 0.01, unknown: float = 1e-5) -> DataFrame:
    """(user_id, business_id, sim) of distinct pairs: common words over the root of the product of the numbers of words;
    `unknown` where either side has no profile; pairs below `least` are left out."""
    # a profile is bounded by its number of words, so it is one array
    u, b = users.groupBy("user_id").agg(F.collect_set("word").alias("uw")), businesses.groupBy("business_id").agg(F.collect_set("word").alias("bw"))
    wanted = pairs.select("user_id", "business_id").dropna().distinct()
    joined = wanted.join(u, "user_id", "left").join(b, "business_id", "left")
    sim = F.when(F.col("uw").isNotNull() & F.col("bw").isNotNull(), F.size(F.array_intersect("uw", "bw")) / (F.sqrt(F.size("uw")) * F.sqrt(F.size("bw")))).otherwise(unknown)
    return joined.select("user_id", "business_id", F.round(sim, 6).alias("sim")).where(F.col("sim") >= least)


def model_document(profiles: DataFrame, key: str) -> DataFrame:
    """(key, feature_vector): one row per profile, words by rank; a profile has at most a fixed number of words."""
    words = F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"])
    return profiles.groupBy(key).agg(words.alias("feature_vector"))


__all__ = ("business_profiles", "content_similarity", "model_document", "term_weights", "user_profiles")
