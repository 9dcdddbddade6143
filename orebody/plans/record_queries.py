"""Queries of the operators on packed fields, skewed keys and references, with equivalent SQL where there is one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.operators.orphans import classify_references, intervals
from orebody.operators.packed import explode_packed
from orebody.operators.skew import fragment, key_shares, plan_load, skew_aggregate, skew_join
from orebody.sources.tables import table

MIN_SHARE = 0.02


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return explode_packed(table(spark, d, "business"), "categories", ["business_id"], "category").distinct()


def p2_category_counts(spark: SparkSession, d: str) -> DataFrame:
    """Businesses and places per category name, in lower case."""
    names = explode_packed(table(spark, d, "business"), "categories", ["business_id"], "category").withColumn("category", F.lower("category"))
    each = names.groupBy("category", "business_id").agg(F.min("pos").alias("first"))
    return each.groupBy("category").agg(F.count("*").alias("n_business"), F.min("first").alias("first_pos"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "train_review")
    total = rows.count()
    each = [
        key_shares(rows.select(k, "review_id", "loaded_at"), k, ["review_id", "loaded_at"]).where(F.col("n") >= MIN_SHARE * total).select(F.lit(k).alias("key_field"), F.col(k).alias("key_value"))
        for k in ("business_id", "user_id")
    ]
    return reduce(DataFrame.unionByName, each)


def _results(spark: SparkSession, d: str, key: str, parent: str, attribute: str) -> DataFrame:
    """Per key: reviews, rated reviews, sum of stars, and what the parent table says of it; repeated rows count once."""
    rows = table(spark, d, "train_review").select(key, "review_id", "stars")
    known = table(spark, d, parent).groupBy(key).agg(F.max(attribute).alias(attribute), F.count("*").alias("n_records"))
    plan = plan_load(rows, [key])
    joined = skew_join(rows, known, plan, ["review_id"], "left")
    partial = [
        F.count("*").alias("n_reviews"), F.count("stars").alias("n_rated"), F.sum(F.col("stars").cast("decimal(12,4)")).alias("stars"),
        F.max(attribute).alias(attribute), F.max("n_records").alias("n_records"),
    ]
    final = [
        F.sum("n_reviews").alias("n_reviews"), F.sum("n_rated").alias("n_rated"), F.sum("stars").cast("double").alias("sum_stars"),
        F.max(attribute).alias(attribute), F.coalesce(F.max("n_records"), F.lit(0)).cast("bigint").alias("n_records"),
    ]
    return skew_aggregate(joined, plan, partial, final, unique=["review_id"])


def _results_sql(key: str, parent: str, attribute: str) -> str:
    return f"""
        WITH r AS (SELECT {key}, review_id, max(stars) AS stars FROM train_review WHERE {key} IS NOT NULL GROUP BY ALL),
        k AS (SELECT {key}, max({attribute}) AS {attribute}, count(*) AS n_records FROM {parent} GROUP BY {key})
        SELECT r.{key}, count(*) AS n_reviews, count(stars) AS n_rated, sum(stars) AS sum_stars,
               max(k.{attribute}) AS {attribute}, coalesce(max(k.n_records), 0) AS n_records
        FROM r LEFT JOIN k ON r.{key} = k.{key} GROUP BY r.{key}"""


def p3_business_results(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d, "business_id", "business", "name")


def p3_user_results(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d, "user_id", "user_info", "useful")


def p3_business_terms(spark: SparkSession, d: str) -> DataFrame:
    """Per business: the words of all its texts, counted in balanced tasks (a per-key result whose work lies in the rows)."""
    rows = table(spark, d, "train_review").select("business_id", "review_id", "text")
    plan = plan_load(rows, ["business_id"])
    placed = fragment(rows, plan, ["review_id"])
    words = F.aggregate(F.split(F.coalesce("text", F.lit("")), " "), F.lit(0), lambda n, w: n + F.when(w != "", 1).otherwise(0))
    return skew_aggregate(placed.dropDuplicates(["__task", "business_id", "review_id"]).withColumn("w", words), plan, [F.sum("w").alias("w"), F.max("w").alias("m")], [F.sum("w").alias("n_words"), F.max("m").alias("longest")])


REFERENCES = (("user_id", "user_info"), ("business_id", "business"))


def _references(spark: SparkSession, d: str) -> DataFrame:
    """Distinct references of test_review with their status."""
    rows = table(spark, d, "test_review")
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("ref_field"), F.col(k).alias("ref_key")) for k, _ in REFERENCES)))
    refs = rows.select("review_id", "arrived_at", each.alias("r")).select("review_id", "arrived_at", "r.*")
    parents = [intervals(table(spark, d, t), k).select(F.lit(k).alias("ref_field"), "*") for k, t in REFERENCES]
    return classify_references(refs, reduce(DataFrame.unionByName, parents), ["ref_field", "ref_key"], "arrived_at", ["review_id"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    bad = _references(spark, d).where("status <> 'ok'")
    return bad.select("review_id", "ref_field", F.date_format("arrived_at", "yyyy-MM").alias("arrived_month")).distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """References per field, table and month of arrival: how many in all, and how many of each status."""
    refs = _references(spark, d).withColumn("arrived_month", F.date_format("arrived_at", "yyyy-MM"))
    tables = F.create_map(*(F.lit(x) for pair in REFERENCES for x in pair))
    unique = refs.groupBy("ref_field", "ref_key", "review_id", "arrived_at", "arrived_month", "status").agg(F.lit(1).alias("one"))
    return unique.groupBy("ref_field", tables[F.col("ref_field")].alias("ref_table"), "arrived_month").agg(
        F.count("*").alias("n_references"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("missing", "deleted", "late"))
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_category_counts, p3_found, p3_business_results, p3_user_results, p3_business_terms, p5_found, p5_report)}

_REFS_SQL = """
    refs AS (
        SELECT DISTINCT * FROM (
            SELECT review_id, 'user_id' AS ref_field, user_id AS ref_key, arrived_at FROM test_review
            UNION ALL SELECT review_id, 'business_id', business_id, arrived_at FROM test_review) WHERE ref_key IS NOT NULL),
    parents AS (
        SELECT DISTINCT 'user_id' AS ref_field, user_id AS ref_key, added_at, removed_at FROM user_info
        UNION ALL SELECT DISTINCT 'business_id', business_id, added_at, removed_at FROM business),
    judged AS (
        SELECT r.*, coalesce(bool_or(p.added_at <= r.arrived_at AND (p.removed_at IS NULL OR r.arrived_at < p.removed_at)), false) AS ok,
               count(p.ref_key) > 0 AS known, coalesce(bool_or(p.removed_at <= r.arrived_at), false) AS gone
        FROM refs r LEFT JOIN parents p ON r.ref_field = p.ref_field AND r.ref_key = p.ref_key GROUP BY ALL)"""

SQL = {
    "p3_found": f"""
        SELECT 'business_id' AS key_field, business_id AS key_value FROM train_review WHERE business_id IS NOT NULL
        GROUP BY business_id HAVING count(*) >= {MIN_SHARE} * (SELECT count(*) FROM train_review)
        UNION ALL SELECT 'user_id', user_id FROM train_review WHERE user_id IS NOT NULL
        GROUP BY user_id HAVING count(*) >= {MIN_SHARE} * (SELECT count(*) FROM train_review)""",
    "p3_business_results": _results_sql("business_id", "business", "name"),
    "p3_user_results": _results_sql("user_id", "user_info", "useful"),
    "p3_business_terms": """
        WITH r AS (SELECT business_id, review_id, max(text) AS text FROM train_review WHERE business_id IS NOT NULL GROUP BY ALL),
        w AS (SELECT business_id, len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')) AS w FROM r)
        SELECT business_id, sum(w)::BIGINT AS n_words, max(w)::INTEGER AS longest FROM w GROUP BY business_id""",
    "p5_found": f"""
        WITH {_REFS_SQL}
        SELECT DISTINCT review_id, ref_field, strftime(arrived_at, '%Y-%m') AS arrived_month FROM judged WHERE NOT ok""",
    "p5_report": f"""
        WITH {_REFS_SQL}
        SELECT ref_field, CASE ref_field WHEN 'user_id' THEN 'user_info' ELSE 'business' END AS ref_table,
               strftime(arrived_at, '%Y-%m') AS arrived_month, count(*) AS n_references,
               count(*) FILTER (NOT ok AND NOT known) AS n_missing, count(*) FILTER (NOT ok AND known AND gone) AS n_deleted,
               count(*) FILTER (NOT ok AND known AND NOT gone) AS n_late
        FROM judged GROUP BY ALL""",
}
