"""Queries of the operators for training data, with equivalent SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebody.llm.leaks import find_leaks, item_lengths
from orebody.llm.mixture import mixture, plan_mixture, shares
from orebody.llm.ngrams import all_records, mark_frequency, ngram_counts
from orebody.llm.pii import find_pii, mask_pii
from orebody.llm.setjoin import expand, similar_sets
from orebody.llm.terms import distinctive_terms
from orebody.llm.topn import top_n
from orebody.sources.tables import table

_TERMS_SQL = """
    r AS (SELECT business_id, review_id, max(text) AS text FROM train_review WHERE business_id IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
    stops AS (SELECT DISTINCT trim(value) AS t FROM stopwords),
    w AS (SELECT business_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM r),
    k AS (SELECT business_id, term, count(*) AS c FROM w WHERE term NOT IN (SELECT t FROM stops) GROUP BY ALL),
    e AS (SELECT *, max(c) OVER (PARTITION BY business_id) AS m, sum(c) OVER (PARTITION BY business_id)::DOUBLE AS n1,
                 count(*) OVER (PARTITION BY term) AS d, sum(c) OVER (PARTITION BY term)::DOUBLE AS t1, (SELECT sum(c) FROM k)::DOUBLE AS n FROM k)"""


def _train_terms(spark: SparkSession, d: str) -> DataFrame:
    return distinctive_terms(table(spark, d, "train_review"), "business_id", "review_id", "text", table(spark, d, "stopwords"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The operator's cells, scored as the definition of the query says; see README on the method."""
    reviews = table(spark, d, "train_review").where("business_id is not null and text is not null").select("business_id", "review_id").distinct()
    per_business = reviews.groupBy("business_id").agg(F.count("*").alias("n_reviews"))
    n = per_business.agg(F.count("*")).scalar()
    score = F.round(F.col("c") / F.col("m") * F.log2(n / F.col("d")), 6)
    best = Window.partitionBy("business_id").orderBy(F.desc("score"), "term")
    top = _train_terms(spark, d).where("d >= 2").select("business_id", "term", score.alias("score")).withColumn("k", F.row_number().over(best)).where("k <= 3")
    return top.join(per_business.where("n_reviews >= 5"), "business_id", "left_semi").select("business_id", "term")


def p1_log_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """Every term of every business with its cells and its log-likelihood ratio."""
    return _train_terms(spark, d).select("business_id", "term", "c", "d", "n_record", "n_term", F.round("llr", 4).alias("llr"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n(table(spark, d, "task3item_model"), "b1", "b2", "sim", 5).select("b1", "b2")


def p4_top_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return top_n(table(spark, d, "task3item_model"), "b1", "b2", "sim", 50)


def _business_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return similar_sets(table(spark, d, "train_review"), "business_id", "user_id", 0.5, least=5)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pairs, classes = _business_pairs(spark, d)
    return expand(pairs, classes).select(F.col("r1").alias("b1"), F.col("r2").alias("b2")).distinct()


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    """Per business of at least 5 users: its class of equal sets, and how many other businesses its set resembles."""
    pairs, classes = _business_pairs(spark, d)
    sizes = classes.groupBy("rep").agg(F.count("*").alias("members"))
    ends = pairs.select(F.col("r1").alias("rep"), F.col("r2").alias("far")).unionByName(pairs.select(F.col("r2").alias("rep"), F.col("r1").alias("far")))
    links = ends.join(sizes.select(F.col("rep").alias("far"), F.col("members").alias("n")), "far").groupBy("rep").agg(F.sum("n").alias("n"))
    per_class = sizes.join(links, "rep", "left").select("rep", (F.coalesce("n", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    return classes.join(per_class, "rep").select(F.col("r").alias("business_id"), F.col("rep").alias("class_id"), "n_links")


RARE, COMMON = 2, 0.3


def _marked(spark: SparkSession, d: str, max_n: int) -> DataFrame:
    rows = table(spark, d, "review")
    return mark_frequency(ngram_counts(rows, "review_id", "text", max_n), all_records(rows, "review_id", "text").scalar(), RARE, COMMON)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d, 1).where("mark is not null").select(F.col("gram").alias("term"), "mark")


def p7_terms(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d, 1).select(F.col("gram").alias("term"), "occurrences", "records", "mark")


def p7_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """All terms, pairs and triples of terms."""
    return _marked(spark, d, 3)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "heldout_review"), "item_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per item: its words, in how many documents it leaks, and the longest run of its words in one of them; an item of fewer
    than 13 words cannot be searched for."""
    leaked = _leaks(spark, d).groupBy("item").agg(F.count("*").alias("n_documents"), F.max("longest").alias("longest"))
    every = item_lengths(table(spark, d, "heldout_review"), "item_id", "text").join(leaked, "item", "left")
    return every.select(F.col("item").alias("item_id"), "n_words", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), "longest", (F.col("n_words") >= 13).alias("searched"))


def _mixture(spark: SparkSession, d: str):
    return plan_mixture(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_target"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).table.where("short").select("source")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    plan = _mixture(spark, d)
    return shares(plan, mixture(plan))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture's records with their texts and how often each comes."""
    chosen = mixture(_mixture(spark, d)).withColumnRenamed("id", "doc_id")
    return chosen.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_pii(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "person_name")).select(F.col("doc").alias("doc_id"), "kind", "surface").distinct()


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    return mask_pii(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "person_name")).withColumnRenamed("doc", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_log_likelihood, p4_found, p4_top_neighbours, p6_found, p6_links, p7_found, p7_terms, p7_ngrams, p8_found, p8_items, p9_found, p9_shares, p9_mixture, p10_found, p10_masked)}

_SETS_SQL = """
    m AS (SELECT DISTINCT business_id AS r, user_id AS t FROM train_review WHERE business_id IS NOT NULL AND user_id IS NOT NULL),
    z AS (SELECT r, count(*) AS n FROM m GROUP BY r HAVING count(*) >= 5),
    x AS (SELECT a.r AS r1, b.r AS r2, count(*) AS common FROM m a JOIN m b ON a.t = b.t AND a.r < b.r GROUP BY ALL),
    pairs AS (SELECT r1, r2 FROM x JOIN z p ON r1 = p.r JOIN z q ON r2 = q.r WHERE 2 * common >= p.n + q.n - common)"""

_GRAMS_SQL = f"""
    r AS (SELECT review_id, max(text) AS text FROM review WHERE text IS NOT NULL GROUP BY review_id),
    w AS (SELECT review_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM r),
    g AS (SELECT k.n, review_id, unnest(list_transform(range(1, len(w) - k.n + 2), lambda i: array_to_string(w[i:i + k.n - 1], ' '))) AS gram FROM w, (SELECT unnest([1, 2, 3]) AS n) k),
    c AS (SELECT n, gram, count(*) AS occurrences, count(DISTINCT review_id) AS records FROM g GROUP BY ALL),
    marked AS (SELECT *, CASE WHEN records <= {RARE} THEN 'rare' WHEN records > {COMMON} * (SELECT count(*) FROM r) THEN 'common' END AS mark FROM c)"""


def _top_sql(n: int, columns: str) -> str:
    return f"""
        WITH p AS (SELECT b1, b2, max(sim) AS sim FROM task3item_model WHERE b1 IS NOT NULL AND b2 IS NOT NULL AND sim IS NOT NULL AND NOT isnan(sim) GROUP BY b1, b2),
        k AS (SELECT *, row_number() OVER (PARTITION BY b1 ORDER BY sim DESC, b2) AS rank FROM p)
        SELECT {columns} FROM k WHERE rank <= {n}"""


SQL = {
    "p6_found": f"WITH {_SETS_SQL} SELECT r1 AS b1, r2 AS b2 FROM pairs",
    "p6_links": f"""WITH {_SETS_SQL}, sets AS (SELECT m.r, string_agg(t, ' ' ORDER BY t) AS s FROM m JOIN z USING (r) GROUP BY m.r),
        ends AS (SELECT r1 AS r FROM pairs UNION ALL SELECT r2 FROM pairs), k AS (SELECT r, count(*) AS n FROM ends GROUP BY r)
        SELECT r AS business_id, min(r) OVER (PARTITION BY s) AS class_id, coalesce(n, 0) AS n_links FROM sets LEFT JOIN k USING (r)""",
    "p7_found": f"WITH {_GRAMS_SQL} SELECT gram AS term, mark FROM marked WHERE n = 1 AND mark IS NOT NULL",
    "p7_terms": f"WITH {_GRAMS_SQL} SELECT gram AS term, occurrences, records, mark FROM marked WHERE n = 1",
    "p7_ngrams": f"WITH {_GRAMS_SQL} SELECT n, gram, occurrences, records, mark FROM marked",
    "p1_found": f"""
        WITH {_TERMS_SQL},
        b AS (SELECT business_id, count(*) AS reviews FROM r GROUP BY business_id),
        s AS (SELECT business_id, term, round(c / m * log2((SELECT count(*) FROM b) / d), 6) AS score FROM e WHERE d >= 2),
        top AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY score DESC, term) AS place FROM s)
        SELECT business_id, term FROM top JOIN b USING (business_id) WHERE place <= 3 AND reviews >= 5""",
    "p1_log_likelihood": f"""
        WITH {_TERMS_SQL},
        g AS (SELECT *, c::DOUBLE AS o11, n1 - c AS o12, t1 - c AS o21, n - n1 - t1 + c AS o22 FROM e),
        l AS (SELECT *, 2 * (o11 * ln(o11 * n / (n1 * t1))
                + CASE WHEN o12 > 0 THEN o12 * ln(o12 * n / (n1 * (n - t1))) ELSE 0 END
                + CASE WHEN o21 > 0 THEN o21 * ln(o21 * n / ((n - n1) * t1)) ELSE 0 END
                + CASE WHEN o22 > 0 THEN o22 * ln(o22 * n / ((n - n1) * (n - t1))) ELSE 0 END) AS g2 FROM g)
        SELECT business_id, term, c, d, n1::BIGINT AS n_record, t1::BIGINT AS n_term,
               round(CASE WHEN c * n >= n1 * t1 THEN greatest(g2, 0) ELSE -greatest(g2, 0) END, 4) AS llr FROM l""",
    # words and signs stand for tokens: the cases are the same for every usual tokenizer
    "p9_found": """
        WITH s AS (SELECT lower(trim(source)) AS source, sum(len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+|[^\\p{L}\\p{N}\\s]'))) AS n FROM documents GROUP BY 1),
        g AS (SELECT lower(trim(source)) AS source, sum(weight) AS weight, max(max_repeat) AS most FROM mix_target GROUP BY 1)
        SELECT g.source FROM g LEFT JOIN s USING (source) WHERE coalesce(s.n, 0) * most < weight * (SELECT sum(n) FROM s)""",
    "p4_found": _top_sql(5, "b1, b2"),
    "p4_top_neighbours": _top_sql(50, "b1, b2, sim, rank"),
}
