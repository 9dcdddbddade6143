"""How distinctive a term is of a record, compared with the whole collection: Dunning's log-likelihood ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebody.operators.skew import TASK, fragment, plan_load
from orebody.plans.session import materialise

#: Terms in more than 1 / FREQUENT of all cells are sent to the tasks: there are at most as many.
FREQUENT = 200_000


def term_array(text: str) -> Column:
    """The maximal runs of a-z in the lower-cased text; void pieces at the ends are dropped by the caller."""
    return F.split(F.lower(text), "[^a-z]+")


def log_likelihood(a: Column, in_record: Column, in_all: Column, total: Column) -> Column:
    """G2 of the table [[a, b], [c, d]]: the term and all other terms (columns), in the record and in the rest (rows).
    Positive where the term is more frequent in the record than in the rest, negative where it is less frequent."""
    a, n1, t, n = (x.cast("double") for x in (a, in_record, in_all, total))
    b, c = n1 - a, t - a
    d = n - n1 - c

    def cell(seen: Column, row: Column, col: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen * n / (row * col))).otherwise(0.0)

    g2 = 2 * (cell(a, n1, t) + cell(b, n1, n - t) + cell(c, n - n1, t) + cell(d, n - n1, n - t))
    return F.when(a * n >= n1 * t, F.greatest(g2, F.lit(0.0))).otherwise(-F.greatest(g2, F.lit(0.0)))


def distinctive_terms(docs: DataFrame, record: str, part: str, text: str, stopwords: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """(record, term, c, m, n_record, d, n_term, n_total, llr) for every term of every record.

    A record's text is the text of all its parts; rows that agree in record and part are one part. c is the term's count
    in the record, m the largest count in the record, n_record its number of terms, d the number of records with the term,
    n_term the term's count in all records, n_total the number of all terms. llr compares the record with the rest of the
    collection; it is negative for terms that the record avoids. Rows with a null record or text are left out, a null part
    is a part like any other, records without a term give no row. stopwords has one column; blanks around a word are removed.

    Rows of a record are counted where plan_load puts them: a record above half a task's share is cut into shards by part,
    so no task gets a third of all rows. The texts are exchanged once; the counts are written once, in the order of the
    records, and only the heavy records' rows are merged again. Statistics of terms are added up before they are exchanged.
    Those of frequent terms (at most FREQUENT of them, as each has its share of the cells) are broadcast, so that no task
    gets all cells of a common word; those of all others, whose cells are few, are joined by a sort."""
    docs = docs.select(F.col(record).alias("r"), F.col(part).alias("p"), F.col(text).alias("x")).where("r is not null and x is not null")
    spark, plan = docs.sparkSession, plan_load(docs, ["r"], tasks)
    unique = fragment(docs, plan, ["p"]).dropDuplicates([TASK, "r", "p"])
    terms = unique.select(TASK, "r", F.explode(term_array("x")).alias("t")).where("t <> ''")
    if stopwords is not None:
        words = stopwords.select(F.trim(stopwords[stopwords.columns[0]]).alias("t")).where("t <> ''").distinct()
        terms = terms.join(words, "t", "left_anti")
    here = Window.partitionBy(TASK, "r")
    counted = terms.groupBy(TASK, "r", "t").agg(F.count("*").alias("c"))
    counts = materialise(counted.select("r", "t", "c", F.max("c").over(here).alias("m"), F.sum("c").over(here).alias("n")), "counts")
    if plan.heavy:
        # at most 2 * tasks records are heavy, which bounds these broadcasts
        heavy = F.broadcast(spark.createDataFrame([(k[0],) for k, _, _ in plan.heavy], docs.select("r").schema))
        merged = counts.join(heavy, "r", "left_semi").groupBy("r", "t").agg(F.sum("c").alias("c"))
        whole = F.broadcast(merged.groupBy("r").agg(F.max("c").alias("m"), F.sum("c").alias("n")))
        counts = counts.join(heavy, "r", "left_anti").unionByName(merged.join(whole, "r"))
    per_term = counts.groupBy("t").agg(F.count("*").alias("d"), F.sum("c").alias("n_term"))
    per_term = materialise(per_term, "terms")
    total, cells = per_term.agg(F.coalesce(F.sum("n_term"), F.lit(0)), F.coalesce(F.sum("d"), F.lit(0))).first()
    often = F.col("d") > cells / FREQUENT
    frequent = F.broadcast(per_term.where(often))
    rest = counts.join(frequent.select("t"), "t", "left_anti").join(per_term.where(~often).hint("shuffle_merge"), "t")
    return counts.join(frequent, "t").unionByName(rest).select(
        F.col("r").alias(record), F.col("t").alias("term"), "c", "m", F.col("n").alias("n_record"), "d", "n_term", F.lit(total).alias("n_total"),
        log_likelihood(F.col("c"), F.col("n"), F.col("n_term"), F.lit(total)).alias("llr"),
    )
