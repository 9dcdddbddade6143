"""Set similarity: MinHash signatures, banding, exact Jaccard, and the quality of the former against the latter."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebody.operators import grid
from orebody.operators.numbering import dense_index
from orebody.operators.skew import TASK, plan_load, skew_join
from orebody.plans.session import materialise


def hash_family(n: int, high: int, seed: int) -> list[tuple[int, int]]:
    """n pairs (a, b) between 1 and high, from a seed."""
    r = random.Random(seed)
    return [(r.randint(1, high), r.randint(1, high)) for _ in range(n)]


def signatures(df: DataFrame, record: str, member: str, family: Sequence[tuple[int, int]], p: int, m: int) -> DataFrame:
    """(record, i, h): the least value of each function ((a * x + b) mod p) mod m over the numbers x of a record's members.

    All functions are computed in one pass and minimised before the exchange; nulls are no members and no records."""
    pairs = materialise(df.select(F.col(record).alias("r"), F.col(member).alias("t")).dropna(), "pairs")
    numbered = skew_join(pairs, dense_index(pairs, "t"), plan_load(pairs, ["t"]), ["r"])
    least = numbered.groupBy("r").agg(*(F.min(((F.lit(a) * F.col("idx") + F.lit(b)) % p) % m).alias(f"h{i}") for i, (a, b) in enumerate(family)))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.col(f"h{i}").alias("h")) for i in range(len(family)))))
    return least.select(F.col("r").alias(record), each.alias("s")).select(record, "s.i", "s.h")


def candidates(sig: DataFrame, record: str, rows_per_band: int = 1) -> DataFrame:
    """Distinct (r1, r2), r1 < r2, with equal hashes in all rows of some band. Buckets that hold many records are cut into
    shards on one side of the join, so no task joins a whole hot bucket."""
    banded = sig.select(F.col(record).alias("r"), F.floor(F.col("i") / rows_per_band).alias("band"), "i", "h")
    if rows_per_band == 1:
        keyed = banded.select("band", F.col("h").cast("string").alias("bucket"), "r")
    else:
        keyed = banded.groupBy("r", "band").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"].cast("string")), " ").alias("bucket")).select("band", "bucket", "r")
    keyed = materialise(keyed, "buckets")
    plan = plan_load(keyed, ["band", "bucket"])
    left, right = keyed.withColumnRenamed("r", "r1"), keyed.withColumnRenamed("r", "r2")
    return skew_join(left, right, plan, ["r1"]).where("r1 < r2").select("r1", "r2").distinct()


def jaccard_of(pairs: DataFrame, df: DataFrame, record: str, member: str, threshold: float) -> DataFrame:
    """(r1, r2, sim) of the given pairs whose exact Jaccard similarity reaches the threshold, counted by joins: of each pair the
    smaller set is looked up in the larger one, or, where that is less to do, all meetings of records are counted and those
    of the pairs kept."""
    sets = materialise(df.select(F.col(record).alias("r"), F.col(member).alias("t")).dropna().distinct(), "sets")
    size = sets.groupBy("r").agg(F.count("*").alias("n"))
    pairs = materialise(pairs.select("r1", "r2"), "pairs")
    mean = size.agg(F.coalesce(F.avg("n"), F.lit(0.0))).first()[0]
    if _pairs_in(sets) < pairs.count() * mean:
        shared = shared_members(sets, "r", "t").join(pairs, ["r1", "r2"], "left_semi")
    else:
        shared = _common(pairs, sets, size)
    return _similarity(shared, size, threshold)


def _common(pairs: DataFrame, sets: DataFrame, size: DataFrame) -> DataFrame:
    """(r1, r2, common) of the pairs (r1 < r2) with a member in common; a record of many pairs is spread over tasks."""
    sized = pairs.join(size.toDF("r1", "n1"), "r1").join(size.toDF("r2", "n2"), "r2")
    first = F.col("n1") <= F.col("n2")
    near = materialise(sized.select(F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("a"), F.when(first, F.col("r2")).otherwise(F.col("r1")).alias("b")), "near")
    both = skew_join(near, sets.withColumnRenamed("r", "a"), plan_load(near, ["a"]), ["b"]).join(sets.withColumnRenamed("r", "b"), ["b", "t"])
    counted = both.groupBy("a", "b").agg(F.count("*").alias("common"))
    return counted.select(F.least("a", "b").alias("r1"), F.greatest("a", "b").alias("r2"), "common")


def _similarity(shared: DataFrame, size: DataFrame, threshold: float) -> DataFrame:
    n1, n2 = (size.select(F.col("r").alias(f"r{i}"), F.col("n").alias(f"n{i}")) for i in (1, 2))
    both = shared.join(n1, "r1").join(n2, "r2")
    return both.withColumn("sim", F.col("common") / (F.col("n1") + F.col("n2") - F.col("common"))).where(F.col("sim") >= threshold).select("r1", "r2", "sim")


def _pairs_in(sets: DataFrame) -> float:
    """How many pairs an inverted self-join of the sets meets."""
    return sets.groupBy("t").agg(F.count("*").cast("double").alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]


def _meeting(sets: DataFrame) -> DataFrame:
    plan = plan_load(sets, ["t"])
    return skew_join(sets.withColumnRenamed("r", "r1"), sets.withColumnRenamed("r", "r2"), plan, ["r1"]).where("r1 < r2")


def shared_members(df: DataFrame, record: str, member: str, least: int = 1) -> DataFrame:
    """(r1, r2, common), r1 < r2: pairs with at least `least` members in common, by an inverted self-join in which members
    with many records are cut into shards.

    A record of fewer members is in no such pair. Of n members, with the rarest first in one order for all records, the
    first n - least + 1 of two records of a pair must meet. Where that leaves less to do than all meetings, only pairs that
    meet there are counted, over all their members."""
    sets = materialise(df.select(F.col(record).alias("r"), F.col(member).alias("t")).dropna().distinct(), "sets")
    if least > 1:
        size = sets.groupBy("r").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        sized = materialise(sets.join(size, "r"), "sets")
        sets = sized.select("r", "t")
        placed = sized.join(sets.groupBy("t").agg(F.count("*").alias("f")), "t").withColumn("k", F.row_number().over(Window.partitionBy("r").orderBy("f", "t")))
        first = materialise(placed.where(F.col("k") <= F.col("n") - least + 1).select("r", "t"), "first")
        mean = size.agg(F.coalesce(F.avg("n"), F.lit(0.0))).first()[0]
        if _pairs_in(first) * (1 + mean) < _pairs_in(sets):
            near = _meeting(first).select("r1", "r2").distinct()
            return _common(near, sets, size).where(F.col("common") >= least)
    # added up inside each task first: a pair meets in as many tasks as have members in common
    return _meeting(sets).groupBy(TASK, "r1", "r2").agg(F.count("*").alias("c")).groupBy("r1", "r2").agg(F.sum("c").alias("common")).where(F.col("common") >= least)


def exact_pairs(df: DataFrame, record: str, member: str, threshold: float) -> DataFrame:
    """(r1, r2, sim) of all pairs of records whose sets reach the threshold (above 0)."""
    return _reaching(df, record, member, grid.Rule(jaccard=threshold)).drop("agree")


def lsh_pairs(df: DataFrame, record: str, member: str, family: Sequence[tuple[int, int]], p: int, m: int, threshold: float) -> DataFrame:
    """(r1, r2, sim) of jaccard_of the candidates with one row a band. Those are a large share of all pairs, so signatures are
    compared last, of the pairs whose exact similarity reaches the threshold (above 0)."""
    return marked_pairs(df, record, member, family, p, m, threshold).where("agree").drop("agree")


def marked_pairs(df: DataFrame, record: str, member: str, family: Sequence[tuple[int, int]], p: int, m: int, threshold: float) -> DataFrame:
    """exact_pairs with the column agree: whether they are candidates with one row a band."""
    return _reaching(df, record, member, grid.Rule(jaccard=threshold, family=tuple(family), p=p, m=m, mark=True))


def _reaching(df: DataFrame, record: str, member: str, rule: grid.Rule) -> DataFrame:
    sets = materialise(df.select(F.col(record).alias("i"), F.col(member).alias("k")).dropna().distinct().withColumn("x", F.lit(0.0)), "sets")
    rows, records = grid.numbered(sets, "i")
    rows, _ = grid.numbered(rows, "k", dense=bool(rule.family))
    found = grid.pairs(rows, rule).select(F.col("i1").alias("r1"), F.col("i2").alias("r2"), (F.col("common") / (F.col("n1") + F.col("n2") - F.col("common"))).alias("sim"), "agree")
    return grid.named(grid.named(found, "r1", records), "r2", records)


def quality(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: precision and recall of found pairs; 1 where there is nothing to find or nothing found."""
    a, b = found.select("r1", "r2").withColumn("f", F.lit(1)), truth.select("r1", "r2").withColumn("t", F.lit(1))
    n = a.join(b, ["r1", "r2"], "full").agg(F.count("f").alias("found"), F.count("t").alias("truth"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("hit"))
    return n.select("found", "truth", F.when(F.col("found") > 0, F.col("hit") / F.col("found")).otherwise(1.0).alias("precision"), F.when(F.col("truth") > 0, F.col("hit") / F.col("truth")).otherwise(1.0).alias("recall"))
