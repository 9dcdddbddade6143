"""Frequent itemsets: level-wise A-Priori on DataFrames, the two-pass form, FP-Growth, and their comparison."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.plans.session import materialise


def pairs_of(df: DataFrame, basket: str, item: str, more_than: int = 0) -> DataFrame:
    """Distinct (basket, item) without nulls, of baskets with more than so many items."""
    out = df.select(F.col(basket).alias("basket"), F.col(item).cast("string").alias("item")).dropna().distinct()
    if more_than:
        big = out.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > more_than).select("basket")
        out = out.join(big, "basket", "left_semi")
    return out


def baskets_of(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("basket").agg(F.array_sort(F.collect_set("item")).alias("items"))


def apriori(pairs: DataFrame, support: int, max_size: int | None = None) -> DataFrame:
    """(size, items, support) of every itemset in at least `support` baskets; items are sorted arrays.

    Level k joins frequent sets of k items that share their first k - 1, keeps candidates all of whose subsets are
    frequent, and counts them in long form: an occurrence (basket, set) is extended by the basket's later live items, so
    baskets are never arrays and no candidate is tested against a basket that lacks its prefix. A basket without an
    occurrence of a frequent set takes no part in later levels."""
    pairs = materialise(pairs.select("basket", "item"), "pairs")
    frequent = pairs.groupBy("item").agg(F.count("*").alias("support")).where(F.col("support") >= support)
    frequent = materialise(frequent, "items")
    out = frequent.select(F.lit(1).alias("size"), F.array("item").alias("items"), "support")
    live = materialise(pairs.join(frequent.select("item"), "item", "left_semi").select("basket", "item"), "live")
    sets = out.select("items", F.col("items")[0].alias("last"))
    held = live.select("basket", F.array("item").alias("items"), F.col("item").alias("last"))
    size = 1
    while max_size is None or size < max_size:
        a = sets.select(F.slice("items", 1, size - 1).alias("prefix"), F.col("last").alias("x")) if size > 1 else sets.select(F.array().cast("array<string>").alias("prefix"), F.col("last").alias("x"))
        b = a.select("prefix", F.col("x").alias("y"))
        made = a.join(b, "prefix").where("x < y").select(F.concat("prefix", F.array("x", "y")).alias("items"))
        if size > 1:
            # every subset of k items must be frequent; leaving out either of the last two is known
            drop = [F.concat(F.slice("items", 1, i), F.slice("items", i + 2, size)).alias("sub") for i in range(size - 1)]
            for sub in drop:
                made = made.withColumn("sub", sub).join(sets.select(F.col("items").alias("sub")), "sub", "left_semi").drop("sub")
        candidates = made.select(F.slice("items", 1, size).alias("head"), F.col("items")[size].alias("tail"), "items")
        grown = held.select("basket", F.col("items").alias("head")).join(candidates, "head").join(live.select("basket", F.col("item").alias("tail")), ["basket", "tail"])
        grown = materialise(grown.select("basket", "items"), "grown")
        counted = grown.groupBy("items").agg(F.count("*").alias("support")).where(F.col("support") >= support)
        found = materialise(counted.select(F.lit(size + 1).alias("size"), "items", "support"), "level")
        if found.isEmpty():
            break
        out = out.unionByName(found)
        size += 1
        sets = found.select("items", F.col("items")[size - 1].alias("last"))
        held = grown.join(found.select("items"), "items", "left_semi").select("basket", "items", F.element_at("items", -1).alias("last"))
    return out


def _local_sets(batches: Iterator[pd.DataFrame], support: int, total: int) -> Iterator[pd.DataFrame]:
    """Sets that are frequent in one partition of baskets by its share of the support. A set of k items is counted where its
    first k - 1 were found: per set the baskets that hold it are kept, and longer ones come from cutting these lists."""
    rows = [frozenset(x) for batch in batches for x in batch["items"]]
    least = max(1, math.floor(support * len(rows) / total))
    held: dict[tuple, np.ndarray] = {}
    where: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        for x in r:
            where.setdefault(x, []).append(i)
    held = {(x,): np.array(at) for x, at in sorted(where.items()) if len(at) >= least}
    while held:
        yield pd.DataFrame({"items": [list(c) for c in held]})
        heads: dict[tuple, list[str]] = {}
        for c in held:
            heads.setdefault(c[:-1], []).append(c[-1])
        longer: dict[tuple, np.ndarray] = {}
        for h, tails in heads.items():
            for k, x in enumerate(tails):
                for y in tails[k + 1 :]:
                    c = (*h, x, y)
                    if all(c[:n] + c[n + 1 :] in held for n in range(len(c) - 2)):
                        both = np.intersect1d(held[(*h, x)], held[(*h, y)], assume_unique=True)
                        if len(both) >= least:
                            longer[c] = both
        held = longer


def son(pairs: DataFrame, support: int) -> DataFrame:
    """The two-pass form: sets that are frequent in some partition of the baskets (by its share of the support, rounded down so
    that none is lost) are counted exactly in all baskets, of any size. The result equals apriori.

    The second pass counts by prefix: an occurrence of a candidate's first items is extended by the basket's later items,
    if that is a candidate or the beginning of one."""
    pairs = materialise(pairs.select("basket", "item"), "pairs")
    baskets = materialise(baskets_of(pairs), "baskets")
    total = max(1, baskets.count())
    candidates = baskets.select("items").mapInPandas(lambda batches: _local_sets(batches, support, total), "items array<string>").distinct()
    candidates = materialise(candidates.withColumn("size", F.size("items")), "candidates")
    longest = candidates.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    held = pairs.join(candidates.where("size = 1").select(F.col("items")[0].alias("item")), "item", "left_semi").select("basket", F.array("item").alias("items"))
    out = held.groupBy(F.lit(1).alias("size"), "items").agg(F.count("*").alias("support"))
    for size in range(2, longest + 1):
        grown = candidates.where(F.col("size") == size).select(F.slice("items", 1, size - 1).alias("head"), F.element_at("items", -1).alias("item"), "items")
        held = held.select("basket", F.col("items").alias("head")).join(grown, "head").join(pairs, ["basket", "item"]).select("basket", "items")
        held = materialise(held, "held")
        out = out.unionByName(held.groupBy(F.lit(size).alias("size"), "items").agg(F.count("*").alias("support")))
    return out.where(F.col("support") >= support)


def fp_growth(pairs: DataFrame, support: int) -> DataFrame:
    """(items, support) by FP-Growth; half a basket is taken off the share so that rounding loses no set at the support."""
    from pyspark.ml.fpm import FPGrowth

    baskets = materialise(baskets_of(pairs), "baskets")
    total = max(1, baskets.count())
    model = FPGrowth(itemsCol="items", minSupport=max(0.0, support - 0.5) / total).fit(baskets)
    return model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("support"))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how many itemsets each has, and how many they have in common."""
    a, b = left.select("items").distinct(), right.select("items").distinct()
    both = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "items", "full")
    return both.agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_both"))
