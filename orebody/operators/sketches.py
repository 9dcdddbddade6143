"""Sketches: Bloom filter, Flajolet-Martin distinct counts per window, reservoir samples and rankings of their values."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orebody.functions.codes import code_mod, trailing_zeros, universal_hash
from orebody.operators.similar import hash_family

# The prime and bits of the Bloom filter; the functions of Flajolet-Martin (Python's Random(42), 1 to 2000) and its prime.
BLOOM_P, BLOOM_M = 22777, 10000
BLOOM_FAMILY = tuple(hash_family(10, BLOOM_P - 1, 7))
FM_P = 22777
FM_FAMILY = ((1310, 229), (52, 1519), (564, 502), (458, 286), (1509, 210), (1386, 1517), (1828, 1117), (179, 1210), (865, 66), (62, 192))
FM_FAR = 200.0


def bloom_bits(df: DataFrame, column: str, family: Sequence[tuple[int, int]] = BLOOM_FAMILY, p: int = BLOOM_P, m: int = BLOOM_M) -> DataFrame:
    """(bit): distinct bits set by the non-empty values; null and empty values set none. At most m rows."""
    values = df.where(F.col(column).isNotNull() & (F.col(column) != "")).select(column).distinct()
    x = values.withColumn("x", code_mod(F.col(column), p))
    return x.select(F.explode(F.array(*(universal_hash(F.col("x"), a, b, p, m) for a, b in family))).alias("bit")).distinct()


def bloom_probe(df: DataFrame, column: str, bits: DataFrame, family: Sequence[tuple[int, int]] = BLOOM_FAMILY, p: int = BLOOM_P, m: int = BLOOM_M) -> DataFrame:
    """df with pred: 1 where all bits of the value are set, else 0; 0 for null and empty values. The filter is one bitmap of
    m bits in words of 32, sent along as a single row, so the probe is a projection."""
    words = bits.groupBy((F.col("bit") / 32).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 32).cast("int"))).alias("v"))
    row = words.agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("__map"))  # m / 32 entries
    x = code_mod(F.col(column), p)

    def is_set(a: int, b: int) -> Column:
        h = universal_hash(F.col("__x"), a, b, p, m)
        word = F.coalesce(F.try_element_at("__map", (h / 32).cast("int")), F.lit(0).cast("bigint"))
        return F.call_function("shiftright", word, (h % 32).cast("int")).bitwiseAND(F.lit(1)) == 1

    all_set = is_set(*family[0])
    for f in family[1:]:
        all_set = all_set & is_set(*f)
    probed = df.withColumn("__x", x).join(F.broadcast(row), F.lit(True), "left")
    filled = F.col(column).isNotNull() & (F.col(column) != "")
    return probed.withColumn("pred", F.when(filled & all_set, 1).otherwise(0)).drop("__x", "__map")


def fm_maxima(df: DataFrame, column: str, by: Sequence[Column | str] = (), family: Sequence[tuple[int, int]] = FM_FAMILY, p: int = FM_P) -> DataFrame:
    """Per group: truth (exact distinct values) and r0.. (most trailing zeros of each function, 0 where all values hash to 0).
    The maxima are partial aggregates; null and empty values are skipped. A stream cannot count distinct values, so there the
    truth is the size of their set, which is as large as a window's; in a table the values stay spread over the tasks."""
    truth = F.size(F.collect_set(column)).cast("bigint") if df.isStreaming else F.count_distinct(column)
    x = df.where(F.col(column).isNotNull() & (F.col(column) != "")).withColumn("__x", code_mod(F.col(column), p))
    return x.groupBy(*by).agg(
        truth.alias("truth"),
        *(F.coalesce(F.max(trailing_zeros(universal_hash(F.col("__x"), a, b, p))), F.lit(0)).alias(f"r{i}") for i, (a, b) in enumerate(family)),
    )


def combine_estimates(values: Sequence[float], far: float = FM_FAR, rounds: int = 10) -> int:
    """Two means in one dimension, from the second and the first value; a value farther than `far` from its nearest mean is
    out for good; the answer is half the sum of the largest and least mean, rounded down."""
    live, means = list(values), [values[1], values[0]]
    for _ in range(rounds):
        groups: list[list[float]] = [[] for _ in means]
        gone = set()
        for v in live:
            d, k = min((abs(v - m), k) for k, m in enumerate(means))
            if d > far:
                gone.add(v)
            else:
                groups[k].append(v)
        live = [v for v in live if v not in gone]
        new = [sum(g) / len(g) for g in groups if g]
        if not new or new == means:
            means = new or means
            break
        means = new
    return math.floor((max(means) + min(means)) / 2)


def fm_estimates(maxima: DataFrame, functions: int = len(FM_FAMILY)) -> DataFrame:
    """Adds estimate to rows of fm_maxima."""

    @F.pandas_udf("bigint")
    def combine(r: pd.Series) -> pd.Series:
        return r.map(lambda x: combine_estimates([float(2**k) for k in x]))

    return maxima.withColumn("estimate", combine(F.array(*(f"r{i}" for i in range(functions)))))


def sliding(df: DataFrame, ts: str, length: str = "3 hours", slide: str = "1 hour") -> DataFrame:
    """df once for every sliding window that holds the row, with the window's start."""
    return df.withColumn("start", F.window(F.col(ts), length, slide)["start"])


def ranked_values(df: DataFrame, value: str, ranks: int = 3) -> DataFrame:
    """(value, n, rank): values whose count is among the `ranks` highest distinct counts; nulls are left out."""
    return ranked_counts(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")), value, ranks)


def ranked_counts(counts: DataFrame, value: str, ranks: int = 3) -> DataFrame:
    """As ranked_values, of counts (value, n). Counts above the last of the ranks are found first, from the distinct counts."""
    top = counts.select("n").distinct().orderBy(F.desc("n")).limit(ranks)
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n"))).alias("rank")  # at most `ranks` rows
    return counts.join(F.broadcast(top.select("n", rank)), "n").select(value, "n", "rank")


def reservoir(df: DataFrame, order: str, size: int, seed: int = 0) -> DataFrame:
    """A uniform sample of `size` rows: those with the least hash of (order, seed), equal ones by order. A function of the
    rows alone: the same after a replay, with any partitioning, and by partial limits in every task."""
    h = F.xxhash64(order, F.lit(seed))
    return df.orderBy(h, order).limit(size)
