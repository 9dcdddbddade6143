"""Dense numbers and running sums in a global order, without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebody.plans.session import materialise, shuffle_partitions


def dense_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """(key, idx): every distinct non-null key with its rank from 0. Keys are range-partitioned; ranks inside a partition
    are moved by the number of keys before it, of which there is one per partition."""
    spark = df.sparkSession
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    placed = materialise(keys.repartitionByRange(shuffle_partitions(spark), key).withColumn("__p", F.spark_partition_id()), "keys")
    before, moves = 0, []
    for r in placed.groupBy("__p").agg(F.count("*").alias("n")).orderBy("__p").collect():
        moves.append((r["__p"], before))
        before += r.n
    offsets = spark.createDataFrame(moves, "__p int, __before bigint")
    rank = F.row_number().over(Window.partitionBy("__p").orderBy(key)) - 1
    return placed.withColumn("__r", rank).join(F.broadcast(offsets), "__p").select(key, (F.col("__r") + F.col("__before")).alias(name))


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum of value over all rows up to this one in the given order, which must be a unique key. Rows are
    range-partitioned; sums inside a partition are moved by the total of the partitions before it."""
    spark = df.sparkSession
    placed = materialise(df.repartitionByRange(shuffle_partitions(spark), *order).withColumn("__p", F.spark_partition_id()), "ordered")
    before, moves = 0.0, []
    for r in placed.groupBy("__p").agg(F.sum(value).alias("v")).orderBy("__p").collect():
        moves.append((r["__p"], before))
        before += r.v or 0.0
    offsets = spark.createDataFrame(moves, "__p int, __before double")
    inside = F.sum(value).over(Window.partitionBy("__p").orderBy(*order))
    return placed.withColumn("__s", inside).join(F.broadcast(offsets), "__p").withColumn(name, F.col("__s") + F.col("__before")).drop("__p", "__s", "__before")


def nth_key(df: DataFrame, key: str, n: int) -> object:
    """The n-th smallest value of a unique key, from 1. Only the range of keys that holds it is numbered, in one task."""
    placed = materialise(df.select(key).repartitionByRange(shuffle_partitions(df.sparkSession), key).withColumn("__p", F.spark_partition_id()), "keys")
    before = 0
    for r in placed.groupBy("__p").agg(F.count("*").alias("n")).orderBy("__p").collect():
        if before + r.n >= n:
            number = F.row_number().over(Window.partitionBy("__p").orderBy(key))
            return placed.where(F.col("__p") == r["__p"]).withColumn("__r", number).where(F.col("__r") == n - before).first()[key]
        before += r.n
    raise IndexError(f"there are fewer than {n} keys")
