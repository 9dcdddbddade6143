"""Streaming forms of the sketches: windows over event time, filters on text, and a stateful reservoir."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orebody.operators.sketches import fm_maxima
from orebody.plans.session import shared_path


def file_stream(spark: SparkSession, path: str, like: DataFrame, ts: str | None = None, files: int = 1) -> DataFrame:
    """A stream over Parquet files (a folder or one file) with the schema of `like`; the time column becomes a timestamp
    with zone."""
    folder, _, name = path.rstrip("/").rpartition("/")
    pattern = f"{folder}/[{name[0]}]{name[1:]}"  # as a pattern, the path may also be that of a single file
    stream = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(pattern)
    return stream.withColumn(ts, F.col(ts).cast("timestamp")) if ts else stream


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Text lines of a socket with the time they were read."""
    return spark.readStream.format("socket").option("host", host).option("port", port).option("includeTimestamp", True).load()


def json_lines(stream: DataFrame, schema: str | T.StructType) -> DataFrame:
    """Lines of JSON as columns; a broken line gives nulls."""
    return stream.select(F.from_json("value", schema).alias("r"), *([c for c in stream.columns if c != "value"])).select("r.*", *([c for c in stream.columns if c != "value"]))


def tracked(stream: DataFrame, text: str, words: list[str], lang: str | None = None, languages: list[str] | None = None) -> DataFrame:
    """Rows whose text contains one of the words, in any case, and whose language is listed; null texts are dropped."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(text), F.lit(w.lower()))
    out = stream.where(F.col(text).isNotNull() & hit)
    return out.where(F.col(lang).isin(languages)) if lang and languages else out


def tags_of(stream: DataFrame, text: str) -> DataFrame:
    """Adds tags: the words after a # in a text, split at white space; rows without one are dropped."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w.startswith("#") & (F.length(w) > 1))
    return stream.withColumn("tags", F.transform(words, lambda w: F.substring(w, 2, 1 << 30))).where(F.size("tags") > 0)


def windowed_maxima(stream: DataFrame, ts: str, column: str, length: str = "3 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """fm_maxima per sliding window of event time, with a watermark so that windows can close."""
    return fm_maxima(stream.withWatermark(ts, late), column, [F.window(ts, length, slide).alias("w")]).withColumn("start", F.col("w.start")).drop("w")


def reservoir_stream(stream: DataFrame, value: str, size: int = 100, seed: int = 0, bug_compatible: bool = False) -> DataFrame:
    """(count, sample) after each batch: a reservoir of `size` values over all rows so far, from one seeded generator whose
    state is kept, so that a replay gives the same sample. bug_compatible accepts one value less and never replaces the
    last slot. One reservoir is one group: its state is bounded by size; values are pre-numbered by arrival in the batch."""
    out = T.StructType([T.StructField("count", T.LongType()), T.StructField("sample", T.ArrayType(T.StringType()))])
    kept = T.StructType([T.StructField("count", T.LongType()), T.StructField("sample", T.ArrayType(T.StringType()))])

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, sample = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        for batch in batches:
            for v in batch[value]:
                count += 1
                if len(sample) < size:
                    sample.append(v)
                    continue
                slot = random.Random(f"{seed}:{count}").randint(1, count)
                if slot < size or (slot == size and not bug_compatible):
                    sample[slot - 1] = v
        state.update((count, sample))
        yield pd.DataFrame({"count": [count], "sample": [sample]})

    return stream.where(F.col(value).isNotNull()).select(F.lit(0).alias("g"), value).groupBy("g").applyInPandasWithState(step, out, kept, "update", "NoTimeout")


def sharded_reservoir(stream: DataFrame, key: str, value: str, size: int = 100, seed: int = 0, shards: int = 8) -> DataFrame:
    """(shard, count, h, k, v) after each batch: of every shard of the rows, those `size` with the least hash of (key, seed),
    with their keys and values. Shards are states of their own, each bounded by the size, that merge_reservoir puts together;
    the sample is a function of the rows alone, in whatever batches they come. Rows with a null key or value are left out."""
    fields = [T.StructField("count", T.LongType()), T.StructField("h", T.ArrayType(T.LongType())), T.StructField("k", T.ArrayType(T.StringType())), T.StructField("v", T.ArrayType(T.StringType()))]

    def step(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        count, *held = state.get if state.exists else (0, [], [], [])
        rows = list(zip(*held))
        for batch in batches:
            count += len(batch)
            rows = sorted([*rows, *zip(batch["h"].tolist(), batch["k"].tolist(), batch["v"].tolist())])[:size]
        h, k, v = (list(x) for x in zip(*rows)) if rows else ([], [], [])
        state.update((count, h, k, v))
        yield pd.DataFrame({"shard": [group[0]], "count": [count], "h": [h], "k": [k], "v": [v]})

    named = stream.select(F.col(key).cast("string").alias("k"), F.col(value).cast("string").alias("v"), F.xxhash64(key, F.lit(seed)).alias("h")).dropna()
    placed = named.withColumn("g", F.pmod(F.xxhash64("k", F.lit(seed + 1)), F.lit(shards)).cast("int"))
    out = T.StructType([T.StructField("shard", T.IntegerType()), *fields])
    return placed.groupBy("g").applyInPandasWithState(step, out, T.StructType(fields), "update", "NoTimeout")


def merge_reservoir(updates: DataFrame, size: int = 100) -> DataFrame:
    """(k, v): the sample of all shards, from what they have put out so far."""
    last = updates.groupBy("shard").agg(F.max_by(F.arrays_zip("h", "k", "v"), "count").alias("r"))
    return last.select(F.explode("r").alias("r")).orderBy("r.h", "r.k").limit(size).select("r.k", "r.v")


def run_available(stream: DataFrame, mode: str = "complete", partitions: int | None = None) -> DataFrame:
    """Run a stream over what is there, then stop: the sink's rows as a table. In complete mode each batch replaces the
    result; in append and update mode batches are collected with their number in column batch."""
    spark = stream.sparkSession
    out, state = shared_path(spark, "sink"), shared_path(spark, "stream")

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/{0 if mode == 'complete' else batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)


def append_csv(stream: DataFrame, path: str) -> None:
    """Append the rows of a stream over what is there to CSV files with a header, batch by batch, each row once."""
    state = shared_path(stream.sparkSession, "stream")
    writer = stream.writeStream.outputMode("append").format("csv").option("header", True).option("path", path)
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
