"""Top N items of every group by statistics-guided skipping.

The table is written once, clustered: range-partitioned and sorted by group, descending score and item, in small row
groups. A group of any size is cut by the ranges, because the score is part of the range key. Readers take the row groups
of a file in descending maximum score and skip one whose maximum is strictly below the N-th score that every group it can
contain has reached: only a row group of a single group can say so, as its statistics then name all that it contains.
The few survivors of each file are merged into the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebody.plans.session import shared_path, shuffle_partitions

ROW_GROUP_BYTES = 256 << 10


def cluster(df: DataFrame, group: str, item: str, score: str, row_group_bytes: int = ROW_GROUP_BYTES) -> str:
    """Write (group, item, score) clustered to the shared folder; the path. Rows with a null in any of the three, or a
    score that is no number, are left out."""
    spark = df.sparkSession
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s")).where("g is not null and i is not null and s is not null and not isnan(s)")
    path = shared_path(spark, "clustered")
    order = [F.col("g"), F.col("s").desc(), F.col("i")]
    rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).write.option("parquet.block.size", str(row_group_bytes)).option("parquet.page.row.count.limit", "2000").parquet(path)
    return path


def best_of_file(file: pq.ParquetFile, n: int) -> tuple[pd.DataFrame, int]:
    """The n best distinct items of each group in one clustered file, and how many row groups were skipped."""
    meta = file.metadata
    groups = []
    for k in range(meta.num_row_groups):
        rg = meta.row_group(k)
        g, s = rg.column(0).statistics, rg.column(2).statistics
        exact = g is not None and g.has_min_max and s is not None and s.has_min_max
        groups.append((-(s.max if exact else float("inf")), k, (g.min, g.max) if exact else (None, None)))
    reached: dict[str, float] = {}
    best_of: dict[str, pd.DataFrame] = {}
    kept, skipped = [], 0
    for top, k, (low, high) in sorted(groups, key=lambda x: x[:2]):
        if low is not None and low == high and low in reached and -top < reached[low]:
            skipped += 1
            continue
        part = file.read_row_group(k, use_threads=False).to_pandas()
        part = part.sort_values(["g", "s", "i"], ascending=[True, False, True], kind="stable").drop_duplicates(["g", "i"])
        part = part[part.groupby("g", sort=False).cumcount() < n]
        last = part.iloc[-1]["g"]
        if low is not None and low == high:
            # of a group of many row groups no more than its n best are held
            own = pd.concat([best_of[last], part]) if last in best_of else part
            own = best_of[last] = own.sort_values(["s", "i"], ascending=[False, True], kind="stable").drop_duplicates("i").head(n)
        else:
            kept.append(part)
            own = part[part["g"] == last]
        if len(own) >= n:
            reached[last] = max(reached.get(last, -np.inf), float(own["s"].iloc[n - 1]))
    kept += best_of.values()
    if not kept:
        return pd.DataFrame({"g": [], "i": [], "s": []}), skipped
    best = pd.concat(kept).sort_values(["g", "s", "i"], ascending=[True, False, True], kind="stable").drop_duplicates(["g", "i"])
    return best[best.groupby("g", sort=False).cumcount() < n], skipped


def top_clustered(spark, path: str, n: int) -> DataFrame:
    """(g, i, s, rank) of a table written by cluster()."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [str(x.getPath()) for x in system.listStatus(hadoop) if str(x.getPath()).endswith(".parquet")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri in batch["file"]:
                uri = uri.replace("s3a://", "s3://", 1) if "://" in uri else uri.replace("file:", "file://", 1)
                at, name = fs.FileSystem.from_uri(uri)
                with at.open_input_file(name) as f:
                    best, _ = best_of_file(pq.ParquetFile(f), n)
                if len(best):
                    yield best.astype({"g": object, "i": object})

    listed = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "file string, k int")
    survivors = listed.repartitionById(max(1, len(files)), F.col("k")).mapInPandas(read, "g string, i string, s double")
    # only a group cut by a range has survivors in several files; repeated pairs keep their highest score
    best = survivors.groupBy("g", "i").agg(F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("s"), "i"))
    return best.withColumn("rank", rank).where(F.col("rank") <= n)


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, row_group_bytes: int = ROW_GROUP_BYTES) -> DataFrame:
    """(group, item, score, rank): the n items with the highest score in each group, equal scores by item ascending.

    A repeated (group, item) counts once with its highest score. Rows with a null group, item or score, or with NaN, are
    ignored; infinite scores are ordinary ones. Groups and items are strings. A group with fewer items has fewer rows; an
    empty table gives none. Other columns are not read."""
    out = top_clustered(df.sparkSession, cluster(df, group, item, score, row_group_bytes), n)
    return out.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
