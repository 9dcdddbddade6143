"""Sinks: JSON reports, models and rows, CSV, and the text layouts of itemsets, communities and edges.

Each writes a folder of part files. Layouts with an order are written as part files in that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def json_report(parts: dict[str, DataFrame], path: str) -> None:
    """One object: each part's rows as a list."""
    each = [df.agg(F.collect_list(F.struct(*df.columns)).alias(k)) for k, df in parts.items()]
    one = each[0]
    for e in each[1:]:
        one = one.join(F.broadcast(e), F.lit(True))  # one row each
    one.select(F.to_json(F.struct(*parts)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def json_map(df: DataFrame, key: str, value: str, path: str) -> None:
    """One object of key and value."""
    df.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string"), value))))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def csv_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def quoted(items: str) -> Column:
    return F.array_join(F.transform(F.col(items), lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'"))), ", ")


def itemset_lines(df: DataFrame) -> DataFrame:
    """(size, value): a line per size with its itemsets in order, in brackets and separated by commas."""
    one = df.select("size", "items", F.concat(F.lit("("), quoted("items"), F.lit(")")).alias("s"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("items", "s"))), lambda x: x["s"]), ",")
    return one.groupBy("size").agg(line.alias("value")).orderBy("size")


def community_lines(df: DataFrame, label: str = "label") -> DataFrame:
    """(size, value): a line per community with its members in order and quotes, by size and members."""
    sets = df.groupBy(label).agg(F.array_sort(F.collect_list(F.col("id").cast("string"))).alias("items"))
    return sets.select(F.size("items").alias("size"), quoted("items").alias("value")).orderBy("size", "value")


def edge_lines(df: DataFrame, value: str = "betweenness") -> DataFrame:
    """(value): ('a', 'b'), v by descending v and edge."""
    ordered = df.orderBy(F.desc(value), "v1", "v2")
    return ordered.select(F.concat(F.lit("('"), F.col("v1").cast("string"), F.lit("', '"), F.col("v2").cast("string"), F.lit("'), "), F.col(value).cast("string")).alias("value"))


def text_lines(df: DataFrame, path: str) -> None:
    """Lines in the order of df: part files are numbered in that order."""
    df.select("value").write.mode("overwrite").text(path)


def prediction_line(df: DataFrame, row: str = "row", pred: str = "pred") -> DataFrame:
    """(value): the predictions in the order of their rows, separated by blanks."""
    return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(row, pred))), lambda x: x[pred].cast("string")), " ").alias("value"))


def rank_lines(df: DataFrame, value: str, count: str = "n") -> DataFrame:
    """(value): for each count among the ranked ones, a line of it and its values in order, the highest first."""
    one = df.groupBy(count).agg(F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), ", ").alias("v"))
    return one.orderBy(F.desc(count)).select(F.concat(F.col("v"), F.lit(" : "), F.col(count).cast("string")).alias("value"))


def csv_points(rounds: list[DataFrame], path: str) -> None:
    """Points (id, vec) as lines of id and coordinates, a folder of part files for each round, numbered in order."""
    for i, points in enumerate(rounds):
        line = F.concat_ws(",", F.col("id").cast("string"), F.transform("vec", lambda x: x.cast("string")))
        points.select(line.alias("value")).write.mode("overwrite").text(f"{path}/round-{i:06d}")
