"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

A source's records are hashed into shards; in a shard they lie in a seeded order and are cut into blocks of equal tokens.
Blocks of the whole mixture are given to sources by the highest quotients weight / (2 k + 1), a source dropping out when
its repeats are used up; each source's blocks are given to its shards in the same way by their sizes. A shard then takes
its blocks in the seeded order, from the first again after the last, and a record comes as often as its block.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebody.operators.numbering import running_sum
from orebody.operators.skew import TASK, plan_load, skew_join
from orebody.plans.session import materialise

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK_TOKENS = 256
SHARD_TOKENS = 4_000_000
MOST_SHARDS = 50_000
MOST_SOURCES = 10_000

_encodings: dict[str, object] = {}


def _encoding(path: str):
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def with_tokens(df: DataFrame, text: str, keep: Sequence[str], tokenizer: str = TOKENIZER, size: str = "n_tokens") -> DataFrame:
    """The kept columns and the number of tokens of the text, 0 for a null; the text itself is not kept."""
    keep = list(keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(tokenizer)
        for batch in batches:
            sizes = [len(enc.encode_ordinary(t)) if t is not None else 0 for t in batch.pop("__text")]
            yield batch.assign(**{size: sizes}).astype({size: "int64"})

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).alias("__text")).mapInPandas(run, f"{fields}, `{size}` bigint")


def apportion(weights: Sequence[float], caps: Sequence[int], seats: int) -> list[int]:
    """Sainte-Lague with caps: seats go one by one to the highest weight / (2 k + 1), k being those already held, equal
    quotients to the earlier entry; an entry at its cap, or without weight, gets none. Found by bisection, not seat by seat."""
    n = len(weights)
    caps = [c if w > 0 else 0 for w, c in zip(weights, caps)]
    if seats >= sum(caps):
        return caps

    def held(q: float) -> list[int]:
        return [min(c, int((w / q + 1) / 2)) for w, c in zip(weights, caps)]

    low, high = 0.0, max(weights) * 2
    for _ in range(200):
        mid = (low + high) / 2
        if not low < mid < high:
            break
        low, high = (low, mid) if sum(held(mid)) <= seats else (mid, high)
    out = held(high * (1 + 1e-9))  # what is equal but for rounding is given seat by seat
    heap = [(-weights[i] / (2 * out[i] + 1), i) for i in range(n) if out[i] < caps[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(out)):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def apportion_table(df: DataFrame, cap: str, seats: int, name: str) -> DataFrame:
    """df (source, weight, ...) with each source's seats: apportion for any number of sources, by sums over the table. The last
    quotient that gets a seat is enclosed by some points at a time; equal ones at the end go by source."""
    c = F.when(F.col("weight") > 0, F.col(cap)).otherwise(0).cast("bigint")
    every, most = df.agg(F.coalesce(F.sum(c), F.lit(0)), F.coalesce(F.max("weight"), F.lit(0.0))).first()
    if seats >= every:
        return df.withColumn(name, c)

    def held(q: float):
        return F.least(c, F.floor((F.col("weight") / F.lit(q) + 1) / 2))

    low, high = 0.0, most * 2
    for _ in range(60):
        points = [x for x in (low + (high - low) * k / 17 for k in range(1, 17)) if low < x < high]
        if not points or points[0] == points[-1]:
            break
        sums = df.agg(*(F.sum(held(x)) for x in points)).first()
        fits = [x for x, n in zip(points, sums) if n <= seats]
        low, high = max((x for x, n in zip(points, sums) if n > seats), default=low), min(fits, default=high)
    out = df.withColumn(name, held(high * (1 + 1e-9)))
    rest = seats - out.agg(F.sum(name)).first()[0]
    if not rest:
        return out
    next_ = out.where(F.col(name) < c).select("source", (-F.col("weight") / (2 * F.col(name) + 1)).alias("order"), F.lit(1.0).alias("one"))
    more = running_sum(next_, ["order", "source"], "one", "place").where(F.col("place") <= rest).select("source", F.lit(1).alias("extra"))
    return out.join(more, "source", "left").withColumn(name, F.col(name) + F.coalesce("extra", F.lit(0))).drop("extra")


@dataclass
class Mixture:
    """sized: (id, source, n_tokens, shard) of all listed sources; shards: per shard its blocks and its quota; table: per listed
    source its figures, which report has as a list, unless there are more than MOST_SOURCES (few is then false)."""

    sized: DataFrame
    shards: DataFrame
    report: list[dict]
    total: int
    block: int
    seed: int
    budget: int
    table: DataFrame
    few: bool = True


def normal_source(c: str):
    return F.lower(F.trim(F.col(c)))


def plan_mixture(docs: DataFrame, doc: str, text: str, source: str, targets: DataFrame, block: int = BLOCK_TOKENS, seed: int = 0, tokenizer: str = TOKENIZER, budget: int | None = None) -> Mixture:
    """Sizes and quotas. targets has source, weight and max_repeat; spellings that differ in case or outer blanks are one
    source, whose weights add up and whose largest max_repeat holds; a null weight is 0, a null max_repeat 1; weights are
    shares of their sum. The budget is by default the total size of all records, each taken once, listed or not.

    A source is short if its size with all repeats is less than its weight of the budget. Those that the apportionment without
    caps gives about as many blocks as they have, or more, are compared with it token by token; others cannot be short.

    Records of unlisted or null sources count for the total only. Records of no tokens are in no block. An empty table has
    a total of 0 and no quotas."""
    goals = targets.select(normal_source("source").alias("source"), "weight", "max_repeat").where("source is not null")
    goals = goals.groupBy("source").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"), F.max(F.coalesce("max_repeat", F.lit(1))).alias("max_repeat")).orderBy("source")
    goal = goals.limit(MOST_SOURCES + 1).collect()
    spark = docs.sparkSession
    sized = materialise(with_tokens(docs.select(F.col(doc).alias("id"), normal_source(source).alias("source"), F.col(text).alias("x")), "x", ["id", "source"], tokenizer), "sized")
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    if len(goal) > MOST_SOURCES:
        return _plan_spread(sized, goals, total, block, seed, total if budget is None else budget)
    listed = F.broadcast(spark.createDataFrame([(g.source,) for g in goal], "source string"))  # at most MOST_SOURCES rows
    per_source = {r.source: r.n for r in sized.join(listed, "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    wide = max(SHARD_TOKENS, -(-total // MOST_SHARDS))
    counts = spark.createDataFrame([(g.source, max(1, -(-per_source.get(g.source, 0) // wide))) for g in goal], "source string, n_shards bigint")
    sized = sized.where("n_tokens > 0").join(F.broadcast(counts), "source").withColumn("shard", F.pmod(F.xxhash64("id", F.lit(seed)), "n_shards")).drop("n_shards")
    # at most MOST_SHARDS shards, and one more for each source
    shard = sized.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")).orderBy("source", "shard").collect()
    blocks: dict[str, list[tuple[int, int]]] = {}
    for r in shard:
        blocks.setdefault(r.source, []).append((r.shard, -(-r.n // block)))
    capacity = [g.max_repeat * sum(n for _, n in blocks.get(g.source, [])) for g in goal]
    budget = total if budget is None else budget
    seats = round(budget / block)
    weights = [g.weight for g in goal]
    # weights that miss 1 by rounding alone are taken as they are
    whole = sum(weights) if abs(sum(weights) - 1) > 1e-9 else 1.0
    quota, entitled = apportion(weights, capacity, seats), apportion(weights, [seats] * len(goal), seats)
    rows, report = [], []
    for g, q, c, e in zip(goal, quota, capacity, entitled):
        own = blocks.get(g.source, [])
        for (s, n), k in zip(own, apportion([n for _, n in own], [g.max_repeat * n for _, n in own], q)):
            rows.append((g.source, s, n, k))
        size, share = per_source.get(g.source, 0), g.weight / whole if whole else 0.0
        # divisor methods differ from the exact share by at most half a block and half of the weight of all sources; every
        # shard's last block is filled up
        near = c <= e + 2 + share * len(goal) / 2 + g.max_repeat * len(own)
        report.append({"source": g.source, "weight": g.weight, "max_repeat": g.max_repeat, "n_tokens": size, "quota_blocks": q, "short": near and size * g.max_repeat < share * budget})
    return Mixture(sized, spark.createDataFrame(rows, "source string, shard bigint, n_blocks bigint, quota bigint"), report, total, block, seed, budget, spark.createDataFrame([tuple(r.values()) for r in report], REPORT))


REPORT = "source string, weight double, max_repeat bigint, n_tokens bigint, quota_blocks bigint, short boolean"


def _plan_spread(sized: DataFrame, goals: DataFrame, total: int, block: int, seed: int, budget: int) -> Mixture:
    """The plan for any number of listed sources: what plan_mixture does on the driver, as tables."""
    goals, wide = materialise(goals, "goals"), max(SHARD_TOKENS, -(-total // MOST_SHARDS))
    size = sized.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"))
    goals = materialise(goals.join(size, "source", "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0))), "goals")
    shards = goals.select("source", F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / wide)).alias("n_shards"))
    own = sized.where("n_tokens > 0 and source is not null")
    placed = skew_join(own, shards, plan_load(own, ["source"]), ["id"]).drop(TASK)
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(seed)), "n_shards")).drop("n_shards")
    blocks = materialise(placed.groupBy("source", "shard").agg(F.ceil(F.sum("n_tokens") / block).cast("bigint").alias("n_blocks")), "blocks")
    held = blocks.groupBy("source").agg(F.sum("n_blocks").alias("all_blocks"), F.count("*").alias("own"))
    full = goals.join(held, "source", "left").withColumns({"capacity": F.col("max_repeat") * F.coalesce("all_blocks", F.lit(0)), "own": F.coalesce("own", F.lit(0))})
    seats, n = round(budget / block), goals.count()
    summed = goals.agg(F.sum("weight")).first()[0]
    whole = summed if abs(summed - 1) > 1e-9 else 1.0
    full = apportion_table(materialise(full, "sources"), "capacity", seats, "quota_blocks")
    full = materialise(apportion_table(full.withColumn("seats", F.lit(seats)), "seats", seats, "entitled"), "sources")
    share = F.col("weight") / whole if whole else F.lit(0.0)
    near = F.col("capacity") <= F.col("entitled") + 2 + share * n / 2 + F.col("max_repeat") * F.col("own")
    table = full.select("source", "weight", "max_repeat", "n_tokens", F.col("quota_blocks").cast("bigint").alias("quota_blocks"), (near & (F.col("n_tokens") * F.col("max_repeat") < share * budget)).alias("short"))

    def divide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        n = [int(x) for x in pdf["n_blocks"]]
        quota = apportion(n, [int(pdf["max_repeat"].iloc[0]) * x for x in n], int(pdf["quota_blocks"].iloc[0]))
        return pdf.assign(quota=quota)[["source", "shard", "n_blocks", "quota"]]

    of_source = blocks.join(table.select("source", "max_repeat", "quota_blocks"), "source")
    quotas = of_source.groupBy("source").applyInPandas(divide, "source string, shard bigint, n_blocks bigint, quota bigint")
    return Mixture(placed.select("id", "source", "n_tokens", "shard"), materialise(quotas, "quotas"), [], total, block, seed, budget, table, False)


def mixture(plan: Mixture) -> DataFrame:
    """(id, source, n_tokens, copies) of the records chosen, copies being 1 or more."""
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("id", F.lit(plan.seed + 1)), "id")
    before = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    placed = plan.sized.withColumn("block", F.floor(before / plan.block)).join(F.broadcast(plan.shards) if plan.few else plan.shards, ["source", "shard"])
    copies = F.floor(F.col("quota") / F.col("n_blocks")) + F.when(F.col("block") < F.col("quota") % F.col("n_blocks"), 1).otherwise(0)
    return placed.withColumn("copies", copies.cast("bigint")).where("copies > 0").select("id", "source", "n_tokens", "copies")


def shares(plan: Mixture, chosen: DataFrame) -> DataFrame:
    """Per listed source: its target weight, size, quota, tokens in the mixture and the share reached."""
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    out = plan.table.join(got, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    if not plan.few:
        mixed = chosen.agg(F.coalesce(F.sum(F.col("n_tokens") * F.col("copies")), F.lit(0))).first()[0]
        return out.withColumn("share", F.col("mixed_tokens") / F.lit(mixed) if mixed else F.lit(0.0))
    everything = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))  # at most MOST_SOURCES rows
    return out.withColumn("share", F.when(everything > 0, F.col("mixed_tokens") / everything).otherwise(0.0))
