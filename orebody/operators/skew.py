"""Per-key work without imbalance: fragment-replicate by measured load.

Load is measured in two passes of bounded size. The first counts rows by hash bucket of the key (as
many counters as buckets). The second counts single keys, but only inside buckets that alone exceed
half a task's share; every key above that share lies in such a bucket, so none is missed, and at most
2 * tasks keys can be above it. Heavy keys are cut into shards in proportion to their load; shards
and the remaining buckets are packed into tasks, largest first, each to the task with the least load.
A side that has to match is replicated only to the shards of its key.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orebody.plans.session import shuffle_partitions

TASK, SALT = "__task", "__salt"
#: Longer lists of buckets are sent as a table instead of standing in the plan.
LITERAL_BUCKETS = 4096


@dataclass(frozen=True)
class LoadPlan:
    """Where each key's rows go. heavy: (key values, rows, tasks of its shards)."""

    keys: tuple[str, ...]
    types: tuple[T.DataType, ...]
    tasks: int
    bucket_task: tuple[int, ...]
    heavy: tuple[tuple[tuple, int, tuple[int, ...]], ...] = ()
    task_load: tuple[int, ...] = field(default=(), compare=False)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(len(self.bucket_task))).cast("int")


def pack(loads: Sequence[tuple[object, int]], tasks: int) -> tuple[dict[object, int], list[int]]:
    """Largest item first, each to the least loaded task; ties by task number."""
    heap = [(0, t) for t in range(tasks)]
    where: dict[object, int] = {}
    for item, load in sorted(loads, key=lambda x: (-x[1], str(x[0]))):
        total, t = heapq.heappop(heap)
        where[item] = t
        heapq.heappush(heap, (total + load, t))
    out = [0] * tasks
    for total, t in heap:
        out[t] = total
    return where, out


def plan_load(df: DataFrame, keys: Sequence[str], tasks: int | None = None, buckets_per_task: int = 32) -> LoadPlan:
    """Measure the load of keys (rows with a null in any of them count as no key) and pack it into tasks."""
    spark, keys = df.sparkSession, tuple(keys)
    tasks = max(1, tasks or shuffle_partitions(spark))
    n = tasks * buckets_per_task
    rows = df.select(*keys).dropna()
    hashed = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int").alias("b")
    load = {r.b: r.n for r in rows.groupBy(hashed).agg(F.count("*").alias("n")).collect()}
    share = max(1.0, sum(load.values()) / tasks / 2)
    full = [b for b, m in load.items() if m > share]
    heavy = []
    if full:
        inside = rows.where(hashed.isin(full)).groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > share)
        for r in inside.select(*keys, "__n", hashed).collect():
            load[r["b"]] -= r["__n"]
            heavy.append((tuple(r[k] for k in keys), r["__n"]))
    items: list[tuple[object, int]] = [(b, load.get(b, 0)) for b in range(n)]
    for i, (_, m) in enumerate(heavy):
        shards = math.ceil(m / share)
        items += [((i, s), math.ceil(m / shards)) for s in range(shards)]
    where, loads = pack(items, tasks)
    return LoadPlan(
        keys, tuple(df.schema[k].dataType for k in keys), tasks, tuple(where[b] for b in range(n)),
        tuple((k, m, tuple(where[(i, s)] for s in range(math.ceil(m / share)))) for i, (k, m) in enumerate(heavy)), tuple(loads),
    )


def _heavy(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """The heavy keys with their tasks: at most 2 * tasks rows, which bounds the broadcast."""
    schema = T.StructType([T.StructField(f"__k{i}", t) for i, t in enumerate(plan.types)] + [T.StructField("__tasks", T.ArrayType(T.IntegerType()))])
    return df.sparkSession.createDataFrame([(*k, list(t)) for k, _, t in plan.heavy], schema)


def _with_heavy(df: DataFrame, plan: LoadPlan) -> DataFrame:
    if not plan.heavy:
        return df.withColumn("__tasks", F.lit(None).cast("array<int>"))
    on = [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(plan.keys)]
    joined = df.join(F.broadcast(_heavy(df, plan)), on, "left")
    return joined.drop(*(f"__k{i}" for i in range(len(plan.keys))))


def _place(df: DataFrame, plan: LoadPlan) -> DataFrame:
    return df.repartitionById(plan.tasks, F.col(TASK))


def _with_light(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """df with __light, the task of the key's bucket; there are buckets_per_task of them for each task."""
    if len(plan.bucket_task) <= LITERAL_BUCKETS:
        return df.withColumn("__light", F.get(F.lit(list(plan.bucket_task)), plan.bucket()))
    table = df.sparkSession.createDataFrame(list(enumerate(plan.bucket_task)), "__bucket int, __light int")
    return df.withColumn("__bucket", plan.bucket()).join(F.broadcast(table), "__bucket", "left").drop("__bucket")


def fragment(df: DataFrame, plan: LoadPlan, salt: Sequence[str], place: bool = True) -> DataFrame:
    """Send each row to a task of its key, with the task's number in column __task. Rows of a heavy key are spread over
    its shards by a hash of the salt columns: rows that agree in all of them stay together, and a task that is run again
    sends them to the same place. Rows with a null key are dropped."""
    spread = F.get("__tasks", F.pmod(F.xxhash64(*salt, F.lit(7)), F.size("__tasks")).cast("int"))
    out = _with_light(_with_heavy(df.dropna(subset=list(plan.keys)), plan), plan)
    out = out.withColumn(TASK, F.when(F.col("__tasks").isNotNull(), spread).otherwise(F.col("__light"))).drop("__tasks", "__light")
    return _place(out, plan) if place else out


def replicate(df: DataFrame, plan: LoadPlan, place: bool = True) -> DataFrame:
    """Send each row to every task that holds a shard of its key. Rows with a null key are dropped."""
    out = _with_light(_with_heavy(df.dropna(subset=list(plan.keys)), plan), plan)
    every = F.coalesce(F.array_distinct("__tasks"), F.array("__light"))
    out = out.withColumn(TASK, F.explode(every)).drop("__tasks", "__light")
    return _place(out, plan) if place else out


def skew_join(left: DataFrame, right: DataFrame, plan: LoadPlan, salt: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on plan.keys; how is inner, left, left_semi or left_anti (each left row is in one place, so these hold).
    The result keeps __task, for per-key work that goes on in the same places. Null keys never match and are dropped."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join cannot replicate the right side of a {how} join")
    clash = (set(left.columns) & set(right.columns)) - set(plan.keys)
    if clash:
        raise ValueError(f"rename before the join: {sorted(clash)}")
    return fragment(left, plan, salt).join(replicate(right, plan).hint("shuffle_merge"), [TASK, *plan.keys], how)


def skew_aggregate(df: DataFrame, plan: LoadPlan, partial: Sequence[Column], final: Sequence[Column], unique: Sequence[str] = ()) -> DataFrame:
    """Per-key results of a fragmented df (one that has __task): partial aggregates within each task, where unique names
    columns whose repeats within a key count once (they must be the salt), then one row per key and shard is merged."""
    if unique:
        df = df.dropDuplicates([TASK, *plan.keys, *unique])
    return df.groupBy(TASK, *plan.keys).agg(*partial).groupBy(*plan.keys).agg(*final)


def key_shares(df: DataFrame, key: str, salt: Sequence[str], tasks: int | None = None) -> DataFrame:
    """(key, n) for every non-null value of key, counted in balanced tasks; of an empty table, no rows."""
    plan = plan_load(df, [key], tasks)
    rows = fragment(df.select(*dict.fromkeys([key, *salt])), plan, salt)
    return skew_aggregate(rows, plan, [F.count("*").alias("n")], [F.sum("n").alias("n")])
