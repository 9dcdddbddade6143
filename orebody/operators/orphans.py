"""References to records that are missing, deleted or late.

References and parents' validity intervals are co-partitioned by key (heavily referenced keys over several shards, with
their intervals replicated) and sorted by key and time; one pass over the merged stream keeps, per key, the number of
intervals open so far. A reference at time t is good while an interval with added_at <= t < removed_at is open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebody.operators.skew import TASK, fragment, plan_load, replicate


def intervals(parent: DataFrame, key: str, added: str = "added_at", removed: str = "removed_at") -> DataFrame:
    """Distinct validity intervals (ref_key, added, removed) of a parent table; records that are equal in these count once."""
    return parent.select(F.col(key).alias("ref_key"), F.col(added).alias("__added"), F.col(removed).alias("__removed")).where("ref_key is not null").distinct()


def classify_references(refs: DataFrame, parents: DataFrame, keys: Sequence[str], at: str, salt: Sequence[str], tasks: int | None = None) -> DataFrame:
    """refs with a column status: ok, missing (no parent record at all), deleted (some interval ended before), late (all
    begin later). refs has the key columns and the time `at`; parents has the key columns, __added and __removed.

    References with a null key are dropped: they refer to nothing. A null time finds no record in force: the status is
    missing, or late if a parent exists. An interval without a beginning, or that ends before it begins, is never in
    force, but its parent exists. Repeated references and intervals are kept, and equal times open an interval first."""
    keys = list(keys)
    plan = plan_load(refs, keys, tasks)
    extra = [c for c in refs.columns if c not in keys]
    ref = fragment(refs, plan, salt, place=False).select(
        TASK, *keys, F.col(at).alias("__t"), F.lit(2).alias("__kind"), F.lit(0).alias("__open"), F.lit(0).alias("__ended"), F.struct(*extra).alias("__row")
    )
    void = F.lit(None).cast(ref.schema["__row"].dataType)
    real = F.col("__added").isNotNull() & (F.col("__removed").isNull() | (F.col("__removed") > F.col("__added")))
    begin = F.struct(F.when(real, F.col("__added")).alias("t"), F.when(real, 1).otherwise(0).alias("open"), F.lit(0).alias("ended"))
    end = F.struct(F.col("__removed").alias("t"), F.when(real, -1).otherwise(0).alias("open"), F.lit(1).alias("ended"))
    both = F.when(F.col("__removed").isNull(), F.array(begin)).otherwise(F.array(begin, end))
    par = replicate(parents, plan, place=False).select(TASK, *keys, F.explode(both).alias("e"))
    par = par.select(TASK, *keys, F.col("e.t").alias("__t"), F.lit(1).alias("__kind"), F.col("e.open").alias("__open"), F.col("e.ended").alias("__ended"), void.alias("__row"))
    merged = ref.unionByName(par).repartitionById(plan.tasks, F.col(TASK))
    key = Window.partitionBy(TASK, *keys)
    # nulls sort first, so a reference without a time meets no event; a begin without a time adds nothing
    so_far = key.orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.max(F.when(F.col("__kind") == 1, 1).otherwise(0)).over(key)
    status = (
        F.when(F.col("__now") > 0, "ok").when(F.col("__known") == 0, "missing").when(F.col("__gone") > 0, "deleted").otherwise("late")
    )
    out = merged.withColumns({"__now": F.sum("__open").over(so_far), "__gone": F.sum("__ended").over(so_far), "__known": known})
    return out.where("__kind = 2").select(*keys, "__row.*", status.alias("status"))
