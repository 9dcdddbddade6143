"""Graphs of records that share members: components, label propagation, betweenness, modularity, Girvan-Newman.

An undirected graph is a table (src, dst) with each edge in both directions. Iterations write their state to the shared
folder, so lineages stay short and survive lost executors; the driver sees one flag or number per iteration."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orebody.operators.numbering import running_sum
from orebody.operators.similar import shared_members
from orebody.plans.session import materialise

MOST_VERTICES = 5_000


def both_directions(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.col(a).alias("src"), F.col(b).alias("dst")).unionByName(pairs.select(F.col(b).alias("src"), F.col(a).alias("dst"))).where("src <> dst").distinct()


def overlap_graph(df: DataFrame, record: str, member: str, least: int) -> DataFrame:
    """(src, dst), both ways, of records with at least so many members in common. Records without an edge are absent."""
    return both_directions(shared_members(df, record, member, least), "r1", "r2")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that is connected. Each round takes the least label around and then the label of that
    label, so long paths shrink by doubling; an empty graph has none."""
    edges = materialise(edges.select("src", "dst"), "edges")
    state = materialise(edges.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("label")), "labels")
    while True:
        near = edges.join(state.select(F.col("id").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("label").alias("around"))
        met = state.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "around").alias("label"))
        jump = met.select(F.col("id").alias("label"), F.col("label").alias("far"))
        new = materialise(met.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "labels")
        state = new.select("id", "label")
        if new.where("label <> old").isEmpty():
            return state.select("id", F.col("label").alias("component"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label) after so many synchronous rounds: the most frequent label of the neighbours, the least of equal ones."""
    edges = materialise(edges.select("src", "dst"), "edges")
    state = edges.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = edges.join(state.select(F.col("id").alias("dst"), "label"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
        state = materialise(votes.groupBy(F.col("src").alias("id")).agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label")), "labels")
    return state


def communities(labels: DataFrame, label: str = "label") -> DataFrame:
    """(size, members) per label, members as one string in order, by size and members."""
    sets = labels.groupBy(label).agg(F.count("*").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ", ").alias("members"))
    return sets.select("size", "members").orderBy("size", "members")


def betweenness(edges: DataFrame, sources: DataFrame | None = None, decimals: int = 6) -> DataFrame:
    """(v1, v2, betweenness), v1 < v2: shares of shortest paths over each edge, from every source (by default every vertex),
    halved. Searches run from all sources at once, level by level; credit then flows back from the deepest level."""
    edges = materialise(edges.select("src", "dst"), "edges")
    start = (edges.select(F.col("src").alias("s")).distinct() if sources is None else sources.toDF("s"))
    reached = materialise(start.select("s", F.col("s").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("paths")), "reached")
    front, depth = reached, 0
    while True:
        step = front.select("s", F.col("v").alias("src"), "paths").join(edges, "src").groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        depth += 1
        front = materialise(step.join(reached.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.lit(depth).alias("d"), "paths"), "front")
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    credit, parts = None, []
    for level in range(depth - 1, 0, -1):
        own = reached.where(F.col("d") == level)
        own = own.withColumn("credit", F.lit(1.0)) if credit is None else own.join(credit, ["s", "v"], "left").withColumn("credit", 1.0 + F.coalesce("extra", F.lit(0.0)))
        above = reached.where(F.col("d") == level - 1).select("s", F.col("v").alias("p"), F.col("paths").alias("pp"))
        down = own.select("s", "v", "paths", "credit").join(edges.select(F.col("src").alias("v"), F.col("dst").alias("p")), "v").join(above, ["s", "p"])
        flow = materialise(down.select("s", "v", "p", (F.col("credit") * F.col("pp") / F.col("paths")).alias("flow")), "flow")
        parts.append(flow)
        credit = flow.groupBy("s", F.col("p").alias("v")).agg(F.sum("flow").alias("extra"))
    if not parts:
        return edges.select(F.col("src").alias("v1"), F.col("dst").alias("v2"), F.lit(0.0).alias("betweenness")).where("v1 < v2")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    total = every.groupBy(F.least("v", "p").alias("v1"), F.greatest("v", "p").alias("v2")).agg((F.sum("flow") / 2).alias("betweenness"))
    return total.select("v1", "v2", F.round("betweenness", decimals).alias("betweenness"))


def modularity(edges: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """One row: sum over communities of (edges inside - expected) / 2m, all from the given graph."""
    of = labels.select(F.col("id"), F.col(label).alias("c"))
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))
    per = degree.join(of, "id").groupBy("c").agg(F.sum("k").alias("k"))
    inside = edges.join(of.select(F.col("id").alias("src"), F.col("c").alias("c1")), "src").join(of.select(F.col("id").alias("dst"), F.col("c").alias("c2")), "dst").where("c1 = c2").groupBy(F.col("c1").alias("c")).agg(F.count("*").alias("a"))
    m2 = edges.agg(F.count("*").cast("double")).scalar()
    each = per.join(inside, "c", "left").select((F.coalesce("a", F.lit(0)) / m2 - F.pow(F.col("k") / m2, 2)).alias("q"))
    return each.agg(F.round(F.coalesce(F.sum("q"), F.lit(0.0)), 6).alias("modularity"))


def _edge_credit(adjacent: dict) -> dict[tuple, float]:
    total: dict[tuple, float] = {}
    for s in adjacent:
        dist, paths, order, queue = {s: 0}, {s: 1.0}, [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in adjacent[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0.0
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        credit = dict.fromkeys(order, 1.0)
        for v in reversed(order[1:]):
            for p in adjacent[v]:
                if dist[p] == dist[v] - 1:
                    part = credit[v] * paths[p] / paths[v]
                    credit[p] += part
                    e = (v, p) if v < p else (p, v)
                    total[e] = total.get(e, 0.0) + part / 2
    return total


def _split(adjacent: dict) -> list[list]:
    left, out = set(adjacent), []
    while left:
        group, queue = [], [min(left)]
        left.discard(queue[0])
        while queue:
            v = queue.pop()
            group.append(v)
            for w in adjacent[v]:
                if w in left:
                    left.discard(w)
                    queue.append(w)
        out.append(sorted(group))
    return out


def _cut_spread(placed: DataFrame, m2: float) -> list[DataFrame]:
    """The rows of cut for components of any size, in tables that are written once a step: in each step the top edge of every
    component is cut, so there are as many steps as the largest component has edges."""
    first = materialise(placed, "first")
    degree = first.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))
    everyone = materialise(first.select("component", F.col("src").alias("id")).distinct(), "everyone")
    now, out, step, at, state, top, none = first, [], 0, None, None, None, F.lit(None)
    while True:
        found = components(now.select("src", "dst")).toDF("id", "c")
        groups = materialise(everyone.join(found, "id", "left").select("component", "id", F.coalesce("c", "id").alias("community")), "groups")
        known = groups.select("id", "community")
        expected = groups.join(degree, "id").groupBy("component", "community").agg(F.sum("k").alias("k"))
        within = first.join(known.toDF("src", "c1"), "src").join(known.toDF("dst", "c2"), "dst").where("c1 = c2").groupBy("component", F.col("c1").alias("community")).agg(F.count("*").alias("a"))
        share = F.coalesce("a", F.lit(0)) / m2 - F.pow(F.col("k") / m2, 2)
        q = expected.join(within, ["component", "community"], "left").groupBy("component").agg(F.sum(share).alias("q"))
        if state is None:
            state = q.select("component", "q", F.col("q").alias("gain"), none.cast("double").alias("level"))
        else:
            before = state.select("component", F.col("q").alias("before"), "level")
            state = q.join(before, "component").join(top.select("component", "value"), "component")
            state = state.select("component", "q", (F.col("q") - F.col("before")).alias("gain"), F.least("level", "value").alias("level"))
        state = materialise(state, "state")
        out.append(state.select("component", F.lit(step).alias("step"), "gain", "level", none.alias("id"), none.alias("community")))
        changed = groups if at is None else groups.join(at.select("id", F.col("community").alias("was")), "id").where("community <> was")
        out.append(materialise(changed.select("component", F.lit(step).alias("step"), none.cast("double").alias("gain"), none.cast("double").alias("level"), "id", "community"), "changed"))
        at = groups
        if now.isEmpty():
            return out
        value = betweenness(now.select("src", "dst"), decimals=9).withColumnRenamed("betweenness", "value")
        ranked = value.join(now.select("component", F.col("src").alias("v1"), F.col("dst").alias("v2")), ["v1", "v2"])
        best = F.min_by(F.struct("v1", "v2", "value"), F.struct(-F.col("value"), F.col("v1"), F.col("v2")))
        top = materialise(ranked.groupBy("component").agg(best.alias("e")).select("component", "e.*"), "top")
        gone = both_directions(top, "v1", "v2")
        now = materialise(now.join(gone, ["src", "dst"], "left_anti").select("component", "src", "dst"), "edges")
        step += 1


def girvan_newman(edges: DataFrame) -> DataFrame:
    """(id, community, modularity): the best partition when the edge of the highest betweenness (equal ones by component
    and edge) is cut again and again; the first partition of the highest modularity holds, the uncut graph is no candidate.

    What a cut does stays inside its component, so every component is cut on its own, in parallel. The global order of the
    cuts follows from a sort: a cut comes when the least value that its component has shown so far is the highest of all.
    A running sum of the changes in modularity over that order finds the best moment. A component of more than MOST_VERTICES
    vertices is cut edge by edge with all its searches spread over the tasks (_cut_spread), with the same result."""
    edges = materialise(edges.select("src", "dst"), "edges")
    placed = materialise(edges.join(components(edges), edges.src == F.col("id")).select("component", "src", "dst"), "placed")
    most = placed.groupBy("component").agg(F.countDistinct("src").alias("n")).agg(F.max("n")).first()[0]
    kind = edges.schema["src"].dataType
    if most is None:
        return edges.sparkSession.createDataFrame([], T.StructType([T.StructField("id", kind), T.StructField("community", kind), T.StructField("modularity", T.DoubleType())]))
    m2 = float(edges.count())

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows of steps (id null: what the cut cost, and the value of the edge) and of vertices whose community changed."""
        adjacent: dict = {}
        for a, b in zip(pdf["src"].tolist(), pdf["dst"].tolist()):
            adjacent.setdefault(a, set()).add(b)
        degree = {v: len(x) for v, x in adjacent.items()}
        first = {v: frozenset(x) for v, x in adjacent.items()}
        component, rows, at, step, before, lowest = pdf["component"].iloc[0], [], {}, 0, 0.0, float("inf")
        while True:
            groups, q = _split(adjacent), 0.0
            for g in groups:
                members = set(g)
                q += sum(len(first[v] & members) for v in g) / m2 - (sum(degree[v] for v in g) / m2) ** 2
                rows += [(component, step, None, None, v, g[0]) for v in g if at.get(v) != g[0]]
                at.update(dict.fromkeys(g, g[0]))
            rows.append((component, step, q - before, None if step == 0 else lowest, None, None))
            before, score = q, _edge_credit(adjacent)
            if not score:
                return pd.DataFrame(rows, columns=["component", "step", "gain", "level", "id", "community"], dtype=object)
            top = min(score, key=lambda e: (-round(score[e], 9), e))
            lowest = min(lowest, round(score[top], 9))
            adjacent[top[0]].discard(top[1])
            adjacent[top[1]].discard(top[0])
            step += 1

    schema = T.StructType([T.StructField("component", kind), T.StructField("step", T.IntegerType()), T.StructField("gain", T.DoubleType()), T.StructField("level", T.DoubleType()), T.StructField("id", kind), T.StructField("community", kind)])
    big = F.broadcast(placed.groupBy("component").agg(F.countDistinct("src").alias("n")).where(F.col("n") > MOST_VERTICES).select("component")) if most > MOST_VERTICES else None
    small = placed if big is None else placed.join(big, "component", "left_anti")
    states = materialise(small.groupBy("component").applyInPandas(cut, schema), "cuts")
    if big is not None:
        for part in _cut_spread(placed.join(big, "component", "left_semi"), m2):
            states = states.unionByName(part.select(*(F.col(f.name).cast(f.dataType) for f in schema)))
    lines = states.where("id is null")
    base = lines.where("step = 0").agg(F.sum("gain")).first()[0]
    order = ["down", "component", "step"]
    timed = running_sum(lines.where("step > 0").select((-F.col("level")).alias("down"), "component", "step", "gain"), order, "gain", "q")
    best = timed.agg(F.min_by(F.struct(*order, "q"), F.struct(-F.round("q", 9), *order)).alias("b")).first().b
    taken = timed.where(F.struct(*order) <= F.struct(F.lit(best.down), F.lit(best.component).cast(kind), F.lit(best.step))).groupBy("component").agg(F.max("step").alias("last"))
    known = states.where("id is not null").join(taken, "component", "left").where(F.col("step") <= F.coalesce("last", F.lit(0)))
    final = known.groupBy("id").agg(F.max_by("community", "step").alias("community"))
    return final.withColumn("modularity", F.lit(round(base + best.q, 6)))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).distinct()


__all__ = ("betweenness", "both_directions", "communities", "components", "girvan_newman", "label_propagation", "modularity", "overlap_graph", "vertices")
