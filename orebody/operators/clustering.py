"""Clustering of points (id, vec): k-means with outliers, and BFR in rounds over discard, compression and retained sets.

Points stay in tables; what travels are summaries of clusters (count, mean, mean of squares per dimension), whose number is
bounded by a few k per round. Assignment and sums are one pass of numpy over Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orebody.operators.numbering import nth_key
from orebody.plans.session import materialise

FLOOR_STD = 0.001


@dataclass(frozen=True)
class Summary:
    """Statistics of one cluster."""

    n: int
    mean: np.ndarray
    squares: np.ndarray

    @property
    def std(self) -> np.ndarray:
        var = np.sqrt(np.maximum(self.squares - self.mean**2, 0.0))
        return np.where(var == 0, FLOOR_STD, var)

    def merged(self, other: Summary) -> Summary:
        n = self.n + other.n
        return Summary(n, (self.mean * self.n + other.mean * other.n) / n, (self.squares * self.n + other.squares * other.n) / n)

    def with_point(self, vec: np.ndarray) -> Summary:
        return self.merged(Summary(1, vec, vec * vec))


def _nearest(vecs: np.ndarray, means: np.ndarray, stds: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest mean and the distance; equal distances go to the earlier one."""
    best, where = np.full(len(vecs), np.inf), np.zeros(len(vecs), np.int64)
    for k, m in enumerate(means):
        d = vecs - m
        if stds is not None:
            d = d / stds[k]
        dist = np.sqrt((d * d).sum(1))
        closer = dist < best
        best[closer], where[closer] = dist[closer], k
    return where, best


def assign(points: DataFrame, means: np.ndarray, stds: np.ndarray | None = None, within: float = math.inf) -> DataFrame:
    """points with c, the nearest cluster's number, or -1 where none is nearer than `within` (or there is none)."""
    sent = points.sparkSession.sparkContext.broadcast((means, stds))
    kind = points.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, s = sent.value
        for batch in batches:
            if len(m) and len(batch):
                c, d = _nearest(np.stack(batch["vec"].to_numpy()).astype(float), m, s)
                batch["c"] = np.where(d < within, c, -1)
            else:
                batch["c"] = -1
            yield batch

    return points.select("id", "vec").mapInPandas(run, f"id {kind}, vec array<double>, c int")


def summaries(assigned: DataFrame) -> dict[int, Summary]:
    """Per cluster number, from one partial sum per batch and cluster."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vecs, c = np.stack(batch["vec"].to_numpy()).astype(float), batch["c"].to_numpy()
                for k in np.unique(c).tolist():
                    own = vecs[c == k]
                    yield pd.DataFrame({"c": [k], "n": [len(own)], "s": [own.sum(0)], "q": [(own * own).sum(0)]})

    return _collected(assigned.where("c >= 0").select("vec", "c").mapInPandas(run, "c int, n bigint, s array<double>, q array<double>"))


def _collected(parts: DataFrame) -> dict[int, Summary]:
    """Partial sums added up per cluster and dimension: as many rows reach the driver."""
    flat = parts.select("c", "n", F.posexplode(F.arrays_zip("s", "q")).alias("i", "z")).groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum("z.s").alias("s"), F.sum("z.q").alias("q"))
    out: dict[int, list] = {}
    for r in flat.collect():
        out.setdefault(r.c, []).append((r.i, r.n, r.s, r.q))
    return {c: Summary(rows[0][1], np.array([s / n for _, n, s, _ in rows]), np.array([q / n for _, n, _, q in rows])) for c, rows in ((c, sorted(x)) for c, x in sorted(out.items()))}


def _partial_sums(points: DataFrame, means: np.ndarray, far: float) -> tuple[dict[int, Summary], int]:
    """(summaries by nearest mean, points farther than `far` from all) in one pass over the points."""
    sent = points.sparkSession.sparkContext.broadcast(means)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, list] = {}
        for batch in batches:
            if len(batch):
                vecs = np.stack(batch["vec"].to_numpy()).astype(float)
                c, dist = _nearest(vecs, sent.value, None)
                c = np.where(dist < far, c, -1)
                for k in np.unique(c).tolist():
                    own = vecs[c == k]
                    n, s, q = total.get(k, (0, 0.0, 0.0))
                    total[k] = (n + len(own), s + own.sum(0), q + (own * own).sum(0))
        if total:
            yield pd.DataFrame({"c": list(total), "n": [x[0] for x in total.values()], "s": [x[1] for x in total.values()], "q": [x[2] for x in total.values()]})

    out = _collected(points.select("vec").mapInPandas(run, "c int, n bigint, s array<double>, q array<double>"))
    gone = out.pop(-1, None)
    return out, gone.n if gone else 0


def kmeans(points: DataFrame, k: int, rounds: int, far: float = 3000.0, seed: int = 666, first: np.ndarray | None = None) -> tuple[DataFrame, dict[int, Summary]]:
    """(assigned, summaries): Euclidean k-means from k points of the least hash, or from the first means given. A point farther than `far` from its nearest
    mean is out for good (c = -1); clusters without points vanish; it ends when no mean moves, or after so many rounds.
    Clusters are numbered from 0 in both results."""
    points = materialise(points.select("id", F.col("vec").cast("array<double>").alias("vec")), "points")
    if first is None:
        first = np.array([r.vec for r in points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).collect()])
    means, live, out = first, points, None
    for _ in range(rounds):
        if not len(means):
            break
        stats, n_gone = _partial_sums(live, means, far)
        if n_gone:
            assigned = assign(live, means, None, far)
            gone = materialise(assigned.where("c < 0").select("id", "vec"), "gone")
            out = gone if out is None else out.unionByName(gone)
            live = materialise(assigned.where("c >= 0").select("id", "vec"), "live")
        new = np.array([stats[c].mean for c in sorted(stats)])
        if new.shape == means.shape and np.allclose(new, means, rtol=0, atol=1e-12):
            break
        means = new
    stats = _partial_sums(live, means, math.inf)[0] if len(means) else {}
    means = np.array([means[c] for c in sorted(stats)])  # those that have points
    final = materialise(assign(live, means), "assigned")
    if out is not None:
        final = final.unionByName(out.withColumn("c", F.lit(-1)))
    return final, {i: stats[c] for i, c in enumerate(sorted(stats))}


def _matrix(of: dict[int, Summary]) -> tuple[list[int], np.ndarray, np.ndarray]:
    keys = sorted(of)
    return keys, np.array([of[c].mean for c in keys]), np.array([of[c].std for c in keys])


def mahalanobis(a: np.ndarray, b: np.ndarray, std: np.ndarray) -> float:
    return float(np.sqrt((((a - b) / std) ** 2).sum()))


def merge_compressed(cs: dict[int, Summary], limit: float) -> tuple[dict[int, Summary], dict[int, int]]:
    """Merges pairs by ascending distance (with the first one's deviation) below the limit, each cluster at most once; the
    new clusters, and where each old number went."""
    keys = sorted(cs)
    pairs = sorted((mahalanobis(cs[a].mean, cs[b].mean, cs[a].std), a, b) for i, a in enumerate(keys) for b in keys[i + 1 :])
    out, went, used = dict(cs), {}, set()
    for d, a, b in pairs:
        if d >= limit:
            break
        if a in used or b in used:
            continue
        used |= {a, b}
        out[a] = cs[a].merged(cs[b])
        del out[b]
        went[b] = a
    return out, went


@dataclass
class State:
    """ds, cs: clusters by number. points: how many points each cluster of a set has. went: where the points of a compression
    cluster are now, by its first number. parts: (id, set, cid) of every point as it was assigned, written once."""

    ds: dict[int, Summary]
    cs: dict[int, Summary]
    retained: DataFrame
    parts: list[DataFrame] = field(default_factory=list)
    points: dict[tuple[str, int], int] = field(default_factory=dict)
    went: dict[int, tuple[str, int]] = field(default_factory=dict)

    def add(self, to: str, keys: list[int], assigned: DataFrame) -> None:
        """Take up points assigned to clusters, whose numbers keys[c] belong to c."""
        target = self.ds if to == "ds" else self.cs
        for c, s in summaries(assigned).items():
            target[keys[c]] = target[keys[c]].merged(s)
            self.points[to, keys[c]] = self.points.get((to, keys[c]), 0) + s.n
        if keys:
            names = F.array(*(F.lit(int(k)) for k in keys))
            self.parts.append(assigned.where("c >= 0").select("id", F.lit(to).alias("set"), F.get(names, F.col("c")).alias("cid")))

    def compress(self, points: DataFrame, k: int, start: int, far: float) -> dict[int, Summary]:
        """New clusters of more than one point among these; the rest is retained."""
        assigned, stats = kmeans(points, 3 * k, 10, far)
        keep = [c for c, s in stats.items() if s.n > 1]
        inside = F.col("c").isin(keep) if keep else F.lit(False)
        self.parts.append(assigned.where(inside).select("id", F.lit("cs").alias("set"), (F.col("c") + start).cast("int").alias("cid")))
        self.retained = materialise(assigned.where(~inside).select("id", "vec"), "retained")
        for c in keep:
            self.points["cs", c + start] = stats[c].n
            self.went[c + start] = ("cs", c + start)
        return {c + start: stats[c] for c in keep}

    def move(self, cluster: int, to: tuple[str, int]) -> None:
        """A compression cluster's points go to another cluster."""
        self.points[to] = self.points.get(to, 0) + self.points.pop(("cs", cluster), 0)
        self.went = {c: to if now == ("cs", cluster) else now for c, now in self.went.items()}

    def in_set(self, name: str) -> int:
        return sum(n for (s, _), n in self.points.items() if s == name)

    def members(self) -> DataFrame:
        """(id, set, cid) as things are now: the parts, through a map of as many rows as there were compression clusters."""
        every = self.parts[0]
        for p in self.parts[1:]:
            every = every.unionByName(p)
        now = every.sparkSession.createDataFrame([(c, s, k) for c, (s, k) in self.went.items()], "cid int, now_set string, now_cid int")
        joined = every.join(F.broadcast(now), "cid", "left")
        return joined.select("id", F.coalesce("now_set", "set").alias("set"), F.coalesce("now_cid", "cid").alias("cid"))


def bfr(rounds: list[DataFrame], k: int, far: float = 3000.0, fix_n: bool = False) -> tuple[list[tuple], DataFrame]:
    """(report, assignment) over batches of points (id, vec), each id once: per round (round_id, nof_cluster_discard,
    nof_point_discard, nof_cluster_compression, nof_point_compression, nof_point_retained); (point_id, cluster), -1 for
    points that end up in no discard cluster. Clusters are numbered 0..k-1. With one batch there is no final merge. Counts
    of a discard cluster are not raised by the final merge unless fix_n, which changes the distances of later merges. Empty
    batches change nothing; without any point the counts are 0. Points are read once a round; what earlier rounds assigned
    is not touched again, as only summaries of clusters change."""
    report, state = [], None
    d = next((len(x.vec) for x in (r.select("vec").first() for r in rounds) if x), 0)
    near = 3 * math.sqrt(d)
    for i, batch in enumerate(rounds):
        batch = materialise(batch.select("id", F.col("vec").cast("array<double>").alias("vec")), "batch")
        start = (i + 1) * 1_000_000
        if state is None:
            n = batch.count()
            head = F.col("id") <= F.lit(nth_key(batch, "id", math.ceil(0.75 * n))) if n else F.lit(True)
            assigned, ds = kmeans(batch.where(head), k, 30, far)
            state = State(ds, {}, batch, [assigned.where("c >= 0").select("id", F.lit("ds").alias("set"), F.col("c").alias("cid"))], {("ds", c): s.n for c, s in ds.items()})
            rest = batch.where(~head).unionByName(assigned.where("c < 0").select("id", "vec"))
            keys, means, stds = _matrix(ds)
            close = materialise(assign(rest, means, stds, math.sqrt(d) / 2), "close")
            state.add("ds", keys, close)
            state.cs = state.compress(close.where("c < 0").select("id", "vec"), k, start, far)
        else:
            keys, means, stds = _matrix(state.ds)
            to_ds = materialise(assign(batch, means, stds, near), "to_ds")
            state.add("ds", keys, to_ds)
            left = to_ds.where("c < 0").select("id", "vec")
            if state.cs:
                keys, means, stds = _matrix(state.cs)
                to_cs = materialise(assign(left, means, stds, near), "to_cs")
                state.add("cs", keys, to_cs)
                left = to_cs.where("c < 0").select("id", "vec")
            new = state.compress(state.retained.unionByName(left), k, start, far)
            state.cs, went = merge_compressed(state.cs | new, near)
            for b, a in went.items():
                state.move(b, ("cs", a))
            if i == len(rounds) - 1:
                for c in sorted(state.cs) if state.ds else []:
                    s = state.cs[c]
                    dist, best = min((mahalanobis(x.mean, s.mean, x.std), b) for b, x in state.ds.items())
                    if dist < near:
                        merged = state.ds[best].merged(s)
                        state.ds[best] = merged if fix_n else replace(merged, n=state.ds[best].n)
                        state.move(c, ("ds", best))
                        del state.cs[c]
                keys, means, stds = _matrix(state.ds)
                last = materialise(assign(state.retained, means, stds, near), "last")
                for r in last.where("c >= 0").groupBy("c").agg(F.count("*").alias("n")).collect():
                    state.points["ds", keys[r.c]] = state.points.get(("ds", keys[r.c]), 0) + r.n
                state.parts.append(last.where("c >= 0").select("id", F.lit("ds").alias("set"), (F.get(F.array(*(F.lit(int(x)) for x in keys)), F.col("c")) if keys else F.col("c")).alias("cid")))
                state.retained = last.where("c < 0").select("id", "vec")
        report.append((i + 1, len(state.ds), state.in_set("ds"), len(state.cs), state.in_set("cs"), state.retained.count()))
    clusters = state.members().select(F.col("id").alias("point_id"), F.when(F.col("set") == "ds", F.col("cid")).otherwise(-1).cast("int").alias("cluster"))
    return report, clusters.unionByName(state.retained.select(F.col("id").alias("point_id"), F.lit(-1).alias("cluster")))
