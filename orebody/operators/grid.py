"""Pairs of records with members in common, counted without an exchange of meetings.

Records are dealt to groups by a hash, and the rows of each group are written once to the shared folder. A cell of the grid is a
pair of groups: its task reads both and goes through the records of the first in blocks, so meetings of two records are made,
counted and dropped where they are. Only pairs that keep the rule, or each wanted key's best neighbours, leave the task. What is
written and exchanged is therefore proportional to the rows and the result, whatever the number of meetings.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orebody.operators.numbering import dense_index
from orebody.operators.skew import plan_load, skew_join
from orebody.plans.session import materialise, qualified, shared_path

#: Rows of a group at most (of one record always in one), and rows for which another group is worth its task.
GROUP_ROWS, WORTH, GROUPS = 2_500_000, 5_000, 12
#: Meetings made at once, counters, and neighbours sent on at once.
MEETINGS, COUNTERS, SENT = 1_500_000, 1 << 23, 200_000
#: Members at most whose meetings are counted by products of matrices, and pairs summed up at once.
HOT, PIECE = 64, 20_000

PAIR = "i1 bigint, i2 bigint, common bigint, n1 bigint, n2 bigint, n bigint, sx double, sy double, sxx double, syy double, sxy double, agree boolean"
NEIGHBOUR = "own bigint, key bigint, far bigint, sim double, x double, far_avg double"


@dataclass(frozen=True)
class Rule:
    """Which pairs count: `least` members in common with values on both sides, the Jaccard similarity `jaccard`, a positive
    correlation, and an equal minimum of one of the hash functions ((a * k + b) mod p) mod m of the members. With `mark`,
    the last only decides the column agree."""

    least: int = 1
    jaccard: float = 0.0
    positive: bool = False
    family: tuple[tuple[int, int], ...] = ()
    p: int = 1
    m: int = 1
    mark: bool = False


def numbered(df: DataFrame, column: str, dense: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """df, a stored table, with a column of whole numbers in the order of its values, and the table (column, idx) of them; None
    where the numbers are the column itself."""
    if not dense and isinstance(df.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return df.withColumn(column, F.col(column).cast("bigint")), None
    index = materialise(dense_index(df, column, "idx"), "index")
    return materialise(_placed(df, column, index), "numbered"), index


def _placed(df: DataFrame, column: str, index: DataFrame) -> DataFrame:
    joined = skew_join(df, index, plan_load(df, [column]), [c for c in df.columns if c != column] or [column])
    return joined.select(*(F.col("idx").alias(c) if c == column else F.col(c) for c in df.columns))


def number(df: DataFrame, column: str, index: DataFrame | None) -> DataFrame:
    """df with the numbers that were given to another table's column; rows without one are dropped."""
    if index is None:
        return df.withColumn(column, F.col(column).cast("bigint"))
    return _placed(df, column, index.withColumnRenamed(next(c for c in index.columns if c != "idx"), column))


def named(df: DataFrame, column: str, index: DataFrame | None) -> DataFrame:
    """df with the values that were numbered."""
    if index is None:
        return df
    value = next(c for c in index.columns if c != "idx")
    return df.join(index.select(F.col("idx").alias(column), F.col(value).alias("__value")), column).drop(column).withColumnRenamed("__value", column).select(*df.columns)


def _stored(df: DataFrame, by: str, groups: int, what: str) -> str:
    path = shared_path(df.sparkSession, what)
    df.withColumn("g", F.pmod(F.xxhash64(by), F.lit(groups)).cast("int")).write.partitionBy("g").parquet(path)
    return qualified(df.sparkSession, path)


def _groups(rows: int) -> int:
    return max(math.ceil(rows / GROUP_ROWS), min(GROUPS, 1 + rows // WORTH))


def pairs(rows: DataFrame, rule: Rule) -> DataFrame:
    """PAIR of all i1 < i2 that keep the rule, of rows (i, k, x), each (i, k) once. x may be null: such a row counts as a
    member, not for n and the sums."""
    spark = rows.sparkSession
    rows = rows.select("i", "k", F.col("x").cast("double").alias("x"))
    groups = _groups(rows.count())
    path = _stored(rows, "i", groups, "grid")
    cells = [(a, b) for a in range(groups) for b in range(a, groups)]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for c in f["id"]:
                yield from _cell(path, *cells[c], rule)

    return spark.range(0, len(cells), 1, len(cells)).mapInPandas(count, PAIR)


def neighbours(wanted: DataFrame, rows: DataFrame, rule: Rule, n: int) -> DataFrame:
    """NEIGHBOUR of wanted (own, key): the n records far with a row of that key that are most similar to own (equal ones by
    far), with x of that row and the mean x of far. The similarity is the correlation, rounded to six decimals, and positive."""
    spark = rows.sparkSession
    rows = rows.select("i", "k", F.col("x").cast("double").alias("x"))
    groups = _groups(rows.count())
    path, asked = _stored(rows, "i", groups, "grid"), _stored(wanted.select("own", "key"), "own", groups, "asked")

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for g in f["id"]:
                yield from _near(path, asked, int(g), groups, rule, n)

    return spark.range(0, groups, 1, groups).mapInPandas(look, NEIGHBOUR)


def _read(path: str, g: int, columns: list[str]) -> list[np.ndarray]:
    import pyarrow.fs as pf
    import pyarrow.parquet as pq

    system, root = pf.FileSystem.from_uri(path)
    at = f"{root}/g={g}"
    if system.get_file_info(at).type == pf.FileType.NotFound:
        return [np.empty(0, np.float64 if c == "x" else np.int64) for c in columns]
    found = pq.read_table(at, filesystem=system, columns=columns, partitioning=None)
    return [found[c].to_numpy() for c in columns]


class _Side:
    """The records of a group: ids in ascending order, and their members k and values x from ptr[r] to ptr[r + 1]."""

    def __init__(self, path: str, g: int, only: np.ndarray | None = None):
        i, k, x = _read(path, g, ["i", "k", "x"])
        if only is not None:
            inside = np.isin(i, only)
            i, k, x = i[inside], k[inside], x[inside]
        order = np.argsort(i, kind="stable")
        self.k, self.x = k[order], x[order]
        self.ids, first = np.unique(i[order], return_index=True)
        self.ptr = np.append(first, len(i)).astype(np.int64)
        self.size = np.diff(self.ptr)
        self.row = np.repeat(np.arange(len(self.ids), dtype=np.int64), self.size)

    def by_member(self) -> None:
        order = np.argsort(self.k, kind="stable")
        self.members, first = np.unique(self.k[order], return_index=True)
        self.start, self.held = first.astype(np.int64), np.diff(np.append(first, len(self.k)))
        self.of, self.of_x = self.row[order], self.x[order]

    def found(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the records of the members k begin, and how many there are."""
        if not len(self.members):
            return np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
        at = np.minimum(np.searchsorted(self.members, k), len(self.members) - 1)
        return self.start[at], np.where(self.members[at] == k, self.held[at], 0)

    def signatures(self, rows: np.ndarray, rule: Rule) -> np.ndarray:
        """The minimum of each hash function over the members of the given records."""
        size = self.size[rows]
        first = np.cumsum(size) - size
        k = self.k[np.repeat(self.ptr[rows] - first, size) + np.arange(size.sum())]
        out = np.empty((len(rule.family), len(rows)), np.int64)
        for f, (a, b) in enumerate(rule.family):
            out[f] = np.minimum.reduceat((a * k + b) % rule.p % rule.m, first) if len(rows) else 0
        return out


def _spans(load: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Successive ranges of items whose loads are not above `most` together, or single items."""
    total, at = np.append(0, np.cumsum(load)), 0
    while at < len(load):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        if total[to] > total[at]:
            yield at, to
        at = to


def _spread(start: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each range from start of length held, its number and its places."""
    which = np.repeat(np.arange(len(start)), held)
    return which, np.arange(len(which)) + np.repeat(start - (np.cumsum(held) - held), held)


def _blocks(a: _Side, b: _Side, same: bool, once: bool, rule: Rule) -> Iterator[tuple]:
    """(first row, end row, row, col, common, n, sums) of the pairs of a and b that may keep the rule, block by block of rows."""
    hot = _frequent(a, b)
    if len(hot):
        yield from _hot_blocks(a, b, hot, same, once, rule)
        return
    start, held = b.found(a.k)
    load = np.add.reduceat(held, a.ptr[:-1]) if len(a.ids) else held
    width = len(b.ids)
    for r0, r1 in _spans(load, MEETINGS):
        e0, e1 = a.ptr[r0], a.ptr[r1]
        entry, place = _spread(start[e0:e1], held[e0:e1])
        entry += e0
        row, col = a.row[entry], b.of[place]
        if same:
            other = _other(a, b, row, col, once)
            entry, place, row, col = entry[other], place[other], row[other], col[other]
        code = (row - r0) * width + col
        dense = (r1 - r0) * width <= COUNTERS
        where = code if dense else ((code * -7046029254386353131).view(np.uint64) >> np.uint64(42)).astype(np.int64)
        count = np.bincount(where)[where]
        keep = count >= rule.least
        if rule.jaccard:
            keep &= count * (1 + rule.jaccard) >= rule.jaccard * (1 - 1e-9) * (a.size[row] + b.size[col])
        keep = np.flatnonzero(keep)
        if not len(keep):
            continue
        code, inverse = np.unique(code[keep], return_inverse=True)
        x, y = a.x[entry[keep]], b.of_x[place[keep]]
        there = ~np.isnan(x + y)
        x, y = np.where(there, x, 0.0), np.where(there, y, 0.0)
        common, n = np.bincount(inverse), np.bincount(inverse, there).astype(np.int64)
        row, col = code // width + r0, code % width
        sums = [np.bincount(inverse, v) for v in (x, y, x * x, y * y, x * y)]
        good = n >= rule.least
        if rule.jaccard:
            good &= common / (a.size[row] + b.size[col] - common) >= rule.jaccard
        if rule.positive:
            over, under = _parts(n, *sums)
            good &= (over > 0) & (under > 0)
        yield r0, r1, row[good], col[good], common[good], n[good], [s[good] for s in sums]


def _other(a: _Side, b: _Side, row: np.ndarray, col: np.ndarray, once: bool) -> np.ndarray:
    return a.ids[row] < b.ids[col] if once else a.ids[row] != b.ids[col]


def _frequent(a: _Side, b: _Side) -> np.ndarray:
    """The members that so many records of both sides have that a product of matrices counts them with less to do."""
    cells = len(a.ids) * len(b.ids)
    if not cells or len(b.ids) > COUNTERS:
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(b.members, a.k), len(b.members) - 1)
    load = np.bincount(at[b.members[at] == a.k], minlength=len(b.members)) * b.held
    top = np.argsort(-load, kind="stable")[:HOT]
    top = top[load[top] * 500 >= cells]
    return np.sort(b.members[top]) if load[top].sum() * 25 >= cells else np.empty(0, np.int64)


def _matrices(side: _Side, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which records have the hot members, with a value, and the values; which rows are those."""
    at = np.minimum(np.searchsorted(hot, side.k), len(hot) - 1)
    inside = hot[at] == side.k
    row, at, x = side.row[inside], at[inside], side.x[inside]
    has, there, value = np.zeros((len(side.ids), len(hot)), np.float32), np.zeros((len(side.ids), len(hot))), np.zeros((len(side.ids), len(hot)))
    has[row, at], there[row, at], value[row, at] = 1, ~np.isnan(x), np.nan_to_num(x)
    return has, there, value, inside


def _hot_blocks(a: _Side, b: _Side, hot: np.ndarray, same: bool, once: bool, rule: Rule) -> Iterator[tuple]:
    """As _blocks, with meetings in hot members counted by products of matrices and all others one by one."""
    (ha, ta, va, inside), (hb, tb, vb, _) = _matrices(a, hot), _matrices(b, hot)
    start, held = b.found(a.k)
    held = np.where(inside, 0, held)
    width = len(b.ids)
    load = np.add.reduceat(held, a.ptr[:-1]) + math.ceil(width * MEETINGS / COUNTERS)
    for r0, r1 in _spans(load, MEETINGS):
        count = (ha[r0:r1] @ hb.T).ravel()
        e0, e1 = a.ptr[r0], a.ptr[r1]
        entry, place = _spread(start[e0:e1], held[e0:e1])
        entry += e0
        met = (a.row[entry] - r0) * width + b.of[place]
        np.add.at(count, met, np.float32(1))
        code = np.flatnonzero(count >= max(1, rule.least))
        row, col = code // width + r0, code % width
        good = _other(a, b, row, col, once) if same else np.ones(len(code), bool)
        common = count[code].astype(np.int64)
        if rule.jaccard:
            good &= common / (a.size[row] + b.size[col] - common) >= rule.jaccard
        code, row, col, common = code[good], row[good], col[good], common[good]
        if not len(code):
            continue
        at = np.minimum(np.searchsorted(code, met), len(code) - 1)
        kept = np.flatnonzero(code[at] == met)
        at, x, y = at[kept], a.x[entry[kept]], b.of_x[place[kept]]
        there = ~np.isnan(x + y)
        x, y = np.where(there, x, 0.0), np.where(there, y, 0.0)
        sums = [np.bincount(at, v, len(code)).astype(float) for v in (there, x, y, x * x, y * y, x * y)]
        for p in range(0, len(code), PIECE):
            q = slice(p, p + PIECE)
            t1, v1, t2, v2 = ta[row[q]], va[row[q]], tb[col[q]], vb[col[q]]
            for total, one, two in zip(sums, (t1, v1, t1, v1 * v1, t1, v1), (t2, t2, v2, t2, v2 * v2, v2)):
                total[q] += np.einsum("ph,ph->p", one, two)
        n, *sums = sums
        n = np.rint(n).astype(np.int64)
        good = n >= rule.least
        if rule.positive:
            over, under = _parts(n, *sums)
            good &= (over > 0) & (under > 0)
        yield r0, r1, row[good], col[good], common[good], n[good], [v[good] for v in sums]


def _parts(n, sx, sy, sxx, syy, sxy) -> tuple[np.ndarray, np.ndarray]:
    m = np.maximum(n, 1)
    return sxy - sx * sy / m, (sxx - sx * sx / m) * (syy - sy * sy / m)


def _agree(a: _Side, b: _Side, row: np.ndarray, col: np.ndarray, rule: Rule) -> np.ndarray:
    """Pairs with an equal minimum; signatures are made of the records in them only."""
    (ra, ia), (rb, ib) = np.unique(row, return_inverse=True), np.unique(col, return_inverse=True)
    sa, sb = a.signatures(ra, rule), b.signatures(rb, rule)
    out = np.zeros(len(row), bool)
    for x, y in zip(sa, sb):
        out |= x[ia] == y[ib]
    return out


def _cell(path: str, g1: int, g2: int, rule: Rule) -> Iterator[pd.DataFrame]:
    a = _Side(path, g1)
    b = a if g1 == g2 else _Side(path, g2)
    b.by_member()
    held, size = [], 0

    def out() -> pd.DataFrame:
        row, col, common, n, *sums = (np.concatenate(v) for v in zip(*held))
        agree = _agree(a, b, row, col, rule) if rule.family else np.ones(len(row), bool)
        if not rule.mark:
            row, col, common, n, *sums = (v[agree] for v in (row, col, common, n, *sums))
            agree = agree[agree]
        one, two, n1, n2 = a.ids[row], b.ids[col], a.size[row], b.size[col]
        turn = one > two
        swap = lambda x, y: (np.where(turn, y, x), np.where(turn, x, y))
        (one, two), (n1, n2), (sx, sy), (sxx, syy) = swap(one, two), swap(n1, n2), swap(sums[0], sums[1]), swap(sums[2], sums[3])
        return pd.DataFrame({"i1": one, "i2": two, "common": common, "n1": n1, "n2": n2, "n": n, "sx": sx, "sy": sy, "sxx": sxx, "syy": syy, "sxy": sums[4], "agree": agree})

    for _, _, row, col, common, n, sums in _blocks(a, b, g1 == g2, True, rule):
        held.append((row, col, common, n, *sums))
        size += len(row)
        if size > SENT:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _near(path: str, asked: str, g: int, groups: int, rule: Rule, n: int) -> Iterator[pd.DataFrame]:
    own, key = _read(asked, g, ["own", "key"])
    a = _Side(path, g, own)
    order = np.argsort(own, kind="stable")
    own, key = own[order], key[order]
    at = np.searchsorted(own, a.ids)
    end = np.searchsorted(own, a.ids, "right")
    row_of = np.searchsorted(a.ids, own)
    best: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0), np.empty(0)]
    for other in range(groups):
        b = _Side(path, other)
        b.by_member()
        with np.errstate(invalid="ignore"):
            mean = np.array([np.nansum(b.x[p:q]) / max(1, np.count_nonzero(~np.isnan(b.x[p:q]))) for p, q in zip(b.ptr[:-1], b.ptr[1:])])
        start, held = b.found(key)
        held = np.where(np.isin(own, a.ids), held, 0)
        width, new = len(b.ids), []
        for r0, r1, row, col, _, count, sums in _blocks(a, b, other == g, False, rule):
            if not len(row):
                continue
            over, under = _parts(count, *sums)
            scaled = over / np.sqrt(under) * 1e6
            sim = (np.floor(scaled) + (scaled - np.floor(scaled) >= 0.5)) / 1e6
            keep = sim > 0
            if rule.family:
                keep &= _agree(a, b, row, col, rule)
            code, sim = ((row - r0) * width + col)[keep], sim[keep]
            w0, w1 = int(at[r0]), int(end[r1 - 1])
            if w0 >= w1 or not len(code):
                continue
            table = None
            if (r1 - r0) * width <= COUNTERS:
                table = np.zeros((r1 - r0) * width)
                table[code] = sim
            for v0, v1 in _spans(held[w0:w1], MEETINGS):
                entry, place = _spread(start[w0 + v0 : w0 + v1], held[w0 + v0 : w0 + v1])
                entry += w0 + v0
                met = (row_of[entry] - r0) * width + b.of[place]
                if table is not None:
                    s = table[met]
                else:
                    where = np.minimum(np.searchsorted(code, met), len(code) - 1)
                    s = np.where(code[where] == met, sim[where], 0.0)
                hit = np.flatnonzero((s > 0) & ~np.isnan(b.of_x[place]))
                far = b.of[place[hit]]
                new.append(_top([entry[hit], s[hit], b.ids[far], b.of_x[place[hit]], mean[far]], n))
        if new:
            best = _top([np.concatenate(v) for v in zip(best, *new)], n)
    entry, s, far, x, far_avg = best
    if len(entry):
        yield pd.DataFrame({"own": own[entry], "key": key[entry], "far": far, "sim": s, "x": x, "far_avg": far_avg})


def _top(rows: list[np.ndarray], n: int) -> list[np.ndarray]:
    """Of each entry, the n rows with the highest similarity, equal ones by far."""
    order = np.lexsort((rows[2], -rows[1], rows[0]))
    entry = rows[0][order]
    first = np.flatnonzero(np.append(True, entry[1:] != entry[:-1])) if len(entry) else np.empty(0, np.int64)
    rank = np.arange(len(entry)) - np.repeat(first, np.diff(np.append(first, len(entry))))
    return [v[order[rank < n]] for v in rows]
