"""Several values packed in one field: split into (position, value) without a loop over rows.

The scan works on the bytes of an Arrow string buffer. Masks mark escapes, quotes and delimiters; the parity of the quotes
seen since a field's beginning tells what is protected; delimiters outside it become child offsets of a list array, which
is flattened with the ordinal of its parent.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The delimiters of one byte, those of several bytes, white space of several bytes.
SINGLE = b",;|\t\n\r"
WIDE = ("•",)
WIDE_SPACE = (" ", " ", " ", " ", "　", "​", "﻿")


def _buffer(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a string array; a null has length 0."""
    strings = strings.cast(pa.large_string()).fill_null("")
    n = len(strings)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    off = np.frombuffer(strings.buffers()[1], np.int64, n + 1, strings.offset * 8)
    data = strings.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def _seen(mask: np.ndarray, start: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many marked bytes lie in the field before each byte."""
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[:-1] - total[start][of]


def _find(b: np.ndarray, text: str, within: np.ndarray) -> np.ndarray:
    """Marks every byte of the occurrences of a text of several bytes."""
    code, out = text.encode(), np.zeros(len(b), bool)
    hit = np.flatnonzero(b[: len(b) - len(code) + 1] == code[0]) if len(b) >= len(code) else np.zeros(0, int)
    for i, c in enumerate(code):
        hit = hit[b[hit + i] == c]
    hit = hit[within[hit] == within[hit + len(code) - 1]] if len(hit) else hit
    for i in range(len(code)):
        out[hit + i] = True
    return out


def split_packed(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(parent ordinal, position from 1, value) of every value in every field.

    Values stand between the delimiters , ; | tab, line break, bullet, or a slash with blanks on both sides. Double quotes
    protect what is between them (doubled inside, they are one sign); single quotes do so only where they enclose a whole
    value; a backslash protects the next byte. Brackets or braces around a whole field are dropped, as are void places and
    the white space around a value. A field whose double quotes are odd in number has them as ordinary signs, and a
    backslash at a field's end is one too."""
    off, b = _buffer(strings)
    fields, size = len(off) - 1, len(b)
    if not size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    length = np.diff(off)
    of = np.repeat(np.arange(fields), length)
    start, stop = off[:-1], off[1:]
    at = np.arange(size)

    # a backslash protects the next byte unless it is protected itself: runs of backslashes count from their beginning
    slash = b == ord("\\")
    first = np.maximum.accumulate(np.where(slash & np.concatenate(([True], ~slash[:-1] | (of[1:] != of[:-1]))), at, 0))
    escape = slash & ((at - first) % 2 == 0) & (np.append(of[1:], -1) == of)
    guarded = np.concatenate(([False], escape[:-1]))

    blank = ((b == 32) | ((b >= 9) & (b <= 13))) & ~guarded
    for w in WIDE_SPACE:
        if (b == w.encode()[0]).any():
            blank |= _find(b, w, of)

    def ends(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last byte before, and the first one after, that is not marked; -1 and size if there is none."""
        before = np.concatenate(([-1], np.maximum.accumulate(np.where(mask, -1, at))[:-1]))
        after = np.append(np.minimum.accumulate(np.where(mask, size, at)[::-1])[::-1][1:], size)
        return before, after

    prev, nxt = ends(blank)
    # brackets around the whole field count as blanks from here on
    lead = np.where(length > 0, start, 0)
    lead = np.where(blank[np.minimum(lead, size - 1)], nxt[np.minimum(lead, size - 1)], lead)
    tail = np.where(length > 0, stop - 1, 0)
    tail = np.where(blank[np.maximum(tail, 0)], prev[np.maximum(tail, 0)], tail)
    real = (length > 0) & (lead < stop) & (tail >= start) & (tail > lead)
    li, ti = np.clip(lead, 0, size - 1), np.clip(tail, 0, size - 1)
    square, brace = real & (b[li] == ord("[")) & (b[ti] == ord("]")), real & (b[li] == ord("{")) & (b[ti] == ord("}"))
    wrapped = square | brace
    hull = np.zeros(size, bool)
    hull[li[wrapped]] = hull[ti[wrapped]] = True
    blank |= hull
    prev, nxt = ends(blank)

    one = np.isin(b, np.frombuffer(SINGLE, np.uint8)) & ~guarded
    wide = np.zeros(size, bool)
    for w in WIDE:
        if (b == w.encode()[0]).any():
            wide |= _find(b, w, of)
    side = np.append(b[1:], 0), np.concatenate(([0], b[:-1]))
    around = np.append(of[1:], -1) == of, np.concatenate(([-1], of[:-1])) == of
    loose = (b == ord("/")) & ~guarded & np.append(blank[1:], False) & np.concatenate(([False], blank[:-1])) & around[0] & around[1]
    cut = one | wide | loose

    double = (b == ord('"')) & ~guarded
    total = np.concatenate(([0], np.cumsum(double, dtype=np.int64)))
    odd = (total[stop] - total[start]) % 2 == 1
    double &= ~odd[of]
    inside = (_seen(double, start, of) % 2 == 1) | double
    single = (b == ord("'")) & ~guarded & ~inside
    if single.any():
        edge = cut & ~inside
        ahead = (prev < start[of]) | edge[np.maximum(prev, 0)]
        behind = (nxt >= stop[of]) | edge[np.minimum(nxt, size - 1)]
        opens, shuts = single & ahead & ~behind, single & behind & ~ahead
        # only a pair counts: an opening sign whose next marked sign in the field closes
        marks = np.flatnonzero(opens | shuts)
        if len(marks) > 1:
            pair = opens[marks[:-1]] & shuts[marks[1:]] & (of[marks[:-1]] == of[marks[1:]])
            delta = np.zeros(size + 1, np.int64)
            delta[marks[:-1][pair]] += 1
            delta[marks[1:][pair] + 1] -= 1
            enclosed = np.cumsum(delta)[:-1] > 0
        else:
            enclosed = np.zeros(size, bool)
    else:
        enclosed = np.zeros(size, bool)
    cut &= ~inside & ~enclosed

    # child offsets: a child begins with its field and after each delimiter
    head = np.zeros(size, bool)
    head[start[length > 0]] = True
    head |= np.concatenate(([False], cut[:-1]))
    c0 = np.flatnonzero(head)
    c1 = np.append(c0[1:], size)
    c1 = np.where(cut[c1 - 1], c1 - 1, c1)
    void = blank | cut

    def shrink(s: np.ndarray, e: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before, after = ends(mask)
        s1 = np.where((s < e) & mask[np.minimum(s, size - 1)], after[np.minimum(s, size - 1)], s)
        e1 = np.where((s < e) & mask[np.maximum(e - 1, 0)], before[np.maximum(e - 1, 0)] + 1, e)
        return np.minimum(s1, e), np.maximum(np.minimum(e1, e), np.minimum(s1, e))

    s, e = shrink(c0, c1, void)
    full = e - s >= 2
    q0, q1 = b[np.minimum(s, size - 1)], b[np.maximum(e - 1, 0)]
    by_double = full & double[np.minimum(s, size - 1)] & double[np.maximum(e - 1, 0)] & (q0 == q1)
    by_single = full & enclosed[np.minimum(s, size - 1)] & (q0 == ord("'")) & (q1 == ord("'"))
    shed = by_double | by_single
    s, e = np.where(shed, s + 1, s), np.where(shed, e - 1, e)
    s, e = shrink(s, e, blank)

    parent = of[np.minimum(c0, size - 1)]
    keep = e > s
    s, e, parent, by_double = s[keep], e[keep], parent[keep], by_double[keep]
    order = np.arange(len(parent))
    pos = order - np.searchsorted(parent, parent) + 1

    # take the bytes of the values, without escapes and without the first of two quotes
    width = e - s
    total = int(width.sum())
    src = np.repeat(s - np.concatenate(([0], np.cumsum(width)[:-1])), width) + np.arange(total)
    took = ~escape[src]
    if by_double.any():
        run = double & np.concatenate(([False], double[:-1]))
        since = np.maximum.accumulate(np.where(double & ~run, at, 0))
        inner = np.repeat(by_double, width)
        base = np.maximum(since[src], np.repeat(s, width))
        took &= ~(inner & double[src] & ((src - base) % 2 == 0) & np.append(double[1:], False)[src] & (src + 1 < np.repeat(e, width)))
    child = np.repeat(np.arange(len(s)), width)[took]
    data = b[src[took]]
    offsets = np.concatenate(([0], np.cumsum(np.bincount(child, minlength=len(s))))).astype(np.int32)
    values = pa.StringArray.from_buffers(len(s), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))
    return parent, pos, values


def list_array(strings: pa.Array) -> pa.ListArray:
    """One list of values for each field; void and null fields give empty lists."""
    parent, _, values = split_packed(strings)
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(parent, np.arange(len(strings) + 1)), pa.int32()), values)


def explode_packed(df: DataFrame, field: str, keep: Sequence[str], value: str = "value", position: str = "pos") -> DataFrame:
    """One row for each value of a packed field: the kept columns, the position (from 1, void places skipped), the value.

    A null, empty or void field gives no row. Repeated rows and repeated values are kept. Other columns are not read."""
    keep = list(keep)
    schema = T.StructType([*(df.schema[k] for k in keep), T.StructField(position, T.LongType()), T.StructField(value, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = batch.column(len(keep))
            parent, pos, values = split_packed(fields)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(parent, np.arange(len(fields) + 1)), pa.int32()), values)
            rows = lists.value_parent_indices()
            cols = [batch.column(i).take(rows) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pos, pa.int64()), lists.flatten()], names=[*keep, position, value])

    names = [f"__k{i}" for i in range(len(keep))]
    return df.select(*(df[k].alias(n) for k, n in zip(keep, names)), df[field].alias("__packed")).where("__packed is not null").mapInArrow(run, schema)
