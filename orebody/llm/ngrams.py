"""Frequency of every term and n-gram, in all and in records, from suffix arrays.

Each block of records is one sequence of term numbers in which every record ends with a number of its own. Its suffixes
are sorted up to the first n terms by prefix doubling; the array of common prefixes cuts the order into intervals, one for
each distinct n-gram. An interval's width is the n-gram's count; taking away the adjacencies of suffixes of one record
inside the interval leaves the number of records. Blocks share no record, so their figures add up.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_TERMS = 1_000_000


def suffix_order(code: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes' first `depth` numbers, equal ones by position."""
    rank, width = code.astype(np.int64), 1
    while width < depth:
        step = min(width, depth - width)
        after = np.concatenate((rank[step:], np.full(min(step, len(rank)), -1)))
        order = np.lexsort((after, rank))
        a, b = rank[order], after[order]
        fresh = np.empty(len(order), np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        rank, width = fresh, width + step
    return np.argsort(rank, kind="stable")


def common_prefixes(code: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place in the order, how many numbers (at most depth) its suffix shares with the one before; 0 at the first."""
    size = len(code)
    padded = np.concatenate((code, -1 - np.arange(depth)))
    out, open_ = np.zeros(size, np.int32), np.ones(max(0, size - 1), bool)
    for k in range(depth):
        open_ &= padded[order[1:] + k] == padded[order[:-1] + k]
        out[1:] += open_
    return out


def count_block(code: np.ndarray, record: np.ndarray, depth: int, longest: int | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per n from 1 to longest (by default depth): (a position of each distinct n-gram, count, number of records). code is negative at the ends
    of records, with a number of its own each time; record is the record's number at each position, ascending."""
    order = suffix_order(code, depth)
    shared = common_prefixes(code, order, depth)
    ends = np.flatnonzero(code < 0)
    room = ends[np.searchsorted(ends, np.arange(len(code)))] - np.arange(len(code)) if len(ends) else np.zeros(0, int)
    out = []
    for n in range(1, (longest or depth) + 1):
        whole = room[order] >= n
        head = shared < n
        interval = np.cumsum(head) - 1
        total = np.bincount(interval, minlength=1)
        first = order[head]
        ok = whole[head]
        # suffixes with equal first n numbers but different later ones are not in the order of their records
        if n < depth:
            inner = np.lexsort((record[order], interval))
            rec = record[order][inner]
        else:
            rec = record[order]
        again = np.concatenate(([False], (rec[1:] == rec[:-1]) & (interval[1:] == interval[:-1])))
        records = total - np.bincount(interval, weights=again, minlength=len(total)).astype(np.int64)
        out.append((first[ok], total[ok], records[ok]))
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Array]:
    """Lists of terms, about BLOCK_TERMS terms at a time; a record is never cut."""
    held, size = [], 0
    for batch in batches:
        lists = pc.split_pattern_regex(batch.column(0).cast(pa.large_string()), "[^a-z]+")
        held.append(lists)
        size += len(lists.flatten())
        if size >= BLOCK_TERMS:
            yield pa.chunked_array(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.chunked_array(held).combine_chunks()


def _encode(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code, record, vocabulary): term numbers with an end of its own after each record; void terms are dropped."""
    flat, owner = lists.flatten(), lists.value_parent_indices().to_numpy()
    words = flat.dictionary_encode()
    vocabulary = words.dictionary
    void = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py()
    term = words.indices.to_numpy()
    keep = term != void
    term, owner, n = term[keep], owner[keep], len(lists)
    at = np.arange(len(term)) + owner
    code, record = np.empty(len(term) + n, np.int64), np.empty(len(term) + n, np.int64)
    code[at], record[at] = term, owner
    end = np.cumsum(np.bincount(owner, minlength=n)) + np.arange(n)
    code[end], record[end] = -1 - np.arange(n), np.arange(n)
    return code, record, vocabulary


def ngram_counts(docs: DataFrame, record: str, text: str, max_n: int = 1, depth: int = 2) -> DataFrame:
    """(n, gram, occurrences, records) of every n-gram of terms up to max_n; the terms of a gram are joined by a blank.

    A term is a maximal run of a-z in the lower-cased text; grams do not reach over a record's end. Rows that agree in
    record are one record, a null record is a record too (all such rows are one); rows with a null text are left out, a
    text without terms has no grams. Suffixes are sorted by at least `depth` terms, from which the shorter grams are read, too.
    A record's text is never cut, and a block is as large as its records need."""
    depth = max(depth, max_n)
    rows = docs.select(F.col(record).alias("r"), F.lower(F.col(text)).alias("x")).where("x is not null").dropDuplicates(["r"]).select("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in _blocks(batches):
            code, who, vocabulary = _encode(lists)
            for n, (first, total, records) in enumerate(count_block(code, who, depth, max_n), 1):
                parts = [vocabulary.take(pa.array(code[first + k])) for k in range(n)]
                gram = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", vocabulary.type))
                for i in range(0, len(first), 50_000):
                    j = slice(i, i + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(first[j]), n), pa.int32()), gram.slice(i, 50_000).cast(pa.string()), pa.array(total[j], pa.int64()), pa.array(records[j], pa.int64())],
                        names=["n", "gram", "occurrences", "records"],
                    )

    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("gram", T.StringType()), T.StructField("occurrences", T.LongType()), T.StructField("records", T.LongType())])
    parts = rows.mapInArrow(run, schema)
    return parts.groupBy("n", "gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_frequency(counts: DataFrame, records: int | object, rare: int, common: float) -> DataFrame:
    """Adds a column mark: rare (at most `rare` records), otherwise common (more than the share `common` of all records), else null."""
    share = F.col("records") > F.lit(common) * records
    return counts.withColumn("mark", F.when(F.col("records") <= rare, "rare").when(share, "common"))


def all_records(docs: DataFrame, record: str, text: str) -> DataFrame:
    """One row, n: the number of records with a text."""
    return docs.where(F.col(text).isNotNull()).select(record).distinct().agg(F.count("*").alias("n"))


__all__: Sequence[str] = ("all_records", "count_block", "mark_frequency", "ngram_counts", "suffix_order")
