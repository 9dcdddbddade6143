"""Passages of evaluation texts inside training documents: size-partitioned MinHash containment search, verified exactly.

Queries are the windows of `passage` words of every evaluation text, as sets of five-word shingles. Documents are read in
overlapping passages of bounded length, so that a window inside a document is wholly inside one of them, and passages are
partitioned by their number of shingles. In a partition of at most u shingles a contained window of q shingles has a
similarity of at least q / u, which fixes how many hash functions give the wanted recall. The index holds the minimum of
every function over every window, as one number. A passage that has one of them as a minimum of its own is a candidate, and
its runs of `passage` words are joined to those of the items, as words. Windows that repeat a shingle are smaller sets than
the functions are made for; passages with any of their shingles are candidates too.

The index is sent as a Bloom filter of a bounded size whatever the number of items; with it go the items' runs as numbers,
so that of a candidate only runs that an item may have are exchanged. What a filter lets through by mistake the join takes out.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orebody.operators.skew import plan_load, skew_join
from orebody.plans.session import materialise

SHINGLE = 5
PASSAGE_WORDS = 32
#: Bits of the filter for each number in the index, probes, and the most bits that are sent to the tasks (64 MB).
BITS_EACH, PROBES, MOST_BITS = 32, 4, 1 << 29
_BLOCK_BITS = 19

# Elements that begin a new line, marks that are not seen, the hyphen at a line's end.
_BLOCK = re.compile(r"<(?:br|/?(?:p|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|blockquote|section|article|pre))(?:\s[^<>@]*)?/?>", re.I)
_HIDDEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>", re.I | re.S)
_INLINE = re.compile(r"</?[a-z][a-z0-9]*(?:\s[^<>@]*)?/?>", re.I)
_UNSEEN = re.compile("[­​-‏⁠⁡-⁤﻿]")
_HYPHEN = re.compile(r"(?<=\w)[-‐‑][ \t]*\r?\n\s*(?=\w)")
_MARKS = re.compile("[̀-ͯ᪰-᫿⃐-⃿︀-️]")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """The words a reader of the displayed page takes: without markup, entities, case, accents, punctuation and layout."""
    if "<" in text:
        text = _INLINE.sub("", _BLOCK.sub("\n", _HIDDEN.sub(" ", text)))
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", _UNSEEN.sub("", text).casefold()))
    else:
        text = text.lower()
    return _WORD.findall(_HYPHEN.sub("", text))


def functions_for(query: int, most: int, recall: float) -> int:
    """Hash functions by which a set contained in one of at most `most` elements is found with the given probability."""
    similarity = query / max(most, query)
    return 1 if similarity >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - similarity))


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Batch:
    """Words and shingles of some texts on one axis; the shingles that begin in a text's last words are of no text."""

    def __init__(self, texts: list[str]):
        self.words = [words_of(t) for t in texts]
        flat = list(chain.from_iterable(self.words))
        sizes = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.base = np.concatenate(([0], np.cumsum(sizes)))
        self.count = np.maximum(sizes - SHINGLE + 1, 0)
        of = dict.fromkeys(flat, 0)
        for w in of:
            of[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(of.__getitem__, flat), np.uint64, len(flat))
        h = np.concatenate((h, np.zeros(SHINGLE, np.uint64)))
        out = np.zeros(len(flat) + 1, np.uint64)
        for i in range(SHINGLE):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)]
        self.shingles = _mix(out)
        self.hashes = h

    def runs(self, passage: int) -> np.ndarray:
        """Hash of the words from each place on, as many as a passage has."""
        h, out = np.concatenate((self.hashes, np.zeros(passage, np.uint64))), np.zeros(len(self.shingles), np.uint64)
        for i in range(passage):
            out = out * np.uint64(0xD1342543DE82EF95) + h[i : i + len(out)]
        return _mix(out)


class Search:
    """How windows and passages are hashed; a number stands for a function and a minimum, or for a shingle by itself."""

    def __init__(self, passage: int, recall: float, seed: int = 1):
        self.passage, self.window = passage, passage - SHINGLE + 1
        self.length = max(PASSAGE_WORDS, 2 * passage)
        self.span, self.stride = self.length - SHINGLE + 1, self.length - passage + 1
        self.bounds = sorted({max(self.window, math.ceil(self.span * x)) for x in (0.45, 0.7, 1.0)})
        self.functions = np.array([functions_for(self.window, b, recall) for b in self.bounds])
        rng = np.random.default_rng(seed)
        most = int(self.functions.max())
        self.a = rng.integers(0, 1 << 63, most, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.c = rng.integers(0, 1 << 63, most, dtype=np.uint64)

    @staticmethod
    def number(values: np.ndarray, function: int) -> np.ndarray:
        return _mix(values ^ np.uint64((function + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).view(np.int64)

    def of_items(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all windows, numbers of the shingles of windows that repeat one)"""
        batch, parts, again = Batch(texts), [], []
        for d, n in enumerate(batch.count.tolist()):
            if n >= self.window:
                s = batch.shingles[batch.base[d] : batch.base[d] + n]
                windows = np.lib.stride_tricks.sliding_window_view(s, self.window)
                parts += [self.number((windows * a + c).min(1), k) for k, (a, c) in enumerate(zip(self.a, self.c))]
                ordered = np.sort(windows, 1)
                again.append(self.number(np.unique(windows[(ordered[:, 1:] == ordered[:, :-1]).any(1)]), -1))
                parts.append(self.number(batch.runs(self.passage)[batch.base[d] : batch.base[d + 1] - self.passage + 1], -2))
        void = np.zeros(0, np.int64)
        return np.unique(np.concatenate(parts)) if parts else void, np.unique(np.concatenate(again)) if again else void

    def candidates(self, batch: Batch, keep, repeats: bool) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of the words of passages with a minimum, or a shingle of a window that repeats one, that keep lets
        through."""
        n = len(batch.count)
        pieces = np.where(batch.count >= self.window, np.ceil(np.maximum(batch.count - self.span, 0) / self.stride).astype(np.int64) + 1, 0)
        owner = np.repeat(np.arange(n), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = batch.base[owner] + nth * self.stride
        stop = np.minimum(start + self.span, batch.base[owner] + batch.count[owner])
        hit = np.zeros(len(owner), bool)
        if len(owner) and repeats:
            seen = np.concatenate(([0], np.cumsum(keep(self.number(batch.shingles, -1)))))
            hit = seen[stop] > seen[start]
        uses = self.functions[np.searchsorted(self.bounds, stop - start)]
        for k in range(len(self.a)):
            todo = np.flatnonzero(~hit & (uses > k))
            if not len(todo):
                break
            values = batch.shingles * self.a[k] + self.c[k]
            low = np.minimum.reduceat(values, np.stack([start[todo], stop[todo]], 1).ravel())[::2]
            hit[todo] = keep(self.number(low, k))
        return start[hit], stop[hit] + SHINGLE - 1

    def places(self, batch: Batch, keep, repeats: bool) -> np.ndarray:
        """Words of the batch at which a run of a candidate begins that an item may have."""
        first, end = self.candidates(batch, keep, repeats)
        edge = np.zeros(len(batch.shingles) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, np.maximum(end - self.passage + 1, first), -1)
        at = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        return at[keep(self.number(batch.runs(self.passage)[at], -2))] if len(at) else at


def probes(number: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bits of a number in a filter of 2 ** bits of them."""
    h = number.view(np.uint64)
    low, step = h, _mix(h) | np.uint64(1)
    return [((low + np.uint64(j) * step) & np.uint64((1 << bits) - 1)).astype(np.int64) for j in range(PROBES)]


def build_filter(index: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of the index's numbers, of at most MOST_BITS bits: blocks of it are made in parallel and put together."""
    bits = min(max(_BLOCK_BITS, math.ceil(math.log2(max(1, n) * BITS_EACH))), MOST_BITS.bit_length() - 1)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.unique(np.concatenate(probes(batch["number"].to_numpy(), bits)))
            yield pd.DataFrame({"block": at >> _BLOCK_BITS, "at": at & ((1 << _BLOCK_BITS) - 1)})

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(1 << _BLOCK_BITS, np.uint8)
        marks[pdf["at"].to_numpy()] = 1
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(marks).tobytes()]})

    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in index.select("number").mapInPandas(place, "block bigint, at bigint").distinct().groupBy("block").applyInPandas(fill, "block bigint, bits binary").collect():
        out[r.block << (_BLOCK_BITS - 3) : (r.block + 1) << (_BLOCK_BITS - 3)] = np.frombuffer(r.bits, np.uint8)
    return out, bits


def passes(table: np.ndarray, bits: int, number: np.ndarray) -> np.ndarray:
    """Which numbers the filter lets through: all that are in it, and few others."""
    left = np.arange(len(number))
    for at in probes(number, bits):
        at = at[left]
        left = left[(table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1]
    out = np.zeros(len(number), bool)
    out[left] = True
    return out


def item_words(items: DataFrame, item: str, item_text: str) -> DataFrame:
    """(item, words) of every item with a text; repeated rows are one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"item": batch["item"], "words": pd.Series([words_of(t) for t in batch["t"]], index=batch.index, dtype=object)})

    read = items.select(F.col(item).cast("bigint").alias("item"), F.col(item_text).alias("t")).dropna().distinct()
    return read.mapInPandas(run, "item bigint, words array<string>")


def _runs_of(words: str, passage: int):
    """(pos, gram): the runs of so many words, joined by blanks, with their places from 0."""
    last = F.size(words) - passage
    joined = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, F.lit(passage)), " ")))
    return F.posexplode(joined).alias("pos", "gram")


def find_leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, passage: int = 13, recall: float = 0.9999) -> DataFrame:
    """(doc, item, longest): documents with a run of at least `passage` consecutive words of an item, and the longest run.

    Ids are whole numbers. A null text has no words; items of fewer words than a passage are in no document by this measure
    (item_lengths names them); repeated documents and items are one each, texts with one id are looked at one by one. Items
    and documents are both read in parallel, and neither passes through the driver; what is sent to the tasks is a filter of
    at most MOST_BITS bits. Whole documents are read, of any length. Passages that many documents share are spread."""
    search = Search(passage, recall)
    words = materialise(item_words(items, item, item_text), "items")

    def index_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            numbers, again = search.of_items([" ".join(w) for w in batch["words"]])
            yield pd.DataFrame({"number": np.concatenate((numbers, again)), "again": np.repeat([False, True], [len(numbers), len(again)])})

    index = materialise(words.mapInPandas(index_of, "number bigint, again boolean").distinct(), "index")
    n, again = index.agg(F.count("*"), F.coalesce(F.max("again"), F.lit(False))).first()
    sent = docs.sparkSession.sparkContext.broadcast(build_filter(index, n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, bits = sent.value
        for batch in batches:
            for i in range(0, len(batch), 2000):
                part = batch.iloc[i : i + 2000]
                texts, ids = part["t"].tolist(), part["d"].to_numpy()
                found = Batch(texts)
                at = search.places(found, lambda x: passes(table, bits, x), again)
                of = np.searchsorted(found.base, at, side="right") - 1
                p = at - found.base[of]
                own = {d: xxhash.xxh64_intdigest(texts[d]) - (1 << 63) for d in np.unique(of).tolist()}
                grams = [" ".join(found.words[d][k : k + passage]) for d, k in zip(of.tolist(), p.tolist())]
                yield pd.DataFrame({"doc": ids[of], "h": pd.Series([own[d] for d in of.tolist()], dtype="int64"), "p": p, "gram": pd.Series(grams, dtype=object)})

    read = docs.select(F.col(doc).cast("bigint").alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")
    places = materialise(read.mapInPandas(run, "doc bigint, h bigint, p bigint, gram string"), "places")
    known = words.select("item", _runs_of("words", passage)).select("item", F.col("pos").alias("q"), "gram")
    same = skew_join(places, known, plan_load(places, ["gram"]), ["doc", "h", "p"]).select("doc", "h", "item", "p", (F.col("p") - F.col("q")).alias("off"))
    # a run goes on where the next place matches at the same distance
    along = Window.partitionBy("doc", "h", "item", "off").orderBy("p")
    stretch = same.distinct().withColumn("run", F.col("p") - F.row_number().over(along)).groupBy("doc", "h", "item", "off", "run").agg(F.count("*").alias("n"))
    return stretch.groupBy("doc", "item").agg((F.max("n") + passage - 1).alias("longest"))


def item_lengths(items: DataFrame, item: str, item_text: str) -> DataFrame:
    """(item, n_words): how long the items are; those shorter than a passage cannot be searched for."""
    return item_words(items, item, item_text).groupBy("item").agg(F.max(F.size("words")).cast("bigint").alias("n_words"))
