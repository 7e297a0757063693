"""Ranked lexical search, reversed: the items' index is broadcast and the documents stream through it.

Terms are maximal runs of digits, letters of ASCII and characters from U+0080 on, A-Z in lower case. An item is
a query; its terms, repeats included, make the index: term, then ``(item, uses)``. One pass over the texts counts
the terms of the index in each document (``search-counts``, written: ids and counts, no text); from it come
the document frequencies. A second pass over these counts adds, for a batch of documents, each term's weight
to its items (one dense sum a batch) and updates one heap of ``k`` documents an item; a batch only touches the
documents that reach an item's lowest kept score. The heaps of all tasks, ``k`` rows an item each, are merged in
two steps: ``MERGE`` tasks at a time, then the rest.

Items come to the driver in blocks of ``INDEX_BYTES`` of text, whatever the table's size; every block is an
index of its own and meets all documents, so what is broadcast and collected has that bound (one longer item is
a block by itself).

Defined results: a text without a term, null or empty, is neither a result nor counted in ``N``; an item without
a term has no rows. Scores of 0 are left out. Rows that repeat an ``item_id`` are items of their own; rows that
repeat a ``doc_id`` are documents of their own. Equal scores are in ascending ``doc_id`` order, null last. Empty
tables give an empty result. Only ``item_id, text`` and ``doc_id, text`` are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import materialize

TOP = 20
#: Text of the items that one index is made of.
INDEX_BYTES = 4 << 20
#: Heaps that are merged at once.
MERGE = 64
#: Sums of one dense batch, and uses of terms that are spread at once.
CELLS = 1 << 22
_LAST = 1 << 63  # a null id, after every other

# --- Fixed values: bytes that are part of a term (in UTF-8 all from 0x80 on are), A-Z as a-z -------
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
# --------------------------------------------------------------------------------------------------


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


class Index:
    """Inverted index of some items: ``ids``; ``number``: term to its number; postings as flat arrays."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.ids = [i for i, _ in items]
        self.number: dict[bytes, int] = {}
        uses: list[dict[int, int]] = []
        for k, (_, text) in enumerate(items):
            for t in terms(text):
                n = self.number.setdefault(t, len(self.number))
                if n == len(uses):
                    uses.append({})
                uses[n][k] = uses[n].get(k, 0) + 1
        self.size = np.array([len(u) for u in uses], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.item = np.array([k for u in uses for k in u], np.int64)
        self.uses = np.array([n for u in uses for n in u.values()], np.int64)


def blocks(items: DataFrame, limit: int) -> Iterator[Index]:
    """Indexes over runs of items, a partition of the table at a time on the driver."""
    got, size = [], 0
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).where("text IS NOT NULL")
    for item, text in rows.toLocalIterator():
        got.append((item, bytes(text)))
        size += len(text)
        if size >= limit:
            yield Index(got)
            got, size = [], 0
    if got:
        yield Index(got)


def _counts(docs: DataFrame, index) -> DataFrame:
    """``doc_id, n, terms, tfs``: a document's number of terms, and which terms of the index it has how often."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = index.value.number
        width = len(number) + 1
        for batch in batches:
            lengths, found = [], []
            for text in batch.column("text").to_pylist():
                words = terms(text)
                lengths.append(len(words))
                found.append(np.fromiter(map(number.get, words, repeat(width - 1)), np.int64, len(words)))
            n = np.array(lengths, np.int64)
            row = np.repeat(np.arange(len(n)), n)
            key, tf = np.unique(row * width + np.concatenate([*found, np.zeros(0, np.int64)]), return_counts=True)
            own = key % width < width - 1
            key, tf = key[own], tf[own]
            ends = np.searchsorted(key, np.arange(len(n) + 1) * width).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((key % width, pa.int32()), (tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


class Heaps:
    """The best ``k`` documents of each item so far; ``floor``: the score that a document must reach to get in."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps, self.floor = k, [[] for _ in range(items)], np.ones(items, np.int64)

    def add(self, docs: list[int], scores: np.ndarray) -> None:
        """``scores``: a row a document, a column an item."""
        for row, item in zip(*np.nonzero(scores >= self.floor), strict=True):
            heap, entry = self.heaps[item], (int(scores[row, item]), -docs[row])
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.floor[item] = heap[0][0]


def _sums(cell: np.ndarray, value: np.ndarray, size: int, exact: bool) -> np.ndarray:
    """Integer sums of ``value`` by ``cell``: doubles hold them below 2**53, else two halves do."""
    if exact:
        return np.bincount(cell, value, size).astype(np.int64)
    low = np.bincount(cell, value & 0x3FFFFFF, size).astype(np.int64)
    return low + (np.bincount(cell, value >> 26, size).astype(np.int64) << 26)


def _score(counts: DataFrame, index, weight, total: int, length: int, k: int, cells: int) -> DataFrame:
    """``item, item_id, doc_id, score, task``: the heaps of each task."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, w = index.value, weight.value
        items = len(ix.ids)
        heaps = Heaps(items, k)
        most = np.bincount(ix.item, ix.uses, items).max() * float(w.max()) * 1e6 if len(w) else 0
        for batch in batches:
            docs = [_LAST if d is None else d for d in batch.column("doc_id").to_pylist()]
            lists, tfs = batch.column("terms"), batch.column("tfs")
            edges = np.asarray(lists.offsets, np.int64) - lists.offsets[0].as_py()
            term, tf = np.asarray(lists.flatten(), np.int64), np.asarray(tfs.flatten(), np.int64)
            # In whole numbers of any size, as 25 * n * N may pass 64 bits.
            m = np.array([75 + 25 * n * total // length if n else 75 for n in batch.column("n").to_pylist()], np.int64)
            doc = np.repeat(np.arange(len(docs)), np.diff(edges))
            value = w[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
            spread = np.concatenate([[0], np.cumsum(ix.size[term])])
            lo = 0
            while lo < len(docs):
                # As many documents as fit both bounds, one at least.
                hi = int(np.searchsorted(spread[edges], spread[edges[lo]] + cells, "right")) - 1
                hi = max(lo + 1, min(hi, lo + cells // max(items, 1), len(docs)))
                some = slice(edges[lo], edges[hi])
                size = ix.size[term[some]]
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ix.start[term[some]], size)
                cell = np.repeat(doc[some] - lo, size) * items + ix.item[at]
                got = _sums(cell, np.repeat(value[some], size) * ix.uses[at], (hi - lo) * items, most < 2**53)
                heaps.add(docs[lo:hi], got.reshape(hi - lo, items))
                lo = hi
        rows = [(i, ix.ids[i], None if -d == _LAST else -d, s) for i, heap in enumerate(heaps.heaps) for s, d in heap]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        task = [TaskContext.get().partitionId()] * len(rows)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*cols, task], kinds, strict=True)], ["item", "item_id", "doc_id", "score", "task"])

    return counts.mapInArrow(stream, "item int, item_id long, doc_id long, score long, task int")


def _best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search(index: Index, docs: DataFrame, k: int, cells: int) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(index)
    counts = materialize(_counts(docs, shared), "search-counts")
    total, length = counts.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row a term of the index at most
    weight = np.zeros(len(index.number), np.int64)
    for term, df in held:
        weight[term] = math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))
    heaps = _score(counts, shared, spark.sparkContext.broadcast(weight), total, length, k, cells)
    heaps = heaps.withColumn("part", F.expr(f"task div {MERGE}"))
    best = _best(_best(heaps, ["item", "part"], k).drop("rank"), ["item"], k)
    return best.select("item_id", "rank", "doc_id", "score")


def search(items: DataFrame, docs: DataFrame, k: int = TOP, index_bytes: int = INDEX_BYTES, cells: int = CELLS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring documents of each row of ``items``."""
    out = None
    for index in blocks(items, index_bytes):
        found = _search(index, docs, k, cells)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
