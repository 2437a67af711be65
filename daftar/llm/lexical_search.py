"""Ranked lexical search: inverted shards, and a hierarchical max tree over document ranges for each term.

The index has one row per shard, some SHARD bytes of neighbouring documents:
ids and lengths, the shard's terms, and for each term the documents that hold
it with its occurrences. It is written once, knows nothing of any query and
serves all of them; counts of the collection are sums over its narrow columns.

Items are searched in blocks of bounded size. A task builds, for the terms of a
block that its shard holds, trees whose leaves are the term's scores in single
documents and whose nodes are the largest score in ranges of FAN, FAN^2 ...
documents. The sum of an item's nodes bounds every document of a range, so the
range with the highest bound is opened first, and a range stays closed only if
its bound is below the k-th best score found: one with an equal bound is opened,
since it may hold an equal score of a smaller id. A task carries the best of its
shards along; k rows an item and task are merged by a window.

Defined results: documents and items that are null, empty or without a term have
no results; a null doc_id takes part and comes last among equal scores; repeated
document rows are ranked one by one; equal items (id and text) are one, an id
with several texts is several items; a null item_id is an id; a very long text
is a shard of its own; fewer than k documents with a score above 0 are all
returned; without documents or items the result is empty; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .decontaminate import OUTSIDE
from .scratch import discard, materialize, new_path, small_batches
from .sums import partition_sum
from .words import SpanHash, buffer, lowered, slices, split

#: Bytes of text in a shard; children of a tree's node.
SHARD, FAN = 8 << 20, 32
#: Bytes of item texts that go to every task at once; more take more passes over the index.
BLOCK_BYTES = 4 << 20
#: Best documents of an item.
TOP = 10
INDEX = "doc_ids array<long>, lengths binary, keys binary, words binary, ends binary, starts binary, docs binary, counts binary"


def terms_of(column: pa.Array):
    """Terms of a column of texts: ASCII letters and digits and all other characters, A-Z lowered."""
    data, offsets = buffer(column)
    return split(lowered(data), offsets, OUTSIDE)


def distinct_keys(spans: SpanHash, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of spans, equal exactly for equal bytes: hashes, and one more for the later of different spans with one hash. With them their order, and where in it a new key begins."""
    key = spans(start, end)
    while True:
        order = np.argsort(key, kind="stable")
        now = key[order]
        head = np.ones(len(now), bool)
        head[1:] = now[1:] != now[:-1]
        first = order[np.flatnonzero(head)][np.cumsum(head) - 1] if len(now) else order
        other = ~spans.equal(start[order], end[order], spans, start[first], end[first])
        if not other.any():
            return key, order, head
        key[order[other]] += np.uint64(1)


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans one after another, and where each ends."""
    size = end - start
    ends = np.cumsum(size)
    return data[np.repeat(start - (ends - size), size) + np.arange(int(size.sum()))], ends


def inverted(part: pa.RecordBatch) -> list[pa.Array]:
    """The index row of a shard (doc_id, text)."""
    w = terms_of(part.column(1))
    key, order, head = distinct_keys(SpanHash(w.data), w.start, w.end)
    doc = w.doc_of()[order]
    cut = head.copy()
    cut[1:] |= doc[1:] != doc[:-1]
    at = np.flatnonzero(cut)
    starts = np.append(np.flatnonzero(head[at]), len(at))
    heads = order[np.flatnonzero(head)]
    words, ends = gathered(w.data, w.start[heads], w.end[heads])
    blobs = [np.diff(w.first).astype(np.int32), key[heads], words, ends.astype(np.int32), starts.astype(np.int32), doc[at].astype(np.int32), np.diff(np.append(at, len(doc))).astype(np.int32)]
    ids = part.column(0)
    return [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for part in slices(batches, "text", SHARD):
        bytes_here = int(buffer(part.column(1))[1][-1])
        if held and size + bytes_here > SHARD:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(part)
        size += bytes_here
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _shards(batches):
        yield pa.RecordBatch.from_arrays(inverted(part), names=[f.split()[0] for f in INDEX.split(", ")])


def build_index(docs: DataFrame, column: str = "text") -> tuple[DataFrame, str]:
    """The index over all rows of ``docs`` and its path in the shared folder. No shuffle."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col(column).cast("string").alias("text"))
    return materialize(rows.mapInArrow(_index, INDEX), "lexical", large_rows=True)


class Vocabulary:
    """The terms of a block of items, and each item as (term, times)."""

    def __init__(self, items: list[tuple[str | None, str]]):
        w = terms_of(pa.array([t for _, t in items], pa.string()))
        every = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
        self.words = sorted(set(every))
        place = {x: k for k, x in enumerate(self.words)}
        self.ids = [i for i, _ in items]
        counts = [Counter(place[x] for x in every[a:b]) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.terms = [np.array(sorted(c), np.int64) for c in counts]
        self.times = [np.array([c[k] for k in sorted(c)], np.int64) for c in counts]
        sizes = np.array([len(x) for x in self.words], np.int64)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.data = np.frombuffer(b"".join(self.words), np.uint8)

    def find(self, keys: np.ndarray, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which term of a shard each word is, or -1; bytes decide."""
        own, other = SpanHash(self.data), SpanHash(words)
        wanted = own(self.start, self.end)
        starts = np.concatenate((np.zeros(1, ends.dtype), ends[:-1])).astype(np.int64)
        found = np.full(len(wanted), -1, np.int64)
        left = np.arange(len(wanted)) if len(keys) else np.zeros(0, np.int64)
        while len(left):
            at = np.minimum(np.searchsorted(keys, wanted[left]), len(keys) - 1)
            left, at = left[keys[at] == wanted[left]], at[keys[at] == wanted[left]]
            same = own.equal(self.start[left], self.end[left], other, starts[at], ends[at].astype(np.int64))
            found[left[same]] = at[same]
            left = left[~same]
            wanted[left] += np.uint64(1)
        return found


class Trees:
    """Max trees of some terms over the documents of a shard: from the documents up to one node a term, each level's entries in order of term and range."""

    def __init__(self, term: np.ndarray, docs: np.ndarray, values: np.ndarray, n_docs: int):
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(docs, values, docs[:0])]
        width = n_docs
        while width > 1 or len(self.levels) == 1:
            docs = docs // FAN
            head = np.ones(len(docs), bool)
            head[1:] = (term[1:] != term[:-1]) | (docs[1:] != docs[:-1])
            at = np.flatnonzero(head)
            values = np.maximum.reduceat(values, at)
            self.levels.append((docs[at], values, np.append(at, len(docs))))
            docs, term, width = docs[at], term[at], -(-width // FAN)

    @property
    def top(self) -> np.ndarray:
        """The largest value of each term."""
        return self.levels[-1][1]

    def search(self, terms: np.ndarray, times: np.ndarray, best: Best) -> None:
        """Offer every document that can still be among the best to ``best``, ranges of the highest bound first."""
        level = len(self.levels) - 1
        bound = int((self.levels[level][1][terms] * times).sum())
        heap, pushed = [(-bound, 0, level, 0, terms, times)], 1
        while heap and -heap[0][0] >= best.floor:
            _, _, level, range_id, entries, times = heapq.heappop(heap)
            child = self.levels[level][2]
            ranges, values, _ = self.levels[level - 1]
            first = child[entries]
            size = child[entries + 1] - first
            total = np.cumsum(size)
            below = np.repeat(first - (total - size), size) + np.arange(total[-1])
            weight = np.repeat(times, size)
            local = ranges[below] - range_id * FAN
            sums = np.zeros(FAN, np.int64)
            np.add.at(sums, local, values[below] * weight)
            open_ = np.flatnonzero(sums >= best.floor)
            if level == 1:
                for k in open_[np.argsort(-sums[open_], kind="stable")]:
                    best.offer(int(sums[k]), range_id * FAN + int(k))
                continue
            for k in open_:
                mine = local == k
                heapq.heappush(heap, (-int(sums[k]), pushed, level - 1, range_id * FAN + int(k), below[mine], weight[mine]))
                pushed += 1


class Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int):
        self.k, self.floor, self.heap, self.ids = k, 1, [], []

    def offer(self, score: int, doc: int) -> None:
        doc_id = self.ids[doc]
        row = (score, doc_id is not None, -(doc_id or 0))
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, row)
        elif row > self.heap[0]:
            heapq.heapreplace(self.heap, row)
        if len(self.heap) == self.k:
            self.floor = self.heap[0][0]


def _numbers(column: pa.Array, row: int, kind) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), kind)


def collection(index: DataFrame, vocabulary: Vocabulary) -> tuple[int, int, np.ndarray]:
    """Documents with a term, their terms, and the documents that hold each word of the vocabulary."""

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for row in range(batch.num_rows):
            lengths = _numbers(batch.column(0), row, np.int32)
            total[0] += np.count_nonzero(lengths)
            total[1] += lengths.sum()
            found = vocabulary.find(_numbers(batch.column(1), row, np.uint64), _numbers(batch.column(2), row, np.uint8), _numbers(batch.column(3), row, np.int32))
            held = np.flatnonzero(found >= 0)
            total[2 + held] += np.diff(_numbers(batch.column(4), row, np.int32))[found[held]]

    total = partition_sum(index.select("lengths", "keys", "words", "ends", "starts"), add, 2 + len(vocabulary.words))
    return int(total[0]), int(total[1]), total[2:].astype(np.int64)


def _searched(vocabulary: Vocabulary, n_docs: int, n_terms: int, weight: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in vocabulary.ids]
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column(0)[row].as_py()
                kinds = (np.int32, np.uint64, np.uint8, np.int32, np.int32, np.int32, np.int32)
                lengths, keys, words, ends, starts, docs, counts = (_numbers(batch.column(1 + c), row, kind) for c, kind in enumerate(kinds))
                found = vocabulary.find(keys, words, ends)
                held = np.flatnonzero(found >= 0)
                if not len(held):
                    continue
                # the postings of the words that are held, one word after another
                first, size = starts[found[held]].astype(np.int64), np.diff(starts)[found[held]].astype(np.int64)
                at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                term, doc, tf = np.repeat(np.arange(len(held)), size), docs[at].astype(np.int64), counts[at].astype(np.int64)
                m = np.array([25 + 75 * n * n_docs // n_terms for n in lengths.tolist()], np.int64)
                trees = Trees(term, doc, weight[held[term]] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])), len(lengths))
                place = np.full(len(vocabulary.words), -1, np.int64)
                place[held] = np.arange(len(held))
                for terms, times, b in zip(vocabulary.terms, vocabulary.times, best, strict=True):
                    mine = place[terms]
                    some = mine >= 0
                    if some.any():
                        b.ids = ids
                        trees.search(mine[some], times[some], b)
        rows = [(q, score, -low if known else None) for q, b in enumerate(best) for score, known, low in b.heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["query", "score", "doc_id"])

    return run


def item_blocks(items: DataFrame) -> Iterator[list[tuple[str | None, str]]]:
    """Distinct (item_id, text) in blocks of bounded size, streamed through the driver."""
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).filter("t is not null").distinct()
    for row in rows.orderBy("i", "t").toLocalIterator():
        if block and size + len(row[1].encode()) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += len(row[1].encode())
    if block:
        yield block


def search(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k best documents; exact."""
    spark = index.sparkSession
    small_batches(spark)
    kind = items.schema["item_id"].dataType
    order = Window.partitionBy("block", "query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = new_path(spark, "ranked")
    spark.createDataFrame([], "item_id string, rank int, doc_id long, score long").write.parquet(out)
    for n, block in enumerate(item_blocks(items)):
        vocabulary = Vocabulary(block)
        n_docs, n_terms, df = collection(index, vocabulary)
        if not n_terms or not vocabulary.words:
            continue
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        found = index.mapInArrow(_searched(vocabulary, n_docs, n_terms, weight, k), "query int, score long, doc_id long")
        names = spark.createDataFrame([(q, i) for q, i in enumerate(vocabulary.ids)], "query int, item_id string")
        ranked = found.withColumn("block", F.lit(n)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score").write.mode("append").parquet(out)
    return spark.read.schema("item_id string, rank int, doc_id long, score long").parquet(out).withColumn("item_id", F.col("item_id").cast(kind))


def rank(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Index ``docs``, search all items, and remove the index."""
    index, path = build_index(docs)
    out = search(index, items, k)
    discard(docs.sparkSession, path)
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
