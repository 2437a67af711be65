"""Benchmark decontamination with an FM-index per training shard.

Texts become word ids over the benchmark's vocabulary; a word outside it ends
any occurrence, so only runs of known words as long as the shortest window are
indexed. Each shard of runs gets a suffix array (prefix doubling until all ranks
differ), its BWT in a wavelet tree, and every ``SAMPLE``-th suffix
position. All windows are searched backwards together, their rows located by
walking to sampled positions, and the occurrences merged into spans.

Defined results: null and empty texts have no words and no hits; benchmark
items without words are ignored; a null item_id is shown as "null" in the list
of ids, one item with any that is so named; repeated document rows are scored
one by one and repeated items count once per distinct item_id; ties cannot arise, since separators differ by
place; a very long text is a shard of its own and takes memory in proportion to
its length; an empty benchmark leaves every text clean and an empty table stays
empty; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize, small_batches
from .words import CHUNK, SpanHash, Words, buffer, covered, lowered, slices, split

#: Windows of so many words; items with fewer words are one window.
WINDOW = 13
#: Every so many text positions are kept for locating.
SAMPLE = 8
#: Benchmark words (or eights of bytes) in one broadcast block, and blocks that a worker holds at once; a larger benchmark
#: takes more passes. A block takes some 45 MB in a worker.
BLOCK_WORDS, AT_ONCE = 250_000, 4
#: A text is contaminated if so many times the hit words reach its words.
CONTAMINATED = 20
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ : bytes that end a word.
OUTSIDE = np.array([not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80) for b in range(256)])


class WaveletTree:
    """Rank over an integer sequence: one bit vector per bit of the alphabet, most significant first."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.zeros: list[np.ndarray] = []
        now = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level) & 1
            zero = np.zeros(len(now) + 1, np.int32)
            np.cumsum(1 - bit, out=zero[1:])
            self.zeros.append(zero)
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before position ``at``, for arrays of both."""
        begin = np.zeros_like(at)
        for level, zero in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            one = ((symbol >> level) & 1).astype(bool)
            zb, za = zero[begin], zero[at]
            begin, at = np.where(one, zero[-1] + begin - zb, zb), np.where(one, zero[-1] + at - za, za)
        return at - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(at)
        for zero in self.zeros:
            one = zero[at + 1] == zero[at]
            symbol = symbol * 2 + one
            at = np.where(one, zero[-1] + at - zero[at], zero[at])
        return symbol


class FMIndex:
    """Backward search in a sequence of ids >= 1 in which 0 separates runs."""

    def __init__(self, text: np.ndarray, size: int):
        text = np.append(text, 0)
        n = len(text)
        # Separators differ from each other, by place, so that comparing suffixes ends at the run's end.
        gap = text == 0
        rank = np.where(gap, np.cumsum(gap) - 1, text + int(gap.sum()))
        span, top = 1, 0
        while top < n:
            follow = np.zeros(n, np.int64)
            if top:
                follow[: n - span] = rank[span:] + 1
                span *= 2
            key = rank * (n + size + 2) + follow
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([False], ordered[1:] != ordered[:-1])))
            top = int(rank.max()) + 1
        self.n = n
        bwt = text[order - 1]
        self.tree = WaveletTree(bwt, size)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        self.sampled = np.full(n, -1, np.int64)
        kept = (order % SAMPLE == 0) | (bwt == 0)  # a walk never has to cross a separator
        self.sampled[kept] = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges of equally long patterns, one per row."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, j]
            low[live] = self.before[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.tree.rank(symbol, high[live])
            live = live[high[live] > low[live]]
            if not len(live):
                break
        gone = np.ones(len(patterns), bool)
        gone[live] = False
        high[gone] = low[gone]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        rows = rows.copy()
        found = np.full(len(rows), -1, np.int64)
        steps = np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            at = self.sampled[rows[live]]
            known = at >= 0
            found[live[known]] = (at[known] + steps[live[known]]) % self.n
            live = live[~known]
            symbol = self.tree.access(rows[live])
            rows[live] = self.before[symbol] + self.tree.rank(symbol, rows[live])
            steps[live] += 1
        return found


class Phrases:
    """The windows of a block of benchmark items, as ids over their own vocabulary."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        rows: dict[tuple[bytes, ...], set[str]] = {}
        for item, text in items:
            w = split(*_lower(pa.array([text], pa.binary())), OUTSIDE)
            words = [w.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
            width = min(window, len(words))
            for i in range(len(words) - width + 1 if width else 0):
                rows.setdefault(tuple(words[i : i + width]), set()).add(item)
        vocabulary = sorted({x for row in rows for x in row})
        ids = {x: i + 1 for i, x in enumerate(vocabulary)}
        self.size = len(vocabulary) + 1
        joined = np.frombuffer(b"".join(vocabulary), np.uint8)
        ends = np.cumsum([len(x) for x in vocabulary], dtype=np.int64)
        hashes = SpanHash(joined)(np.concatenate(([0], ends))[:-1].astype(np.int64), ends) if vocabulary else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], (order + 1).astype(np.int32)
        self.bytes, self.ends = joined, ends
        # words that share a hash with another are told apart one by one
        same = self.hashes[1:] == self.hashes[:-1]
        self.doubtful = np.unique(self.hashes[1:][same])
        self.word_ids = {x: ids[x] for x in vocabulary} if len(self.doubtful) else {}
        self.by_width: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for width in sorted({len(row) for row in rows}):
            some = [row for row in rows if len(row) == width]
            self.by_width[width] = np.array([[ids[x] for x in row] for row in some], np.int64), [sorted(rows[row]) for row in some]
        self.shortest = min(self.by_width, default=0)

    def lookup(self, spans: SpanHash, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Vocabulary ids of words, 0 for others: the hash finds a word and its bytes decide."""
        out = np.zeros(len(hashes), np.int32)
        if not len(self.hashes):
            return out
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        some = np.flatnonzero(self.hashes[at] == hashes)
        ids = self.ids[at[some]]
        begin = np.concatenate(([0], self.ends))[ids - 1]
        same = spans.equal(start[some], end[some], SpanHash(self.bytes), begin, self.ends[ids - 1])
        out[some[same]] = ids[same]
        if len(self.doubtful):
            for i in some[np.isin(hashes[some], self.doubtful)]:
                out[i] = self.word_ids.get(spans.data[start[i] : end[i]].tobytes(), 0)
        return out


def _lower(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffer(column)
    return lowered(data), offsets


def runs(ids: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of maximal runs of known words inside a document, of ``least`` words or more."""
    known = ids > 0
    edge = np.zeros(len(ids) + 1, bool)
    edge[first[:-1]] = True
    change = np.flatnonzero(edge[:-1] | np.concatenate(([True], known[1:] != known[:-1]))) if len(ids) else np.zeros(0, np.int64)
    ends = np.append(change[1:], len(ids))
    keep = known[change] & (ends - change >= least)
    return change[keep], ends[keep]


def occurrences(ids: np.ndarray, first: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Word positions and widths of all phrase occurrences in a shard, with the items of each."""
    start, end = runs(ids, first, phrases.shortest)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    sizes = end - start + 1
    place = np.cumsum(sizes) - sizes
    text = np.zeros(int(sizes.sum()), np.int64)
    origin = np.full(len(text), -1, np.int64)
    inner = np.repeat(start - place, sizes - 1) + (at := np.concatenate([np.arange(p, p + s - 1) for p, s in zip(place, sizes, strict=True)]))
    text[at], origin[at] = ids[inner], inner
    index = FMIndex(text, phrases.size)
    found, widths, items = [], [], []
    for width, (patterns, of) in phrases.by_width.items():
        low, high = index.search(patterns)
        some = np.flatnonzero(high > low)
        counts = high[some] - low[some]
        if not len(some):
            continue
        rows = np.repeat(low[some] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        found.append(origin[index.locate(rows)])
        widths.append(np.full(len(rows), width))
        items += [of[k] for k in np.repeat(some, counts)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    return np.concatenate(found), np.concatenate(widths), items


def shard(column: pa.Array, phrases: list[Phrases]) -> tuple[Words, np.ndarray, np.ndarray, list[set[str]]]:
    """Words of a shard, which of them are hit, the hits per text, and the items found in each."""
    w = split(*_lower(column), OUTSIDE)
    spans = SpanHash(w.data)
    hashes = spans(w.start, w.end)
    hit = np.zeros(len(w.start), bool)
    items: list[set[str]] = [set() for _ in range(w.docs)]
    for p in phrases:
        at, width, of = occurrences(p.lookup(spans, hashes, w.start, w.end), w.first, p)
        hit |= covered(at, at + width, len(w.start))
        for d, names in zip(np.searchsorted(w.first, at, "right") - 1, of, strict=True):
            items[d].update(names)
    hits = np.concatenate(([0], np.cumsum(hit)))
    return w, hit, hits[w.first[1:]] - hits[w.first[:-1]], items


def _scan(blocks: list, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = [b.value for b in blocks]
        for part in slices(batches, "text", 2 * CHUNK):
            w, hit, n_hit, items = shard(part.column(1), phrases)
            n_words = np.diff(w.first)
            listed = [sorted(x) for x in items]
            columns = [
                part.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(listed, pa.list_(pa.string())),
                pa.array([_spans(hit[a:b], w, a) if n else [] for a, b, n in zip(w.first[:-1], w.first[1:], n_hit, strict=True)], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ]
            yield pa.RecordBatch.from_arrays(columns + ([part.column(1)] if with_text else []), names=["doc_id", "n_words", "n_hit", "items", "spans"] + ["text"] * with_text)

    return run


def _spans(hit: np.ndarray, w, first: int) -> list[dict[str, int]]:
    """Byte spans of the text from the first to the last word of each run of hit words."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    base = w.offsets[np.searchsorted(w.first, first, "right") - 1]
    a, b = np.flatnonzero(edge == 1) + first, np.flatnonzero(edge == -1) - 1 + first
    return [{"start": int(x - base), "end": int(y - base)} for x, y in zip(w.start[a], w.end[b], strict=True)]


def phrase_blocks(benchmark: DataFrame, block_words: int) -> Iterator[Phrases]:
    """The benchmark in blocks of bounded size, streamed through the driver."""
    block: list[tuple[str, bytes]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        text = bytes(row[1] or b"")
        block.append(("null" if row[0] is None else row[0], text))
        size += max(text.count(b" ") + 1, len(text) // 8)
        if size >= block_words:
            yield Phrases(block)
            block, size = [], 0
    if block:
        yield Phrases(block)


def _hit_rows(blocks: list):
    """Rows (doc_id, text) to (doc_id, rid, starts, ends, items) of the texts with hits: runs of hit words, by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = [b.value for b in blocks]
        for part in slices(batches, "text", 2 * CHUNK):
            w, hit, n_hit, items = shard(part.column(2), phrases)
            some = np.flatnonzero(n_hit)
            edges = [np.diff(np.concatenate(([0], hit[w.first[d] : w.first[d + 1]].astype(np.int8), [0]))) for d in some]
            columns = [part.column(0).take(pa.array(some)), part.column(1).take(pa.array(some)), *(pa.array([np.flatnonzero(e == sign) for e in edges], pa.list_(pa.int64())) for sign in (1, -1)), pa.array([sorted(items[d]) for d in some], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["h_doc", "h_rid", "starts", "ends", "items"])

    return run


def _united(with_text: bool):
    """Rows (doc_id, text, starts, ends, items) with the runs of all blocks to the operator's result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 * CHUNK):
            w = split(*_lower(part.column(1)), OUTSIDE)
            starts, ends, items = (part.column(k).to_pylist() for k in (2, 3, 4))
            n_hit, spans = [], []
            for d in range(w.docs):
                hit = covered(np.array(starts[d] or [], np.int64), np.array(ends[d] or [], np.int64), int(w.first[d + 1] - w.first[d]))
                n_hit.append(int(hit.sum()))
                spans.append(_spans(hit, w, w.first[d]) if n_hit[-1] else [])
            columns = [part.column(0), pa.array(np.diff(w.first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(set(x or [])) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns + ([part.column(1)] if with_text else []), names=["doc_id", "n_words", "n_hit", "items", "spans"] + ["text"] * with_text)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids) and spans (bytes of the text) of every document.

    Workers hold AT_ONCE blocks of the benchmark's windows, BLOCK_WORDS words
    each. A benchmark that fits takes one pass over the texts without a shuffle;
    a larger one takes a pass for each group of blocks, whose hits are written
    and joined to the texts.
    """
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = phrase_blocks(benchmark, BLOCK_WORDS)
    group = [context.broadcast(p) for p in itertools.islice(blocks, AT_ONCE)]
    more = next(blocks, None)
    if more is None:
        schema = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
        return texts.mapInArrow(_scan(group, with_text), schema + ", text string" * with_text)
    named = texts.select("doc_id", F.sha2("text", 256).alias("rid"), "text")
    hits, blocks = None, itertools.chain([more], blocks)
    while group:
        found, _ = materialize(named.mapInArrow(_hit_rows(group), "h_doc long, h_rid string, starts array<long>, ends array<long>, items array<string>"), "hits")
        hits = found if hits is None else hits.unionAll(found)
        for b in group:
            b.destroy()
        group = [context.broadcast(p) for p in itertools.islice(blocks, AT_ONCE)]
    hits = hits.groupBy("h_doc", "h_rid").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")))
    joined = named.join(hits, F.col("rid").eqNullSafe(F.col("h_rid")) & F.col("doc_id").eqNullSafe(F.col("h_doc")), "left")
    schema = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
    return joined.select("doc_id", "text", "starts", "ends", "items").mapInArrow(_united(with_text), schema + ", text string" * with_text)


def contaminated():
    return (F.col("n_hit") > 0) & (CONTAMINATED * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, column: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    One pass without a shuffle for a benchmark of up to AT_ONCE blocks; beyond,
    rows are joined with the contaminated texts by a hash, and the texts are compared.
    """
    context = docs.sparkSession.sparkContext
    small_batches(docs.sparkSession)
    blocks = phrase_blocks(benchmark, BLOCK_WORDS)
    group = [context.broadcast(p) for p in itertools.islice(blocks, AT_ONCE)]
    if next(blocks, None) is not None:
        texts = docs.select(F.xxhash64(column).alias("doc_id"), F.col(column).alias("text")).distinct()
        bad = decontaminate(texts, benchmark, with_text=True).filter(contaminated()).select(F.col("doc_id").alias("bad_hash"), F.col("text").alias("bad_text"))
        return docs.join(bad, (F.xxhash64(docs[column]) == bad["bad_hash"]) & (docs[column] == bad["bad_text"]), "left_anti")
    place = docs.columns.index(column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = [b.value for b in group]
        for part in slices(batches, column, 2 * CHUNK):
            w, _, n_hit, _ = shard(part.column(place), phrases)
            yield part.filter(pa.array(~((n_hit > 0) & (CONTAMINATED * n_hit >= np.diff(w.first)))))

    return docs.mapInArrow(keep, docs.schema)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))
