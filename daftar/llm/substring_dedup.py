"""Removal of passages that start in an earlier document, found by suffix automata of reference shards.

A document's 13-word windows are grouped by their minimiser (the least hash of
their 5-word groups), so equal windows always carry equal keys. Keys that only
one document has are dropped; what is left is cut into segments, the words of
consecutive windows of one key. The distinct segments of a shard of keys form a
generalised suffix automaton whose states know the least doc_id that contains
them; the segments stream through it for their matching statistics, and each
window of 13 words or more learns the smallest document in which it starts. A
key with one distinct segment needs no automaton: all its windows start in that
segment's least document. A key whose segments exceed an automaton is split
into its single windows, whose least documents come from an aggregate.

Routing by content replaces a broadcast of every shard's automaton to every
task: each automaton goes only where texts that can match it are, its size is
bounded by ``SHARD_WORDS``, and the work grows with the text, not its square.

Defined results: null and empty texts have no words; a null doc_id neither
removes nor loses words; rows of equal doc_id never remove each other's words,
and repeated rows get the same result; ties of hashes only send more text
through the automata; a very long text is a slice of its own and takes memory in
proportion to its length; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import discard, materialize
from .words import CHUNK, covered, mix, slices, windows, words_of

#: Words of a window, of a group whose least hash is the window's key, and words in one automaton at most.
WINDOW, GROUP, SHARD_WORDS = 13, 5, 20_000
REACH = WINDOW - GROUP + 1
#: Keys that a task gathers to find hot ones, and the documents of one key among them that make it hot.
GATHER, HOT = 200_000, 4
#: Segments a task remembers, rows that it hands on at once, and rows that are broadcast at most.
SEEN, OUT, BROADCAST_ROWS = 100_000, 20_000, 200_000
SALT = np.uint64(0x9E3779B97F4A7C15)


def minimisers(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first window and number of windows of each run of consecutive windows with one minimiser."""
    _, start = windows(hashes, first, WINDOW)
    if not len(start):
        return np.zeros(0, np.uint64), start, start
    group, at = windows(hashes, first, GROUP)
    dense = np.full(len(hashes), np.uint64(2**64 - 1))
    dense[at] = group
    best, place = dense[start], np.zeros(len(start), np.int64)
    for j in range(1, REACH):
        here = dense[start + j]
        less = here < best
        best = np.where(less, here, best)
        place[less] = j
    place += start
    begin = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1))))
    return best[begin], start[begin], np.diff(np.append(begin, len(start)))


def _gathered(keys: list[np.ndarray], docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, mark) with the marks of a hot key: 1, it is hot here; 3, the row is also dealt by its document."""
    key, doc = np.concatenate(keys), np.concatenate(docs)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    size = np.diff(np.append(begin, len(key)))
    mark = np.where(np.repeat(size, size) >= HOT, 3, 0).astype(np.int32)
    mark[begin] &= 1
    whole = pa.RecordBatch.from_arrays([pa.array(ordered.view(np.int64)), pa.array(doc[order]), pa.array(mark)], names=["key", "doc_id", "mark"])
    yield from (whole.slice(k, OUT) for k in range(0, len(key), OUT))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, docs, rows = [], [], 0
    for part in slices(batches, "text", CHUNK):
        w = words_of(part.column(1))
        key, start, _ = minimisers(w.hashes(), w.first)
        doc = np.searchsorted(w.first, start, "right") - 1
        known = np.asarray(part.column(0).is_valid())[doc]
        key, doc = key[known], doc[known]
        _, once = np.unique(mix(key) + doc.astype(np.uint64) * SALT, return_index=True)
        keys.append(key[once]), docs.append(np.asarray(part.column(0).fill_null(0))[doc[once]])
        rows += len(once)
        if rows >= GATHER:
            yield from _gathered(keys, docs)
            keys, docs, rows = [], [], 0
    if rows:
        yield from _gathered(keys, docs)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, those whose key a neighbour has too or that are marked as hot."""
    held = np.zeros((0, 3), np.int64)  # the last row so far, which waits for its right neighbour

    def kept(rows: np.ndarray, whole: int) -> pa.RecordBatch:
        same = rows[1:, 0] == rows[:-1, 0]
        keep = rows[:, 2] > 0
        keep[1:] |= same
        keep[:-1] |= same
        some = rows[:whole][keep[:whole]]
        return pa.RecordBatch.from_arrays([pa.array(some[:, 0]), pa.array(some[:, 1])], names=["key", "doc_id"])

    before = None  # the key of the last row that has gone out
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate((held, np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], 1)))
        if rows[0, 0] == before:
            rows[0, 2] |= 1
        if len(rows) > 1:
            yield kept(rows, len(rows) - 1)
            before = rows[-2, 0]
        held = rows[-1:].copy()
        held[0, 2] |= rows[-1, 0] == before
    if len(held):
        yield kept(held, 1)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of each document's shared keys: (key, segment, doc_id, rid, pos, windows), with the words and their least document so far for the first of equal ones in a task."""
    seen: dict[tuple[int, int], int] = {}
    for part in slices(batches, "text", CHUNK):
        w = words_of(part.column(2))
        hashes = w.hashes()
        key, start, count = minimisers(hashes, w.first)
        doc = np.searchsorted(w.first, start, "right") - 1
        keys = part.column(3)
        own = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(keys.offsets)))
        wanted = mix(np.asarray(keys.flatten()).view(np.uint64)) + own.astype(np.uint64) * SALT
        use = np.isin(mix(key) + doc.astype(np.uint64) * SALT, wanted)
        key, start, count, doc = key[use].view(np.int64), start[use], count[use], doc[use]
        ids = np.asarray(part.column(0))[doc]
        segment = span_hashes(hashes, start, count + WINDOW - 1)
        raw = w.data.tobytes()
        words: list[str | None] = [None] * len(key)
        for i, (s, d) in enumerate(zip(zip(key.tolist(), segment.tolist(), strict=True), ids.tolist(), strict=True)):
            least = seen.get(s)
            if least is None or d < least:
                if len(seen) >= SEEN:
                    seen.clear()
                seen[s] = d
                a, b = start[i], start[i] + count[i] + WINDOW - 2
                words[i] = b" ".join(raw[w.start[a] : w.end[b]].split()).decode()
        columns = [pa.array(key), pa.array(segment), pa.array(ids), part.column(1).take(pa.array(doc)), pa.array(start - w.first[doc]), pa.array(count.astype(np.int32)), pa.array(words, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "segment", "doc_id", "rid", "pos", "windows", "words"])


def span_hashes(hashes: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each run of ``length`` words from ``start``, as signed numbers; runs are at most WINDOW + REACH - 1 long."""
    total = length.astype(np.uint64)
    for j in range(int(length.max(initial=0))):
        some = np.flatnonzero(length > j)
        total[some] = mix((total[some] ^ hashes[start[some] + j]) + SALT)
    return total.view(np.int64)


def kept_words(text: bytes, removed: np.ndarray) -> bytes:
    """The words outside ``removed`` (empty: none is removed), joined by one space.

    bytes.split() splits at exactly the white space of the word pattern.
    """
    words = text.split()
    if len(removed):
        words = [x for x, gone in zip(words, removed.tolist(), strict=True) if not gone]
    return b" ".join(words)


def kept_digest(text: bytes, removed: np.ndarray) -> str:
    return hashlib.sha256(kept_words(text, removed)).hexdigest()


class Automaton:
    """A generalised suffix automaton over words; each state keeps the least document of its strings."""

    def __init__(self):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len, self.least = [-1], [0], [2**63 - 1]

    def _state(self, length: int, link: int, least: int, follow: dict) -> int:
        self.next.append(follow), self.len.append(length), self.link.append(link), self.least.append(least)
        return len(self.len) - 1

    def _clone(self, p: int, word: str, q: int) -> int:
        c = self._state(self.len[p] + 1, self.link[q], self.least[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def add(self, words: list[str], doc: int) -> None:
        last = 0
        for word in words:
            p = last
            if word in self.next[p]:
                q = self.next[p][word]
                last = q if self.len[q] == self.len[p] + 1 else self._clone(p, word, q)
            else:
                last = self._state(self.len[p] + 1, 0, doc, {})
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[last] = q if self.len[q] == self.len[p] + 1 else self._clone(p, word, q)
            if doc < self.least[last]:
                self.least[last] = doc

    def finish(self) -> None:
        """Carry the least document to every suffix, longest strings first."""
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            up = self.link[s]
            if self.least[s] < self.least[up]:
                self.least[up] = self.least[s]

    def least_documents(self, words: list[str], width: int = WINDOW) -> list[int]:
        """For each window of ``width`` words, the least document in which it occurs (matching statistics held at the width)."""
        out, state, matched = [], 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.len[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            while self.link[state] >= 0 and self.len[self.link[state]] >= width:
                state = self.link[state]
                matched = self.len[state]
            if i >= width - 1:
                out.append(self.least[state] if matched >= width else 2**63 - 1)
        return out


MATCHED = "m_key long, m_segment long, least array<long>"


def _matched(out: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
    """Least documents of the windows of each segment; one number if they are all the same."""
    least = [x[2] if len(set(x[2])) > 1 else x[2][:1] for x in out]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array(least, pa.list_(pa.int64()))], names=["m_key", "m_segment", "least"])


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, segment, doc_id, words) sorted by key and segment: automata of whole keys, about SHARD_WORDS words each."""
    key: int | None = None
    now: dict[int, tuple[int, str]] = {}  # the distinct segments of the key
    shard: list[tuple[int, int, int, list[str]]] = []
    plain: list[tuple[int, int, list[int]]] = []
    size = 0

    def end_of_key() -> None:
        nonlocal size
        if len(now) == 1:
            plain.extend((key, segment, [least]) for segment, (least, _) in now.items())
        for segment, (least, words) in now.items() if len(now) > 1 else ():
            cut = words.split(" ")
            shard.append((key, segment, least, cut))
            size += len(cut)

    def flush() -> pa.RecordBatch:
        nonlocal size
        automaton = Automaton()
        for _, _, least, words in shard:
            automaton.add(words, least)
        automaton.finish()
        out = plain + [(k, s, automaton.least_documents(words)) for k, s, _, words in shard]
        shard.clear(), plain.clear()
        size = 0
        return _matched(out)

    for batch in batches:
        for k, segment, doc, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if key is not None:
                    end_of_key()
                    if size >= SHARD_WORDS or len(plain) >= SHARD_WORDS:
                        yield flush()
                key, now = k, {}
            have = now.get(segment)
            if have is None or doc < have[0]:
                now[segment] = doc, words
    if key is not None:
        end_of_key()
        yield flush()


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of hot keys as their single windows, each with a hash of its own."""
    for batch in batches:
        out: list[tuple] = []
        for key, segment, doc, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cut = words.split(" ")
            for j in range(len(cut) - WINDOW + 1):
                window = hashlib.blake2b(" ".join(cut[j : j + WINDOW]).encode(), digest_size=8).digest()
                out.append((int.from_bytes(window, "big", signed=True), key, segment, j, doc))
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["window", "key", "segment", "j", "doc_id"])


def _finish(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 * CHUNK):
            n = np.diff(words_of(part.column(1)).first)
            removed, digests, kept_texts = [], [], []
            for size, text, runs in zip(n.tolist(), part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                gone = np.zeros(0, bool)
                if runs:
                    at = np.array(runs, np.int64)
                    gone = covered(at >> 4, (at >> 4) + (at & 15) + WINDOW - 1, size)
                kept = kept_words((text or "").encode(), gone)
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode() if with_text else None)
            columns = [part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept_texts, pa.string())] if with_text else []), names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    return run


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _least_of_hot(segments: DataFrame) -> tuple[DataFrame, list[str]]:
    """(m_key, m_segment, least) of the segments of hot keys, by single windows."""
    units, units_path = materialize(segments.mapInArrow(_single, "window long, key long, segment long, j long, doc_id long"), "units")
    least, least_path = materialize(units.groupBy(F.col("window").alias("w_window")).agg(F.min("doc_id").alias("least")), "windows")
    rows = units.select("window", "key", "segment", "j").join(_few(least), F.col("window") == F.col("w_window"))
    by = rows.groupBy(F.col("key").alias("m_key"), F.col("segment").alias("m_segment")).agg(F.transform(F.array_sort(F.collect_set(F.struct("j", "least"))), lambda x: x["least"]).alias("least"))
    return by, [units_path, least_path]


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text, if asked for) of every document.

    Shuffles: keys (a fifth of the words, 20 bytes each) by key, a hot key's by
    document; texts twice, with their shared keys and with their removals;
    segments of shared keys, with their words once per task. Working tables are
    discarded before the result is returned.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rid = F.xxhash64("doc_id", "text").alias("rid")
    dealt = F.when(F.col("mark") == 3, F.pmod("doc_id", F.lit(4096))).otherwise(-1)
    keys = texts.mapInArrow(_keys, "key long, doc_id long, mark int").repartition("key", dealt).sortWithinPartitions("key")
    shared = keys.mapInArrow(_shared, "key long, doc_id long").groupBy(F.col("doc_id").alias("k_id")).agg(F.collect_set("key").alias("keys"))
    rows = texts.join(shared, F.col("doc_id") == F.col("k_id")).select("doc_id", rid, "text", "keys")
    found, found_path = materialize(rows.mapInArrow(_segments, "key long, segment long, doc_id long, rid long, pos long, windows int, words string"), "segments")
    spelled = found.filter("words is not null").select("key", "segment", "doc_id", "words")
    # keys with more distinct words than an automaton takes go on as single windows
    distinct = found.filter("words is not null").groupBy("key", "segment").agg(F.max("windows").alias("w"))
    hot, hot_path = materialize(distinct.groupBy(F.col("key").alias("h_key")).agg(F.sum(F.col("w") + WINDOW - 1).alias("n")).filter(F.col("n") > SHARD_WORDS).select("h_key"), "hot")
    some_hot = _few(hot)
    ordinary = spelled.join(some_hot, F.col("key") == F.col("h_key"), "left_anti").repartition("key").sortWithinPartitions("key")
    matched, used = ordinary.mapInArrow(_match, MATCHED), []
    if hot.limit(1).count():
        by_window, used = _least_of_hot(spelled.join(some_hot, F.col("key") == F.col("h_key"), "left_semi"))
        matched = matched.unionByName(by_window)
    matched, matched_path = materialize(matched, "matched")
    discard(spark, hot_path, *used)
    hits = found.select("key", "segment", "doc_id", "rid", "pos", "windows").join(matched, (F.col("key") == F.col("m_key")) & (F.col("segment") == F.col("m_segment")))
    # a run is its first window times 16 plus its number of windows, of which a segment has at most REACH
    each = F.filter(F.transform("least", lambda least, j: F.when(least < F.col("doc_id"), (F.col("pos") + j) * 16 + 1)), lambda x: x.isNotNull())
    whole = F.when(F.element_at("least", 1) < F.col("doc_id"), F.array(F.col("pos") * 16 + F.col("windows")))
    runs = hits.select(F.col("rid").alias("r_id"), F.col("doc_id").alias("r_doc"), F.when(F.size("least") == 1, whole).otherwise(each).alias("runs")).filter(F.size("runs") > 0)
    per_doc, _ = materialize(runs.groupBy("r_id", "r_doc").agg(F.flatten(F.collect_list("runs")).alias("runs")), "runs")
    discard(spark, found_path, matched_path)
    out = texts.select("doc_id", "text", rid).join(per_doc, (F.col("rid") == F.col("r_id")) & (F.col("doc_id") == F.col("r_doc")), "left").select("doc_id", "text", "runs")
    return out.mapInArrow(_finish(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
