"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

A text is cut into units that no merge can cross (before a space and around
line ends, which no piece holds). The units of a slice that are new to the
worker are encoded together: their symbols lie in flat arrays, each round finds
the lowest pair rank of every unit with a segmented minimum and merges its
leftmost occurrences at once, and units without a pair left are compacted away.
Units of more than LONG_UNIT characters would need as many rounds as they have
different pairs; they are merged one pair after another from a heap.
Ids equal those of the sentencepiece library without begin or end ids.

Defined results: a null text is empty and has no ids; pairs of equal rank merge
leftmost first; repeated rows are encoded one by one; a very long text is a slice
of its own and takes memory in proportion to its length; an empty table stays
empty; other columns are ignored, but ``encode_rows`` replaces columns named
n_tokens and ids.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .scratch import small_batches
from .words import CHUNK, SpanHash, buffer, slices

#: Meta symbol for a space, and how many units a worker keeps encoded.
META = "▁"
CACHE = 300_000
#: Bytes of units kept at most; a slice may go over it by its own length.
CACHE_BYTES = 16 << 20
#: Bytes of text encoded together.
SLICE = CHUNK
NONE = np.int64(2**40)
#: Characters of a unit beyond which it is merged by itself.
LONG_UNIT = 2_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """Pieces, scores and the pair table of a SentencePiece BPE model."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id_of = {pieces[i]: i for i in normal}
        self.byte_id = np.zeros(256, np.int64)
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(pieces[i][3:5], 16)] = i
        self.bytes_of = [b"" if sp.is_control(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(META, " ").encode() for i, p in enumerate(pieces)]
        # Symbols that are characters without a piece get numbers from n on; they never merge.
        self.n = n
        scores = {i: sp.get_score(i) for i in normal}
        rank_of = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        left, right, merged = [], [], []
        for p, i in self.id_of.items():
            for cut in range(1, len(p)):
                a, b = self.id_of.get(p[:cut]), self.id_of.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(i)
        self.rank = np.array([rank_of[scores[i]] if i in scores else 0 for i in range(n)], np.int64)
        key = np.array(left, np.int64) * n + np.array(right, np.int64)
        bits = 4
        while 1 << bits < 8 * len(key) + 16:
            bits += 1
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.merged = np.zeros(1 << bits, np.int64)
        todo, probe, value = np.arange(len(key)), 0, np.array(merged, np.int64)
        while len(todo):
            slot = self._slot(key[todo], probe)
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[todo[free]]
            placed = self.keys[slot] == key[todo]
            self.merged[slot[placed]] = value[todo[placed]]
            todo, probe = todo[~placed], probe + 1
        self.probes = probe
        self.pairs: dict[int, int] | None = None  # the same table for single lookups, made when needed
        # What splits units: characters in no piece of two or more characters.
        self.atomic_newline = not any("\n" in p for p in self.id_of)
        self.space_leads = not any(META in p.strip(META) or (p.endswith(META) and p.strip(META)) for p in self.id_of)

    def _slot(self, key: np.ndarray, probe: int) -> np.ndarray:
        return (((key.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64) + probe & (1 << 64 - int(self.shift)) - 1

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols merge to, or -1."""
        key = np.where((left < self.n) & (right < self.n), left * self.n + right, -2)
        out = np.full(len(key), -1, np.int64)
        look = np.arange(len(key))
        for probe in range(self.probes):
            slot = self._slot(key[look], probe)
            at = self.keys[slot]
            same = at == key[look]
            out[look[same]] = self.merged[slot[same]]
            look = look[~same & (at != -1)]
            if not len(look):
                break
        return out

    def ranks(self, symbols: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged piece and its rank for each symbol and its right neighbour in the unit."""
        piece = np.full(len(symbols), -1, np.int64)
        if len(symbols) > 1:
            inner = unit[1:] == unit[:-1]
            piece[:-1][inner] = self.pair(symbols[:-1][inner], symbols[1:][inner])
        return piece, np.where(piece >= 0, self.rank[piece], NONE)

    def encode_units(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units ``data[edges[k]:edges[k + 1]]``, end to end, and where each unit's begin."""
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        lengths = np.diff(lead[edges])
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        distinct, inverse = np.unique(points, return_inverse=True)
        symbol_of = np.array([self.id_of.get(META if c == 32 else chr(c), self.n + int(c)) for c in distinct], np.int64)
        symbols = symbol_of[inverse] if len(points) else np.zeros(0, np.int64)
        unit = np.repeat(np.arange(len(lengths)), lengths)
        done_symbols, done_unit = [], []
        # the rounds that a unit needs grow with its length: very long ones are merged pair by pair
        for k in np.flatnonzero(lengths > LONG_UNIT):
            done_symbols.append(self.one_by_one(symbols[unit == k]))
            done_unit.append(np.full(len(done_symbols[-1]), k))
        if done_symbols:
            short = lengths[unit] <= LONG_UNIT
            symbols, unit = symbols[short], unit[short]
        piece, rank = self.ranks(symbols, unit)
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            low = np.minimum.reduceat(rank, first)
            ends = np.append(first[1:], len(symbols))
            low_each = np.repeat(low, ends - first)
            over = low_each == NONE
            if over.any():
                done_symbols.append(symbols[over]), done_unit.append(unit[over])
                stay = ~over
                symbols, unit, piece, rank, low_each = symbols[stay], unit[stay], piece[stay], rank[stay], low_each[stay]
                if not len(symbols):
                    break
            hit = rank == low_each
            at = np.flatnonzero(hit)
            # leftmost first, without overlap: in a run of adjacent hits every other one merges
            starts = np.concatenate(([True], np.diff(at) > 1))
            run = np.maximum.accumulate(np.where(starts, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            at = self._safe(at, symbols, unit, piece, low_each)
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            symbols = symbols.copy()
            symbols[at] = piece[at]
            stale = gone.copy()
            stale[at] = True
            stale[np.maximum(at - 1, 0)] = True
            keep = ~gone
            symbols, unit, rank, piece, stale = symbols[keep], unit[keep], rank[keep], piece[keep], stale[keep]
            look = np.flatnonzero(stale)
            right = np.minimum(look + 1, len(symbols) - 1)
            inner = (right > look) & (unit[right] == unit[look])
            new = np.full(len(look), -1, np.int64)
            new[inner] = self.pair(symbols[look[inner]], symbols[right[inner]])
            piece[look], rank[look] = new, np.where(new >= 0, self.rank[new], NONE)
        symbols = np.concatenate(done_symbols) if done_symbols else np.zeros(0, np.int64)
        unit = np.concatenate(done_unit) if done_unit else np.zeros(0, np.int64)
        order = np.argsort(unit, kind="stable")
        symbols, unit = symbols[order], unit[order]
        unknown = np.flatnonzero(symbols >= self.n)
        if len(unknown):
            fall = [self.byte_id[list(chr(int(c) - self.n).encode())] for c in symbols[unknown]]
            sizes = np.ones(len(symbols), np.int64)
            sizes[unknown] = [len(f) for f in fall]
            place = np.cumsum(sizes) - sizes
            wide = np.repeat(symbols, sizes)
            for k, f in zip(unknown, fall, strict=True):
                wide[place[k] : place[k] + len(f)] = f
            symbols, unit = wide, np.repeat(unit, sizes)
        return symbols, np.searchsorted(unit, np.arange(len(lengths) + 1))

    def one_by_one(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols of one unit after all merges, the lowest rank and then the leftmost pair first, from a heap."""
        if self.pairs is None:
            used = np.flatnonzero(self.keys >= 0)
            self.pairs = dict(zip(self.keys[used].tolist(), self.merged[used].tolist(), strict=True))
        pairs, n, rank, end = self.pairs, self.n, self.rank.tolist(), len(symbols)
        now, after, before = symbols.tolist(), list(range(1, end + 1)), list(range(-1, end - 1))
        merged = lambda a, b: pairs.get(a * n + b, -1) if a < n and b < n else -1
        heap = [(rank[m], i, now[i], now[i + 1], m) for i in range(end - 1) if (m := merged(now[i], now[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if now[i] != a or j >= end or now[j] != b:
                continue  # one of the two has been merged meanwhile
            now[i], now[j] = m, -1
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (x := merged(m, now[k])) >= 0:
                    heapq.heappush(heap, (rank[x], i, m, now[k], x))
            if (h := before[i]) >= 0 and (x := merged(now[h], m)) >= 0:
                heapq.heappush(heap, (rank[x], h, now[h], m, x))
        out = np.array(now, np.int64)
        return out[out >= 0]

    def _safe(self, at: np.ndarray, symbols: np.ndarray, unit: np.ndarray, piece: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Of the merges of a round, those that one-by-one merging would also make next.

        Merging one occurrence can make a pair of lower rank with a neighbour,
        which one-by-one merging takes before the next occurrence. Units where
        that could happen merge only their leftmost occurrence in this round.
        """
        many = np.concatenate((unit[at[1:]] == unit[at[:-1]], [False])) | np.concatenate(([False], unit[at[1:]] == unit[at[:-1]])) if len(at) > 1 else np.zeros(len(at), bool)
        if not many.any():
            return at
        some = at[many]
        merged = symbols.copy()
        merged[some] = piece[some]
        risky = np.zeros(len(some), bool)
        last = len(symbols) - 1
        for source in (symbols, merged):
            left, right = np.maximum(some - 1, 0), np.minimum(some + 2, last)
            for a, b, ok in ((left, some, (some > 0) & (unit[left] == unit[some])), (some, right, (some + 2 <= last) & (unit[right] == unit[some]))):
                x, y = (source[a], merged[b]) if b is some else (merged[a], source[b])
                made = self.pair(x, y)
                risky |= ok & (made >= 0) & (self.rank[made] <= low[some])
        # the left neighbour may also be the piece just merged two places before
        two = np.maximum(some - 2, 0)
        made = self.pair(merged[two], merged[some])
        risky |= (some >= 2) & (unit[two] == unit[some]) & (made >= 0) & (self.rank[made] <= low[some])
        if not risky.any():
            return at
        bad = np.unique(unit[some[risky]])
        leftmost = np.concatenate(([True], unit[at[1:]] != unit[at[:-1]]))
        return at[leftmost | ~np.isin(unit[at], bad)]


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte strings end to end, with the start and length of each."""
    lengths = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


def spread(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Source indexes of the ranges (start, length) laid end to end, and the edges of the result."""
    edges = np.concatenate(([0], np.cumsum(lengths)))
    return np.repeat(starts - edges[:-1], lengths) + np.arange(edges[-1]), edges


class Codec:
    """Encodes slices of texts through a bounded cache of units, kept as flat arrays sorted by the units' hash."""

    def __init__(self, model: Model, most: int = CACHE):
        self.model, self.most = model, most
        self.decimal = _flat([b"%d," % i for i in range(model.n)])
        self.piece = _flat(model.bytes_of)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros((0, 2), np.int64)  # start and length of each unit's ids
        self.spelled = np.zeros((0, 2), np.int64)  # start and end of each unit's bytes
        self.ids = np.zeros(0, np.int32)
        self.bytes = np.zeros(0, np.uint8)

    def boundaries(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where units begin: at texts, before a space that follows no space, before and after a line end."""
        begin = np.zeros(len(data) + 1, bool)
        begin[offsets] = True
        if self.model.space_leads:
            space = data == 32
            begin[1:-1] |= space[1:] & ~space[:-1]
            if self.model.atomic_newline:
                line = data == 10
                begin[:-1] |= line
                begin[1:] |= line
        begin[-1] = False
        return np.flatnonzero(begin)

    def add(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode the units together; the places of their ids and bytes."""
        source, edges = spread(start, end - start)
        raw = data[source]
        ids, where = self.model.encode_units(raw, edges)
        at = np.stack((where[:-1] + len(self.ids), np.diff(where)), 1)
        spelled = np.stack((edges[:-1], edges[1:]), 1) + len(self.bytes)
        self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        self.bytes = np.concatenate((self.bytes, raw))
        return at, spelled

    def lookup(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Start and length in ``self.ids`` of each unit; new units are encoded together.

        The hash only finds a unit: its bytes decide, and a unit that shares the
        hash of another is encoded by itself.
        """
        spans = SpanHash(data)
        keys, first, inverse = np.unique(spans(start, end), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.most or len(self.bytes) > CACHE_BYTES:
            self.clear()
        slot = np.searchsorted(self.keys, keys)
        new = np.flatnonzero(self.keys[np.minimum(slot, len(self.keys) - 1)] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            at, spelled = self.add(data, start[first[new]], end[first[new]])
            self.at = np.insert(self.at, slot[new], at, axis=0)
            self.spelled = np.insert(self.spelled, slot[new], spelled, axis=0)
            self.keys = np.insert(self.keys, slot[new], keys[new])
            slot = np.searchsorted(self.keys, keys)
        found = slot[inverse]
        rows = self.at[found]
        other = np.flatnonzero(~spans.equal(start, end, SpanHash(self.bytes), self.spelled[found, 0], self.spelled[found, 1]))
        if len(other):
            rows[other] = self.add(data, start[other], end[other])[0]
        return rows

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the edges between texts. Null is empty."""
        if pc.any(pc.match_substring(texts, META)).as_py():
            texts = pc.replace_substring(texts, META, " ")
        data, offsets = buffer(texts)
        filled = np.diff(offsets) > 0
        data = np.insert(data, offsets[:-1][filled], 32)
        offsets = offsets + np.concatenate(([0], np.cumsum(filled)))
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        start = self.boundaries(data, offsets)
        rows = self.lookup(data, start, np.append(start[1:], len(data)))
        source, edges = spread(rows[:, 0], rows[:, 1])
        return self.ids[source], edges[np.searchsorted(start, offsets)]

    def strings(self, ids: np.ndarray, edges: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[bytes, np.ndarray]:
        """Each id's byte string end to end, and the edges between texts."""
        flat, starts, lengths = table
        source, ends = spread(starts[ids], lengths[ids])
        return flat[source].tobytes(), ends[edges]

    def listed(self, ids: np.ndarray, edges: np.ndarray) -> Iterator[bytes]:
        """Comma-joined decimals of each text's ids."""
        raw, at = self.strings(ids, edges, self.decimal)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield raw[a : max(a, b - 1)]

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> Iterator[bytes]:
        """The text of each run of ids: pieces joined, the leading space dropped."""
        raw, at = self.strings(ids, edges, self.piece)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield raw[a + (raw[a : a + 1] == b" " and a < b) : b]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and model file."""
    if path not in _codecs:
        _codecs[path] = Codec(Model(path))
    return _codecs[path]


def _encode(path: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in slices(batches, "text", SLICE):
            ids, edges = c.encode(part.column(1))
            n = pa.array(np.diff(edges), pa.int64())
            if digests:
                out = [pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string()) for rows in (c.listed(ids, edges), c.decode(ids, edges))]
                yield pa.RecordBatch.from_arrays([part.column(0), n, *out], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            else:
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), n, lists, pa.array([x.decode("utf-8", "replace") for x in c.decode(ids, edges)], pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode(docs: DataFrame, model: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of each document (or digests of both). No shuffle.

    ``model`` is a path that every executor can open; by default the public 32k model.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, n_tokens long, ids array<int>, decoded string"
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_encode(model or default_model(), digests), schema)


def encode_rows(docs: DataFrame, model: str | None = None, column: str = "text") -> DataFrame:
    """``docs`` with n_tokens and ids added and ``column`` decoded from the ids again. No shuffle."""
    path, place = model or default_model(), docs.columns.index(column)
    schema = StructType([*(f for f in docs.schema if f.name not in ("n_tokens", "ids")), StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType()))])
    rows = docs.drop("n_tokens", "ids")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part in slices(batches, column, SLICE):
            ids, edges = c.encode(part.column(place))
            text = pa.array([x.decode("utf-8", "replace") for x in c.decode(ids, edges)], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
            columns = [text if k == place else part.column(k) for k in range(part.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(edges), pa.int64()), lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True)
