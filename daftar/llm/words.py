"""Vectorised word splitting and hashing over the UTF-8 bytes of Arrow string columns.

Everything works on slices of about ``CHUNK`` bytes so that the temporary
arrays stay in cache and a task's memory does not depend on its partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
#: White space of the word pattern [^\x20\x09-\x0D]+
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

U = np.uint64
#: Spans of more bytes are hashed one by one, by BLAKE2b.
LONG = 256
_KEYS = np.random.default_rng(0x5EED).integers(1, 2**63, LONG // 8 + 1, dtype=np.uint64) * U(2) + U(1)
#: The low bytes that belong to a span with so many bytes left.
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class SpanHash:
    """Hashes of any byte spans of one buffer: eight bytes at a time, each step mixed before the next; exact comparison too."""

    def __init__(self, data: np.ndarray):
        self.data = data
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        self.lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))

    def lane(self, start: np.ndarray, left: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 7 of spans with ``left`` bytes from there on."""
        return self.lanes[start + 8 * k] & _TAIL[np.minimum(left, 8)]

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        left = end - start
        out = left.astype(np.uint64) * _KEYS[-1]
        live, k = np.flatnonzero((left > 0) & (left <= LONG)), 0
        while len(live):
            rest = left[live] - 8 * k
            out[live] = mix((out[live] ^ self.lane(start[live], rest, k)) + _KEYS[k])
            live, k = live[rest > 8], k + 1
        for i in np.flatnonzero(left > LONG):
            out[i] = int.from_bytes(hashlib.blake2b(self.data[start[i] : end[i]], digest_size=8).digest(), "little")
        return out

    def equal(self, start: np.ndarray, end: np.ndarray, other: SpanHash, other_start: np.ndarray, other_end: np.ndarray) -> np.ndarray:
        """Which spans have the same bytes as their partners in ``other``."""
        left = end - start
        out = left == other_end - other_start
        live, k = np.flatnonzero(out & (left > 0) & (left <= LONG)), 0
        while len(live):
            rest = left[live] - 8 * k
            same = self.lane(start[live], rest, k) == other.lane(other_start[live], rest, k)
            out[live[~same]] = False
            live, k = live[same & (rest > 8)], k + 1
        for i in np.flatnonzero(out & (left > LONG)):
            out[i] = np.array_equal(self.data[start[i] : end[i]], other.data[other_start[i] : other_end[i]])
        return out


@dataclass
class Words:
    """Words of a slice of documents. ``first[d]:first[d + 1]`` are those of document d."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return SpanHash(self.data)(self.start, self.end)


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = buffers[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``most`` bytes in ``column``; one longer text is a part of its own."""
    for batch in batches:
        _, offsets = buffer(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def split(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes outside ``space``, none over the end of a document."""
    inside = ~space[data]
    filled = offsets[:-1][np.diff(offsets) > 0]
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        before[filled] = False
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        after[filled[1:] - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
    else:
        start = end = np.zeros(0, np.int64)
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def words_of(column: pa.Array, space: np.ndarray = SPACE) -> Words:
    return split(*buffer(column), space)


_STEPS = mix(np.arange(1, 65, dtype=np.uint64)) | U(1)


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words inside a document, and the index of its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += hashes[j : j + n] * _STEPS[j]
    whole = np.zeros(len(hashes) + 1, bool)
    lengths = np.diff(first)
    ends = np.minimum(first[1:], len(hashes))
    # words that start no whole window: the last width - 1 of each document
    for j in range(1, width):
        at = ends - j
        whole[at[(lengths >= j)]] = True
    keep = np.flatnonzero(~whole[:n])
    return mix(total[keep]), keep


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in any of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:n]) > 0


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, every other byte as it is."""
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << 5)
