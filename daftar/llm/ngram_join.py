"""Jaccard self-join of 5-word shingle sets by token-combination prefixes.

Shingles are ordered rare class first, then by hash; the classes come from a
count sketch of fixed size over all documents. Two sets of similarity 0.8 share
their first common shingle within both prefixes. If that shingle is rare it is
an index key by itself. If it is frequent, all common shingles are; prefixes
are then extended by G, G + 1 common shingles lie in both, and of G hash groups
one holds two of them: the keys are pairs of frequent shingles of one group.

Equal sets are one class from the start. Keys with few classes pair them all;
keys with many pair their first class with the others (a star). Pairs are
verified exactly on whole sets, and links merge labels. Where a large key still
has several labels, its classes outside the main label are held against the
rest in blocks, by parity bits that never rule out a similar pair: first their
nearest partners are verified, and after these links every partner left. So each pair of classes that shares a key is verified, ruled out
by an exact bound or already connected, and a group of copies costs its size,
not its square.

Defined results: null, empty and wordless texts have an empty set, are linked
with nothing and are their own component; texts under five words are one
shingle; a null doc_id takes part and shows the least id of its component, null
if there is none; repeated rows fall in one class; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import ROWS, least_labels
from .scratch import discard, materialize
from .words import CHUNK, U, buffer, lowered, mix, slices, split, windows

#: Words of a shingle; similarity is NUM / DEN or more.
SHINGLE, NUM, DEN = 5, 4, 5
#: log2 of the sketch's counters, and the least count above the mean that makes a shingle frequent.
BITS, FREQUENT = 18, 100
#: Classes of a key that are all paired with each other; keys with more go by stars.
SMALL = 16
#: Postings that a task gathers to find hot keys, and the classes of one key among them that make it hot.
GATHER, HOT = 200_000, 4
#: Members of a group in one block, and nearest partners of a class that are verified first.
BLOCK, FIRST = 4_000, 3
#: Class ids that are broadcast at most, and members of a leader verified in one task.
BROADCAST_ROWS, TASK_PAIRS = 500_000, 4_000
#: Classes whose postings a task remembers having emitted, and rows that a task hands on at once.
SEEN, OUT = 50_000, 20_000


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Each text's set of shingle hashes, in ascending order."""
    data, offsets = buffer(column)
    w = split(lowered(data), offsets)
    hashes = w.hashes()
    whole, at = windows(hashes, w.first, SHINGLE)
    edges = np.searchsorted(at, w.first)
    out = []
    for d in range(w.docs):
        a, b = w.first[d], w.first[d + 1]
        if b - a >= SHINGLE:
            out.append(np.unique(whole[edges[d] : edges[d + 1]]))
        elif b > a:
            out.append(mix(windows(hashes[a:b], np.array([0, b - a]), int(b - a))[0] + U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_id(tokens: np.ndarray) -> int:
    """A 64-bit fingerprint of a set."""
    if not len(tokens):
        return 0
    total = mix(tokens ^ U(0xD1B54A32D192ED03)).sum(dtype=np.uint64)
    return int(mix(np.array([total + U(len(tokens))], np.uint64)).view(np.int64)[0])


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document its class and set size, and, last, the task's sketch."""
    from pyspark import TaskContext

    sketch = np.zeros(1 << BITS, np.int32)
    names = ["doc_id", "class_id", "n", "slot", "sketch"]
    for part in slices(batches, "text", CHUNK):
        sets = shingle_sets(part.column(1))
        sketch += np.bincount((np.concatenate(sets) >> U(64 - BITS)).astype(np.int64), minlength=1 << BITS).astype(np.int32)
        none = pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.binary())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([class_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *none], names=names)
    if sketch.any():
        nothing = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([sketch.tobytes()], pa.binary())], names=names)


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(1 << BITS, np.int64)
    for raw in table["sketch"].to_pylist():
        total += np.frombuffer(raw, np.int64 if len(raw) == 8 << BITS else np.int32)
    return pa.table({"slot": pa.array([table["slot"][0].as_py()], pa.int64()), "sketch": pa.array([total.tobytes()], pa.binary())})


def merged_sketch(rows: DataFrame) -> np.ndarray:
    """The sum of all sketches, 64 at a time; at most 64 of fixed size reach the driver."""
    n = rows.count()
    while n > 64:
        rows = rows.withColumn("slot", F.floor(F.col("slot") / 64)).groupBy("slot").applyInArrow(_add, "slot long, sketch binary")
        rows, _ = materialize(rows, "sketch")
        n = min(n - 1, rows.count())
    total = np.zeros(1 << BITS, np.int64)
    for row in rows.select("sketch").toLocalIterator():
        raw = bytes(row[0])
        total += np.frombuffer(raw, np.int64 if len(raw) == 8 << BITS else np.int32)
    return total


def frequent_counters(sketch: np.ndarray) -> np.ndarray:
    """Which counters belong to the frequent class."""
    mean = sketch.mean()
    return sketch > mean + max(FREQUENT, 8 * np.sqrt(mean))


_BOUNDS = [1]
while _BOUNDS[-1] < 2**40:
    _BOUNDS.append(_BOUNDS[-1] * DEN // NUM + 1)
_BOUNDS = np.array(_BOUNDS)


def prefix_keys(tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of a set and the position of each key's shingle in the order (-1 for pairs)."""
    n = len(tokens)
    prefix = n - -(-NUM * n // DEN) + 1
    common = frequent[(tokens >> U(64 - BITS)).astype(np.int64)]
    rare = tokens[~common]
    keys, places = [rare[:prefix]], [np.arange(min(prefix, len(rare)))]
    if len(rare) < prefix:
        often = tokens[common]
        size = int(np.searchsorted(_BOUNDS, n, "right")) - 1
        for level in {size, max(size - 1, 0)}:
            groups = int(_BOUNDS[level]) // DEN
            salt = U((level + 1) * 0x9E3779B97F4A7C15 & 2**64 - 1)
            if not groups:  # too small for pairs: single shingles
                keys.append(mix(often[: prefix - len(rare)] + salt))
                places.append(np.full(len(keys[-1]), -1))
                continue
            some = often[: prefix + groups - len(rare)]
            group = (mix(some) % U(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            some, group = some[order], group[order]
            for step in range(1, len(some)):
                same = group[step:] == group[:-step]
                if not same.any():
                    break
                keys.append(mix(mix(some[:-step][same]) + some[step:][same] * U(3) + salt))
                places.append(np.full(len(keys[-1]), -1))
    return np.concatenate(keys), np.concatenate(places)


POSTING = "key long, id long, info long"


def _gathered(keys: list[np.ndarray], ids: list[np.ndarray], sizes: list[np.ndarray], places: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Postings with their size, place and two marks in ``info``: bit 0, the key is hot here; bit 1, the row is dealt by its class."""
    key, own = np.concatenate(keys), np.concatenate(ids)
    info = (np.concatenate(sizes) << 32) | (np.concatenate(places) + 1 << 2)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    size = np.diff(np.append(begin, len(key)))
    mark = np.where(np.repeat(size, size) >= HOT, 3, 0)
    mark[begin] &= 1  # one row of a hot key goes where the key's other rows are
    info[order] |= mark
    whole = pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own), pa.array(info)], names=["key", "id", "info"])
    yield from (whole.slice(k, OUT) for k in range(0, len(key), OUT))


def _postings(frequent: np.ndarray):
    """Index keys of each class, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, rows = ([], [], [], []), 0
        for part in slices(batches, "text", CHUNK):
            for tokens in shingle_sets(part.column(0)):
                if not len(tokens) or (own := class_id(tokens)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(own)
                k, p = prefix_keys(tokens, frequent)
                for to, x in zip(held, (k, np.full(len(k), own, np.int64), np.full(len(k), len(tokens), np.int64), p.astype(np.int64)), strict=True):
                    to.append(x)
                rows += len(k)
            if rows >= GATHER:
                yield from _gathered(*held)
                held, rows = ([], [], [], []), 0
        if rows:
            yield from _gathered(*held)

    return run


def enough(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least overlap of sets of sizes a and b with similarity NUM / DEN."""
    return -(-NUM * (a + b) // (NUM + DEN))


def possible(n: np.ndarray, place: np.ndarray, other_n: np.ndarray, other_place: np.ndarray) -> np.ndarray:
    """Whether sizes, and the places of a shared rare shingle, leave room for the similarity."""
    ok = DEN * np.minimum(n, other_n) >= NUM * np.maximum(n, other_n)
    known = (place >= 0) & (other_place >= 0)
    return ok & (~known | (np.minimum(n - place, other_n - other_place) >= enough(n, other_n)))


def ordered_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, smaller id first."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


FOUND = "key long, a long, b long, n int, place int"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, id): pairs (a, b) of keys with up to SMALL classes, and the postings (key, a, n, place) of larger keys."""
    held = np.zeros((0, 3), np.int64)
    large_key: int | None = None  # a large key whose first rows are gone

    def done(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole keys, or parts of ``large_key``."""
        again = np.zeros(len(rows), bool)
        again[1:] = (rows[1:, 0] == rows[:-1, 0]) & (rows[1:, 1] == rows[:-1, 1])
        hot = rows[(rows[:, 2] & 1) > 0, 0]
        key, own, info = rows[~again].T
        if not len(key):
            return
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(begin, len(key)))
        large = (size > SMALL) | np.isin(key[begin], hot)
        if large_key is not None:
            large |= key[begin] == large_key
        large, size = np.repeat(large, size), np.repeat(size, size)
        n, place = info >> 32, (info & 0xFFFFFFFF) // 4 - 1
        left, right = [], []
        for step in range(1, SMALL):
            i = np.flatnonzero((key[step:] == key[:-step]) & ~large[:-step] & (size[:-step] > step)) if len(key) > step else np.zeros(0, np.int64)
            if not len(i):
                break
            i = i[possible(n[i], place[i], n[i + step], place[i + step])]
            left.append(own[i]), right.append(own[i + step])
        if left:
            a, b = ordered_pairs(np.concatenate(left), np.concatenate(right))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int32())], names=["key", "a", "b", "n", "place"])
        if large.any():
            count = int(large.sum())
            yield pa.RecordBatch.from_arrays([pa.array(key[large]), pa.array(own[large]), pa.nulls(count, pa.int64()), pa.array(n[large].astype(np.int32)), pa.array(place[large].astype(np.int32))], names=["key", "a", "b", "n", "place"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.concatenate((held, np.stack([np.asarray(c) for c in batch.columns], 1)))
        last = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
        if len(rows) - last > 2 * SMALL and len(np.unique(rows[last:, 1])) > SMALL:
            yield from done(rows)
            held, large_key = rows[:0], int(rows[-1, 0])
        elif rows[-1, 0] == large_key:
            yield from done(rows)
            held = rows[:0]
        else:
            yield from done(rows[:last])
            held = rows[last:]
    yield from done(held)


def parity(tokens: np.ndarray) -> bytes:
    """A bit per hash bucket: whether it holds an odd number of the set's shingles; two to four bits per shingle.

    Each element of the symmetric difference of two sets flips one bit, so the
    bits that differ never outnumber it.
    """
    size = 64
    while size < 2 * len(tokens):
        size *= 2
    return np.packbits(np.bincount((mix(tokens + U(0x2545F4914F6CDD1D)) & U(size - 1)).astype(np.int64), minlength=size) & 1).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two parities differ, the longer one folded to the shorter."""
    x, y = int.from_bytes(a, "big"), int.from_bytes(b, "big")
    n, m = 8 * len(a), 8 * len(b)
    while n > m:
        n //= 2
        x = (x >> n) ^ (x & (1 << n) - 1)
    while m > n:
        m //= 2
        y = (y >> m) ^ (y & (1 << m) - 1)
    return (x ^ y).bit_count()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", CHUNK):
        sets = shingle_sets(part.column(0))
        columns = [pa.array([class_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([parity(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "tokens", "parity", "size"])


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose parities allow the similarity: sets of that similarity differ in at most (1 - s) / (1 + s) of their elements."""
    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
        keep = [(NUM + DEN) * differing(pa_, pb) <= (DEN - NUM) * (na + nb) for pa_, na, pb, nb in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by leader, its own set before those of the others."""
    leader, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        a_out, b_out = [], []
        for a, b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            tokens = np.frombuffer(raw.as_buffer(), np.uint64)
            if b is None:
                leader, own = a, tokens
                continue
            assert a == leader
            # both are sorted and distinct: equal neighbours of the merged array are common
            both = np.sort(np.concatenate((own, tokens)), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            if DEN * shared >= NUM * (len(own) + len(tokens) - shared):
                a_out.append(a), b_out.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose parities (two bits or more per shingle) allow the similarity; no set is moved for it."""
    sign = lambda k: sets.select(F.col("id").alias(k), F.col("parity").alias(f"p{k}"), F.col("size").alias(f"n{k}"))
    signed = pairs.join(sign("a"), "a").join(sign("b"), "b").select("a", "b", "pa", "na", "pb", "nb")
    return signed.mapInArrow(_possible, "a long, b long")


def verified(some: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[str]]:
    """The pairs of a written table whose whole sets are similar, and working tables to discard once they are written.

    The side with more pairs is the leader, whose set moves once for TASK_PAIRS
    of its pairs; a leader's pairs are dealt over tasks.
    """
    degree = some.select(F.explode(F.array("a", "b")).alias("x")).groupBy("x").agg(F.count("*").alias("d"))
    width = some.count() // ROWS + 1  # narrow tables of few rows go to few files
    degree, degree_path = materialize(degree.coalesce(width), "degree")
    side = lambda k: _few(degree).select(F.col("x").alias(k), F.col("d").alias(f"d{k}"))
    ranked = some.join(side("a"), "a").join(side("b"), "b")
    swap = F.col("db") > F.col("da")
    led = ranked.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"), F.greatest("da", "db").alias("d"))
    dealt, dealt_path = materialize(led.withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("d") / TASK_PAIRS))).coalesce(width), "dealt")
    heads = dealt.select("a", F.lit(None).cast("long").alias("b"), "salt", F.col("a").alias("whose")).distinct()
    moves = dealt.select("a", "b", "salt", F.col("b").alias("whose")).unionByName(heads)
    # few moves are broadcast to the sets; otherwise only the sets that have a pair are shuffled
    rows = sets.select("id", "tokens").join(_few(moves), F.col("id") == F.col("whose"))
    rows = rows.select("a", "b", "tokens", "salt").repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.select("a", "b", "tokens").mapInArrow(_verify, "a long, b long"), [degree_path, dealt_path]


def _few(df: DataFrame) -> DataFrame:
    """Broadcast if few rows, a shuffled join otherwise."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


MEMBER = ["group", "block", "probe", "id", "n", "label", "parity"]


def _blocks(first: int | None):
    """Rows sorted by (group, block, probe): each probe's pairs with members of other labels that their parities allow.

    With ``first``, only so many nearest partners.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, member, bits, tables = None, [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            place = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            probe, raw = batch.column(2).to_pylist(), batch.column(6)
            rows = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in (3, 4, 5)], 1)
            left, right = [], []
            for i, at in enumerate(place):
                if at != now:
                    now, member, bits, tables = at, [], [], []
                if not probe[i]:
                    member.append(rows[i]), bits.append(raw[i].as_buffer().to_pybytes())
                    continue
                if bits:
                    table, sizes = np.array(member), np.array([len(x) for x in bits])
                    tables = [(table[sizes == w], np.frombuffer(b"".join(x for x in bits if len(x) == w), np.uint8).reshape(-1, w).view(np.uint64)) for w in np.unique(sizes).tolist()]
                    bits = []
                near = partners(rows[i], np.frombuffer(raw[i].as_buffer(), np.uint64), tables, first)
                if len(near):
                    left.append(np.full(len(near), rows[i, 0])), right.append(near)
            if left:
                a, b = ordered_pairs(np.concatenate(left), np.concatenate(right))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Parities (rows of 64-bit words) folded to so many words; halves are added modulo 2."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def partners(row: np.ndarray, own: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]], first: int | None) -> np.ndarray:
    """Ids of the members that may be similar to ``row`` (id, n, label) and have another label."""
    found, apart = [], []
    for member, bits in tables:
        n = member[:, 1]
        some = np.flatnonzero((member[:, 2] != row[2]) & (DEN * np.minimum(n, row[1]) >= NUM * np.maximum(n, row[1])))
        if not len(some):
            continue
        words = min(bits.shape[1], len(own))
        differ = np.bitwise_count(folded(bits[some], words) ^ folded(own, words)).sum(1, dtype=np.int64)
        ok = (NUM + DEN) * differ <= (DEN - NUM) * (n[some] + row[1])
        found.append(member[some[ok], 0]), apart.append(differ[ok])
    if not found:
        return np.zeros(0, np.int64)
    found, apart = np.concatenate(found), np.concatenate(apart)
    return found if first is None else found[np.lexsort((found, apart))[:first]]


def crossing(large: DataFrame, labels: DataFrame, sets: DataFrame, first: int | None) -> tuple[DataFrame, str]:
    """Pairs between labels inside the large keys that have several: classes outside a key's main label against all others.

    Keys of one main label share most of their classes, so they form one group, in
    which each class is one row; a key without two classes of a label is a group of its own. Also
    returns the working table that the pairs read.
    """
    now = large.join(labels.select(F.col("node").alias("l_id"), "label"), F.col("id") == F.col("l_id"), "left").select("key", "id", "n", F.coalesce("label", "id").alias("label"))
    each = now.groupBy("key", "label").agg(F.count("*").alias("c"))
    mixed = each.groupBy(F.col("key").alias("m_key")).agg(F.max(F.struct("c", "label")).alias("top"), F.count("*").alias("labels")).filter("labels > 1")
    mixed, mixed_path = materialize(mixed.select("m_key", F.col("top.label").alias("main"), F.when(F.col("top.c") > 1, F.xxhash64("top.label")).otherwise(F.col("m_key")).alias("group")), "mixed")
    rows = now.join(_few(mixed), F.col("key") == F.col("m_key")).select("group", "id", "n", "label", (F.col("label") != F.col("main")).alias("outside")).distinct()
    rows, rows_path = materialize(rows, "members")
    discard(large.sparkSession, mixed_path)
    parts = rows.groupBy(F.col("group").alias("g")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    rows = rows.join(_few(parts), F.col("group") == F.col("g"))
    member = rows.select("group", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("block"), F.lit(False).alias("probe"), "id", "n", "label")
    probe = rows.filter("outside").select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"), F.lit(True).alias("probe"), "id", "n", "label")
    signed = member.unionByName(probe).join(sets.select(F.col("id").alias("s_id"), "parity"), F.col("id") == F.col("s_id")).select(*MEMBER)
    return signed.repartition("group", "block").sortWithinPartitions("group", "block", "probe").mapInArrow(_blocks(first), "a long, b long").distinct(), rows_path


def merged(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, list[str]]:
    """``labels`` (node, label) after more links."""
    old = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"l{k}"))
    over = links.join(old("a"), "a", "left").join(old("b"), "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    joined, joined_path = least_labels(over)
    ends = labels.select("node", "label").unionAll(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels, "node", "left_anti").select("node", F.col("node").alias("label")))
    new = ends.join(joined.select(F.col("node").alias("m_node"), F.col("label").alias("m_label")), F.col("label") == F.col("m_node"), "left").select("node", F.coalesce("m_label", "label").alias("label"))
    new, new_path = materialize(new.coalesce(new.count() // ROWS + 1), "labels")
    return new, [joined_path, new_path]


def starred(large: DataFrame) -> DataFrame:
    """Pairs of each large key's least class with its others."""
    heads = large.groupBy(F.col("key").alias("h_key")).agg(F.min(F.struct("id", "n", "place")).alias("h")).select("h_key", F.col("h.id").alias("h_id"), F.col("h.n").alias("h_n"), F.col("h.place").alias("h_place"))
    heads, _ = materialize(heads, "heads")
    n, m = F.col("n").cast("long"), F.col("h_n").cast("long")
    room = (F.col("place") < 0) | (F.col("h_place") < 0) | ((DEN + NUM) * F.least(n - F.col("place"), m - F.col("h_place")) >= NUM * (n + m))
    rows = large.join(_few(heads), F.col("key") == F.col("h_key")).filter((F.col("id") != F.col("h_id")) & (DEN * F.least(n, m) >= NUM * F.greatest(n, m)) & room)
    return rows.select(F.least("id", "h_id").alias("a"), F.greatest("id", "h_id").alias("b"))


def similarity_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class_id, n) of every row and (id, label) of the classes that have links."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found, _ = materialize(texts.mapInArrow(_classes, "doc_id long, class_id long, n long, slot long, sketch binary"), "classes")
    classes = found.filter("sketch is null").select("doc_id", "class_id", "n")
    frequent = frequent_counters(merged_sketch(found.filter("sketch is not null").select("slot", "sketch")))

    # a hot key is one row per task where its key belongs, and the rest is dealt by class
    dealt = F.when(F.col("info").bitwiseAND(2) > 0, F.pmod("id", F.lit(4096))).otherwise(-1)
    rows = texts.select("text").mapInArrow(_postings(frequent), POSTING).repartition("key", dealt).sortWithinPartitions("key", "id")
    met, met_path = materialize(rows.mapInArrow(_meet, FOUND), "met")
    large = met.filter("key is not null").select("key", F.col("a").alias("id"), "n", "place")
    pairs, pair_path = materialize(met.filter("key is null").select("a", "b").unionAll(starred(large)).distinct(), "pairs")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionAll(large.select("id")).distinct()
    wanted, wanted_path = materialize(wanted, "wanted")
    one_each = classes.join(_few(wanted), F.col("class_id") == F.col("id"), "left_semi").groupBy("class_id").agg(F.min("doc_id").alias("w_doc")).select("w_doc")
    one_each, one_path = materialize(one_each, "wanted")
    own = _few(one_each)
    sets = texts.join(own, F.col("doc_id").eqNullSafe(F.col("w_doc")), "left_semi").select("text").mapInArrow(_sets, "id long, tokens binary, parity binary, size long")
    # several rows of one class share the least doc_id only if that id is repeated
    repeats = classes.join(own, F.col("doc_id").eqNullSafe(F.col("w_doc")), "left_semi").count() > one_each.count()
    sets, set_path = materialize(sets.groupBy("id").agg(*(F.first(c).alias(c) for c in ("tokens", "parity", "size"))) if repeats else sets, "sets")
    some, some_path = materialize(plausible(pairs, sets), "possible")
    discard(spark, pair_path, wanted_path, one_path)

    checked, used = verified(some, sets)
    links, link_path = materialize(checked, "links")
    labels, label_path = least_labels(links)
    discard(spark, *used, some_path, link_path)
    for first in (FIRST, None) if large.limit(1).count() else ():
        pairs, member_path = crossing(large, labels, sets, first)
        pairs, pair_path = materialize(pairs, "pairs")
        checked, used = verified(pairs, sets)
        links, link_path = materialize(checked, "links")
        some_links = links.limit(1).count()
        if some_links:
            labels, paths = merged(labels, links)
            discard(spark, label_path, paths[0])
            label_path = paths[1]
        discard(spark, *used, member_path, pair_path, link_path)
    discard(spark, set_path, met_path)
    return classes, labels.select(F.col("node").alias("id"), "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies (rows with the same set) of every row."""
    classes, labels = similarity_classes(docs)
    own = classes.filter("n > 0").groupBy("class_id", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_copies"))
    with_label = own.join(labels, F.col("class_id") == F.col("id"), "left").select("class_id", "least", "n_copies", F.coalesce("label", "class_id").alias("label"))
    least = with_label.groupBy(F.col("label").alias("c_label")).agg(F.min("least").alias("component_id"))
    component = with_label.join(least, F.col("label") == F.col("c_label")).select(F.col("class_id").alias("c_id"), "component_id", "n_copies")
    out = classes.join(component, (F.col("class_id") == F.col("c_id")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"))


def fates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class_id, chosen) of the classes in groups of several rows, and (doc_id, n_rows) of ids that several rows have or that are null.

    A group's chosen rows are those of its least doc_id, null last, and of these
    the ones of the least class.
    """
    classes, labels = similarity_classes(docs)
    own = classes.filter("n > 0").groupBy("doc_id", "class_id").agg(F.count("*").alias("n_rows"))
    own, _ = materialize(own.join(labels, F.col("class_id") == F.col("id"), "left").select("doc_id", "class_id", "n_rows", F.coalesce("label", "class_id").alias("label")), "members")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class_id")).alias("c")
    heads = own.groupBy(F.col("label").alias("h_label")).agg(least, F.sum("n_rows").alias("h_rows")).filter("h_rows > 1")
    chosen = F.col("doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("class_id") == F.col("c.class_id"))
    fate, _ = materialize(own.join(heads, F.col("label") == F.col("h_label")).select("doc_id", "class_id", chosen.alias("chosen")), "fates")
    twice, _ = materialize(classes.groupBy("doc_id").agg(F.count("*").alias("n_rows")).filter("n_rows > 1 or doc_id is null"), "twice")
    return fate, twice


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of linked texts: that of the least doc_id, null last.

    Where an id names one row, the id decides. Rows of repeated and null ids are
    told apart by the class of their text, so that a text is never dropped for
    what another text with its id is linked to: of the rows of a group with its
    least id the one of the least class and text stays. Empty texts are linked
    with nothing and all stay. The ids to drop are broadcast when few and
    joined otherwise; only rows of repeated ids are shuffled with their texts.
    """
    fate, twice = fates(docs)
    gone = fate.filter("not chosen").select(F.col("doc_id").alias("g_id")).filter("g_id is not null")
    if not twice.limit(1).count():
        return docs.join(_few(gone), docs["doc_id"].cast("long") == gone["g_id"], "left_anti")
    shared = twice.select(F.col("doc_id").alias("t_id"))
    once = docs.join(_few(shared), docs["doc_id"].cast("long").eqNullSafe(shared["t_id"]), "left_anti").join(_few(gone), docs["doc_id"].cast("long") == gone["g_id"], "left_anti")
    several = docs.join(_few(shared), docs["doc_id"].cast("long").eqNullSafe(shared["t_id"]), "left_semi")
    place, columns = docs.columns.index("text"), docs.columns
    name = next(x for k in range(len(columns) + 1) if (x := f"class_{k}") not in columns)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", CHUNK):
            ids = pa.array([class_id(s) if len(s) else None for s in shingle_sets(part.column(place))], pa.int64())
            yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*columns, name])

    rows = several.mapInArrow(classed, StructType([*docs.schema, StructField(name, LongType())])).alias("r")
    told = rows.join(fate.alias("f"), F.col("r.doc_id").cast("long").eqNullSafe(F.col("f.doc_id")) & (F.col(f"r.{name}") == F.col("f.class_id")), "left")
    free = told.filter("f.chosen is null").select("r.*").drop(name)
    rank = next(x for k in range(len(columns) + 1) if (x := f"rank_{k}") not in columns)
    first = told.filter("f.chosen").select("r.*").withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", name).orderBy("text"))).filter(F.col(rank) == 1)
    return once.unionByName(free).unionByName(first.select(*columns))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
