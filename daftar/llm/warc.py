"""WARC archives: writing with de-duplicated payloads, reading by boundary chains.

Writing uses Spark's text sink: one string per record, records ended by the
CRLF CRLF that the format asks for. Reading deals out byte ranges; each task
emits, for every line that looks like a record's first line, the offset and the
offset where that record would end. Pointer jumping from the start of each file
then keeps only the records that the chain reaches, so a record's first line
quoted inside a payload is never taken for a record.

Defined results: a null payload is empty; a null page_id or url is written as
an empty field and read back as null; repeated rows are separate records, and
all rows that have the largest page_id of their payload are responses; of equal
payloads without any page_id all are responses; headers and payloads may have
any length and take memory in proportion to it; an empty table gives no archive
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize, new_path

#: Fixed values of the format.
MAGIC, END = b"WARC/1.0\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payloads of at least so many bytes are de-duplicated.
MIN_BYTES = 0
#: Repeated payloads (rows of about 80 bytes) that are broadcast at most.
BROADCAST_ROWS = 400_000
#: Bytes of an archive that one reading task takes, and that are read at a time beyond them for a header that goes on.
RANGE, MORE = 8 << 20, 1 << 16
_HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def base32_sha1(payload):
    """Upper-case base32 of a payload's SHA-1, as a column expression."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), _HEX32, BASE32)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to.

    The largest page_id per payload comes from an aggregate over digests with
    map-side combine, kept only for payloads that repeat. That table is written
    and counted: up to ``BROADCAST_ROWS`` rows it is broadcast and the payloads
    stay where they are; beyond that a shuffled join takes over, in which a hot
    payload is one row on the other side, so AQE can split it.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", base32_sha1(F.col("html").cast("binary")))
    largest = rows.groupBy(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b")).agg(F.max("page_id").alias("first_id"), F.count("*").alias("n"))
    largest, _ = materialize(largest.filter("n > 1").drop("n"), "payloads")
    if largest.count() <= BROADCAST_ROWS:
        largest = F.broadcast(largest)
    joined = rows.join(largest, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left").drop("d", "b")
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_id"))).drop("first_id")


def _escaped(column):
    """A header value without white space, which a reader would cut off at its ends."""
    out = F.replace(column, F.lit("%"), F.lit("%25"))
    for c in "\r\n \t\v\f":
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.coalesce(out, F.lit(""))


def record(date: str = "1970-01-01T00:00:00Z"):
    """One record without its closing CRLF CRLF; a revisit has no block."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    revisit = F.col("record_type") == "revisit"
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.col("record_type"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name("page_id"),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), _escaped(F.col("url")),
        F.lit("\r\nContent-Type: text/html\r\nWARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:"), name("refers_to"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Length: "), F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string")), F.lit(END),
    )
    return F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("html")))


def write_warc(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Write archives, one per partition, under ``path``."""
    with_revisits(pages, min_bytes).select(record().alias("value")).write.option("lineSep", END).text(path)


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(inner)


def _uri(path: str) -> str:
    """A Hadoop path (file:/a) as a URI that pyarrow reads (file:///a)."""
    return re.sub(r"^(\w+):/(?!/)", r"\1:///", path)


_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)\r\n", re.I)


def candidates(data: bytes, base: int, limit: int, size: int, more: Callable[[int], bytes] = lambda at: b"") -> list[tuple[int, int]]:
    """(offset, successor) of each line in ``data[:limit]`` that starts like a record; ``more(at)`` gives the bytes from file offset ``at`` on."""
    found, at = [], data.find(MAGIC)
    while 0 <= at < limit:
        ends = data.find(b"\r\n\r\n", at)
        while ends < 0 and base + len(data) < size and (rest := more(base + len(data))):
            data, seen = data + rest, len(data)
            ends = data.find(b"\r\n\r\n", max(at, seen - 3))
        length = _LENGTH.search(data, at, ends + 2) if ends >= 0 else None
        if length:
            following = base + ends + 4 + int(length[1]) + len(END)
            if following <= size:
                found.append((base + at, following))
        at = data.find(MAGIC, at + 1)
    return found


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            with _open(_uri(row["path"])) as f:
                step = MORE

                def more(at: int) -> bytes:
                    nonlocal step
                    step *= 2
                    return f.read_at(min(step, row["size"] - at), at)  # noqa: B023

                data = f.read_at(min(row["end"] + MORE, row["size"]) - row["start"], row["start"])
                found = candidates(data, row["start"], row["end"] - row["start"], row["size"], more)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["path"]] * len(found), pa.string()), pa.array([row["size"]] * len(found), pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())],
                names=["path", "size", "offset", "successor"],
            )


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches: pointer jumping, doubling the stride each round."""
    n = len(offsets)
    order = np.argsort(offsets)
    at = np.minimum(np.searchsorted(offsets, successors, sorter=order), n - 1)
    jump = np.where(offsets[order[at]] == successors, order[at], n)
    jump = np.append(jump, n)
    reach = np.append(offsets == 0, False)
    stride = 1
    while stride <= n:
        reach[jump[np.flatnonzero(reach)]] = True
        reach[n] = False
        jump = jump[jump]
        stride *= 2
    return reach[:n]


def _chain(table: pa.Table) -> pa.Table:
    offsets, successors = table["offset"].to_numpy(), table["successor"].to_numpy()
    keep = reachable(offsets, successors)
    end = int(successors[keep].max()) if keep.any() else 0
    if end != table["size"][0].as_py():
        raise ValueError(f"{table['path'][0]}: the chain of records ends at {end}, the file at {table['size'][0]}")
    return table.filter(pa.array(keep))


def _fields(head: bytes) -> dict[bytes, bytes]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}


def _page(value: bytes) -> int | None:
    return int(m[1]) if (m := re.fullmatch(rb"<urn:page:(-?\d+)>", value)) else None


def _payloads(rows: list[dict]) -> Iterator[tuple[dict, bytes]]:
    """Each row with its record's bytes: neighbours within RANGE are one read, a longer record is one of its own."""
    at = 0
    while at < len(rows):
        path, start, to = rows[at]["path"], rows[at]["offset"], at + 1
        while to < len(rows) and rows[to]["path"] == path and rows[to]["successor"] - start <= RANGE:
            to += 1
        with _open(_uri(path)) as f:
            data = f.read_at(rows[to - 1]["successor"] - start, start)
        for row in rows[at:to]:
            yield row, data[row["offset"] - start : row["successor"] - start]
        at = to


def _records(with_html: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for row, data in _payloads(batch.to_pylist()):
                ends = data.index(b"\r\n\r\n")
                got, block = _fields(data[:ends]), data[ends + 4 : -4]
                digest = got[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
                kind = got[b"warc-type"].decode()
                if kind == "response" and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest:
                    raise ValueError(f"{row['path']} at {row['offset']}: the payload's digest differs")
                out.append({
                    "page_id": _page(got[b"warc-record-id"]), "url": unquote(got[b"warc-target-uri"].decode()) or None if b"%" in got[b"warc-target-uri"] else got[b"warc-target-uri"].decode() or None,
                    "payload_bytes": int(got[b"x-payload-length"]), "payload_digest": digest, "record_type": kind, "refers_to": _page(got.get(b"warc-refers-to", b"")),
                } | ({"html": block.decode() if kind == "response" else None} if with_html else {}))
                held += len(block) if with_html else 0
                if held > RANGE:
                    yield pa.RecordBatch.from_pylist(out, schema=_schema(with_html))
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=_schema(with_html))

    return run


def _schema(with_html: bool) -> pa.Schema:
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    return pa.schema(kinds + ([("html", pa.string())] if with_html else []))


def read_warc(spark: SparkSession, path: str, with_html: bool = False, task_bytes: int = RANGE) -> DataFrame:
    """The records of all archives under ``path``, found by boundary chains.

    Ranges are dealt over tasks; a file's candidates (offsets only, bounded by
    the file's length) meet in one task for the jumping, and payloads are read
    back by offset in tasks again.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size")).filter("size > 0")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(task_bytes).cast("long")))
    ranges = files.select("path", "size", start.alias("start")).withColumn("end", F.least(F.col("start") + task_bytes, F.col("size")))
    ranges = ranges.repartition(F.col("path"), F.col("start"))
    chains = ranges.mapInArrow(_candidates, "path string, size long, offset long, successor long").groupBy("path").applyInArrow(_chain, "path string, size long, offset long, successor long")
    slot = F.floor(F.col("offset") / task_bytes)
    kinds = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * with_html
    return chains.repartition(F.col("path"), slot).sortWithinPartitions("path", "offset").mapInArrow(_records(with_html), kinds)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
