"""Fill-in-middle transformation with a Split pre-tokenizer of the tokenizers library; nothing is trained.

Isolated regex matches give code-point offsets. A match of one code point each
costs a microsecond of library time, so offsets are ranked in two levels: the
first Split isolates blocks of BLOCK units, and the second splits only the
blocks that are asked for. The length of the block offsets and of the last
block's gives n; the offset of rank r is that of place r % BLOCK in block
r // BLOCK. Very long texts go through the library in pieces of PIECE units, so
that what it holds at once does not grow with the text.

The cuts and the form come from the hex sha256 of ``seed:doc_id``, so that they
depend on nothing else: not on partitions, other rows or the order of rows.

Defined results: a null or empty text is plain and its output is empty; a null
doc_id draws like an empty one; repeated rows get equal results; a text that
holds one of the three marks is plain, so that every output can be taken apart;
cuts may fall together and leave empty parts; an empty table stays empty; other
columns stay, but for those with the names of results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .scratch import small_batches
from .words import CHUNK, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, those that are cut at all, and of the cut ones those with the suffix first.
CUT, SUFFIX_FIRST = 90, 20
#: Units of a block, and of a piece that the library gets at once (whole blocks).
BLOCK, PIECE = 128, 4096
PLAIN, PSM, SPM = "plain", "psm", "spm"
RESULTS = StructType([StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType())])


class Offsets:
    """Code-point offsets of a text's units."""

    def __init__(self, unit: str = r"\p{Any}"):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.blocks = Split(Regex(f"(?:{unit}){{1,{BLOCK}}}"), "isolated")
        self.units = Split(Regex(unit), "isolated")

    def of(self, text: str) -> Ranks:
        edges = [np.zeros(1, np.int64)]
        for at in range(0, len(text), PIECE):
            edges.append(at + np.array([end for _, (_, end) in self.blocks.pre_tokenize_str(text[at : at + PIECE])], np.int64))
        return Ranks(self, text, np.concatenate(edges))


class Ranks:
    """The offset of each rank from 0 to n, for one text."""

    def __init__(self, offsets: Offsets, text: str, edges: np.ndarray):
        self.offsets, self.text, self.edges, self.seen = offsets, text, edges, {}
        full = max(len(edges) - 2, 0)
        self.n = full * BLOCK + (len(self.inside(full)) - 1 if len(edges) > 1 else 0)

    def inside(self, block: int) -> list[int]:
        if block not in self.seen:
            start, end = self.edges[block], self.edges[block + 1]
            self.seen[block] = [0, *(e for _, (_, e) in self.offsets.units.pre_tokenize_str(self.text[start:end]))]
        return self.seen[block]

    def __getitem__(self, rank: int) -> int:
        block, place = divmod(rank, BLOCK)
        return int(self.edges[block]) + (self.inside(block)[place] if place else 0)


def transform(text: str, offsets: Offsets, h: list[int]) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text under four drawn numbers."""
    ranks = offsets.of(text)
    n = ranks.n
    if not text or h[2] % 100 >= CUT or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, text
    low, high = (ranks[k] for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    form = SPM if h[3] % 100 < SUFFIX_FIRST else PSM
    parts = (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle) if form == SPM else (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return n, form, low, high - low, "".join(parts)


def drawn(seed: int, doc_id: str = "doc_id") -> Column:
    """The first four groups of eight hex digits of sha256(``seed:doc_id``) as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


def fill_in_middle(docs: DataFrame, seed: int = 1, column: str = "text") -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output. No shuffle."""
    kept = [f for f in docs.schema if f.name not in RESULTS.names or f.name in ("doc_id", column)]
    schema = StructType([*kept, *RESULTS])
    place = [f.name for f in kept].index(column)
    small_batches(docs.sparkSession)
    drawn_name = next(name for k in range(len(kept) + 1) if (name := f"drawn_{k}") not in schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = Offsets()
        for part in slices(batches, column, CHUNK):
            draws = np.asarray(part.column(part.num_columns - 1).flatten()).reshape(-1, 4).tolist()
            rows = [transform(text or "", offsets, h) for text, h in zip(part.column(place).to_pylist(), draws, strict=True)]
            made = [pa.array([r[k] for r in rows], pa.string() if k in (1, 4) else pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=schema.names)

    rows = docs.select(*(F.col(f"`{f.name}`") for f in kept)).withColumn(drawn_name, drawn(seed))
    return rows.mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of. No text that was cut holds a mark, and no part can make up one with the mark beside it, so the first of each mark is the one that was set."""
    out, width = F.col(output), len(PREFIX)

    def between(start: Column, end: Column) -> Column:
        return F.substring(out, start + width, end - start - width)

    p, s, m = (F.instr(out, mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    whole = F.char_length(out) + 1
    psm = F.concat(between(p, s), between(m, whole), between(s, m))
    spm = F.concat(between(p, m), between(m, whole), between(s, p))
    return F.when(F.col(form) == PLAIN, out).when(F.col(form) == PSM, psm).otherwise(spm)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
