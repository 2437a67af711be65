"""Language ID: nearest centroid over normalised TF-IDF vectors of character n-grams.

A text's letters are lowered, everything between two letters counts as one
space, and n-grams of one to three code points are hashed into SIZE places.
Document frequencies are sums over all training rows; each task adds its own.
Every language gets several centroids (spherical k-means, so that registers
or scripts of one language need not share a mean) from at most SAMPLE of its
distinct texts, drawn by hash; their clusters are found in one task per language,
and those of few members are left out. A text gets the language of the centroid with the largest cosine. It is rejected if that
cosine is below what the centroid's own members have, by a margin.

The prediction of a rejected text stays in ``lang_pred``; ``known`` is false.

Defined results: a null text, and one without any letter, is ``und`` with score
0 and unknown; texts with a letter always get a learned language, the one that
comes first in the alphabet among equals; rows with null text or language, or
without letters, teach nothing; a null doc_id is not held out; repeated rows
are learned and scored one by one; texts of any length are counted in pieces;
without training rows every prediction is ``und``; an empty table stays empty;
other columns are ignored. More than LANGUAGES languages are an error, since
their centroids go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality_classifier import remainder
from .scratch import discard, materialize, small_batches
from .sums import partition_sum
from .words import mix, slices

#: Hashed n-grams, and the longest n-gram.
SIZE, LONGEST = 8192, 3
#: The most rows of one language that its centroids are fitted on, and the most languages.
SAMPLE, LANGUAGES = 1000, 500
#: Centroids of a language, rounds of k-means.
CLUSTERS, ROUNDS = 4, 8
#: The least share of a language's sample that a centroid stands for.
MEMBERS = 0.05
#: A text is rejected if its cosine is below the LOW quantile of its centroid's members, divided by MARGIN.
LOW, MARGIN = 0.01, 1.5
#: How steeply differences of cosines turn into scores.
STEEP = 30.0
UNKNOWN = "und"
#: Code points that are counted at once, and documents whose vectors are held at once.
PIECE, DOCS, SLICE = 1 << 18, 64, 1 << 18
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)

_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points are letters; made once in a worker."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _LETTERS


def add_grams(counts: np.ndarray, codes: np.ndarray, row: np.ndarray) -> None:
    """Add the n-grams of code points (letters, and 0 between words) to the rows of ``counts``; none crosses a change of row."""
    width = counts.shape[1]
    key = np.zeros(len(codes), np.uint64)
    for n in range(LONGEST):
        if len(codes) <= n:
            break
        at = len(codes) - n
        key = key[:at] + (codes[n:].astype(np.uint64) + np.uint64(1)) * _STEPS[n]
        place = (mix(key) % np.uint64(width)).astype(np.int64) + row[:at] * width
        if n:
            place = place[row[:at] == row[n:]]
        else:
            place = place[codes[:at] != 0]
        counts.reshape(-1)[:] += np.bincount(place, minlength=counts.size)


def spaced(text: str) -> np.ndarray:
    """Code points of the lowered text in which each run of other characters is one 0; the text is held between two zeros."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = letters()[codes]
    keep = letter.copy()
    keep[:-1] |= letter[1:]
    out = np.where(letter, codes, 0)
    # of a run of others, the last one before a letter stays
    gap = np.zeros(1, out.dtype)
    return np.concatenate((gap[: int(letter[0])], out[keep], gap)) if letter.any() else out[:0]


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams, one row per text, and whether a text has a letter."""
    counts = np.zeros((len(texts), SIZE))
    some = np.zeros(len(texts), bool)
    codes, rows, held = [], [], 0

    def flush() -> None:
        nonlocal codes, rows, held
        if codes:
            add_grams(counts, np.concatenate(codes), np.repeat(rows, [len(c) for c in codes]))
        codes, rows, held = [], [], 0

    for k, text in enumerate(texts):
        for at in range(0, len(text or ""), PIECE):
            part = spaced(text[at : at + PIECE])
            some[k] |= len(part) > 0
            codes.append(part)
            rows.append(k)
            held += len(part)
            if held >= PIECE:
                flush()
    flush()
    return counts, some


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: (1 + ln tf) x idf."""
    x = np.zeros(counts.shape, np.float32)
    np.log(counts, out=x, where=counts > 0)
    x += counts > 0
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x


def some_texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for part in slices(batches, column, SLICE):
        for at in range(0, part.num_rows, DOCS):
            piece = part.slice(at, DOCS)
            yield piece, piece.column(piece.schema.get_field_index(column)).to_pylist()


def inverse_frequencies(train: DataFrame) -> tuple[np.ndarray, float]:
    """ln((1 + rows) / (1 + df)) of every place over all training rows, and their number."""

    def add(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for _, texts in some_texts(iter([batch]), "text"):
            counts, some = counted(texts)
            total[:-1] += (counts > 0).sum(0)
            total[-1] += some.sum()

    total = partition_sum(train.select("text"), add, SIZE + 1)
    return np.log((1 + total[-1]) / (1 + total[:-1])).astype(np.float32) + np.float32(0.1), float(total[-1])


def spherical(x: np.ndarray, k: int = CLUSTERS, rounds: int = ROUNDS) -> np.ndarray:
    """At most k unit centroids: the mean's nearest row first, then the row farthest from all chosen; then Lloyd rounds."""
    chosen = [int(np.argmax(x @ x.mean(0)))]
    while len(chosen) < min(k, len(x)):
        near = (x @ x[chosen].T).max(1)
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-6:
            break
        chosen.append(far)
    c = x[chosen]
    for left in range(2 * rounds, 0, -1):
        at = (x @ c.T).argmax(1)
        members = np.bincount(at, minlength=len(c))
        if left <= rounds and len(c) > 1 and members.min() < MEMBERS * len(x):
            c = np.delete(c, members.argmin(), 0)  # outliers and mislabelled rows: their members go to the others
            continue
        sums = np.stack([x[at == j].sum(0) if members[j] else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c


def _centroids(table: pa.Table) -> pa.Table:
    order = np.argsort(table["draw"].to_numpy(), kind="stable")
    x = np.stack([np.frombuffer(table["x"][int(k)].as_buffer(), np.float32) for k in order])
    c = spherical(x)
    cosine = x @ c.T
    at, best = cosine.argmax(1), cosine.max(1)
    least = [float(np.quantile(best[at == j], LOW)) / MARGIN if (at == j).any() else 0.0 for j in range(len(c))]
    return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(c), pa.string()), "c": pa.array([row.astype(np.float32).tobytes() for row in c], pa.binary()), "least": pa.array(least, pa.float64())})


class Centroids:
    """Languages in order, their centroids, and the cosines below which a text is rejected."""

    def __init__(self, idf: np.ndarray, rows: list[tuple[str, bytes, float]]):
        rows = sorted(rows)
        self.idf = idf
        self.langs = sorted({r[0] for r in rows})
        self.lang_of = np.array([self.langs.index(r[0]) for r in rows], np.int64)
        self.first = np.searchsorted(self.lang_of, np.arange(len(self.langs)))
        self.c = np.stack([np.frombuffer(r[1], np.float32) for r in rows]) if rows else np.zeros((0, SIZE), np.float32)
        self.least = np.array([r[2] for r in rows])

    def __call__(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether the text is near enough, for each text."""
        counts, some = counted(texts)
        if not self.langs or not some.any():
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        cosine = (vectors(counts, self.idf) @ self.c.T).astype(np.float64)
        best = np.maximum.reduceat(cosine, self.first, axis=1)
        at = best.argmax(1)
        score = 1 / np.exp(STEEP * (best - best.max(1, keepdims=True))).sum(1)
        near = cosine.argmax(1)
        known = some & (cosine[np.arange(len(texts)), near] >= self.least[near])
        return [self.langs[k] if s else UNKNOWN for k, s in zip(at.tolist(), some.tolist(), strict=True)], np.where(some, score, 0.0), known


def fit(train: DataFrame) -> Centroids:
    """Centroids of the languages of ``train`` (text, lang); all rows count for the frequencies, SAMPLE a language for the clusters."""
    spark = train.sparkSession
    idf, rows = inverse_frequencies(train)
    per_lang = train.filter(F.col("text").rlike(r"\p{L}")).groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows")).limit(LANGUAGES + 1).collect() if rows else []
    if len(per_lang) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: their centroids would not fit into every task")
    if not per_lang:
        return Centroids(idf, [])
    # twice the expected share of the sample, so that the window below sees few rows
    share = F.create_map(*(F.lit(v) for r in per_lang for v in (r["lang"], min(1.0, 2 * SAMPLE / r["n_rows"]))))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    drawn = train.filter(F.col("text").rlike(r"\p{L}")).withColumn("draw", draw).filter(F.col("draw") < share[F.col("lang")] * (1 << 40))

    def vector(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in some_texts(batches, "text"):
            x = vectors(counted(texts)[0], idf)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([row.tobytes() for row in x], pa.binary())], names=["lang", "draw", "x"])

    # copies have one draw and are drawn once
    first = drawn.select("lang", "draw", "text").dropDuplicates(["lang", "draw"]).withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).filter(F.col("place") <= SAMPLE)
    sample, path = materialize(first.select("lang", "draw", "text").mapInArrow(vector, "lang string, draw long, x binary"), "language")
    found = sample.groupBy("lang").applyInArrow(_centroids, "lang string, c binary, least double").collect()
    discard(spark, path)
    return Centroids(idf, [(r["lang"], bytes(r["c"]), r["least"]) for r in found])


def predict(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, lang_pred, score and known for every document. No shuffle."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in some_texts(batches, "text"):
            lang, score, known = model(texts)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(known)], names=["doc_id", "lang_pred", "score", "known"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, known boolean")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, known; learned from the documents with a language that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    held = F.coalesce(remainder() == 1, F.lit(False))
    model = fit(rows.filter(~held).filter("text is not null and lang is not null"))
    return predict(rows, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "known")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
