"""Quality classifier: random Fourier features, ridge from normal equations, isotonic calibration.

Document statistics (never labels, language, source or id) are standardised and
mapped to cosine features that approximate a Gaussian kernel. The normal
equations are sums over rows, so each task adds up its own and the driver
solves one small system per fold. Scores of rows left out of their fold feed the
isotonic fit, again through summed counts.

Defined results: null and empty texts have all statistics 0 and get the score
that these earn; rows with a null doc_id are scored and never learned from;
repeated labels of a document are averaged, repeated rows are scored one by one;
equal raw scores get equal scores; a very long text is a slice of its own and
takes memory in proportion to its length; without any label every score is 0.5;
an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import _SYMBOL, per_doc, text_counts
from .scratch import discard, materialize
from .sums import matrix, partition_sum
from .words import CHUNK, slices, words_of

FEATURES, FOURIER, FOLDS, RIDGE, WIDTH, BINS = 16, 192, 4, 2.0, 4.0, 1000
#: Raw scores are binned over this range for the isotonic fit.
LOW, HIGH = -0.5, 1.5
#: How far calibrated rates are drawn towards a half.
SHRINK = 1e-3


def _share(wanted: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(wanted)] = True
    return table


_UPPER, _DIGIT = _share(bytes(range(65, 91))), _share(bytes(range(48, 58)))
_BANG, _BAR, _STOP, _COMMA = _share(b"!?"), _share(b"|"), _share(b"."), _share(b",;:")
_WIDE = _share(bytes(range(128, 256)))


def statistics(column: pa.Array) -> np.ndarray:
    """One row of FEATURES numbers per text."""
    c = text_counts(column)
    w = words_of(column)
    n = np.maximum(c["n_words"], 1)
    size = np.maximum(np.diff(w.offsets), 1)
    chars = np.maximum(c["word_chars"], 1)
    share = lambda table: per_doc(table[w.data], w.offsets) / size
    hashes, doc = w.hashes(), w.doc_of()
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    key = hashes ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    upper_start = np.zeros(len(hashes), bool)
    upper_start[:] = _UPPER[w.data[w.start]] if len(hashes) else False
    columns = [
        np.log1p(c["n_words"]), c["word_chars"] / n, share(_UPPER), share(_DIGIT), c["n_symbols"] / chars, share(_BANG), share(_BAR), share(_STOP),
        share(_COMMA), share(_WIDE), c["n_repeat_words"] / n, c["n_dup_lines"] / np.maximum(c["n_lines"], 1), np.bincount(doc[first], minlength=w.docs) / n,
        per_doc(same, w.first) / n, np.log1p(c["n_words"] / np.maximum(c["n_lines"], 1)), per_doc(upper_start, w.first) / n,
    ]
    return np.stack([np.where(c["n_words"] > 0, x, 0.0) for x in columns], 1)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", CHUNK):
        x = statistics(part.column(1)).astype(np.float32)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, FEATURES), pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([part.column(0), rows], names=["doc_id", "x"])


def document_statistics(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_statistics, "doc_id long, x array<float>")


def remainder(doc_id="doc_id"):
    """crc32 of the id as text, modulo 3; rows of remainder 1 are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


class Fourier:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = rng.standard_normal((FEATURES, FOURIER)) / WIDTH
        self.b = rng.uniform(0, 2 * np.pi, FOURIER)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), np.sqrt(2 / FOURIER) * np.cos(z @ self.w + self.b)])


def solve(gram: np.ndarray, moment: np.ndarray) -> np.ndarray:
    penalty = RIDGE * np.eye(len(gram))
    penalty[0, 0] = 1e-6
    return np.linalg.solve(gram + penalty, moment)


def isotonic(count: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins; returns knots (mean bin, rate) for interpolation.

    Rates are drawn towards a half by the same small share in every block, which keeps their order.
    """
    blocks: list[list[float]] = []
    for k in np.flatnonzero(count):
        blocks.append([count[k], positive[k], k * count[k]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    x = np.array([b[2] / b[0] for b in blocks])
    return x, np.array([(1 - SHRINK) * b[1] / b[0] + SHRINK / 2 for b in blocks])


class Scorer:
    """Raw ridge score and its calibrated probability."""

    def __init__(self, fourier: Fourier, beta: np.ndarray, knots: tuple[np.ndarray, np.ndarray]):
        self.fourier, self.beta, self.knots = fourier, beta, knots

    def __call__(self, x: np.ndarray) -> np.ndarray:
        raw = self.fourier(x) @ self.beta
        at, rate = self.knots
        # the linear term keeps the order of scores inside a flat block
        return np.clip(0.999 * np.interp(bins(raw, False), at, rate) + 0.001 * np.clip(raw, 0, 1), 0.0, 1.0)


def bins(raw: np.ndarray, whole: bool = True) -> np.ndarray:
    at = np.clip((raw - LOW) / (HIGH - LOW), 0, 1) * (BINS - 1)
    return np.rint(at).astype(int) if whole else at


def fit(rows: DataFrame, target: str = "quality") -> Scorer | None:
    """Fit on rows (x, target 0..1, fold): three passes over the narrow statistics of all labelled rows."""
    rows = rows.select("x", F.col(target).cast("double").alias("y"), F.col("fold").cast("int"))

    def moments(batch, total):
        x = matrix(batch.column(0), FEATURES)
        total[0] += len(x)
        total[1 : FEATURES + 1] += x.sum(0)
        total[FEATURES + 1 :] += (x * x).sum(0)

    m = partition_sum(rows, moments, 1 + 2 * FEATURES)
    if not m[0]:
        return None
    mean = m[1 : FEATURES + 1] / m[0]
    fourier = Fourier(mean, np.sqrt(np.maximum(m[FEATURES + 1 :] / m[0] - mean**2, 1e-8)))
    d = FOURIER + 1

    def normal(batch, total):
        z, y, fold = fourier(matrix(batch.column(0), FEATURES)), np.asarray(batch.column(1)), np.asarray(batch.column(2))
        at = total.reshape(FOLDS, d, d + 1)
        for k in range(FOLDS):
            zk = z[fold == k]
            at[k, :, :d] += zk.T @ zk
            at[k, :, d] += zk.T @ y[fold == k]

    sums = partition_sum(rows, normal, FOLDS * d * (d + 1)).reshape(FOLDS, d, d + 1)
    whole = sums.sum(0)
    beta = solve(whole[:, :d], whole[:, d])
    without = np.stack([solve(whole[:, :d] - s[:, :d], whole[:, d] - s[:, d]) for s in sums])

    def counts(batch, total):
        z, y, fold = fourier(matrix(batch.column(0), FEATURES)), np.asarray(batch.column(1)), np.asarray(batch.column(2))
        at = bins((z * without[fold]).sum(1))
        total[:BINS] += np.bincount(at, minlength=BINS)
        total[BINS:] += np.bincount(at, y, minlength=BINS)

    c = partition_sum(rows, counts, 2 * BINS)
    return Scorer(fourier, beta, isotonic(c[:BINS], c[BINS:]))


def fit_on(stats: DataFrame, labels: DataFrame) -> Scorer | None:
    """Fit on the statistics of all labelled rows that are not held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("double").alias("quality")).filter("quality is not null and l_id is not null")
    marks = marks.filter(remainder("l_id") != 1).groupBy("l_id").agg(F.avg("quality").alias("quality"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS))
    train, path = materialize(stats.join(marks, F.col("doc_id") == F.col("l_id")).select("x", "quality", fold.alias("fold")), "train")
    scorer = fit(train)
    discard(stats.sparkSession, path)
    return scorer


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels of held-out rows are not learned."""
    stats, _ = materialize(document_statistics(docs), "quality")
    scorer = fit_on(stats, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), FEATURES)
            s = scorer(x) if scorer else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = stats.mapInArrow(score, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_quality(docs: DataFrame, labels: DataFrame, column: str = "text") -> DataFrame:
    """The rows of ``docs`` that are scored 0.5 or more, with all their columns.

    The fit reads narrow statistics; the filter computes them again in place, so
    that no text is shuffled.
    """
    scorer = fit_on(document_statistics(docs), labels)
    at = docs.columns.index(column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column, CHUNK):
            score = scorer(statistics(part.column(at)).astype(np.float32).astype(float)) if scorer else np.full(part.num_rows, 0.5)
            yield part.filter(pa.array(score >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
