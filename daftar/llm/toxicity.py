"""Toxicity as ordered severity: a cumulative-link (ordinal logistic) regression on sparse text features.

Labels say toxic or not; grades above 0 come from the data. Words that labelled
toxic texts use far more often than others are indicators, and a hash splits
them into two views. A toxic text's grade for one view's model is the tercile of
its indicator count in the other view, so no model learns a grade that was made
of its own features. In each model one weight vector is shared by all
thresholds; it gives the probability of each grade, the views' odds multiply, and
the severity is the expected grade.

Defined results: null and empty texts have no features and get the severity of
the intercepts alone; repeated labels of a document take the largest, repeated
rows are scored one by one; equal counts get equal grades, equal ranks of
indicators go by bucket; a very long text is a slice of its own and takes memory
in proportion to its length; without toxic labels every severity is 0; an empty
table stays empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import OUTSIDE
from .scratch import discard, materialize
from .sums import partition_sum
from .words import CHUNK, SpanHash, buffer, lowered, slices, split

#: Hash buckets of words, features kept in each half of them, grades (0 is not toxic), ridge.
BUCKETS, KEPT, GRADES, RIDGE = 1 << 18, 200, 4, 1.0
#: The fit takes at most so many labelled rows of each class, those of least hash: a bounded, documented sample.
SAMPLE = 8_000


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each lower-cased word, and the word edges of each text."""
    data, offsets = buffer(column)
    w = split(lowered(data), offsets, OUTSIDE)
    return (SpanHash(w.data)(w.start, w.end) >> np.uint64(64 - 18)).astype(np.int64), w.first


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", CHUNK):
        bucket, first = words(part.column(1))
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        pair, n = np.unique(doc * BUCKETS + bucket, return_counts=True)
        edges = np.searchsorted(pair, np.arange(len(first)) * BUCKETS)
        as_list = lambda x: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(x, pa.int32()))
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first), pa.int64()), as_list(pair % BUCKETS), as_list(n)], names=["toxic", "n_words", "bucket", "n"])


def indicators(count: np.ndarray, rows: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The KEPT buckets of one half whose document rate differs most between classes (signed log-likelihood root), and their sign."""
    rate = (count + 0.5) / (rows[:, None] + 1.0)
    pooled = (count.sum(0) + 0.5) / (rows.sum() + 1.0)
    g = sum(c * np.log(r / pooled) + (n - c) * np.log((1 - r) / (1 - pooled)) for c, r, n in zip(count, np.minimum(rate, 1 - 1e-9), rows, strict=True))
    signed = np.where(rate[1] > rate[0], 1, -1) * np.maximum(g, 0)
    signed[1 - half :: 2] = 0
    best = np.argsort(-np.abs(signed), kind="stable")[:KEPT]
    best = best[np.abs(signed[best]) > 8.0]
    return best, signed[best]


@dataclass
class View:
    """Indicator buckets of one half of the words, with their signs, and, once fitted, the model on them."""

    kept: np.ndarray
    sign: np.ndarray
    model: Ordinal | None = None
    prior: float = 0.0  # log odds of toxic rows in the fit

    def project(self, bucket: np.ndarray, n: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """log(1 + count) of the kept buckets and, last, of all that point to toxicity; one row per text."""
        column = np.full(BUCKETS, -1, np.int64)
        column[self.kept] = np.arange(len(self.kept))
        doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        at = column[bucket]
        use = at >= 0
        x = np.zeros((len(edges) - 1, len(self.kept) + 1))
        np.add.at(x, (doc[use], at[use]), n[use])
        x[:, -1] = x[:, :-1][:, self.sign > 0].sum(1)
        return np.log1p(x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Ordinal:
    """P(grade <= k) = sigmoid(theta_k - w x), theta increasing."""

    def __init__(self, theta: np.ndarray, w: np.ndarray):
        self.theta, self.w = theta, w

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        upto = _sigmoid(self.theta[None, :] - (x @ self.w)[:, None])
        return np.diff(np.hstack([np.zeros((len(x), 1)), upto, np.ones((len(x), 1))]), axis=1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, grades: int = GRADES, rounds: int = 400) -> Ordinal:
        """Gradient descent with momentum on the mean log-likelihood; thresholds are sums of exponentials; steps shrink over the second half."""
        share = np.clip(np.cumsum(np.bincount(y, weight, minlength=grades))[:-1] / weight.sum(), 1e-4, 1 - 1e-4)
        theta0 = np.log(share / (1 - share))
        raw = np.concatenate((theta0[:1], np.log(np.maximum(np.diff(theta0), 1e-2))))
        w = np.zeros(x.shape[1])
        scale = np.maximum(x.std(0), 1e-3)
        x = x / scale
        m1, m2 = np.zeros(len(raw) + len(w)), np.zeros(len(raw) + len(w))
        total = weight.sum()
        for t in range(1, rounds + 1):
            theta = np.concatenate((raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))))
            edge = np.concatenate(([-35.0], theta, [35.0]))
            eta = x @ w
            hi, lo = _sigmoid(edge[y + 1] - eta), _sigmoid(edge[y] - eta)
            hi, lo = np.where(y == grades - 1, 1.0, hi), np.where(y == 0, 0.0, lo)
            p = np.maximum(hi - lo, 1e-12)
            dh, dl = weight * hi * (1 - hi) / p, weight * lo * (1 - lo) / p
            gt = np.bincount(y, dh, minlength=grades)[: grades - 1] - np.bincount(y, dl, minlength=grades)[1:]
            graw = np.concatenate(([gt.sum()], [gt[k:].sum() * np.exp(raw[k]) for k in range(1, grades - 1)]))
            gw = -(x.T @ (dh - dl)) - RIDGE * w
            g = np.concatenate((graw, gw)) / total
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            rate = 0.1 * min(1.0, 2 * (1 - t / rounds))  # steps of one length would circle around the maximum
            step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
            raw, w = raw + step[: len(raw)], w + step[len(raw) :]
        theta = np.concatenate((raw[:1], raw[0] + np.cumsum(np.exp(raw[1:]))))
        return cls(theta, w / scale)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[View]:
    """The fitted views, from at most ``sample`` rows of each class; their ids (a bounded set) are broadcast to the scan."""
    marks = labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null and l_id is not null")
    marks = marks.groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    totals = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return []
    order = F.crc32(F.col("l_id").cast("string").cast("binary"))
    some = marks.filter("toxic = 0").orderBy(order, "l_id").limit(sample).unionAll(marks.filter("toxic = 1").orderBy(order, "l_id").limit(sample))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(some), F.col("doc_id") == F.col("l_id"))
    sparse, path = materialize(rows.select(F.col("toxic"), "text").mapInArrow(_sparse, "toxic int, n_words long, bucket array<int>, n array<int>"), "toxic")

    def tally(batch, total):
        toxic = np.asarray(batch.column(0))
        at = total[:-2].reshape(2, BUCKETS)
        size = np.diff(np.asarray(batch.column(2).offsets))
        each = np.repeat(toxic, size)
        bucket = np.asarray(batch.column(2).flatten())
        for k in (0, 1):
            at[k] += np.bincount(bucket[each == k], minlength=BUCKETS)
            total[-2 + k] += (toxic == k).sum()

    sums = partition_sum(sparse, tally, 2 * BUCKETS + 2)
    views = [View(*indicators(sums[:-2].reshape(2, BUCKETS), sums[-2:], half)) for half in (0, 1)]

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets = np.asarray(b.column(2).offsets).astype(np.int64)
            each = [v.project(np.asarray(b.column(2).flatten()), np.asarray(b.column(3).flatten()), offsets - offsets[0]) for v in views]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in np.hstack(each).astype(np.float32)], pa.binary())], names=["toxic", "x"])

    table = sparse.mapInArrow(narrow, "toxic int, x binary").toArrow()
    discard(docs.sparkSession, path)
    x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float32).reshape(-1, sum(len(v.kept) + 1 for v in views)).astype(float)
    toxic, (one, two) = table["toxic"].to_numpy(), np.split(x, [len(views[0].kept) + 1], axis=1)
    weight = np.where(toxic == 1, totals[1] / max((toxic == 1).sum(), 1), totals[0] / max((toxic == 0).sum(), 1))
    for view, own, other in ((views[0], one, two), (views[1], two, one)):
        if len(view.kept):
            view.model, view.prior = Ordinal.fit(own, grades(toxic, other[:, -1]), weight / weight.mean()), float(np.log(totals[1] / totals[0]))
    return [v for v in views if v.model]


def grades(toxic: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """0 for texts that are not toxic, else 1 to GRADES - 1 by the terciles of the evidence among toxic texts that have any."""
    some = evidence[(toxic == 1) & (evidence > 0)]
    cuts = np.quantile(some, np.arange(1, GRADES - 1) / (GRADES - 1)) if len(some) else np.full(GRADES - 2, np.inf)
    return np.where(toxic == 1, 1 + np.searchsorted(cuts, evidence, "left"), 0)


def together(views: list[View], each: list[np.ndarray]) -> np.ndarray:
    """Probabilities of the grades from those of the views: odds of being toxic multiply, as for independent views, and grades above 0 are averaged by them."""
    toxic = [np.clip(1 - p[:, 0], 1e-12, 1 - 1e-12) for p in each]
    odds = sum(np.log(t / (1 - t)) for t in toxic) - (len(views) - 1) * views[0].prior
    some = _sigmoid(odds)
    among = sum(t[:, None] * p[:, 1:] / np.maximum(p[:, 1:].sum(1, keepdims=True), 1e-12) for t, p in zip(toxic, each, strict=True)) / sum(toxic)[:, None]
    return np.hstack([(1 - some)[:, None], some[:, None] * among])


def severity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, severity (expected grade, 0 to GRADES - 1), grade (0, or the most likely one above if p_toxic >= 0.5), p_toxic, toxic for every document."""
    views = fit(docs, labels, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", CHUNK):
            p = np.zeros((part.num_rows, GRADES))
            p[:, 0] = 1
            if views:
                bucket, first = words(part.column(1))
                p = together(views, [v.model.probabilities(v.project(bucket, np.ones(len(bucket)), first)) for v in views])
            toxic = 1 - p[:, 0]
            grade = np.where(toxic >= 0.5, 1 + p[:, 1:].argmax(1), 0).astype(np.int32)
            columns = [part.column(0), pa.array(p @ np.arange(GRADES)), pa.array(grade), pa.array(toxic), pa.array(toxic >= 0.5)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return severity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
