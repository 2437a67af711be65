"""Classifier and severity against plain numpy, held-out rows, and the pipeline against brute force."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from daftar.llm import pii, quality_classifier, toxicity
from tests.llm.test_kernels import brute_hits
from tests.llm.test_operators import links
from tests.llm.test_rule_fences import plain_counts

SF = "/root/testdata/sf0.001"
have = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain_statistics(text):
    text = text or ""
    n, chars, symbols, lines, dup, repeat = plain_counts(text)
    if not n:
        return [0.0] * 16
    words, raw = re.findall(r"[^\x20\x09-\x0D]+", text), text.encode()
    share = lambda test: sum(test(b) for b in raw) / len(raw)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        np.log1p(n), chars / n, share(lambda b: 65 <= b <= 90), share(lambda b: 48 <= b <= 57), symbols / chars, share(lambda b: b in b"!?"), share(lambda b: b == 124), share(lambda b: b == 46),
        share(lambda b: b in b",;:"), share(lambda b: b >= 128), repeat / n, dup / max(lines, 1), len(set(words)) / n, same / n, np.log1p(n / max(lines, 1)), sum("A" <= w[0] <= "Z" for w in words) / n,
    ]


def test_statistics_equal_plain_ones():
    r = random.Random(4)
    texts = [None, "", " \n", "A b. C! c c\nA b. C! c c\n"] + ["".join(r.choice("aB c\n.,|!9é#") for _ in range(r.randint(0, 300))) for _ in range(60)]
    assert np.allclose(quality_classifier.statistics(pa.array(texts)), [plain_statistics(t) for t in texts])


def plain_scores(texts, train, target, fold):
    """Scores of all texts from a ridge on random features of the rows ``train``, calibrated on rows left out of their fold."""
    q = quality_classifier
    x = np.array([plain_statistics(t) for t in texts]).astype(np.float32).astype(float)
    some = x[train]
    fourier = q.Fourier(some.mean(0), np.sqrt(np.maximum((some**2).mean(0) - some.mean(0) ** 2, 1e-8)))
    z, every = fourier(some), fourier(x)

    def ridge(rows):
        penalty = q.RIDGE * np.eye(z.shape[1])
        penalty[0, 0] = 1e-6
        return np.linalg.solve(z[rows].T @ z[rows] + penalty, z[rows].T @ target[rows])

    left_out = np.zeros(len(some))
    for k in range(q.FOLDS):
        left_out[fold == k] = z[fold == k] @ ridge(fold != k)
    place = lambda raw: np.clip((raw - q.LOW) / (q.HIGH - q.LOW), 0, 1) * (q.BINS - 1)
    bins = np.rint(place(left_out)).astype(int)
    at = np.unique(bins)
    count, positive = np.array([(bins == b).sum() for b in at]), np.array([target[bins == b].sum() for b in at])
    # isotonic regression by its max-min formula
    fit = np.array([max(min(positive[i : j + 1].sum() / count[i : j + 1].sum() for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))])
    knots, rates = [], []
    for v in dict.fromkeys(fit):
        knots.append((at * count)[fit == v].sum() / count[fit == v].sum()), rates.append((1 - q.SHRINK) * v + q.SHRINK / 2)
    raw = every @ ridge(np.ones(len(some), bool))
    return np.clip(0.999 * np.interp(place(raw), knots, rates) + 0.001 * np.clip(raw, 0, 1), 0, 1)


def scored(spark, docs):
    """(plain scores, labels) of the rows of ``docs``, by doc_id."""
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = docs.orderBy("doc_id").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"), F.pmod(F.xxhash64("doc_id"), F.lit(4)).alias("fold")).collect()
    train = [i for i, r in enumerate(rows) if r["h"] % 3 != 1 and quality.get(r["doc_id"]) is not None]
    scores = plain_scores([r["text"] for r in rows], train, np.array([float(quality[rows[i]["doc_id"]]) for i in train]), np.array([rows[i]["fold"] for i in train]))
    return {r["doc_id"]: s for r, s in zip(rows, scores, strict=True)}


@have
def test_scores_equal_plain_numpy_and_no_held_out_label_is_read(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r for r in quality_classifier.classify(docs, labels).collect()}
    want = scored(spark, docs)
    assert all(abs(got[d]["score"] - s) < 1e-6 and got[d]["predicted"] == (got[d]["score"] >= 0.5) for d, s in want.items())
    flipped = labels.withColumn("quality", F.when(quality_classifier.remainder() == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality_classifier.classify(docs, flipped).collect()}
    assert again == {d: r["score"] for d, r in got.items()}


def test_isotonic_keeps_order_whatever_the_counts():
    r = np.random.default_rng(1)
    count = r.choice([1, 3, 1000], 60).astype(float)
    positive = np.minimum(np.floor(count * np.linspace(0.2, 1, 60) + r.random(60)), count)
    x, y = quality_classifier.isotonic(count, positive)
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()
    x, y = quality_classifier.isotonic(np.array([1000.0, 1.0]), np.array([999.0, 1.0]))
    assert y[0] < y[1]


def test_odd_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "good text", 5), (1, "good text", 5), (None, None, 5), (2, "", 5)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted([tuple(r) for r in quality_classifier.classify(docs, none).collect()], key=str)
    assert [(r[0], r[2], r[3]) for r in got] == [(1, 0.5, 1), (1, 0.5, 1), (2, 0.5, 1), (None, 0.5, 1)]
    assert {(r["doc_id"], r["severity"], r["grade"], r["toxic"]) for r in toxicity.severity(docs, none).collect()} == {(1, 0.0, 0, False), (None, 0.0, 0, False), (2, 0.0, 0, False)}
    marks = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 0, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for f in (quality_classifier.classify, toxicity.severity):
        rows = [tuple(r) for r in f(docs, marks).collect()]
        assert len(rows) == 4 and sum(r == x for r in rows for x in rows if x[0] == 1 and r[0] == 1) == 4  # repeated rows get equal results
        assert f(docs.limit(0), marks).count() == 0


@have
def test_severity_of_held_out_rows(spark):
    """Half of the labels fit; on the other half toxic texts stand out, and more of their words mean more severity."""
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    views = toxicity.fit(docs, labels.filter("doc_id % 2 = 0"))
    assert all((v.kept % 2 == k).all() for k, v in enumerate(views)) and len(views) == 2
    rows = toxicity.severity(docs, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("mark")), "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    mark, severity = np.array([r["mark"] for r in rows]), np.array([r["severity"] for r in rows])
    ranks = severity.argsort().argsort()
    n1, n0 = mark.sum(), (1 - mark).sum()
    assert (ranks[mark == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * n0) > 0.95
    assert np.mean([r["toxic"] for r in rows if r["mark"] == 1]) > 0.85 and np.mean([r["toxic"] for r in rows if not r["mark"]]) < 0.015
    assert {r["grade"] for r in rows if r["mark"]} >= {1, 2, 3} and all((r["grade"] > 0) == r["toxic"] for r in rows)
    bad = re.compile(r"\b(?:trash|pathetic|idiot|disgusting|worthless|stupid|clown|loser|scum|moron)\b")
    hits = np.array([len(bad.findall(r["text"].lower())) for r in rows])
    some = (mark == 1) & (hits > 0)
    assert np.corrcoef(hits[some].argsort().argsort(), severity[some].argsort().argsort())[0, 1] > 0.5


def test_ordinal_fit_is_at_a_maximum():
    r = np.random.default_rng(2)
    x = r.random((500, 3))
    y = np.digitize(x @ [1.0, -0.5, 0] + 0.3 * r.standard_normal(500), [0.0, 0.3, 0.6])
    weight = np.ones(500)
    m = toxicity.Ordinal.fit(x, y, weight, rounds=3000)

    def value(theta, w):
        p = toxicity.Ordinal(theta, w).probabilities(x)[np.arange(500), y]
        return np.log(p).sum() - toxicity.RIDGE / 2 * ((w * x.std(0)) ** 2).sum()

    best = value(m.theta, m.w)
    for k in range(6):
        for step in (-0.05, 0.05):
            theta, w = m.theta.copy(), m.w.copy()
            if k < 3:
                theta[k] += step
            else:
                w[k - 3] += step
            assert value(theta, w) <= best + 1e-3


@have
def test_pipeline_equals_brute_force(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    public = pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scores = scored(spark, docs)
    kept = [r for r in docs.orderBy("doc_id").collect() if scores[r["doc_id"]] >= 0.5]
    kept = [r for i, (r, k) in enumerate(zip(kept, links([r["text"] for r in kept]), strict=True)) if k == i]
    items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {d for d, n, hit, _ in brute_hits([(r["doc_id"], r["text"]) for r in kept], items) if hit and 20 * hit >= n}
    kept = [r for r in kept if r["doc_id"] not in dirty]
    assert dirty and len(kept) < len(scores)
    private = {r["doc_id"]: r["text"] for r in pii.pseudonymize(spark.createDataFrame(kept, docs.schema)).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {r["doc_id"] for r in kept}
    for r in kept:
        out, ids = got[r["doc_id"]], sp.encode(private[r["doc_id"]])
        assert (out["ids"], out["n_tokens"], out["text"]) == (ids, len(ids), sp.decode(ids))
        assert (out["lang"], out["source"], out["n_chars"]) == (r["lang"], r["source"], len(private[r["doc_id"]]))


def test_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    text = " ".join(f"word{k}" for k in range(60))
    schema = "doc_id long, text string, lang string, source string, n_chars long, ids string, key string, a int, label long, rid int"
    rows = [(1, text, "en", "s", 9, "i", "k", 1, 2, 3), (1, text, "en", "s", 9, "i", "k", 1, 2, 3), (2, text + " more", None, None, None, None, None, None, None, None), (None, None, "en", "s", 0, "i", "k", 1, 2, 3), (3, "", "en", "s", 0, "i", "k", 1, 2, 3), (4, "x " * 30_000, "de", "t", 0, "i", "k", 1, 2, 3)]
    for k, some in enumerate((rows, [])):
        at = tmp_path / str(k)
        spark.createDataFrame(some, schema).write.parquet(f"file://{at}/documents.parquet")
        spark.createDataFrame([(1, 1, 0)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"file://{at}/labels.parquet")
        spark.createDataFrame([(1, "word3 word4 word5 word6"), (2, None)] if some else [], "item_id long, text string").write.parquet(f"file://{at}/benchmark.parquet")
        out = sorted(((r["doc_id"], r["n_tokens"], len(r["ids"]), r["key"], r["rid"]) for r in corpus_pipeline.run(spark, f"file://{at}").collect()), key=str)
        # one of the repeated and near texts, less those with the benchmark's words; null and empty texts have no tokens
        assert [(r[0], r[1] == r[2], r[3], r[4]) for r in out] == ([(3, True, "k", 3), (4, True, "k", 3), (None, True, "k", 3)] if some else [])
