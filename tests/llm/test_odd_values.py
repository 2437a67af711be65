"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, with the values that come out."""

import hashlib
import random

import pytest

from daftar.llm import decontaminate, ngram_join, quality_rules, sentencepiece_bpe, substring_dedup
from tests.llm.test_kernels import brute_hits
from tests.llm.test_operators import links
from tests.llm.test_rule_fences import plain_counts

r = random.Random(11)
WORDS = [f"w{i}" for i in range(400)]
PASSAGE = " ".join(WORDS[:40])
VERY_LONG = " ".join(r.choice(WORDS) for _ in range(60_000))
TEXTS = [
    (1, PASSAGE), (1, PASSAGE), (2, PASSAGE + " tail"), (3, None), (4, ""), (None, PASSAGE), (5, "a b"), (6, "A B"), (7, "x" * 200_000), (8, VERY_LONG), (9, VERY_LONG + " " + PASSAGE),
    (10, " \n\t "), (11, "é" * 13 + " " + PASSAGE), (2, "other text of the same id " + PASSAGE),
]
#: Names that the operators use themselves.
NAMES = "key long, id string, n int, label int, a int, b int, place int, rid string, keys array<int>, words array<string>, least int, runs int, items string, spans int, starts int, n_tokens string, ids int, hashes int, block int, probe int, window int, segment int, class_id int, w_doc int, w_id int"
ODD = ["doc_id", "text"], (7, "i", 1, 2, 3, 4, 5, "r", [1], ["w"], 6, 7, "x", 8, 9, "t", 10, 11, 12, 13, 14, 15, 16, 17, 18)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, *ODD[1]) for d, t in TEXTS], f"doc_id long, text string, {NAMES}")


def rows(df, *columns):
    return sorted((tuple(x[c] for c in columns) for x in df.collect()), key=str)


def test_ngram_join(docs):
    named = [(d if d is not None else 10**9, t or "") for d, t in TEXTS]
    order = sorted(range(len(named)), key=lambda i: named[i][0])
    root = dict(zip(order, links([named[i][1] for i in order]), strict=True))
    want = []
    for i, (d, t) in enumerate(TEXTS):
        w = (t or "").lower().split()
        n = len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) if len(w) >= 5 else int(bool(w))
        least = named[order[root[i]]][0]
        want.append((d, n, d if not n else least))
    assert rows(ngram_join.near_duplicates(docs), "doc_id", "n_shingles", "component_id") == sorted(want, key=str)
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0 == ngram_join.keep_one(docs.limit(0)).count()
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns and rows(kept, "key", "label") == [(7, 2)] * kept.count()


def test_rules_count(docs):
    some = docs.selectExpr("*", "'en' as lang", "'s' as source")
    want = [(d, c[0], c[1], c[2], c[4], c[5]) for d, t in TEXTS for c in [plain_counts(t)]]
    assert rows(quality_rules.quality_rules(some), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == sorted(want, key=str)


def test_tokens(docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    public = pytest.importorskip("public_tokenizers")
    sp = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    want = [(d, len(i), i, sp.decode(i)) for d, t in TEXTS for i in [sp.encode(t or "")]]
    assert rows(sentencepiece_bpe.encode(docs), "doc_id", "n_tokens", "ids", "decoded") == sorted(want, key=str)
    out = sentencepiece_bpe.encode_rows(docs)
    assert rows(out, "doc_id", "n_tokens", "ids", "text") == sorted(want, key=str) and rows(out, "label") == [(2,)] * len(TEXTS)
    assert sentencepiece_bpe.encode(docs.limit(0)).count() == 0 == sentencepiece_bpe.encode_rows(docs.limit(0)).count()


def test_repeats(docs):
    first = {}
    for d, t in TEXTS:
        w = (t or "").split()
        for k in range(len(w) - 12):
            if d is not None:
                key = tuple(w[k : k + 13])
                first[key] = min(first.get(key, d), d)
    want = []
    for d, t in TEXTS:
        w = (t or "").split()
        gone = set()
        for k in range(len(w) - 12):
            if d is not None and first[tuple(w[k : k + 13])] < d:
                gone.update(range(k, k + 13))
        left = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest(), left))
    got = rows(substring_dedup.remove_repeats(docs, with_text=True), "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")
    assert got == sorted(want, key=str) and sum(x[2] for x in got) > 60_000
    assert substring_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_contamination(spark, docs):
    items = [(1, PASSAGE), (1, PASSAGE), (2, "a b"), (3, None), (None, "xx yy"), (4, "")]
    bench = spark.createDataFrame([(*x, 1, "t") for x in items], "item_id int, text string, doc_id int, items string")
    want = brute_hits(TEXTS, [("null" if i is None else str(i), t) for i, t in items])
    assert rows(decontaminate.decontaminate(docs, bench), "doc_id", "n_words", "n_hit", "items") == sorted(want, key=str)
    assert all(not x[2] for x in rows(decontaminate.decontaminate(docs, bench.limit(0)), "doc_id", "n_words", "n_hit"))
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not (n and 20 * n >= w) for _, w, n, _ in want)
