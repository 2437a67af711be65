"""Word hashes: no collisions by construction, and right results where a hash does collide."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from daftar.llm import decontaminate, ngram_join, quality_rules, words
from tests.llm.test_kernels import Value, brute_hits


def thue_morse(n):
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 256, 1024, 2048, 4096])
def test_words_that_collide_in_polynomials(n):
    a, b = thue_morse(n)
    w = words.words_of(pa.array([f"{a} {b} {a}"]))
    h = w.hashes()
    assert h[0] != h[1] and h[0] == h[2]
    assert quality_rules.text_counts(pa.array([f"{a}\n{b}\n"]))["n_dup_lines"].tolist() == [0]
    one, two = ngram_join.shingle_sets(pa.array([" ".join([a] * 5), " ".join([b] * 5)]))
    assert not len(np.intersect1d(one, two))


def test_equal_compares_bytes():
    data = np.frombuffer(("x" * 300 + "x" * 299 + "y" + "x" * 300 + "abcdefgh" + "abcdefgi").encode(), np.uint8)
    s = words.SpanHash(data)
    at = lambda *pairs: tuple(np.array(x) for x in zip(*pairs, strict=True))
    left, right = at((0, 300), (0, 300), (900, 908), (0, 3), (5, 5)), at((300, 600), (600, 900), (908, 916), (0, 4), (9, 9))
    assert s.equal(*left, s, *right).tolist() == [False, True, False, False, True]


@pytest.fixture
def colliding(monkeypatch):
    """Every hash is one of three."""
    monkeypatch.setattr(words.SpanHash, "__call__", lambda self, start, end: ((end - start) % 3).astype(np.uint64))


def test_tokenizer_survives_collisions(colliding):
    sentencepiece = pytest.importorskip("sentencepiece")
    public = pytest.importorskip("public_tokenizers")
    from daftar.llm.sentencepiece_bpe import Codec, Model

    path = public.path("piece_bpe_32k.model")
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), Codec(Model(path))
    r = random.Random(3)
    texts = ["".join(r.choice("abet n\né") for _ in range(r.randint(0, 50))) for _ in range(200)]
    for k in range(0, 200, 20):
        ids, edges = c.encode(pa.array(texts[k : k + 20]))
        assert [x.decode() for x in c.listed(ids, edges)] == [",".join(map(str, sp.encode(t))) for t in texts[k : k + 20]]


@pytest.mark.parametrize("n", [1024, 4096])
def test_tokenizer_on_long_words(n):
    sentencepiece = pytest.importorskip("sentencepiece")
    public = pytest.importorskip("public_tokenizers")
    from daftar.llm.sentencepiece_bpe import Codec, Model

    path = public.path("piece_bpe_32k.model")
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), Codec(Model(path))
    for t in thue_morse(n):
        ids, edges = c.encode(pa.array([t]))
        assert ids.tolist() == sp.encode(t)


def test_tokenizer_on_very_long_units():
    sentencepiece = pytest.importorskip("sentencepiece")
    public = pytest.importorskip("public_tokenizers")
    import time

    from daftar.llm.sentencepiece_bpe import Codec, Model

    path = public.path("piece_bpe_32k.model")
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), Codec(Model(path))
    r = random.Random(5)
    texts = ["".join(r.choice(letters) for _ in range(n)) for letters in ("abcdefghijklmnopqrstuvwxyz", "ab", "aeé𝄞x") for n in (1999, 2001, 5000)] + ["a" * 9000, "short"]
    ids, edges = c.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [sp.encode(t) for t in texts]
    seconds = []
    for n in (40_000, 160_000):
        text = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        began = time.process_time()
        got = c.encode(pa.array([text]))[0].tolist()
        seconds.append(time.process_time() - began)
        assert got == sp.encode(text)
    assert seconds[1] < 8 * seconds[0]


@pytest.mark.parametrize("seed", range(4))
def test_phrases_survive_collisions(colliding, seed):
    r = random.Random(seed)
    vocabulary = ["a", "b", "cd", "d1", "abcd", "zzzz"]
    items = [(str(i), " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 3, 13, 14])))) for i in range(5)]
    docs = [(i, " ".join(r.choice([*vocabulary, "yyyy", "q"]) for _ in range(40)) + " " + r.choice(items)[1]) for i in range(20)]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs], pa.string())], names=["doc_id", "text"])
    blocks = [Value(decontaminate.Phrases([(i, t.encode()) for i, t in items]))]
    got = [(x["doc_id"], x["n_words"], x["n_hit"], x["items"]) for o in decontaminate._scan(blocks, False)(iter([batch])) for x in o.to_pylist()]
    assert got == brute_hits(docs, items)


def test_many_blocks_equal_one(spark, monkeypatch):
    r = random.Random(7)
    vocabulary = [f"v{i}" for i in range(6)]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    bench = spark.createDataFrame([(i, say(r.choice([2, 13, 15]))) for i in range(8)] + [(9, None)], "item_id int, text string")
    texts = [say(r.randint(0, 40)) + " zz " * r.randint(0, 200) for _ in range(30)]
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (5, texts[5]), (40, None), (41, "")], "doc_id long, text string")
    rows = lambda df: sorted(df.collect(), key=str)
    one, kept = rows(decontaminate.decontaminate(docs, bench, True)), rows(decontaminate.drop_contaminated(docs, bench))
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    monkeypatch.setattr(decontaminate, "AT_ONCE", 2)
    assert rows(decontaminate.decontaminate(docs, bench, True)) == one and any(r["n_hit"] for r in one)
    assert rows(decontaminate.drop_contaminated(docs, bench)) == kept and len(kept) < len(texts)


def test_contaminated_texts_are_compared_beyond_one_pass(spark, monkeypatch):
    """With many blocks and one hash for all texts only contaminated texts go."""
    texts = [(k, " ".join(f"t{k}x{j}" for j in range(30))) for k in range(12)] + [(40, None), (41, "")]
    bench = spark.createDataFrame([(k, texts[k][1]) for k in (0, 3, 7)], "item_id int, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 10)
    monkeypatch.setattr(decontaminate, "AT_ONCE", 2)
    monkeypatch.setattr(decontaminate.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    docs = spark.createDataFrame([(*x, 1, "b") for x in texts], "doc_id int, text string, bad_hash int, bad_text string")
    got = decontaminate.drop_contaminated(docs, bench)
    assert got.columns == docs.columns and sorted(x["doc_id"] for x in got.collect()) == [1, 2, 4, 5, 6, 8, 9, 10, 11, 40, 41]
