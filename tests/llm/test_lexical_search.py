"""Ranked lexical search against scoring every document, with ties, odd rows, hash collisions and many blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from daftar.llm import lexical_search as ls

r = random.Random(8)
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORDS = [f"w{k}" for k in range(60)] + ["Éa", "漢", "ß9"]


def sentence(n):
    return " ".join(WORDS[min(int(r.expovariate(0.12)), len(WORDS) - 1)] for _ in range(n)) + "."


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_rank(docs, items, k=10):
    bags = [(d, Counter(plain_terms(t))) for d, t in docs]
    bags = [(d, c, sum(c.values())) for d, c in bags if c]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(x for _, c, _ in bags for x in c)
    out = []
    for i, t in {(i, t) for i, t in items if t is not None}:
        scores = []
        for d, c, n in bags:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1_000_000_000 * c[x]) // (1000 * c[x] + 8 * m)) for x in plain_terms(t) if c[x])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(i, p + 1, None if none else d, -s) for p, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(x) for x in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize(("shard", "fan", "block", "parts"), [(8 << 20, 32, 4 << 20, 1), (600, 3, 4 << 20, 3), (3000, 2, 60, 2)])
def test_equals_scoring_every_document(spark, monkeypatch, shard, fan, block, parts):
    for name, value in (("SHARD", shard), ("FAN", fan), ("BLOCK_BYTES", block)):
        monkeypatch.setattr(ls, name, value)
    docs = [(k, sentence(r.choice((1, 3, 8, 20, 60)))) for k in range(150)]
    docs += [(200 + k, docs[k % 7][1]) for k in range(40)]  # equal scores at the edge of the ten
    r.shuffle(docs)
    docs += [(500, None), (501, ""), (502, "?!"), (None, docs[3][1]), (7, docs[7][1]), (7, docs[7][1]), (503, "W1 " * 5000)]
    items = [(k, sentence(r.choice((1, 2, 12, 30)))) for k in range(8)] + [(8, None), (9, ""), (10, "nowhere"), (None, "w1 w2"), (11, "w3 w3 w3 w4"), (11, "w3 w3 w3 w4"), (12, docs[0][1])]
    table = spark.createDataFrame([(d, t, 1, 2, "q") for d, t in docs], "doc_id long, text string, score int, rank int, query string").repartition(parts)
    queries = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, doc_id int")
    assert got(ls.rank(table, queries)) == plain_rank(docs, items)
    assert got(ls.rank(table, queries, 3)) == plain_rank(docs, items, 3)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a")], "item_id string, text string")
    assert got(ls.rank(docs, items)) == [("x", 1, 1, plain_rank([(1, "a b")], [("x", "a")])[0][3])]
    assert got(ls.rank(docs.limit(0), items)) == [] == got(ls.rank(docs, items.limit(0)))
    assert got(ls.rank(docs.selectExpr("doc_id", "' ' as text"), items)) == []


def test_one_index_serves_many_searches(spark):
    docs = [(k, sentence(20)) for k in range(60)]
    index, _ = ls.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    for n in range(2):
        items = [(n, sentence(9))]
        assert got(ls.search(index, spark.createDataFrame(items, "item_id long, text string"))) == plain_rank(docs, items)


def test_ranges_below_the_bound_stay_closed(monkeypatch):
    n = 4096
    docs = np.arange(n)
    trees = ls.Trees(np.zeros(n, np.int64), docs, np.where(docs == 77, 900, docs % 5 + 1), n)
    best, opened = ls.Best(1), []
    best.ids = list(range(n))
    offer = best.offer
    monkeypatch.setattr(best, "offer", lambda s, d: (opened.append(d), offer(s, d)))
    trees.search(np.zeros(1, np.int64), np.ones(1, np.int64), best)
    assert best.heap == [(900, True, -77)] and len(opened) <= ls.FAN
    assert [len(x[0]) for x in trees.levels] == [4096, 128, 4, 1]


def test_words_with_one_hash(monkeypatch):
    def collide(self, start, end):
        return np.minimum(end - start, 2).astype(np.uint64)

    monkeypatch.setattr(ls.SpanHash, "__call__", collide)
    texts = ["aa bb cc aa ddd", "cc zz", "", "bb bb"]
    row = ls.inverted(pa.record_batch([pa.array([0, 1, 2, 3], pa.int64()), pa.array(texts)], names=["doc_id", "text"]))
    keys, words, ends, starts, docs, counts = (np.frombuffer(row[k][0].as_buffer(), kind) for k, kind in ((2, np.uint64), (3, np.uint8), (4, np.int32), (5, np.int32), (6, np.int32), (7, np.int32)))
    v = ls.Vocabulary([("i", "zz cc q aa bb ddd xx")])
    found = v.find(keys, words, ends)
    held = {v.words[k].decode(): sorted(zip(docs[starts[f] : starts[f + 1]].tolist(), counts[starts[f] : starts[f + 1]].tolist(), strict=True)) for k, f in enumerate(found) if f >= 0}
    assert held == {"aa": [(0, 2)], "bb": [(0, 1), (3, 2)], "cc": [(0, 1), (1, 1)], "ddd": [(0, 1)], "zz": [(1, 1)]}


def test_large_rows_are_held_a_few_at_a_time(spark):
    """Shards are rows of megabytes: no row group holds many, so neither does a task that writes or reads them."""
    import pyarrow.parquet as pq

    from daftar.llm.scratch import materialize

    rows = spark.range(0, 40, 1, 1).selectExpr("id", "encode(array_join(transform(sequence(1, 16384), x -> sha2(concat(id, '-', x), 256)), ''), 'utf-8') as blob")
    kept, path = materialize(rows, "large", large_rows=True)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in kept.inputFiles()]
    assert sum(m.num_rows for m in files) == 40 and max(m.row_group(g).num_rows for m in files for g in range(m.num_row_groups)) <= 17
    index, _ = ls.build_index(spark.range(3).selectExpr("id as doc_id", "'a b' as text"))
    one = pq.ParquetFile(index.inputFiles()[0].removeprefix("file://")).metadata.row_group(0)
    assert not any("DICTIONARY" in e for c in range(one.num_columns) for e in one.column(c).encodings)
