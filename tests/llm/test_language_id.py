"""Language ID: plain n-gram counts, held-out accuracy, what may be learned from, and odd rows."""

import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from daftar.llm import language_id as li

SF = "/root/testdata/sf0.001"
r = random.Random(3)
SYLLABLES = {"aa": ["ka", "to", "mi", "ru", "sen"], "bb": ["schl", "ung", "ver", "ei", "acht"], "cc": ["ость", "при", "на", "ко", "ват"], "dd": ["漢", "字", "文", "書", "語"]}


def text(lang, words=30):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(words)) + "."


def table(spark, n=160):
    rows = [(k, text(lang), lang) for k, lang in ((k, r.choice(sorted(SYLLABLES))) for k in range(n))]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def plain_grams(t):
    """Counts of n-grams of code points, 0 for what is between words."""
    codes = [0]
    for c in (t or "").lower():
        if c.isalpha():
            codes.append(ord(c))
        elif codes[-1]:
            codes.append(0)
    if codes[-1]:
        codes.append(0)
    if codes == [0]:
        return Counter()
    grams = Counter()
    for n in range(1, 4):
        for k in range(len(codes) - n + 1):
            if n > 1 or codes[k]:
                grams[tuple(codes[k : k + n])] += 1
    return grams


def place(gram):
    key = sum((c + 1) * int(li._STEPS[k]) for k, c in enumerate(gram)) % (1 << 64)
    return int(li.mix(np.array([key], np.uint64))[0] % np.uint64(li.SIZE))


def test_counts_equal_plain_ones():
    texts = ["", None, "a", "Ab c", "  x!!y  ", "12 ?", "É'ß\n\n漢字 語", text("aa"), text("cc", 200)]
    counts, some = li.counted(texts)
    for k, t in enumerate(texts):
        want = np.zeros(li.SIZE)
        for gram, n in plain_grams(t).items():
            want[place(gram)] += n
        assert np.array_equal(counts[k], want) and some[k] == any(c.isalpha() for c in t or "")


def test_model_equals_a_plain_nearest_centroid(spark):
    rows, docs = table(spark)
    train = [(d, t, x) for d, t, x in rows if zlib.crc32(str(d).encode()) % 3 != 1]
    model = li.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    df = Counter(p for _, t, _ in train for p in {place(g) for g in plain_grams(t)})
    assert np.allclose(model.idf, [math.log((1 + len(train)) / (1 + df[p])) + 0.1 for p in range(li.SIZE)], atol=1e-5)
    assert np.allclose(np.linalg.norm(model.c, axis=1), 1, atol=1e-5)
    got = {x["doc_id"]: x for x in li.predict(docs, model).collect()}
    for d, t, _ in rows:
        v = np.zeros(li.SIZE)
        for p, n in sum((Counter({place(g): n}) for g, n in plain_grams(t).items()), Counter()).items():
            v[p] = (1 + math.log(n)) * model.idf[p]
        cosine = model.c @ (v / np.linalg.norm(v))
        assert got[d]["lang_pred"] == model.langs[model.lang_of[int(cosine.argmax())]]
        assert got[d]["known"] == (cosine.max() >= model.least[int(cosine.argmax())])


def test_held_out_rows_teach_nothing_and_are_found(spark):
    rows, docs = table(spark, 240)
    held = [d for d, _, _ in rows if zlib.crc32(str(d).encode()) % 3 == 1]
    out = {x["doc_id"]: x for x in li.identify(docs).collect()}
    wrong = docs.withColumn("lang", F.when(F.col("doc_id").isin(held), "zz").otherwise(F.col("lang")))
    again = {x["doc_id"]: x for x in li.identify(wrong).collect()}
    assert [x["held_out"] for _, x in sorted(out.items())] == [d in held for d in sorted(out)]
    assert all((out[d]["lang_pred"], round(out[d]["score"], 9)) == (again[d]["lang_pred"], round(again[d]["score"], 9)) for d in out)
    assert sum(out[d]["lang_pred"] == x for d, _, x in rows if d in held) == len(held)
    assert all(0 <= x["score"] <= 1 for x in out.values())


def test_foreign_texts_are_rejected(spark):
    rows, docs = table(spark, 240)
    odd = spark.createDataFrame([(1000 + k, "".join(chr(r.randint(0x10A0, 0x10F0)) for _ in range(60))) for k in range(20)], "doc_id long, text string")
    model = li.fit(docs)
    assert li.predict(odd, model).filter("known").count() == 0
    assert li.predict(odd, model).filter("lang_pred = 'und'").count() == 0
    assert li.predict(docs, model).filter("not known").count() < 12


def test_a_register_of_its_own_gets_a_centroid_and_outliers_none():
    def unit(x):
        return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)

    g = np.random.default_rng(2)
    two = unit(np.concatenate((g.normal(0, 0.05, (60, 40)) + np.eye(40)[0], g.normal(0, 0.05, (40, 40)) + np.eye(40)[1], np.eye(40)[[30]])))
    c = li.spherical(two)
    assert len(c) >= 2 and (c @ two[0]).max() > 0.9 and (c @ two[70]).max() > 0.9 and (c @ two[-1]).max() < 0.5
    assert len(li.spherical(unit(np.ones((5, 8))))) == 1


def test_odd_rows(spark):
    long = text("bb", 60_000)
    rows = [(1, text("aa"), "aa"), (1, text("aa"), "aa"), (2, text("bb"), "bb"), (3, None, "aa"), (4, "", "bb"), (5, "12 !?", "aa"), (None, text("aa"), "aa"), (6, text("bb"), None), (7, long, "bb"), (8, "k", None)]
    docs = spark.createDataFrame([(d, t, x, "k", 1, 0.5, b"") for d, t, x in rows], "doc_id long, text string, lang string, lang_pred string, place int, draw double, x binary")
    got = sorted(((x["doc_id"], x["lang_pred"]) for x in li.identify(docs).collect()), key=str)
    assert got == sorted([(1, "aa"), (1, "aa"), (2, "bb"), (3, "und"), (4, "und"), (5, "und"), (None, "aa"), (6, "bb"), (7, "bb"), (8, "aa")], key=str)
    assert li.identify(docs.limit(0)).count() == 0
    untaught = li.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(x["lang_pred"], x["score"], x["known"]) for x in untaught} == {("und", 0.0, False)}


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(li, "LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        li.fit(table(spark)[1])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_accuracy_on_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
