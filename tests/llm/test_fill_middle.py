"""Fill-in-middle against a plain version: offsets of every rank, draws, marks, and texts rebuilt from the outputs."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tokenizers")
from daftar.llm import fill_middle as fm  # noqa: E402

r = random.Random(5)
ALPHABET = "ab \n\r\t\x00é́ßΩ‍漢😀👩🏽 �"
TEXTS = ["", "x", "😀", "<", "<P", "S>", "a<S>b", "<M>", "<P><S><M>", "<<P", "é" * 127, "é" * 128, "é" * 129, "ab\n" * 3000] + ["".join(r.choice(ALPHABET) for _ in range(r.choice((1, 2, 5, 63, 64, 65, 200, 4095, 4096, 4097, 9000)))) for _ in range(60)]


def plain(doc_id, text):
    text = text or ""
    n = len(text)
    g = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(g[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    x, y, z = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}"


def test_every_rank_has_the_offset_of_its_code_point():
    offsets = fm.Offsets()
    for text in TEXTS:
        ranks = offsets.of(text)
        assert ranks.n == len(text)
        assert [ranks[k] for k in range(ranks.n + 1)] == list(range(len(text) + 1))


def test_units_of_several_code_points():
    ranks = fm.Offsets(r"\w+\s*|[^\w]+").of("one two, three " * 100)
    assert ranks.n == 400 and [ranks[k] for k in (0, 1, 2, 3, 4, 400)] == [0, 4, 7, 9, 15, 1500]


def test_transform_equals_the_plain_version(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(k, "some text, long enough to be cut " * 3) for k in range(100, 400)] + [(None, "abc"), (None, None), (7, None), (100, "again"), (100, "again")]
    docs = spark.createDataFrame([(d, t, 9, "f", "o") for d, t in rows], "doc_id long, text string, n int, form string, drawn_0 string").repartition(3)
    out = fm.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "drawn_0", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = [tuple(x) for x in out.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", fm.restored().alias("back")).collect()]
    assert sorted(got, key=str) == sorted(((d, t, *plain(d, t), t or "") for d, t in rows), key=str)
    assert {x[3] for x in got} == {"plain", "psm", "spm"}
    assert out.filter("drawn_0 = 'o'").count() == len(rows)
    assert fm.fill_in_middle(docs.limit(0)).count() == 0


def test_other_seeds_and_columns(spark):
    docs = spark.createDataFrame([(k, "t" * 50) for k in range(200)], "doc_id long, body string")
    one, two = (fm.fill_in_middle(docs, seed=s, column="body") for s in (1, 2))
    assert one.join(two.select("doc_id", F.col("output").alias("other")), "doc_id").filter("output != other").count() > 100


def test_very_long_text(spark):
    text = "".join(r.choice(ALPHABET) for _ in range(500_000))
    docs = spark.createDataFrame([(k, text) for k in range(4)], "doc_id long, text string")
    assert [tuple(x) for x in fm.fill_in_middle(docs).orderBy("doc_id").select("n", "form", "prefix_chars", "middle_chars", "output").collect()] == [plain(k, text) for k in range(4)]
