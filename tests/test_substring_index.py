"""The substring index equals a scan, and reads only the folders of the trigrams that are asked for."""

import random

import pytest

from daftar.operators.substring_index import SubstringIndex, grams_of

r = random.Random(4)
PARTS = ["ka", "to", "mi", "é", "漢字", "😀", " ", "ru"]
TEXTS = ["".join(r.choice(PARTS) for _ in range(r.choice((0, 1, 2, 10, 60)))) for _ in range(250)] + [None, "", "ka", "kat", "needle in it", "x" * 5000 + "needle"]


@pytest.fixture(scope="module")
def index(spark):
    rows = spark.createDataFrame([(k, t, "g") for k, t in enumerate(TEXTS)], "doc long, text string, gram string").repartition(3)
    return rows, SubstringIndex.build(rows, "doc", "text")


@pytest.mark.parametrize("tokens", [["needle"], ["kato"], ["kato", "mi"], ["漢字漢"], ["😀é", "to"], ["ka"], ["é"], ["nowhere"], ["kat", "zzz"], [], ["x" * 50], ["needle", "in it"]])
def test_equals_a_scan(index, tokens):
    rows, made = index
    got = sorted(x["doc"] for x in made.search(rows, "doc", "text", tokens).collect())
    assert got == [k for k, t in enumerate(TEXTS) if (t is not None or not tokens) and all(x in (t or "") for x in tokens)]


def test_reads_the_folders_of_its_trigrams_only(index):
    rows, made = index
    read, every = made.bytes_read(["needle"])
    assert 0 < read < every / 2
    plan = made.of("nee")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(gram,nee)" in plan
    assert made.rarest_first(["kato", "needle"])[0] in grams_of("needle") and made.rarest_first(["qqq"]) is None


def test_empty_table(index):
    rows, _ = index
    made = SubstringIndex.build(rows.limit(0), "doc", "text")
    assert made.search(rows.limit(0), "doc", "text", ["needle"]).count() == 0
