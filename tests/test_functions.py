"""Normalisers, cleaners and scalar functions on rows written by hand."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from daftar.functions import normalize as N
from daftar.functions import packs
from daftar.functions import text as T
from daftar.functions.regexjs import js

SAMPLES = [
    "الْبَلَاغَةُ", "أإآٱا", "ى ة ؤ ئ", "كـتـاب", "ﻻ", "١٢٣ 45", "نص آخر", "‏ديوان‎ المتنبي", "Arabic كتاب Book", "", "  ", None, "ديوان (الشعر)، ط.1", "A_b-c", "ٱلحمد", "مجموعة؛ شعر: قصائد",
]


def column(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r[1:]) if len(exprs) > 1 else r[1] for r in sorted(df.select("i", *exprs).collect())]


@pytest.mark.parametrize("name", sorted(N.PROFILES))
def test_native_profile_equals_python_twin(spark, name):
    p = N.PROFILES[name]
    assert column(spark, SAMPLES, N.normalize(F.col("t"), p)) == [N.py_normalize(v, p) for v in SAMPLES]


@pytest.mark.parametrize("name", sorted(N.PROFILES))
@settings(max_examples=40, deadline=None)
@given(text=st.text(alphabet="اأإآٱبةىيؤئوـًَُِؐ a Bz9_-.،؛() ‏", max_size=30))
def test_normalising_twice_changes_nothing(name, text):
    p = N.PROFILES[name]
    once = N.py_normalize(text, p)
    assert N.py_normalize(once, p) == once


def test_search_profile_drops_latin_and_blanks_tatweel():
    assert N.py_normalize("Book كتـاب", N.SEARCH) == "كت اب"
    assert N.py_normalize("كتـاب", N.IMPORT) == "كتاب"
    assert N.py_normalize("مكتبة Book!", N.CATALOG_TITLE) == "مكتبة book!"


def test_ascii_word_boundary_never_fires_in_arabic(spark):
    got = column(spark, ["12 ديوان x", "12 pdf x"], F.regexp_replace("t", js(r"^\d+\s+(?=ديوان\b)"), ""), F.regexp_replace("t", js(r"^\d+\s+(?=pdf\b)"), ""))
    assert got == [("12 ديوان x", "12 ديوان x"), ("12 pdf x", "pdf x")]


def test_no_break_space_is_white_space(spark):
    assert column(spark, ["a ﻿b "], N.squeeze(F.col("t"))) == ["a b"]


def test_arabic_tests_differ_in_what_is_visible(spark):
    rows = ["ديوان abcdefgh", "ديوان", "دی وان گل", "abc دار"]
    assert column(spark, rows, T.arabic_text(F.col("t")), T.arabic_share_title(F.col("t"))) == [(True, False), (True, True), (False, True), (True, False)]
    assert column(spark, ["كتاب", "كتابان", "كتابان abcdef"], T.arabic_title(F.col("t"))) == [False, True, False]


def test_titles_are_cleaned(spark):
    rows = ["12345_ديوان المتنبي pdf", "كتاب pdf ديوان", "ديوان أبي تمام اقرأ اونلاين pdf", "—— ديوان", "ديوان [1234] --- نسخة"]
    assert column(spark, rows, T.clean_title(F.col("t"))) == ["ديوان المتنبي", "ديوان", "ديوان أبي تمام", "ديوان", "ديوان"]
    assert column(spark, ["ديوان المتنبي تحقيق فلان"], T.canonical_diwan_title(F.col("t"))) == ["ديوان المتنبي"]
    assert column(spark, ["1234 كتاب النحو word", "book النحو"], T.canonical_archive_title(F.col("t"))) == ["النحو", "النحو"]
    assert column(spark, ["رسالة_في_النحو.PDF", "❀ عنوان ❀"], T.clean_telegram_title(F.col("t"))) == ["رسالة في النحو", "عنوان"]
    assert column(spark, ['"أحمد" (شاعر) 1990-2000', "علي، 1950"], T.clean_person(F.col("t"))) == ["أحمد", "علي"]


def test_keys(spark):
    assert column(spark, ["https://x.org/a// ", None], T.url_key(F.col("t"))) == ["https://x.org/a", ""]
    assert column(spark, ["https://t.me/Arsail2020/15/", "https://t.me/other/15"], T.telegram_post_key(F.col("t"))) == ["15", None]
    titles = ["نحو وصرف", "a&b c"]
    assert column(spark, titles, T.parse_search_url(T.search_url(F.col("t")))) == titles
    assert column(spark, ["00012_x", "12345 عنوان", "123 x", "12345"], T.catalog_identifier(F.col("t")), T.shown_title(F.col("t"))) == [("00012", "x"), ("12345", "عنوان"), (None, "123 x"), ("12345", "12345")]
    assert len(column(spark, ["x"], T.stable_id(F.col("t")))[0]) == len("ddl-title-") + 18


def test_fnv1a_vectors(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h

    rows = ["", "a", "foobar", "ديوان"]
    assert column(spark, rows, T.fnv1a(F.col("t"))) == [fnv(r) for r in rows]


def test_nested_json_is_flattened(spark):
    rows = [json.dumps(["a", {"text": "b"}, ["c"]]), '"d"', "plain", None]
    assert column(spark, rows, T.flatten_json(F.col("t"))) == ["a b c", "d", "plain", ""]


def test_identity_and_tokens(spark):
    df = spark.createDataFrame([("ديوان احمد بن شوقي", "احمد شوقي"), ("كتاب", ""), ("ديوان البحر", "احمد شوقي")], "t string, a string")
    assert [r[0] for r in df.select(T.identity(F.col("t"), F.col("a"))).collect()] == ["poet-diwan::احمد شوقي", "work::كتاب::author-unavailable", "work::ديوان البحر::احمد شوقي"]


def test_truncated_titles(spark):
    assert column(spark, ["قصير", "دراسة طويلة بما يكفي في", "دراسة طويلة بما يكفي هنا"], T.truncated_title(F.col("t"))) == [True, True, False]


def test_all_patterns_compile(spark):
    patterns = [p for pack in (packs.TITLES, packs.LITERATURE, packs.GRAMMAR, packs.RHETORIC, packs.DIWAN, packs.UPLOAD, packs.MERGE, packs.REFINE) for p in pack.values()]
    df = spark.createDataFrame([("نص",)], "t string")
    assert df.select(*(T.test(F.col("t"), p).alias(f"c{i}") for i, p in enumerate(patterns))).count() == 1


@pytest.mark.parametrize("name", ["latin", "search", "import", "refine"])
def test_all_but_kept_letters_take_one_pass(spark, name):
    """A pass over the text with a match for each blank took most of a query's time."""
    p = N.PROFILES[name]
    odd = ["a  b\t c﻿ d", "\U0001f600x\U0001d54f9\x00é\x0b", " 　", "", None, "كتاب ١ 7‏", "A-_[]^b\\c", "ǅİI"]
    assert column(spark, odd, N.normalize(F.col("t"), p)) == [N.py_normalize(v, p) for v in odd]
    if name == "latin":
        plan = spark.createDataFrame([("a",)], "t string").select(N.normalize(F.col("t"), p).alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.splitlines()[0].count("regexp_replace(") == 1, plan
