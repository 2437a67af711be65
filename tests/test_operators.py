"""Joins, aggregates, ordering, greedy deduplication and rules."""

import random

import pytest
from pyspark.sql import functions as F

from daftar.functions import packs
from daftar.functions.normalize import REFINE, normalize
from daftar.operators import aggregates as agg
from daftar.operators import filters, joins, near, ordering, rules
from daftar.operators.dedup import greedy


def test_anti_join_ignores_empty_keys_and_batches_keep_their_own_duplicates(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "")], "id string, url string")
    b = spark.createDataFrame([("3", ""), ("3", ""), ("4", "x"), ("1", "y")], "id string, url string")
    keys = {"id": F.col("id"), "url": F.col("url")}
    assert sorted(r[0] for r in joins.prioritized_union([a, b], [{}, keys]).collect()) == ["1", "2", "3", "3"]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def allowed(n, adaptive):
    return None if n < 18 else (3 if n >= 42 else 2 if n >= 25 else 1) if adaptive else 2


@pytest.mark.parametrize("adaptive", [False, True])
def test_near_pairs_lose_nothing(spark, adaptive):
    r = random.Random(5)
    base = ["".join(r.choice("abcd") for _ in range(n)) for n in (17, 18, 24, 25, 30, 41, 42, 60)]
    titles = []
    for b in base:
        for _ in range(6):
            t = list(b)
            for _ in range(r.randint(0, 4)):
                k = r.randrange(len(t))
                t[k : k + 1] = r.choice([[], ["x"], [t[k], "y"]])
            titles.append("".join(t))
    df = spark.createDataFrame(list(enumerate(titles)), "id long, t string")
    got = {(x[0], x[1], x[2]) for x in near.near_pairs(df, df, "id", "id", "t", adaptive).collect()}
    want = {(i, j, d) for i, a in enumerate(titles) for j, b in enumerate(titles) if (k := allowed(len(a), adaptive)) and (d := levenshtein(a, b)) <= k}
    assert got == want


def loop(rows, adaptive=False):
    seen, out = ({}, {}), []
    kept = []
    for o, a, b in rows:
        near = any((k := allowed(len(b), adaptive)) and levenshtein(b, t) <= k for t in kept)
        dup = (a and a in seen[0]) or (b and b in seen[1]) or near
        if not dup:
            kept.append(b)
            if a:
                seen[0][a] = o
            if b:
                seen[1][b] = o
        out.append((o, not dup))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_equals_the_plain_loop(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice(["", *"pqrstuvwxyz"]), r.choice(["", "short", "abcdefghijklmnopqr", "abcdefghijklmnopqx", "abcdefghijklmnoyyx", "zzzzzzzzzzzzzzzzzzzz", "zzzzzzzzzzzzzzzzzyyy"]) + r.choice(["", "", "q"])) for i in range(40)]
    df = spark.createDataFrame(rows, "ord long, a string, t string")
    got = greedy(df, {"a": F.col("a"), "t": F.col("t")}, "t").select("ord", "kept").collect()
    assert sorted(map(tuple, got)) == loop(rows)


def test_greedy_settles_a_long_chain(spark):
    """Every row shares one key with the next: they alternate, and pointers double."""
    rows = [(i, f"k{i // 2}", f"m{(i + 1) // 2}") for i in range(300)]
    df = spark.createDataFrame(rows, "ord long, a string, b string").repartition(3)
    got = {r["ord"]: (r["kept"], r["reason"]) for r in greedy(df, {"a": F.col("a"), "b": F.col("b")}).collect()}
    assert got == {i: (True, None) if i % 2 == 0 else (False, "a") for i in range(300)}


def test_greedy_of_a_hot_key_and_of_short_titles(spark):
    """All rows of one key but the first go in one round; a title that is too short looks at no other, but longer ones look at it."""
    short, long = "abcdefghijklmnopq", "abcdefghijklmnopqr"
    rows = [(i, "hot", f"t{i}") for i in range(400)] + [(400, "p", short), (401, "q", short), (402, "r", long), (403, "s", short)]
    got = {r["ord"]: r["reason"] for r in greedy(spark.createDataFrame(rows, "ord long, a string, t string"), {"a": F.col("a")}, "t").collect()}
    assert got == {0: None, **dict.fromkeys(range(1, 400), "a"), 400: None, 401: None, 402: "near", 403: None}


@pytest.mark.parametrize("seed", range(2))
def test_greedy_reasons_on_random_graphs(spark, seed):
    r = random.Random(seed)
    rows = [(i, *(r.choice(["", *(f"{c}{n}" for n in range(60))]) for c in "abc")) for i in range(200)]
    df = spark.createDataFrame(rows, "ord long, a string, b string, c string").repartition(4)
    seen, want = ({}, {}, {}), {}
    for o, *own in rows:
        reason = next((k for k, v, s in zip("abc", own, seen, strict=True) if v and v in s), None)
        want[o] = reason
        if reason is None:
            for v, s in zip(own, seen, strict=True):
                s[v] = o
    got = {x["ord"]: x["reason"] for x in greedy(df, {k: F.col(k) for k in "abc"}).collect()}
    assert got == want


def test_near_links_count_rows_that_are_not_paired(spark):
    base = "abcdefghijklmnopqrstuvwxyz"
    titles = [base] * 5 + [base + "x"] * 3 + ["short"] * 4 + [base[:20] + "0123456"] + [None, ""]
    df = spark.createDataFrame(list(enumerate(titles)), "id long, t string")
    pairs, links = near.near_links(df, "id", "t", True)
    assert sorted(map(tuple, pairs.collect())) == [(0, 5, 1), (5, 0, 1)]
    assert sorted(map(tuple, links.collect())) == [(i, 0, 5, 7) for i in range(5)] + [(i, 5, 3, 7) for i in range(5, 8)] + [(i, 8, 4, 0) for i in range(8, 12)] + [(12, 12, 1, 0)]


def test_titles_of_one_stem_meet_by_what_differs(spark):
    """A stem that all titles share is looked up by none: candidates follow the rest."""
    stem = "the proceedings of the society for the study of everything "
    titles = [f"{stem}{k * 7919 % 100003:05d}{k * 104729 % 999983:06d}{k * 611953 % 99991:05d}" for k in range(400)]
    df = spark.createDataFrame(list(enumerate(titles)), "id long, t string")
    compact = [t.replace(" ", "") for t in titles]
    want = {(i, j) for i, a in enumerate(compact) for j, b in enumerate(compact) if i != j and sum(x != y for x, y in zip(a, b, strict=True)) < 12 and levenshtein(a, b) <= 3}
    got = {(r["left_class"], r["right_class"]) for r in near.near_links(df, "id", "t", True)[0].collect()}
    assert got == want


def test_greedy_is_not_transitive(spark):
    df = spark.createDataFrame([(0, "x", "1"), (1, "x", "2"), (2, "y", "2")], "ord long, a string, b string")
    assert [r["kept"] for r in greedy(df, {"a": F.col("a"), "b": F.col("b")}).orderBy("ord").collect()] == [True, False, True]


def test_keep_best_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("k", 1, 0), ("k", 5, 1), ("k", 5, 2)], "key string, score int, ord int")
    assert agg.keep_best(df, ["key"], "score").collect()[0]["ord"] == 1


def test_last_wins_keeps_the_first_place(spark):
    df = spark.createDataFrame([("a", "x", 0), ("b", "y", 1), ("a", "z", 2)], "id string, v string, ord int")
    assert sorted(tuple(r) for r in agg.last_wins(df, "id", "ord").select("id", "v", "ord").collect()) == [("a", "z", 0), ("b", "y", 1)]


@pytest.mark.parametrize(("rows", "id_", "author"), [
    ([("a", "أحمد", "الجامع"), ("b", "علي", "Internet Archive")], "b", "علي"), ([("a", "أحمد", "Internet Archive"), ("b", "علي", "الجامع")], "a", "أحمد"),
    ([("a", "أحمد", "الجامع"), ("b", "مجهول", "Internet Archive")], "b", "أحمد"), ([("a", "مجهول", "الجامع"), ("b", "علي", "الجامع")], "a", "مجهول"),
])
def test_merge_author_rule(spark, rows, id_, author):
    df = spark.createDataFrame([("k", i, "t", a, s, "u", None, None, k) for k, (i, a, s) in enumerate(rows)], "identity string, id string, title string, author string, source string, sourceUrl string, volumes int, pages int, ord int")
    r = agg.merge_identity(df).collect()[0]
    assert (r["id"], r["author"], r["sourceCount"], len(r["mergedIds"])) == (id_, author, 1, 2)


def test_facets_exclude_their_own_choice(spark):
    df = spark.createDataFrame([("x", "1"), ("x", "2"), ("y", "1")], "a string, b string")
    got = {tuple(r) for r in agg.facet_counts(df, {"a": "x", "b": "9"}).collect()}
    assert got == {("a", "x", 0), ("b", "1", 1), ("b", "2", 1), ("b", "9", 0)}


def test_pages_are_clamped_and_cover_everything(spark):
    df = spark.range(25).withColumnRenamed("id", "ord")
    pages = [ordering.page(df, k, "ord") for k in (1, 2, 3, 9)]
    assert [p.number for p in pages] == [1, 2, 3, 3] and pages[0].count == 3
    assert sorted(r[0] for p in pages[:3] for r in p.rows.collect()) == list(range(25))
    assert ordering.page(df.limit(0), 5, "ord").number == 1


def test_row_numbers_are_total(spark):
    rows = ordering.row_numbers(spark.range(0, 1000, 7).repartition(5), "id").collect()
    assert [r["row_number"] for r in sorted(rows)] == list(range(len(rows)))


def test_query_without_arabic_letters_matches_everything(spark):
    df = spark.createDataFrame([("كتاب النحو",), ("ديوان",)], "k string")
    hits = lambda q: df.filter(filters.tokens_and(F.col("k"), q)).count()
    assert (hits("النَّحو كتاب"), hits("book!"), hits("")) == (1, 2, 2)


def test_thesis_signals(spark):
    df = spark.createDataFrame([("النحو في القران",), ("ازالة الشعر بالليزر",), ("القانون المدني",), ("الشعر والقانون",)], "t string")
    assert [r[0] for r in df.select(rules.thesis_signals(F.col("t"))[0]).collect()] == [6, -10, -10, -10]


def test_rules_with_teh_marbuta_are_dead_on_folded_text(spark):
    # the fold turns the last letter to heh, so this signal never fires (kept as it is)
    df = spark.createDataFrame([("البلاغة العربية",)], "t string")
    assert df.select(rules.thesis_signals(F.col("t"))[0]).collect()[0][0] == 0


def test_short_stem_matches_inside_words(spark):
    df = spark.createDataFrame([("خطب العرب",)], "t string")
    from daftar.functions.text import test as matches

    assert df.select(matches(F.col("t"), packs.LITERATURE["excluded_topic"])).collect()[0][0]


def test_version_four_never_gives_eight(spark):
    df = spark.createDataFrame([(rules.EVIDENCE[1],)], "e string")
    s = lambda v4: rules.diwan_score(F.col("e"), F.lit(""), F.lit(""), F.lit(""), F.array().cast("array<string>"), v4)
    assert tuple(df.select(s(False).alias("a"), s(True).alias("b")).collect()[0]) == (8, 6)


def test_merge_reasons(spark):
    rows = [("Title", "x"), ("ديوان فارسي", "x"), ("شرح ديوان المتنبي", "x"), ("نص عربي كامل", "مجهول"), ("ديوان المتنبي", "المتنبي")]
    df = spark.createDataFrame(rows, "t string, a string")
    assert [r[0] for r in df.select(rules.merge_reason(F.col("t"), F.col("a"), F.lit(""))).collect()] == [*rules.MERGE_REASONS, None]


def test_risk_flags_collect_all_labels(spark):
    df = spark.createDataFrame([("دراسة الجزء الأول pdf",)], "t string")
    assert len(df.select(rules.risk_flags(normalize(F.col("t"), REFINE))).collect()[0][0]) == 3


def test_fixed_counts_show_zeros(spark):
    df = spark.createDataFrame([("a",), ("a",)], "k string")
    assert sorted(tuple(r) for r in agg.fixed_counts(df, "k", ["a", "b"]).collect()) == [("a", 2), ("b", 0)]


def test_every_of_nothing_is_true(spark):
    df = spark.createDataFrame([], "x boolean")
    assert tuple(df.agg(agg.every(F.col("x")), agg.some(F.col("x"))).collect()[0]) == (True, False)


def test_grams_are_dealt_not_gathered_in_the_driver(spark):
    """Spark takes the grams of a title for one row when it chooses what to broadcast."""
    titles = near.classes(near.members(spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz"), (2, "abcdefghijklmnopqrstuvwxy")], "id long, t string"), "id", "t"))
    pairs = near.near_classes(titles, titles, True)
    assert pairs.count() == 4 and "Broadcast" not in pairs._jdf.queryExecution().toString()


def test_greedy_deals_groups_and_reasons(spark):
    df = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz"), (2, "abcdefghijklmnopqrstuvwxy"), (3, "a")], "ord long, t string")
    out = greedy(df, {"t": F.col("t")}, "t")
    assert {r["ord"]: r["kept"] for r in out.collect()} == {1: True, 2: False, 3: True}
    last = [j for j in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in j][0]
    assert "strategy=merge" in last, last


def shuffled_rows(df):
    """Rows that the exchanges of ``df`` wrote when it was collected."""
    df.collect()
    nodes, total = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            nodes.append(node.plan())
        else:
            total += node.metrics().get("shuffleRecordsWritten").get().value() if kind == "ShuffleExchangeExec" else 0
            nodes += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_letters_of_long_titles_are_not_shuffled(spark):
    r = random.Random(8)
    titles = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1000)) for _ in range(100)]
    titles += [t[:500] + "-" + t[501:] for t in titles[:10]] + ["\U0001f4d6كتاب" * 9, "\U0001f4d6كتاب" * 8 + "\U0001f4d6كتب"]
    rows = near.classes(near.members(spark.createDataFrame(list(enumerate(titles)), "id long, t string"), "id", "t"))
    pairs = near.near_classes(rows, rows, True)
    assert shuffled_rows(pairs) < 10_000
    met = {(i, 100 + i) for i in range(10)} | {(110, 111)}
    assert {(r["left_class"], r["right_class"]) for r in pairs.filter("distance = 1").collect()} == met | {(j, i) for i, j in met}


def test_the_square_of_a_title_spreads_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 16, raising=False)
    title = "the history of the river and its towns"
    rows = [(i, title) for i in range(150)] + [(None, title), (None, title)] + [(200 + i, title + "s") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, t string")
    pairs = near.near_pairs(df, df, "id", "id", "t", True)
    ids = [i for i, _ in rows]
    got = sorted(map(str, pairs.collect()))
    assert got == sorted(f"Row(left_id={a}, right_id={b}, distance={int((x < 152) != (y < 152))})" for x, a in enumerate(ids) for y, b in enumerate(ids))
    tasks = [n for n in pairs.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert len(tasks) > 1 and max(tasks) < sum(tasks) / 2, tasks
