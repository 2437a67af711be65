"""Registered queries over whole tables, against brute force and their SQL."""

import pytest

from daftar.plans.queries import QUERIES

TITLES = ["the history of the river and its towns", "the history of the river and its town", "das buch der lieder und der anderen dinge", "das buch der lieder und der andern dinge", "short", "short", "el libro de las canciones", "x" * 400, "x" * 399 + "y", "une histoire de la riviere", "the history of the river and its towns", "une histoire de la rivieres"]


@pytest.fixture
def small(spark, tmp_path):
    rows = [(k, t + "\nrest of it", "en fr de es".split()[k % 4], f"s{k % 2}", 100 + k) for k, t in enumerate(TITLES)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def pairs(adaptive):
    t = [x.replace(" ", "") for x in TITLES]
    most = lambda n: (3 if n >= 42 else 2 if n >= 25 else 1) if adaptive else 2
    return {(i, j) for i, a in enumerate(t) for j, b in enumerate(t) if i != j and len(a) >= 18 and distance(a, b) <= most(len(a))}


@pytest.mark.parametrize("name", ["fixed", "adaptive"])
def test_near_titles_of_all_documents(spark, small, name):
    got = {(r["left_id"], r["right_id"]) for r in QUERIES[f"near_title_pairs_{name}"](spark, small).collect()}
    assert got == pairs(name == "adaptive") and (2, 3) in got and (7, 8) in got


@pytest.mark.parametrize("name", ["fixed", "adaptive"])
def test_pairs_of_one_title_are_made_by_many_tasks(spark, tmp_path, monkeypatch, name):
    from daftar.operators import near

    monkeypatch.setattr(near, "BLOCK", 16, raising=False)
    rows = [(k, "the history of the river and its towns\nrest of it", "en", "s", k) for k in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES[f"near_title_pairs_{name}"](spark, str(tmp_path))
    tasks = [n for n in got.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect() if n]
    assert sum(tasks) == 200 * 199 and len(tasks) > 1 and max(tasks) < sum(tasks) / 2, tasks


def test_greedy_takes_near_titles(spark, small):
    near, kept = pairs(False), []
    for i, t in enumerate(TITLES):
        if not any(TITLES[j] == t or (i, j) in near for j in kept):
            kept.append(i)
    assert sorted(r["doc_id"] for r in QUERIES["greedy_dedup"](spark, small).filter("kept").collect()) == kept


def test_duplicate_groups_without_a_cap(spark):
    from daftar.operators import aggregates

    df = spark.createDataFrame([("a", k) for k in range(120)] + [("b", 500)], "key string, ord long")
    got = aggregates.duplicate_groups(df, "key", [], most=None).collect()
    assert [(r["key"], r["n"], [x["ord"] for x in r["records"]]) for r in got] == [("a", 120, list(range(120)))]


def test_duplicate_members_are_all_listed(spark, tmp_path):
    spark.createDataFrame([(k, "same") for k in range(120)] + [(500, "other")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r["doc_id"] for r in QUERIES["duplicate_group_members"](spark, str(tmp_path)).collect()) == list(range(120))
    assert [r["n"] for r in QUERIES["duplicate_group_counts"](spark, str(tmp_path)).collect()] == [120]


def test_keys_take_the_whole_text(spark, tmp_path):
    spark.createDataFrame([(k, f"same line\nother {k}", "en", "s", 20) for k in range(4)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert run("duplicate_count")[0]["duplicates"] == 0 and len(run("keep_best_score")) == 4
    assert {r["tag"]: r["n"] for r in run("tag_explode_counts")} == {"same": 4, "line": 4, "other": 4, "0": 1, "1": 1, "2": 1, "3": 1}


def test_collisions_with_rows_of_any_id_are_found(spark, tmp_path):
    rows = [(k, f"text {k % 500}", "en", "s", k) for k in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(500, 1000)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert QUERIES["anti_two_keys"](spark, str(tmp_path)).count() == 0
    tally = QUERIES["collision_tally"](spark, str(tmp_path)).first()
    assert (tally["by_title"], tally["by_chars"], tally["any_key"], tally["no_key"]) == (500, 0, 500, 0)
