"""Throttling by pointers, interval joins and as-of joins against plain loops: hot keys, ties, empty and endless intervals, nulls."""

import random

import pytest

from daftar.operators.temporal import as_of, interval_join
from daftar.streaming import telemetry

r = random.Random(17)


def loop(rows, gap):
    last, kept = {}, []
    for key, ms, i in sorted(rows, key=lambda x: (x[1], x[2])):
        if key not in last or ms - last[key] >= gap:
            last[key] = ms
            kept.append(i)
    return sorted(kept)


@pytest.mark.parametrize(("keys", "gap"), [([7], 500), ([1, 2, None, 3], 40), ([7], 1)])
def test_throttle_equals_the_loop(spark, keys, gap):
    rows = [(r.choice(keys), r.randrange(0, 20_000, 10), i) for i in range(1500)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, ms long, id long").selectExpr("k", "timestamp_millis(ms) as ts", "id", "'x' as key", "1 as next").repartition(5)
    assert sorted(x["id"] for x in telemetry.throttle(df, "k", "ts", "id", gap).collect()) == loop(rows, gap)


def test_throttle_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (1, 5, 2), (2, 5, 3), (1, 5, 4)], "k long, ms long, id long").selectExpr("k", "timestamp_millis(ms) as ts", "id")
    assert sorted(x["id"] for x in telemetry.throttle(df, "k", "ts", "id").collect()) == [2, 3]
    assert telemetry.throttle(df.limit(0), "k", "ts", "id").count() == 0
    with pytest.raises(ValueError, match="gap"):
        telemetry.throttle(df, "k", "ts", "id", 0)


def test_interval_join_equals_comparing_all(spark):
    points = [(r.choice(["a", "b", None]), r.randrange(-3000, 3000), i) for i in range(300)] + [("a", None, 900)]
    intervals = []
    for i in range(200):
        s = r.randrange(-3000, 3000)
        intervals.append((r.choice(["a", "a", "b", None]), s, s + r.choice([-4, 0, 1, 2, 3, 64, 65, 1000, 2**40]), i))
    intervals += [("a", None, 5, 900), ("b", 5, None, 901), ("a", -(2**62), 2**62, 902)]
    a, b = spark.createDataFrame(points, "k string, t long, p long"), spark.createDataFrame(intervals, "k string, s long, e long, i long")
    joined = interval_join(a, b, ["k"], "t", "s", "e")
    want = sorted((p, i) for k, t, p in points for q, s, e, i in intervals if k is not None and k == q and None not in (t, s, e) and s <= t < e)
    assert sorted((x["p"], x["i"]) for x in joined.collect()) == want and len(want) > 500
    assert "CartesianProduct" not in (plan := joined._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    assert interval_join(a, b.limit(0), ["k"], "t", "s", "e").count() == 0 == interval_join(a.limit(0), b, ["k"], "t", "s", "e").count()


@pytest.mark.parametrize("keys", [["hot"], ["a", "b", "c", None]])
def test_as_of_equals_the_loop(spark, keys):
    left = [(r.choice(keys), r.choice([None, *range(60)]), i) for i in range(300)]
    right = [(r.choice(keys), r.choice([None, *range(0, 60, 7)]), i, f"v{i}") for i in range(80)]
    a, b = spark.createDataFrame(left, "k string, t long, p long").repartition(3), spark.createDataFrame(right, "k string, u long, o long, v string")
    got = {x["p"]: (x["t"], x["v"], x["o"]) for x in as_of(a, b, ["k"], "t", "u", ["v", "o"], "o").collect()}
    for k, t, p in left:
        fit = [(u, o, v) for q, u, o, v in right if k is not None and q == k and t is not None and u is not None and u <= t]
        u, o, v = max(fit) if fit else (None, None, None)
        assert got[p] == (t, v, o)
    assert len(got) == len(left) and as_of(a, b.limit(0), ["k"], "t", "u", ["v"], "o").filter("v is not null").count() == 0


def test_points_are_dealt_not_gathered_in_the_driver(spark):
    """A point counts once for each length of interval, which Spark's estimate for a broadcast leaves out."""
    a, b = spark.range(3, 4).selectExpr("'a' as k", "id as t"), spark.range(1, 2).selectExpr("'a' as k", "id as s", "id + 4 as e")
    joined = interval_join(a, b, ["k"], "t", "s", "e")
    assert joined.count() == 1 and "Broadcast" not in joined._jdf.queryExecution().toString()
