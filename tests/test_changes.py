"""Counts that follow changes, and a cursor feed that is stopped and planned again."""

import random

import pytest
from pyspark.sql import functions as F

from daftar.plans.incremental import Counts
from daftar.sources.paged import CursorStreamReader

r = random.Random(2)


def counted(rows):
    out = {}
    for a, b in rows:
        for key in (("a", a), ("b", b), *([("category", "both")] if a == b else [])):
            if key[1] is not None or key[0] != "category":
                out[key] = out.get(key, 0) + 1
    return out


def test_counts_equal_a_full_recount(spark):
    counts = Counts(spark, ("a", "b"), {"both": F.col("a") == F.col("b")})
    frame = lambda rows: spark.createDataFrame(rows, "a string, b string")
    now = []
    for n in range(1, 6):
        came = [(r.choice("xyz"), r.choice(["x", "y", None])) for _ in range(40)]
        went = [now.pop(r.randrange(len(now))) for _ in range(min(len(now), 25))]
        now += came
        counts.apply(n, frame(came), frame(went) if went else None)
        counts.apply(n, frame(came))  # a change that is repeated counts once
        assert {(x["dimension"], x["value"]): x["n"] for x in counts.table().collect()} == counted(now)
    with pytest.raises(ValueError, match="follows"):
        counts.apply(9, frame([("x", "x")]))
    plan = counts.table()._jdf.queryExecution().toString()
    assert "LocalTableScan" not in plan  # only the counts are read


def test_counts_follow_a_stream(spark, tmp_path):
    rows = [(a, b, "insert") for a, b in [("x", "x"), ("x", "y"), ("z", "y")]] + [("x", "y", "retract")]
    for k in range(4):
        spark.createDataFrame(rows[k : k + 1], "a string, b string, change string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    counts = Counts(spark, ("a", "b"), {"both": F.col("a") == F.col("b")})
    stream = spark.readStream.schema("a string, b string, change string").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(counts.follow).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    assert {(x["dimension"], x["value"]): x["n"] for x in counts.table().collect()} == counted([("x", "x"), ("z", "y")]) and counts.applied >= 2


def feed(n=7, size=3):
    def fetch(url):
        k = int(url.split("cursor=")[1] or 0)
        return {"items": [k * size + j for j in range(size)], "cursor": str(k + 1) if k < n - 1 else None}

    return fetch


def test_a_feed_that_is_stopped_goes_on_where_it_stood(tmp_path):
    options = {"url": "http://stub", "stateLocation": f"file://{tmp_path}/state", "answersPerBatch": "2", "pauseSeconds": "0"}
    start, seen, log = None, [], []
    for crash in (False, True, False, False, True, False):
        reader = CursorStreamReader(options, feed())  # a new reader, as after a restart
        start = log[-1][1] if log else reader.initialOffset()
        if log and log[-1][2]:  # the last batch was logged but not done: Spark plans it again
            begin, end, _ = log.pop()
            parts = reader.partitions(begin, end)
            seen += [x for p in parts for x in reader.read(p)]
            log.append((begin, end, False))
            start = end
        end = reader.latestOffset()
        if end == start:
            continue
        if not crash:
            seen += [x for p in reader.partitions(start, end) for x in reader.read(p)]
        log.append((start, end, crash))
    reader = CursorStreamReader(options, feed())
    if log[-1][2]:
        seen += [x for p in reader.partitions(*log[-1][:2]) for x in reader.read(p)]
    start = log[-1][1]
    while (end := reader.latestOffset()) != start:
        seen += [x for p in reader.partitions(start, end) for x in reader.read(p)]
        start = end
    assert [(a, k, int(j)) for a, k, j in seen] == [(a, k, a * 3 + k) for a in range(7) for k in range(3)]
    assert reader.latestOffset() == start and reader.partitions(start, start) == []


def test_a_long_feed_takes_few_batches(tmp_path):
    """Batches double up to catchUpAnswers; answers keep their numbers, also where a task reads several."""
    options = {"url": "http://stub", "stateLocation": f"file://{tmp_path}/state", "answersPerBatch": "2", "catchUpAnswers": "200", "pauseSeconds": "0"}
    reader = CursorStreamReader(options, feed(300, 3))
    start, seen, sizes = reader.initialOffset(), [], []
    while (end := reader.latestOffset()) != start:
        parts = reader.partitions(start, end)
        assert len(parts) <= 64
        seen += [x for p in parts for x in reader.read(p)]
        sizes.append(end["n"] - start["n"])
        start = end
    assert sizes == [2, 4, 8, 16, 32, 64, 128, 46] and len(seen) == 900
    assert [(n, k) for n, k, _ in seen] == [(i // 3, i % 3) for i in range(900)]
