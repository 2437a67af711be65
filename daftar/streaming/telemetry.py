"""Telemetry: redaction, classification, throttling, bounded buffers, periodic flushes to several sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType

from ..functions.regexjs import WS
from ..operators.shared import discard, written
from ..sources.sinks import log_line

# --- fixed values: limits and field names of the collector ---
BUFFERS = {"console": 500, "network": 200, "ui": 500}
FINAL_KEEP, FINAL_CAP = {"console": 50, "network": 20, "ui": 100}, 60_000
FLUSH_MS, THROTTLE_MS, MAX_BODY, MAX_INPUT, MAX_TEXT = 2000, 500, 10_240, 200, 80
SENSITIVE = ("password", "token", "secret", "key", "authorization", "cookie", "session")
MAX_DEPTH, MAX_STRING, MAX_ITEMS = 5, 1000, 100
STREAMING = ("text/event-stream", "application/stream", "application/x-ndjson")
BINARY = ("image/", "video/", "audio/", "application/octet-stream", "application/pdf", "application/zip")
OWN_TRAFFIC = "/__manus__/"


def redact(value, depth: int = 0):
    """A JSON value without sensitive fields, bounded in depth, string and array length."""
    if depth > MAX_DEPTH:
        return "[Max Depth]"
    if isinstance(value, str):
        return value[:MAX_STRING] + "...[truncated]" if len(value) > MAX_STRING else value
    if isinstance(value, list):
        return [redact(v, depth + 1) for v in value[:MAX_ITEMS]]
    if isinstance(value, dict):
        return {k: "[REDACTED]" if any(s in k.lower() for s in SENSITIVE) else redact(v, depth + 1) for k, v in value.items()}
    return value


@F.pandas_udf(StringType())
def redact_json(texts: pd.Series) -> pd.Series:
    """``redact`` over JSON text; text that is no JSON is cut like a string."""

    def one(t):
        if t is None:
            return None
        try:
            value = json.loads(t)
        except ValueError:
            return redact(t)
        return json.dumps(redact(value), ensure_ascii=False, separators=(",", ":"))

    return texts.map(one)


def redact_flat(props: Column) -> Column:
    """The same for flat JSON objects of scalars, native."""
    m = F.from_json(props, "map<string,string>")
    hidden = lambda k: F.lower(k).rlike("|".join(SENSITIVE))
    return F.transform_values(m, lambda k, v: F.when(hidden(k), "[REDACTED]").when(F.length(v) > MAX_STRING, F.concat(F.substring(v, 1, MAX_STRING), F.lit("...[truncated]"))).otherwise(v))


def mask_input(name: Column, kind: Column, value: Column) -> Column:
    """Sensitive inputs by length only, others cut."""
    hidden = (F.lower(kind) == "password") | F.lower(name).rlike("|".join(SENSITIVE))
    return F.struct(F.coalesce(hidden, F.lit(False)).alias("masked"), F.length(value).alias("length"), F.when(~F.coalesce(hidden, F.lit(False)), F.substring(value, 1, MAX_INPUT)).alias("value"))


def compact_text(text: Column, most: int = MAX_TEXT) -> Column:
    t = F.trim(F.regexp_replace(text, WS + "+", " "))
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def response_class(content_type: Column, length: Column) -> Column:
    """streaming, too_large, binary or text."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    has = lambda words: F.greatest(*(kind.contains(w) for w in words))
    return F.when(has(STREAMING), "streaming").when(length > MAX_BODY, "too_large").when(has(BINARY), "binary").otherwise("text")


def body_text(text: Column) -> Column:
    return F.when(F.length(text) > MAX_BODY, F.concat(F.substring(text, 1, MAX_BODY), F.lit("...[truncated]"))).otherwise(text)


def own_traffic(url: Column) -> Column:
    return F.coalesce(url.contains(OWN_TRAFFIC), F.lit(False))


def recorded(df: DataFrame, url: str, classes: str, marker: str) -> DataFrame:
    """Entries that are neither the collector's own traffic nor inside an element marked as not recorded (``classes`` of it and all around it)."""
    ignored = F.array_contains(F.split(F.coalesce(F.col(classes), F.lit("")), r"\s+"), marker)
    return df.filter(~own_traffic(F.col(url)) & ~ignored)


def requeue(failed: DataFrame, pending: DataFrame, group: list[str], n: int, *order: str) -> DataFrame:
    """Buffers after a failed flush: its entries before the newer ones, each buffer cut to its newest ``n``."""
    return newest(failed.unionByName(pending), group, n, *order)


def network_errors(requests: DataFrame) -> DataFrame:
    """An error event for each failed or refused request."""
    bad = (F.col("status") >= 400) | F.col("error").isNotNull()
    return requests.filter(F.coalesce(bad, F.lit(False)) & ~own_traffic(F.col("url"))).select("ts", F.lit("network_error").alias("kind"), "method", "url", "status", "error")


def duration(start: Column, end: Column) -> Column:
    return F.unix_millis(end) - F.unix_millis(start)


def newest(df: DataFrame, group: list[str], n: int, *order: str) -> DataFrame:
    """A bounded buffer in batch form: the newest rows of each group."""
    w = Window.partitionBy(*group).orderBy(*(F.col(c).desc() for c in order))
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def final_flush(df: DataFrame, session: str, stream: str, payload: str, *order: str) -> DataFrame:
    """What is sent at the end: everything of a session, or its newest entries per stream if it is over the cap."""
    size = df.groupBy(session).agg(F.sum(F.length(payload)).alias("_size"))
    sized = df.join(size, session)
    out = sized.filter(F.col("_size") <= FINAL_CAP)
    w = Window.partitionBy(session).orderBy(*(F.col(c).desc() for c in order))
    for name, most in FINAL_KEEP.items():
        # a constant limit per stream, so that Spark cuts each group before its shuffle
        large = sized.filter((F.col("_size") > FINAL_CAP) & (F.col(stream) == name))
        out = out.unionByName(large.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= most).drop("_rank"))
    return out.drop("_size")


def flush_number(ts: Column, every_ms: int = FLUSH_MS) -> Column:
    """The flush that an event goes with."""
    return F.floor(F.unix_millis(ts) / every_ms)


def throttled_times(times: list[int], last: int | None, gap: int = THROTTLE_MS) -> tuple[list[bool], int | None]:
    """Which of ascending times stand ``gap`` or more after the last kept one."""
    kept = []
    for t in times:
        ok = last is None or t - last >= gap
        kept.append(ok)
        last = t if ok else last
    return kept, last


def successors(events: DataFrame, gap: int) -> tuple[DataFrame, list[str]]:
    """(id, next): of each event (key, ms, id) the first of its key that is ``gap`` or more later, null if there is none; and a working table to discard.

    Events and searches are range-partitioned by key and time, so one key of all
    rows takes all tasks; a search that ends a partition goes on with the first
    event of its key in a later one.
    """
    search = events.select("key", (F.col("ms") + gap).alias("at"), F.lit(0).alias("kind"), F.col("id").alias("of"), F.lit(None).cast("struct<ms:bigint,id:bigint>").alias("e"))
    there = events.select("key", F.col("ms").alias("at"), F.lit(1).alias("kind"), F.col("id").alias("of"), F.struct(F.col("ms").cast("long").alias("ms"), F.col("id").cast("long").alias("id")).alias("e"))
    dealt = search.unionByName(there).repartitionByRange("key", "at", "kind", "of").withColumn("part", F.spark_partition_id())
    parts, path = written(dealt, "searches")
    after = Window.partitionBy("part", "key").orderBy(F.desc("at"), F.desc("kind"), F.desc("of")).rowsBetween(Window.unboundedPreceding, 0)
    found = parts.withColumn("hit", F.last("e", ignorenulls=True).over(after)).filter("kind = 0").select("part", "key", "of", "hit")
    firsts = parts.filter("kind = 1").groupBy("key", "part").agg(F.min("e").alias("first"))
    # of each key in a partition the first event in later partitions: as many rows as partitions and keys
    later = Window.partitionBy("key").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    ends = parts.select("key", "part").distinct().join(firsts, ["key", "part"], "left").withColumn("beyond", F.last("first", ignorenulls=True).over(later)).select("key", "part", "beyond")
    return found.join(ends, ["key", "part"]).select(F.col("of").alias("id"), F.coalesce("hit", "beyond")["id"].alias("next")), [path]


def throttle(df: DataFrame, key: str, ts: str, ident: str, gap: int = THROTTLE_MS) -> DataFrame:
    """Batch form: rows of each key at least ``gap`` milliseconds after the last row kept.

    The last kept row decides, not the last row, so no window frame expresses it.
    Each row points to the first one that could be kept after it; what the
    pointers reach from each key's first row is kept. Pointers are doubled, so
    the rounds are the binary digits of the longest run of kept rows, and no
    step holds a key in one task. Rows without a time are never kept; rows
    without a key are a key of their own; ids are distinct.
    """
    if gap < 1:
        raise ValueError("the gap is a positive number of milliseconds")
    spark = df.sparkSession
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null"))
    events = df.select(name.alias("key"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"), F.col(ident).cast("long").alias("id")).filter("ms is not null")
    events, event_path = written(events, "events")
    found, used = successors(events, gap)
    jump, path = written(found.filter("next is not null"), "jumps")
    reached, reached_path = written(events.groupBy("key").agg(F.min(F.struct("ms", "id")).alias("first")).select(F.col("first.id").alias("id")), "reached")
    discard(spark, event_path, *used)
    while jump.limit(1).count():
        more = reached.join(jump, "id").select(F.col("next").alias("id"))
        now, now_path = written(reached.unionByName(more).distinct(), "reached")
        far = jump.select(F.col("id").alias("next"), F.col("next").alias("far"))
        double, double_path = written(jump.join(far, "next").select("id", F.col("far").alias("next")), "jumps")
        discard(spark, path, reached_path)
        jump, path, reached, reached_path = double, double_path, now, now_path
    return df.join(reached.select(F.col("id").alias("_kept")), F.col(ident) == F.col("_kept"), "left_semi")


def throttle_stream(events: DataFrame, key: str, ts: str, ident: str, gap: int = THROTTLE_MS) -> DataFrame:
    """Streaming form: the time of the last kept event is each key's state."""

    def run(who, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ms", ident])
        kept, last = throttled_times(rows["ms"].tolist(), last, gap)
        if last is not None:
            state.update((last,))
        yield rows[kept].assign(**{key: who[0]})[[key, ident, "ms"]]

    narrow = events.select(F.col(key).cast("long").alias(key), F.col(ident).cast("long").alias(ident), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"))
    return narrow.groupBy(key).applyInPandasWithState(run, f"{key} long, {ident} long, ms long", "last long", "append", GroupStateTimeout.NoTimeout)


def ring_buffer_stream(events: DataFrame, key: str, ident: str, n: int) -> DataFrame:
    """Streaming form of the bounded buffer: after each batch, each touched key's newest ``n`` ids."""

    def run(who, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        held = sorted([*held, *(int(x) for b in batches for x in b[ident])])[-n:]
        state.update((held,))
        yield pd.DataFrame({key: [who[0]], "ids": [held]})

    narrow = events.select(F.col(key).cast("string").alias(key), F.col(ident).cast("long").alias(ident))
    return narrow.groupBy(key).applyInPandasWithState(run, f"{key} string, ids array<long>", "ids array<long>", "update", GroupStateTimeout.NoTimeout)


def sinks(entries: DataFrame) -> dict[str, DataFrame]:
    """Entries by stream; user events also go to the session's replay."""
    of = lambda s: entries.filter(F.col("stream") == s)
    return {"browserConsole": of("console"), "networkRequests": of("network"), "sessionReplay": of("ui"), "uiEvents": of("ui")}


def start_flushes(entries: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """Periodic flushes of (stream, ts, payload) to one log per sink.

    A batch is written under its number and overwrites itself when it is tried
    again, so a failed flush neither loses nor repeats entries.
    """

    def flush(batch: DataFrame, number: int) -> None:
        for name, rows in sinks(batch).items():
            rows.select(log_line(F.col("payload"), F.col("ts")).alias("value")).write.mode("overwrite").text(f"{path}/{name}/batch={number}")

    writer = entries.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{FLUSH_MS} milliseconds")).start()
