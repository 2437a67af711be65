"""Quality rules with thresholds learned per language and source.

Base rules reject texts that are too short or repeat themselves. The other
rules have no fixed cutoff: the log odds of each document ratio, with half a
count added on both sides so that texts without a hit differ by their length,
go into a mergeable quantile sketch (buckets of 4 % in the odds, merged by
adding counts) for its language and source, and a text is rejected when they
lie far above the upper quartile of its own group, measured in interquartile
ranges. Junk in a group lies above its clean texts, so the fence is counted
from the first quartile, and the range is bounded by those of the language and
of all rows: a group with up to half of its rows junk keeps a clean fence. Small
groups are drawn towards their language and those towards all rows, by a weight
that grows with their rows.

Defined results: a null or wordless text has zero counts and fails the base
rules; null language or source form a group of their own; repeated rows are
judged one by one; odds equal to the fence are kept; a very long text is a slice
of its own and takes memory in proportion to its length; an empty table gives an
empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import materialize
from .words import CHUNK, SpanHash, covered, mix, slices, windows, words_of

#: Fixed values of the base rules.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
#: Buckets of the sketch: bucket k holds odds in (GAMMA**(k-1), GAMMA**k].
GAMMA = 1.04
#: Log odds are too high above q1 + (FENCE + 1) * spread, which is q3 + FENCE * (q3 - q1) where the spread is the group's own.
#: LEAST keeps the fence open where all rows of the table have the same counts.
FENCE, LEAST = 3.0, 0.5
#: Rows that the quartiles of a group's parent count as.
PRIOR = 100
RATIOS = ("symbol_ratio", "dup_line_ratio", "repeat_ratio")
#: Hits and total of each ratio.
PARTS = (("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"))

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
STATS_SCHEMA = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)


def per_doc(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive edges."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[edges[1:]] - total[edges[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    if not len(keys):
        return np.zeros(0, bool)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    w = words_of(column)
    lead = (w.data & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(lead, dtype=np.int64)))
    word_chars = np.concatenate(([0], np.cumsum(chars[w.end] - chars[w.start])))
    spans = SpanHash(w.data)
    doc_key = mix(np.arange(1, w.docs + 1, dtype=np.uint64))
    doc_of_word = w.doc_of()

    keys, at = windows(spans(w.start, w.end), w.first, WINDOW)
    hit = at[repeated(keys ^ doc_key[doc_of_word[at]])] if len(at) else at
    repeat = covered(hit, hit + WINDOW, len(w.start))

    newline = np.flatnonzero(w.data == 10)
    filled = np.diff(w.offsets) > 0
    begin = np.union1d(newline + 1, w.offsets[:-1][filled])
    begin = begin[begin < len(w.data)]
    end = np.minimum(np.append(begin[1:], len(w.data)), len(w.data)) if len(begin) else begin
    end = end - (w.data[end - 1] == 10) if len(begin) else end
    has_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, begin)
    begin, end = begin[has_word], end[has_word]
    line_doc = np.searchsorted(w.offsets, begin, "right") - 1
    line_key = spans(begin, end) ^ doc_key[line_doc]
    _, firsts = np.unique(line_key, return_index=True)
    dup = np.ones(len(begin), bool)
    dup[firsts] = False
    return {
        "n_words": np.diff(w.first),
        "word_chars": word_chars[w.first[1:]] - word_chars[w.first[:-1]],
        "n_symbols": per_doc(_SYMBOL[w.data], w.offsets),
        "n_lines": np.bincount(line_doc, minlength=w.docs),
        "n_dup_lines": np.bincount(line_doc[dup], minlength=w.docs),
        "n_repeat_words": per_doc(repeat, w.first),
    }


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", CHUNK):
        counts = text_counts(part.column(3))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), part.column(2), *(pa.array(counts[c], pa.int64()) for c in COUNTS)],
            names=["doc_id", "lang", "source", *COUNTS],
        )


def text_stats(docs: DataFrame) -> DataFrame:
    """One row of counts per document, whole texts."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(_stats, STATS_SCHEMA)


def _with_ratios(stats: DataFrame) -> DataFrame:
    out = stats
    for r, (a, b) in zip(RATIOS, PARTS, strict=True):
        out = out.withColumn(r, F.col(a) / F.greatest(F.col(b), F.lit(1))).withColumn(f"odds_{r}", F.log((F.col(a) + 0.5) / (F.greatest(F.col(b) - F.col(a), F.lit(0)) + 0.5)))
    return out


def bucket(odds):
    """The sketch bucket of log odds."""
    return F.ceil(odds / F.lit(float(np.log(GAMMA)))).cast("int")


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Bucket counts per group and ratio: partial sketches merge by adding counts in the map-side combine."""
    long = rows.select(*keys, F.posexplode(F.array(*(bucket(F.col(f"odds_{r}")) for r in RATIOS))).alias("ratio", "bucket"))
    return long.groupBy(*keys, "ratio", "bucket").agg(F.count("*").alias("n"))


def quartiles(counts: DataFrame, keys: list[str]) -> DataFrame:
    """First and third quartile of each ratio, one row per group, from a merged sketch."""
    by = [*keys, "ratio"]
    w = Window.partitionBy(*by)
    run = counts.withColumn("upto", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    value = F.col("bucket") * F.lit(float(np.log(GAMMA)))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("total"), value))
    return run.groupBy(*by).agg(at(0.25).alias("q1"), at(0.75).alias("q3"), F.max("total").alias("rows"))


def fences(stats: DataFrame) -> DataFrame:
    """Upper fence of the log odds of each ratio per language and source."""
    fine = sketch(_with_ratios(stats), ["lang", "source"])
    by_lang = quartiles(fine.groupBy("lang", "ratio", "bucket").agg(F.sum("n").alias("n")), ["lang"])
    by_all = quartiles(fine.groupBy("ratio", "bucket").agg(F.sum("n").alias("n")), [])
    own = quartiles(fine, ["lang", "source"])
    lang = by_lang.select(F.col("lang").alias("lang_"), F.col("ratio").alias("ratio_"), F.col("q1").alias("l1"), F.col("q3").alias("l3"), F.col("rows").alias("lrows"))
    every = by_all.select(F.col("ratio").alias("ratio_all"), F.col("q1").alias("a1"), F.col("q3").alias("a3"))
    wide = own.join(lang, F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("ratio") == F.col("ratio_")), "left").join(F.broadcast(every), F.col("ratio") == F.col("ratio_all"), "left")
    # the more rows, the more a group's quartiles count against its language's, and those against all rows'
    toward = lambda n, x, parent: (F.col(n) * x + PRIOR * parent) / (F.col(n) + PRIOR)
    all_range = F.col("a3") - F.col("a1")
    lang_q1, lang_range = toward("lrows", F.col("l1"), F.col("a1")), toward("lrows", F.least(F.col("l3") - F.col("l1"), all_range), all_range)
    # a range wider than the parents' may be junk and counts as theirs
    q1, spread = toward("rows", F.col("q1"), lang_q1), F.greatest(toward("rows", F.least(F.col("q3") - F.col("q1"), lang_range), lang_range), F.lit(LEAST))
    limit = wide.select("lang", "source", "ratio", (q1 + (FENCE + 1) * spread).alias("fence"))
    return limit.groupBy(F.col("lang").alias("f_lang"), F.col("source").alias("f_source")).agg(*(F.max(F.when(F.col("ratio") == i, F.col("fence"))).alias(f"max_{r}") for i, r in enumerate(RATIOS)))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, ratios, fences and the verdict for each document.

    Texts are read once; the narrow counts are written to the shared folder and
    read twice, for the sketches and for the filtering join. The join's small
    side has one row per language and source.
    """
    stats, _ = materialize(text_stats(docs), "rules")
    rows = _with_ratios(stats)
    limits = fences(stats)
    joined = rows.join(limits, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left").drop("f_lang", "f_source")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    within = F.lit(True)
    for r in RATIOS:
        within = within & (F.col(f"odds_{r}") <= F.coalesce(F.col(f"max_{r}"), F.lit(float("inf"))))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & within)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
