"""Substring search by an index: posting lists of trigrams, partitioned by trigram, verified on the texts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path

#: Code points of a gram, and folders that the grams are dealt over.
GRAM, BUCKETS = 3, 64


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _grams(text: Column) -> Column:
    """Distinct grams of a column of texts that have one: code points zipped with those one and two places on."""
    size = F.greatest(F.size(text) - GRAM + 1, F.lit(0))
    return F.array_distinct(F.transform(F.arrays_zip(*(F.slice(text, k + 1, size).alias(f"p{k}") for k in range(GRAM))), lambda p: F.concat(*(p[f"p{k}"] for k in range(GRAM)))))


def grams_of(token: str) -> list[str]:
    return sorted({token[k : k + GRAM] for k in range(len(token) - GRAM + 1)})


@dataclass(frozen=True)
class SubstringIndex:
    """Posting lists (gram, id) in folders by gram, sorted, and the number of rows of each gram."""

    spark: SparkSession
    path: str
    id_type: str = "long"

    @classmethod
    def build(cls, rows: DataFrame, id_: str, text: str, path: str | None = None) -> SubstringIndex:
        """Index all rows. Null texts and those of fewer than three code points have no grams.

        Rows go by ranges of (bucket, gram, id), so the posting list of a gram that
        every text has is written by as many tasks as it needs.
        """
        path = path or new_path(rows.sparkSession, "substrings")
        points = rows.select(F.col(id_).alias("id"), F.regexp_extract_all(F.col(text), F.lit("(?s)."), F.lit(0)).alias("points")).filter(F.size("points") >= GRAM)
        postings = points.select("id", F.explode(_grams(F.col("points"))).alias("gram")).withColumn("bucket", _bucket(F.col("gram")))
        dealt = postings.repartitionByRange("bucket", "gram", "id").sortWithinPartitions("bucket", "gram", "id")
        dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
        made = cls(rows.sparkSession, path, rows.schema[id_].dataType.simpleString())
        made.postings().groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
        return made

    def postings(self) -> DataFrame:
        return self.spark.read.schema(f"id {self.id_type}, gram string, bucket int").parquet(f"{self.path}/postings")

    def of(self, gram: str) -> DataFrame:
        """The ids of one gram: its folder only, and in it the row groups whose range holds it."""
        at = self.spark.range(1).select(_bucket(F.lit(gram))).first()[0]
        return self.postings().filter((F.col("bucket") == at) & (F.col("gram") == gram)).select("id")

    def rarest_first(self, tokens: Sequence[str]) -> list[str] | None:
        """The grams of all tokens by their number of rows; None if one has none, so that nothing can match."""
        wanted = sorted({g for t in tokens for g in grams_of(t)})
        counts = self.spark.read.schema("gram string, n long").parquet(f"{self.path}/counts").filter(F.col("gram").isin(wanted)).collect() if wanted else []
        if len(counts) < len(wanted):
            return None
        return [r["gram"] for r in sorted(counts, key=lambda r: (r["n"], r["gram"]))]

    def candidates(self, tokens: Sequence[str], most: int = 6) -> DataFrame | None:
        """Ids that have the rarest grams of the tokens, each list cut down by the next; None if no token has a gram.

        ``most`` lists are read: more of them rule out little, and the texts decide.
        """
        grams = self.rarest_first(tokens)
        if grams is None:
            return self.postings().limit(0).select("id")
        if not grams:
            return None
        found = self.of(grams[0])
        for g in grams[1:most]:
            found = found.join(self.of(g).withColumnRenamed("id", "other"), F.col("id") == F.col("other"), "left_semi")
        return found

    def bytes_read(self, tokens: Sequence[str], most: int = 6) -> tuple[int, int]:
        """Bytes of the posting files that a search opens, and of all posting files."""
        jvm = self.spark.sparkContext._jvm
        size = lambda files: sum(jvm.org.apache.hadoop.fs.Path(f).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jvm.org.apache.hadoop.fs.Path(f)).getLen() for f in files)
        opened = {part.rsplit("/", 1)[0] for g in (self.rarest_first(tokens) or [])[:most] for part in self._files(g)}
        every = self.postings().inputFiles()
        return size([f for f in every if f.rsplit("/", 1)[0] in opened]), size(every)

    def _files(self, gram: str) -> list[str]:
        at = self.spark.range(1).select(_bucket(F.lit(gram))).first()[0]
        return self.spark.read.parquet(f"{self.path}/postings/bucket={at}").inputFiles()

    def search(self, rows: DataFrame, id_: str, text: str, tokens: Sequence[str]) -> DataFrame:
        """The rows of the indexed table whose text holds every token: candidates, then the texts. Tokens without grams alone scan the table."""
        holds = F.lit(True)
        for t in tokens:
            holds = holds & F.col(text).contains(t)
        found = self.candidates(tokens)
        some = rows if found is None else rows.join(found.withColumnRenamed("id", "found_id"), F.col(id_) == F.col("found_id"), "left_semi")
        return some.filter(holds)
