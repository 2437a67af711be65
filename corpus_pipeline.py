"""From raw documents to token ids: quality, near duplicates, benchmark passages, private data, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written and read again as the next stage's input. All but the last keep the
columns of ``documents``.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.llm.decontaminate import drop_contaminated
from daftar.llm.ngram_join import keep_one
from daftar.llm.pii import DEFAULT_KEY, pseudonymize
from daftar.llm.quality_classifier import keep_quality
from daftar.llm.scratch import materialize
from daftar.llm.sentencepiece_bpe import encode_rows

#: The session's setting with the secret key of the pseudonyms; without it a public key for tests is used.
PII_KEY = "spark.daftar.pii.key"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group linked by the n-gram Jaccard join; rows that share an id are told apart by their text."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages beyond the contamination rule."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for private data, under the session's key; n_chars follows the text."""
    key = spark.conf.get(PII_KEY, None)
    if key is None:
        warnings.warn(f"{PII_KEY} is not set: pseudonyms are made with a public key for tests, and anybody can undo them", stacklevel=2)
    return pseudonymize(docs, key or DEFAULT_KEY).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and its text decoded from them."""
    return encode_rows(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", private_data),
    ("SentencePiece encoding and decoding", tokens),
]

#: No SQL expresses the classifier; tests compare run() with the same steps in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = materialize(docs, f"stage{k}")
    return docs
