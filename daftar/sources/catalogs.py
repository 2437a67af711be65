"""Readers of the catalog's JSON, HTML and text sources. Paths go to Spark, so any of its file systems will do."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from ..functions.text import as_list, squeeze
from ..schema import ARCHIVE_FIELDS, RECORD

CARD_SCHEMA = "title string, relativePath string, author string, volumes int, pages int"
# --- fixed values: how the source's cards are marked ---
CARD_CLASSES = {"rounded-xl", "border", "bg-card", "shadow"}
VOLUMES, PAGES = r"المجلدات:\s*(\d+)", r"الصفحات:\s*(\d+)"


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One whole-file JSON document (gzip by suffix)."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_catalog(spark: SparkSession, path: str, schema: StructType = RECORD, field: str = "materials") -> DataFrame:
    """The rows of a ``{metadata, materials: []}`` payload with their place as ``ord``."""
    whole = read_json(spark, path, StructType([StructField(field, ArrayType(schema))]))
    return whole.select(F.posexplode(field).alias("ord", "r")).select("r.*", F.col("ord").cast("long").alias("ord"))


def read_metadata(spark: SparkSession, path: str, field: str = "metadata") -> DataFrame:
    return read_json(spark, path, StructType([StructField(field, MapType(StringType(), StringType()))])).select(field)


def read_array_or_wrapped(spark: SparkSession, path: str, schema: StructType, *fields: str) -> DataFrame:
    """Rows of a bare array, or of the first of ``fields`` that the wrapping object has; anything else is an error."""
    text = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    options = [F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v").cast(ArrayType(schema)))]
    options += [F.try_variant_get("v", f"$.{f}", ArrayType(schema).simpleString()) for f in fields]
    rows = F.coalesce(*options, F.raise_error(F.lit(f"{path}: neither an array nor an object with {', '.join(fields)}")).cast(ArrayType(schema)))
    return text.select(F.posexplode(rows).alias("ord", "r")).select("r.*", F.col("ord").cast("long").alias("ord"))


def read_title_groups(spark: SparkSession, path: str, field: str = "titles_by_category") -> DataFrame:
    """(sourceCategory, title, ord) of a map of arrays; values that are no arrays are skipped."""
    text = spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", f"$.{field}"), MapType(StringType(), StringType())).alias("m"))
    groups = text.select(F.posexplode("m").alias("g", "sourceCategory", "raw")).filter(F.col("raw").startswith("["))
    rows = groups.select("g", "sourceCategory", F.posexplode(F.from_json("raw", "array<string>")).alias("k", "title"))
    return rows.select("sourceCategory", "title", (F.shiftleft(F.col("g").cast("long"), 32) + F.col("k")).alias("ord"))


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a chat export; none if the field is no array. ``text`` stays JSON, of any nesting."""
    text = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.messages").alias("raw"))
    rows = text.filter(F.col("raw").startswith("[")).select(F.posexplode(F.from_json("raw", "array<string>")).alias("ord", "m"))
    get = lambda k: F.get_json_object("m", f"$.{k}")
    return rows.select(F.col("ord").cast("long").alias("ord"), get("type").alias("type"), get("id").cast("long").alias("id"), get("file_name").alias("file_name"), get("mime_type").alias("mime_type"), get("text").alias("text"))


def archive_documents(rows: DataFrame, column: str = "json") -> DataFrame:
    """Archive documents from one JSON object per row; scalar, array or missing fields all become arrays."""
    get = lambda k: as_list(F.get_json_object(column, f"$.{k}"))
    arrays = ("title", "creator", "language", "subject", "description", "collection")
    return rows.select(*(get(k).alias(k) if k in arrays else F.get_json_object(column, f"$.{k}").alias(k) for k in ARCHIVE_FIELDS))


class _Cards(HTMLParser):
    """Cards of a catalog page: title and author links and the text around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.cards: list[dict] = []
        self.stack: list[tuple[str, bool]] = []
        self.card: dict | None = None
        self.link: str | None = None
        self.heading = 0

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "input", "meta", "link", "hr"):
            return
        a = dict(attrs)
        is_card = self.card is None and tag == "div" and set((a.get("class") or "").split()) >= CARD_CLASSES
        if is_card:
            self.card = {"title": "", "path": None, "author": "", "text": []}
        self.stack.append((tag, is_card))
        if self.card is not None:
            self.heading += tag == "h3"
            href = a.get("href") or ""
            if tag == "a" and self.heading and self.card["path"] is None and href.startswith("/ar/"):
                self.card["path"], self.link = href, "title"
            elif tag == "a" and not self.card["author"] and href.startswith("/ar/authors/"):
                self.link = "author"

    def handle_endtag(self, tag):
        while self.stack:
            name, is_card = self.stack.pop()
            if name == "h3":
                self.heading -= self.card is not None
            if name == "a":
                self.link = None
            if is_card:
                self.cards.append(self.card)
                self.card, self.heading = None, 0
            if name == tag:
                break

    def handle_data(self, data):
        if self.card is not None:
            self.card["text"].append(data)
            if self.link:
                self.card[self.link] += data


def html_cards(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(key, place, card columns) of every card with a title link."""

    def run(batches):
        for pdf in batches:
            out = []
            for page, text in zip(pdf[key], pdf[html], strict=True):
                parser = _Cards()
                parser.feed(text or "")
                for k, c in enumerate(c for c in parser.cards if c["path"] and c["title"].strip()):
                    out.append((page, k, c["title"], c["path"], c["author"], " ".join(c["text"])))
            yield pd.DataFrame(out, columns=["page", "place", "title", "relativePath", "author", "text"]).astype({"page": "int64", "place": "int64"})

    rows = pages.select(F.col(key).cast("long").alias(key), html).mapInPandas(run, "page long, place long, title string, relativePath string, author string, text string")
    number = lambda p: F.regexp_extract(squeeze(F.col("text")), p, 1).try_cast("int")
    return rows.select(F.col("page").alias(key), "place", squeeze(F.col("title")).alias("title"), "relativePath", F.nullif(squeeze(F.col("author")), F.lit("")).alias("author"), number(VOLUMES).alias("volumes"), number(PAGES).alias("pages"))


def read_log_newest(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, line) of capped logs; ``place`` counts from the newest line, 0, so sorting by it reads newest first."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.filter(F.split("value", "\n"), lambda x: x != "").alias("lines"))
    return whole.select("file", F.posexplode(F.reverse("lines")).alias("place", "line"))


def read_log(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Lines of a log; with a schema, the JSON after each line's time stamp."""
    lines = spark.read.text(path).select(F.col("value").alias("line"))
    parts = lines.select("line", F.regexp_extract("line", r"^\[([^\]]*)\]", 1).alias("logged"), F.regexp_replace("line", r"^\[[^\]]*\]\s*", "").alias("body"))
    return parts.select("line", "logged", F.from_json("body", schema).alias("entry")) if schema else parts
