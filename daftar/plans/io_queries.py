"""Sources and sinks as queries: a small table is written in a source's form and read back, or sent through a sink."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.normalize import LATIN, normalize
from ..operators import ordering, projections, report
from ..operators.ordering import running_sum
from ..operators.shared import new_path, shared_dir
from ..sources import catalogs, paged, sinks
from . import search
from .arabic import _DIWAN, _POEM, CATALOG, catalog_rows
from .queries import query, table

NAMED = StructType([StructField("id", StringType()), StructField("title", StringType())])


def new_file(spark, tag: str) -> str:
    return f"{shared_dir(spark)}/daftar-{tag}-{uuid.uuid4().hex}"


def document(spark, value, tag: str) -> str:
    """One JSON document in a folder."""
    path = new_file(spark, tag)
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "value string").coalesce(1).write.text(path)
    return path


#: Records in one file of a source.
PER_FILE = 500
FILED = f"select cast(doc_id as varchar) as id, text as title, row_number() over (partition by doc_id // {PER_FILE} order by doc_id) - 1 as ord from documents"


def record_json() -> Column:
    return F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("title"))


def filed(spark, sf, record: Column, wrap, tag: str, compression: str = "none") -> str:
    """Documents as a folder of whole-file JSON documents, written by Spark: a file holds the records of PER_FILE ids in order, in the payload that ``wrap`` makes of their array."""
    rows = table(spark, sf, "documents").select(F.floor(F.col("doc_id") / PER_FILE).alias("file"), F.struct("doc_id", record.alias("r")).alias("x"))
    files = rows.groupBy("file").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["r"]).alias("records"))
    path = new_path(spark, tag)
    files.select(F.to_json(wrap(F.col("records"))).alias("value")).write.option("maxRecordsPerFile", 1).option("compression", compression).text(path)
    return path


@query(FILED)
def source_catalog(spark, sf):
    wrap = lambda r: F.struct(F.create_map(F.lit("n"), F.lit("1")).alias("metadata"), r.alias("materials"))
    return catalogs.read_catalog(spark, filed(spark, sf, record_json(), wrap, "catalog"), NAMED)


@query(FILED)
def source_gzip(spark, sf):
    return catalogs.read_catalog(spark, filed(spark, sf, record_json(), lambda r: F.struct(r.alias("records")), "gzip", "gzip"), NAMED, "records")


@query(FILED)
def source_array(spark, sf):
    return catalogs.read_array_or_wrapped(spark, filed(spark, sf, record_json(), lambda r: r, "array"), NAMED, "books")


@query(FILED)
def source_wrapped(spark, sf):
    return catalogs.read_array_or_wrapped(spark, filed(spark, sf, record_json(), lambda r: F.struct(F.lit(1).alias("n"), r.alias("books")), "wrapped"), NAMED, "materials", "books")


@query(f"select 'n' as key, cast(count(*) as varchar) as value from documents group by doc_id // {PER_FILE}")
def source_metadata(spark, sf):
    wrap = lambda r: F.struct(F.create_map(F.lit("n"), F.size(r).cast("string")).alias("metadata"), r.alias("materials"))
    return catalogs.read_metadata(spark, filed(spark, sf, record_json(), wrap, "metadata")).select(F.explode("metadata").alias("key", "value"))


@query("select n_regionkey::varchar as category, n_name as title, row_number() over (order by n_regionkey, n_nationkey) - 1 as place from nation")
def source_groups(spark, sf):
    groups: dict = {"none": "no list"}
    for r in table(spark, sf, "nation").orderBy("n_regionkey", "n_nationkey").collect():
        groups.setdefault(str(r["n_regionkey"]), []).append(r["n_name"])
    rows = catalogs.read_title_groups(spark, document(spark, {"titles_by_category": groups}, "groups"))
    return ordering.row_numbers(rows, "ord", name="place").select(F.col("sourceCategory").alias("category"), "title", F.col("place").cast("long").alias("place"))


@query("select doc_id as id, 'message' as type, source || '.pdf' as file_name, text from documents")
def source_messages(spark, sf):
    message = F.struct(F.col("doc_id").alias("id"), F.lit("message").alias("type"), F.concat("source", F.lit(".pdf")).alias("file_name"), F.lit("application/pdf").alias("mime_type"), F.col("text"))
    return catalogs.read_messages(spark, filed(spark, sf, message, lambda r: F.struct(r.alias("messages")), "messages")).select("id", "type", "file_name", "text")


@query("select n_regionkey::bigint as page_id, n_name as title, '/ar/' || n_nationkey as path, 'A ' || n_name as author, n_nationkey::int as volumes, 100 + n_nationkey::int as pages from nation")
def source_cards(spark, sf):
    card = F.concat(F.lit('<div class="rounded-xl border bg-card shadow"><h3><a href="/ar/'), F.col("n_nationkey").cast("string"), F.lit('">'), "n_name", F.lit('</a></h3><a href="/ar/authors/1">A '), "n_name", F.lit("</a><p>المجلدات: "), F.col("n_nationkey").cast("string"), F.lit("</p><p>الصفحات: "), (F.col("n_nationkey") + 100).cast("string"), F.lit("</p></div>"))
    pages = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("page_id")).agg(F.concat_ws("", F.collect_list(card)).alias("html"))
    return catalogs.html_cards(pages).select("page_id", "title", F.col("relativePath").alias("path"), "author", "volumes", "pages")


#: Documents on a page of the service that the paged sources are tried on.
PAGE = 100


def published(spark, sf) -> str:
    """Documents as the pages of a service, written by Spark: a folder for each language and page, and a folder with each language's count."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    numbered = running_sum(d, F.lit(1), ["lang"], F.col("doc_id"), name="r").withColumn("page", F.floor((F.col("r") - 1) / PAGE) + 1).withColumn("place", (F.col("r") - 1) % PAGE)
    where = new_path(spark, "service")
    line = F.to_json(F.struct(F.col("doc_id").alias("identifier"), "place"))
    numbered.select("lang", "page", line.alias("value")).repartition("lang", "page").write.partitionBy("lang", "page").text(f"{where}/pages")
    d.groupBy("lang").agg(F.count("*").cast("string").alias("value")).write.partitionBy("lang").text(f"{where}/counts")
    return where


def _lines(folder: str) -> list[str]:
    """Lines of the files in a folder of any file system, none if it is missing."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    if files.get_file_info(path).type == fs.FileType.NotFound:
        return []
    found = [f.path for f in files.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-")]
    return [x for f in found for x in files.open_input_stream(f).read().decode().splitlines()]


def _page(where: str, lang: str, page: int) -> list[dict]:
    return sorted((json.loads(x) for x in _lines(f"{where}/pages/lang={lang}/page={page}")), key=lambda x: x["place"])


def _answer(url: str) -> dict:
    """The service's answer to a search address."""
    where, ask = url.split("?")
    ask = dict(x.split("=") for x in ask.split("&") if not x.startswith("fl"))
    found = int(_lines(f"{where}/counts/lang={ask['q']}")[0])
    return {"response": {"numFound": found, "docs": _page(where, ask["q"], int(ask["page"]))[: int(ask["rows"])]}}


def _feed(url: str) -> dict:
    """The service's answer to a cursor: pages of English documents, each with the number of the next."""
    where, ask = url.split("?")
    page = int(ask.split("=")[1] or 1)
    return {"items": _page(where, "en", page), "cursor": str(page + 1) if _lines(f"{where}/pages/lang=en/page={page + 1}") else None}


class _Documents(paged.PagedSearch):
    @classmethod
    def name(cls):
        return "paged_documents"

    def reader(self, schema):
        return paged.PagedReader(self.options, _answer)


class _DocumentFeed(paged.CursorFeed):
    @classmethod
    def name(cls):
        return "document_feed"

    def streamReader(self, schema):  # noqa: N802
        return paged.CursorStreamReader(self.options, _feed)


def _searched(spark, sf, paging: str, **more: int) -> DataFrame:
    spark.dataSource.register(_Documents)
    langs = [r[0] for r in table(spark, sf, "documents").select("lang").distinct().limit(1000).collect()]
    reader = spark.read.format("paged_documents").option("url", published(spark, sf)).option("queries", json.dumps(langs)).option("rows", PAGE).option("pauseSeconds", 0).option("paging", paging)
    for k, v in more.items():
        reader = reader.option(k, v)
    return reader.load().select(F.get_json_object("json", "$.identifier").cast("long").alias("id"), F.col("query").alias("lang"), "page", "place")


_PAGES_SQL = f"select doc_id as id, lang, (r // {PAGE} + 1)::int as page, (r % {PAGE})::int as place from (select doc_id, lang, row_number() over (partition by lang order by doc_id) - 1 as r from documents)"


@query(_PAGES_SQL)
def source_pages_fixed(spark, sf):
    """Pages of every language's documents until a short one."""
    return _searched(spark, sf, "fixed", maxPages=2**31 - 1)


@query(_PAGES_SQL)
def source_pages_count(spark, sf):
    return _searched(spark, sf, "count", maxResults=2**62)


@query(_PAGES_SQL)
def source_pages_cursor(spark, sf):
    return _searched(spark, sf, "cursor", maxResults=2**62)


@query(f"{_PAGES_SQL} where r < {PAGE}")
def source_pages_single(spark, sf):
    """One page a query is the feature."""
    return _searched(spark, sf, "single")


@query(f"{_PAGES_SQL} where r < 2 * {PAGE}")
def source_pages_limited(spark, sf):
    """Two pages a query at most are the feature."""
    return _searched(spark, sf, "fixed", maxPages=2)


def _drained(spark, where: str, out: str, batches: int | None = None) -> None:
    """Read the feed into ``out`` until nothing comes, or only some batches, from where an earlier run stopped. What is left comes in growing batches."""
    spark.dataSource.register(_DocumentFeed)
    feed = spark.readStream.format("document_feed").option("url", where).option("stateLocation", f"{out}/place").option("answersPerBatch", 3).option("catchUpAnswers", 3 if batches else 1024).option("pauseSeconds", 0).load()
    run = feed.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(processingTime="0 seconds").start()
    try:
        if batches is None:
            run.processAllAvailable()
        else:
            while (run.lastProgress or {"batchId": -1})["batchId"] < batches - 1 and run.isActive:
                run.awaitTermination(1)
    finally:
        run.stop()


@query(f"select doc_id as id, r // {PAGE} as answer, r % {PAGE} as place from (select doc_id, (row_number() over (order by doc_id) - 1)::int as r from documents where lang = 'en')")
def source_cursor(spark, sf):
    """A cursor feed of the English documents as a stream that is stopped once and goes on from its checkpoint."""
    out, where = new_path(spark, "feed"), published(spark, sf)
    _drained(spark, where, out, 1)
    _drained(spark, where, out)
    rows = spark.read.schema("answer int, place int, json string").parquet(f"{out}/rows")
    return rows.select(F.get_json_object("json", "$.identifier").cast("long").alias("id"), "answer", "place")


@query("select s_suppkey::varchar as identifier, case when s_suppkey % 3 = 0 then 'cached' when s_suppkey % 7 = 0 then 'error' else 'fetched ' || s_suppkey end as state from supplier")
def source_hydrated(spark, sf):
    """Only ids that the cache lacks are fetched; those that the service does not know become errors."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("identifier"))
    cache = s.filter(F.col("identifier").cast("long") % 3 == 0).withColumn("json", F.lit('{"t":"cached"}'))
    got = paged.hydrate(s, cache, lambda part: {i: {"t": f"fetched {i}"} for i in part if int(i) % 7})
    return got.select("identifier", F.when(F.get_json_object("json", "$._fetchError").isNotNull(), "error").otherwise(F.get_json_object("json", "$.t")).alias("state"))


@query("select n_name as body, strftime(timestamp '2026-01-01' + to_seconds(n_nationkey), '%Y-%m-%dT%H:%M:%S.000Z') as logged from nation")
def source_log(spark, sf):
    at = F.timestamp_seconds(F.lit(1_767_225_600) + F.col("n_nationkey"))
    path = new_file(spark, "log")
    table(spark, sf, "nation").select(sinks.log_line(F.col("n_name"), at).alias("value")).write.text(path)
    return catalogs.read_log(spark, path).select("body", "logged")


@query("select n_name as line, row_number() over (order by n_nationkey desc) - 1 as place from nation")
def source_log_newest(spark, sf):
    path = new_file(spark, "log")
    table(spark, sf, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select(F.col("n_name").alias("value")).write.text(path)
    return catalogs.read_log_newest(spark, path).select("line", F.col("place").cast("long").alias("place"))


@query("select p_partkey, p_name, p_size from part")
def sink_json(spark, sf):
    path = new_file(spark, "json")
    for _ in range(2):  # the second time over the first
        sinks.write_json(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), path)
    return spark.read.schema("p_partkey long, p_name string, p_size int").json(path)


@query("select 'audit' as what, count(*) as n from supplier union all select 'applied', count(*) from supplier union all select 'dry', 0")
def sink_commit(spark, sf):
    """The audit is written in either case, the catalog only when it is applied."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    dry, wet = new_file(spark, "dry"), new_file(spark, "wet")
    sinks.commit(s, s, f"{dry}/catalog", f"{dry}/audit")
    sinks.commit(s, s, f"{wet}/catalog", f"{wet}/audit", apply=True)
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{dry}/catalog")
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    one = lambda what, df: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    nothing = spark.read.parquet(f"{dry}/catalog") if there else s.limit(0)
    return one("audit", spark.read.json(f"{dry}/audit")).unionAll(one("applied", spark.read.parquet(f"{wet}/catalog"))).unionAll(one("dry", nothing))


@query("select n_nationkey, case when n_nationkey % 2 = 0 then 'note' else 'old note' end as notes, '25' as total, 'kept' as other from nation")
def sink_metadata(spark, sf):
    m = F.create_map(F.lit("other"), F.lit("kept"), F.lit("notes"), F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("old"), F.lit("totalMaterials"), F.lit("1"))
    twice = table(spark, sf, "nation").withColumn("metadata", m)
    for _ in range(2):  # a note is added once
        twice = sinks.patch_metadata(twice, "note", 25)
    return twice.select("n_nationkey", F.col("metadata")["notes"].alias("notes"), F.col("metadata")["totalMaterials"].alias("total"), F.col("metadata")["other"].alias("other"))


@query("select n_regionkey, n_nationkey, '- ' || n_name as line from nation")
def sink_grouped_report(spark, sf):
    return report.grouped_lines(table(spark, sf, "nation"), "n_regionkey", "n_name", "n_nationkey")


@query("select doc_id, lang as url from documents")
def sink_exported(spark, sf):
    return projections.exported(table(spark, sf, "documents").select("doc_id", F.col("lang").alias("sourceUrl")))


@query("select doc_id::varchar as id, source as title, 'u' as url, lang as reason, 'x' as language, left(text, 300) as subject from documents")
def sink_audit_rows(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.lit("u").alias("url"), F.col("lang").alias("reason"), F.lit("x").alias("language"), F.col("text").alias("subject"))
    return projections.audit_row(d)


@query("select 'unique_source' as name, count(source) - count(distinct source) as failed from documents union all select 'unique_doc_id', 0")
def unique_checks(spark, sf):
    d = table(spark, sf, "documents")
    return report.unique(d, "source").unionAll(report.unique(d, "doc_id"))


# Requests of the catalog
@query(f"""with {CATALOG} select 'all' as name, count(*) as n from c union all select 'diwans', count(*) filter (where {_DIWAN} and not {_POEM}) from c union all select 'scientific_poems', count(*) filter (where {_POEM}) from c
union all select 'bilingual_dictionaries', count(*) filter (where doc_id in (2, 3)) from c union all select v.b, count(*) filter (where c.kind = v.b) from c, (values ('academic_theses'), ('references'), ('dictionaries'), ('curricula'), ('academies'), ('literary_clubs')) v(b) group by v.b""")
def category_buttons(spark, sf):
    return search.category_counts(catalog_rows(spark, sf), ("2", "3"))


@query(f"with {CATALOG} select 'all' as name, count(*) as n from c union all select 'linguistics', count(*) filter (where tag = 'نحو') from c union all select 'lexicon-literature-rhetoric', count(*) filter (where tag = 'بلاغة') from c union all select 'diwans', count(*) filter (where {_DIWAN} or {_POEM}) from c")
def stat_buttons(spark, sf):
    return search.stat_cards(catalog_rows(spark, sf))


@query(f"with {CATALOG} select 'diwans' as name, count(*) filter (where {_DIWAN}) as n from c union all select 'poems', count(*) filter (where {_POEM}) from c union all select 'academies', count(*) filter (where kind = 'academies') from c union all select 'curricula', 0 union all select 'literary_clubs', 0")
def global_counters(spark, sf):
    return search.global_counts(catalog_rows(spark, sf))


def _keyed(spark, sf) -> DataFrame:
    rows = catalog_rows(spark, sf)
    return rows.withColumn("search_key", projections.haystack(LATIN)).withColumn("title_key", normalize(F.col("title"), LATIN))


@query(f"with {CATALOG} select doc_id from c where kind = 'diwans' and signed and not {_POEM} and tag = 'نحو'")
def search_request(spark, sf):
    """Category and statistic together; the query of punctuation alone counts as one without tokens."""
    return search.results(_keyed(spark, sf), search.Request(query="!!", category="diwans", stat="linguistics")).select("doc_id")


@query(f"with {CATALOG} select doc_id from c where kind = 'academies' order by doc_id limit 12 offset 12")
def search_page(spark, sf):
    rows = _keyed(spark, sf).withColumn("ord", F.col("doc_id")).withColumn("batch_rank", F.lit(0))
    return search.ordered_page(rows, search.Request(category="academies", page=2)).rows.select("doc_id")


@query(f"with {CATALOG} select doc_id from c where false")
def search_default(spark, sf):
    """Without any choice only the default view's title is shown; no record here has it."""
    return search.results(_keyed(spark, sf), search.Request()).select("doc_id")
