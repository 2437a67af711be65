"""The catalog's operators on the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import LATIN, duckdb_latin, normalize
from ..functions.text import catalog_identifier, compact_key, encode_component, fnv1a, shown_title, stable_id, telegram_post_key, title_author_key, url_key
from ..operators import aggregates as agg
from ..operators import joins, ordering
from ..operators.dedup import greedy
from ..operators.filters import facets, tokens_and
from ..operators.near import near_links, near_pairs
from ..operators.report import cell, constraints, markdown_rows
from ..operators.rules import Rule, all_matches, first_match, score
from ..operators.shared import dealt, written
from ..operators.substring_index import SubstringIndex
from ..operators.temporal import as_of, interval_join
from ..sources.sinks import trim_log
from ..streaming import telemetry

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


LINE = "split_part(text, chr(10), 1)"
TEXT_KEY = duckdb_latin("text")


def lines(spark, sf) -> DataFrame:
    """Documents by their first line, as the title, with its Latin key."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    return d.withColumn("key", normalize(F.col("title"), LATIN))


def texts(spark, sf) -> DataFrame:
    """Documents by their whole text, with its Latin key; ``lines`` has only the first line."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", F.col("text").alias("title"))
    return d.withColumn("key", normalize(F.col("title"), LATIN))


def digests(spark, sf) -> DataFrame:
    """The same for operators that only compare: digests in place of long texts, written once; empty ones stay empty."""
    short = lambda c: F.when(F.col(c) == "", "").otherwise(F.sha2(c, 256))
    return written(texts(spark, sf).withColumns({"title": short("title"), "key": short("key")}), "keys")[0]


@query(f"select doc_id, {TEXT_KEY} as key, length({TEXT_KEY}) as n from documents")
def normalize_text(spark, sf):
    return texts(spark, sf).select("doc_id", "key", F.length("key").cast("long").alias("n"))


@query(f"select doc_id, source from documents where contains({duckdb_latin('text')}, 'the') and contains({duckdb_latin('text')}, 'tion') and contains({duckdb_latin('text')}, 'ou')")
def search_tokens_and(spark, sf):
    d = table(spark, sf, "documents").withColumn("search_key", normalize(F.col("text"), LATIN))
    return d.filter(tokens_and(F.col("search_key"), "The TION, ou!", LATIN)).select("doc_id", "source")


@query(f"select doc_id, source from documents where contains({duckdb_latin('text')}, 'nding') and contains({duckdb_latin('text')}, 'tion') and contains({duckdb_latin('text')}, 'ou')")
def search_by_index(spark, sf):
    """Substring search that reads the posting lists of its trigrams, and the texts of the documents that they leave."""
    d = written(table(spark, sf, "documents").select("doc_id", "source", normalize(F.col("text"), LATIN).alias("search_key")), "keys")[0]
    return SubstringIndex.build(d, "doc_id", "search_key").search(d, "doc_id", "search_key", ["nding", "tion", "ou"]).select("doc_id", "source")


CATS = "(case doc_id % 5 when 0 then 'diwans' when 1 then 'references' when 2 then 'dictionaries' when 3 then 'scientific_poems' else 'academies' end)"


def catalog(spark, sf) -> DataFrame:
    """Documents shaped as catalog records."""
    names = F.array(*map(F.lit, ("diwans", "references", "dictionaries", "scientific_poems", "academies")))
    d = lines(spark, sf)
    return d.select(
        F.col("doc_id").cast("string").alias("id"), "title", "lang", "source", "key", F.col("doc_id").alias("ord"), F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")).alias("primaryCategory"),
        F.array(F.col("lang"), F.when(F.col("n_chars") > 2000, "long").otherwise("short")).alias("tags"), (F.col("n_chars") > 1000).alias("signed"),
    )


@query(f"""with c as (select {CATS} as cat, source, n_chars from documents)
select 'all' as name, count(*) as n from c union all
select 'diwans', count(*) filter (where cat = 'diwans' and n_chars > 1000 and source <> 'src3') from c union all
select 'scientific_poems', count(*) filter (where cat = 'scientific_poems' or (cat = 'diwans' and source = 'src3')) from c union all
select 'references', count(*) filter (where cat = 'references') from c union all
select 'bilingual', count(*) filter (where cat in ('dictionaries', 'references') and source in ('src1', 'src2')) from c""")
def category_counts_overlapping(spark, sf):
    cat, poem = F.col("primaryCategory"), None
    poem = (cat == "scientific_poems") | ((cat == "diwans") & (F.col("source") == "src3"))
    return agg.filtered_counts(catalog(spark, sf), {
        "all": F.lit(True), "diwans": (cat == "diwans") & F.col("signed") & ~poem, "scientific_poems": poem, "references": cat == "references",
        "bilingual": cat.isin("dictionaries", "references") & F.col("source").isin("src1", "src2"),
    })


@query("""select 'all' as name, count(*) as n from documents union all
select 'romance', count(*) filter (where lang in ('fr', 'es')) from documents union all
select 'long_or_german', count(*) filter (where lang = 'de' or n_chars > 2000) from documents union all
select 'none', count(*) filter (where false) from documents""")
def stat_cards(spark, sf):
    from ..operators.filters import any_tag

    return agg.filtered_counts(catalog(spark, sf), {"all": F.lit(True), "romance": any_tag(("fr", "es")), "long_or_german": any_tag(("de", "long")), "none": any_tag(("xx",))})


@query("""with d as (select * from documents where not (n_chars > 2000 and doc_id % 3 = 0))
select 'lang' as dimension, lang as value, count(*) as n from d group by 2 union all select 'source', source, count(*) from d group by 2
union all select 'category', 'short', count(*) from d where n_chars < 500 having count(*) > 0 union all select 'category', 'german', count(*) from d where lang = 'de' having count(*) > 0""")
def incremental_counts(spark, sf):
    """All documents come in four changes, and the long ones of every third id go again; counts follow the changes."""
    from .incremental import Counts

    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    counts = Counts(spark, ("lang", "source"), {"short": F.col("n_chars") < 500, "german": F.col("lang") == "de"})
    gone = d.filter("n_chars > 2000 and doc_id % 3 = 0")
    for k in range(4):
        part = F.pmod("doc_id", F.lit(4)) == k
        late = F.pmod("doc_id", F.lit(4)) == (k - 1) % 4
        counts.apply(k + 1, d.filter(part), gone.filter(late) if k else None)
    counts.apply(5, None, gone.filter(F.pmod("doc_id", F.lit(4)) == 3))
    return counts.table()


CHOSEN = {"p_brand": "Brand#11", "p_type": "all", "p_size": "999"}


@query("""with z as (select 'p_brand' as dimension, p_brand as value, count(*) as n from part where p_size = 999 group by 2
union all select 'p_type', p_type, count(*) from part where p_brand = 'Brand#11' and p_size = 999 group by 2
union all select 'p_size', cast(p_size as varchar), count(*) from part where p_brand = 'Brand#11' group by 2
union all select 'p_brand', 'Brand#11', 0 union all select 'p_size', '999', 0)
select dimension, value, cast(sum(n) as bigint) as n from z group by 1, 2""")
def facet_exclude_self(spark, sf):
    return agg.facet_counts(table(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("string")), CHOSEN)


@query("select p_partkey from part where p_size = 7 and p_type like '%'")
def facet_filter(spark, sf):
    return table(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("string")).filter(facets({"p_size": "7", "p_type": "all"})).select("p_partkey")


@query("select coalesce(nullif(trim(case when n_chars % 3 = 0 then '  ' else lang end), ''), 'غير محدد') as value, count(*) as n from documents group by 1")
def unspecified_default(spark, sf):
    d = table(spark, sf, "documents").withColumn("v", F.when(F.col("n_chars") % 3 == 0, "  ").otherwise(F.col("lang")))
    return agg.histogram(d, F.col("v"), "غير محدد")


@query("select c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)")
def semi_allow_list(spark, sf):
    from ..operators.filters import keep_listed

    return keep_listed(table(spark, sf, "customer"), "c_nationkey", table(spark, sf, "nation").filter("n_regionkey = 1").select("n_nationkey")).select("c_custkey")


UNION_CTE = f"""with d as (select doc_id, doc_id % 4 as b, nullif(text, '') as t, nullif({TEXT_KEY}, '') as k from documents),
b0 as (select * from d where b = 0),
b1 as (select * from d x where b = 1 and not exists (select 1 from b0 y where y.t = x.t)), a1 as (select * from b0 union all select * from b1),
b2 as (select * from d x where b = 2 and not exists (select 1 from a1 y where y.t = x.t) and not exists (select 1 from a1 y where y.k = x.k)), a2 as (select * from a1 union all select * from b2),
b3 as (select * from d x where b = 3 and not exists (select 1 from a2 y where y.k = x.k)) select doc_id, b from a2 union all select doc_id, b from b3"""


@query(UNION_CTE)
def prioritized_union(spark, sf):
    d = digests(spark, sf).withColumn("b", F.col("doc_id") % 4)
    title, key = {"title": F.col("title")}, {"key": F.col("key")}
    return joins.prioritized_union([d.filter(F.col("b") == k) for k in range(4)], [{}, title, title | key, key]).select("doc_id", "b")


LINE_KEY = duckdb_latin(LINE)
#: Distinct compact titles and their rows; a title allows two edits, or one to three by its length.
TITLES_SQL = f"""d as (select doc_id, replace({LINE_KEY}, ' ', '') as c from documents), m as (select * from d where c <> ''),
t as materialized (select c, min(doc_id) as class_id, count(*) as n, length(c) as z from m group by c)"""
NEAR_SQL = {
    kind: f"""o as materialized (select a.class_id as x, b.class_id as y, a.c as ac, b.c as bc, b.n, {most} as k from t a join t b on a.z >= 18 and abs(a.z - b.z) <= {most} and a.class_id <> b.class_id),
p as materialized (select x, y, n, k, levenshtein(ac, bc) as distance from o where levenshtein(ac, bc) <= k)"""
    for kind, most in (("fixed", "2"), ("adaptive", "(case when a.z >= 42 then 3 when a.z >= 25 then 2 else 1 end)"))
}
PAIRS_SQL = "select a.doc_id as left_id, b.doc_id as right_id, distance from p join t s on s.class_id = x join t q on q.class_id = y join m a on a.c = s.c join m b on b.c = q.c union all select a.doc_id, b.doc_id, 0 from m a join m b on a.c = b.c and a.doc_id <> b.doc_id where length(a.c) >= 18"


def all_near(spark, sf, adaptive: bool) -> DataFrame:
    d = lines(spark, sf)
    return near_pairs(d, d, "doc_id", "doc_id", "key", adaptive).filter("left_id <> right_id")


@query(f"with {TITLES_SQL}, {NEAR_SQL['fixed']} {PAIRS_SQL}")
def near_title_pairs_fixed(spark, sf):
    """The titles of all documents with those of all others, as pairs of rows; ``near_title_links`` says the same in one row a document."""
    return all_near(spark, sf, False)


@query(f"with {TITLES_SQL}, {NEAR_SQL['adaptive']} {PAIRS_SQL}")
def near_title_pairs_adaptive(spark, sf):
    return all_near(spark, sf, True)


@query(f"with {TITLES_SQL}, {NEAR_SQL['adaptive']} select x as left_class, y as right_class, distance from p")
def near_title_classes(spark, sf):
    """Pairs of different near titles, each named by the least document that has it."""
    return near_links(lines(spark, sf), "doc_id", "key", True)[0]


@query(f"""with {TITLES_SQL}, {NEAR_SQL['adaptive']}, w as (select x, sum(n) as n_near from p group by x)
select m.doc_id, t.class_id, t.n as n_copies, cast((case when z >= 18 then t.n - 1 else 0 end) + coalesce(n_near, 0) as bigint) as n_links from m join t using (c) left join w on x = t.class_id""")
def near_title_links(spark, sf):
    """Each document's title class, its copies and how many other documents have its title or one near to it."""
    return near_links(lines(spark, sf), "doc_id", "key", True)[1].withColumnRenamed("id", "doc_id")


@query(f"""with recursive {TITLES_SQL}, {NEAR_SQL['fixed']},
f as (select doc_id, {LINE} as title, n_chars::varchar || lang as u, row_number() over (order by doc_id) as r from documents),
e as (select f.r, g.r as b, case when x.title = g.title and x.title <> '' then 1 else 2 end as why from f x join f g on g.r < x.r and ((x.title = g.title and x.title <> '') or x.u = g.u) join f on f.r = x.r
  union all select f.r, g.r, 0 from m a join t s on s.c = a.c join p on p.x = s.class_id join t q on q.class_id = p.y join m b on b.c = q.c join f on f.doc_id = a.doc_id join f g on g.doc_id = b.doc_id where g.r < f.r
  union all select f.r, g.r, 0 from m a join m b on a.c = b.c and length(a.c) >= 18 join f on f.doc_id = a.doc_id join f g on g.doc_id = b.doc_id where g.r < f.r),
w as (select f.r, coalesce(list(b) filter (b is not null), []) as before from f left join e on e.r = f.r group by f.r),
k(i, kept) as (select 0::bigint, []::bigint[] union all select w.r, case when list_has_any(kept, before) then kept else list_append(kept, w.r) end from k join w on w.r = i + 1),
l as (select kept from k order by i desc limit 1),
z as (select e.r, min(why) as why from e, l where list_contains(kept, e.b) group by e.r)
select f.doc_id, z.r is null as kept, case why when 0 then 'near' when 1 then 'title' when 2 then 'size' end as reason from f left join z using (r)""")
def greedy_dedup(spark, sf):
    d = lines(spark, sf).withColumn("u", F.concat(F.col("n_chars").cast("string"), F.col("lang")))
    return greedy(d, {"title": F.col("title"), "size": F.col("u")}, "key", ord_="doc_id").select("doc_id", "kept", "reason")


@query("select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id, min(event_id) as first_id from events group by user_id")
def last_wins_upsert(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type").withColumn("first_id", F.col("event_id"))
    return agg.last_wins(e, "user_id", "event_id", "first_id").select("user_id", "event_type", "event_id", "first_id")


WORKS_SQL = """r as (select 'a' || s_suppkey as id, s_name as title, s_nationkey as identity, 'Internet Archive' as source, s_suppkey % 9 as u, s_suppkey * 2 + 1 as ord from supplier
union all select 'c' || c_custkey, c_name, c_nationkey, 'catalog', c_custkey % 9, c_custkey * 2 from customer)"""


def works(spark, sf) -> DataFrame:
    """Suppliers and customers as records of two sources, by nation."""
    a = table(spark, sf, "supplier").select(F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("title"), F.col("s_nationkey").alias("identity"), F.lit("Internet Archive").alias("source"), (F.col("s_suppkey") % 9).alias("u"), (F.col("s_suppkey") * 2 + 1).alias("ord"))
    b = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("title"), F.col("c_nationkey").alias("identity"), F.lit("catalog").alias("source"), (F.col("c_custkey") % 9).alias("u"), (F.col("c_custkey") * 2).alias("ord"))
    return a.unionByName(b).withColumn("author", F.col("title")).withColumn("sourceUrl", F.col("u").cast("string")).withColumn("volumes", F.lit(None).cast("int")).withColumn("pages", F.lit(None).cast("int"))


@query(f"with {WORKS_SQL} select identity, arg_min(id, (case when source = 'Internet Archive' then 0 else 1 end) * 1000000000 + ord) as id, cast(count(distinct u) as int) as sourceCount, cast(count(*) as int) as merged, min(ord) as ord from r group by identity")
def merge_identity(spark, sf):
    return agg.merge_tables(works(spark, sf)).records.select("identity", "id", F.col("sourceCount").cast("int").alias("sourceCount"), F.col("mergedCount").cast("int").alias("merged"), "ord")


@query(f"with {WORKS_SQL} select identity, cast(u as varchar) as url, arg_min(source, ord) as source, min(ord) as ord from r group by identity, u")
def merge_references(spark, sf):
    """Each identity's references, distinct by address, the first of each: a table, not a list in the record."""
    return agg.merge_tables(works(spark, sf)).references


@query(f"with {WORKS_SQL} select identity, id, ord from r")
def merge_members(spark, sf):
    return agg.merge_tables(works(spark, sf)).members


def text_keys(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.sha2("text", 256).alias("text_key"), "doc_id")


@query("select sha256(text) as text_key, count(*) as n from documents group by text having count(*) > 1")
def duplicate_group_counts(spark, sf):
    return agg.duplicate_values(text_keys(spark, sf), "text_key")


@query("select sha256(text) as text_key, doc_id from documents where text in (select text from documents group by text having count(*) > 1)")
def duplicate_group_members(spark, sf):
    """One row per member: no list of a group is gathered anywhere."""
    d = text_keys(spark, sf)
    return d.join(agg.duplicate_values(d, "text_key").select("text_key"), "text_key", "left_semi").select("text_key", "doc_id")


@query(f"select {TEXT_KEY} as key, count(*) as n from documents group by 1 having count(*) > 1")
def duplicate_values(spark, sf):
    return agg.duplicate_values(texts(spark, sf), "key")


@query(f"select count({TEXT_KEY}) - count(distinct {TEXT_KEY}) as duplicates from documents")
def duplicate_count(spark, sf):
    return agg.duplicate_count(digests(spark, sf), "key")


@query("select source, count(*) as n, min(doc_id) as first from documents group by source")
def count_by_reason(spark, sf):
    return agg.count_by(table(spark, sf, "documents"), "source", "doc_id")


@query("select v.value, count(e.event_id) as n from (values ('click'), ('view'), ('refund'), ('error')) v(value) left join events e on e.event_type = v.value group by 1")
def fixed_key_counts(spark, sf):
    return agg.fixed_counts(table(spark, sf, "events"), "event_type", ["click", "view", "refund", "error"])


@query(f"select tag, count(*) as n from (select unnest(list_distinct(string_split({TEXT_KEY}, ' '))) as tag from documents) group by tag")
def tag_explode_counts(spark, sf):
    return agg.tag_counts(texts(spark, sf).select(F.array_distinct(F.split("key", " ")).alias("tags")))


@query("select lang, doc_id from documents qualify row_number() over (partition by lang order by n_chars desc, doc_id) <= 5")
def sample_per_group(spark, sf):
    return ordering.first_per_group(table(spark, sf, "documents"), ["lang"], 5, F.col("n_chars").desc(), F.col("doc_id")).select("lang", "doc_id")


@query("select p_partkey, p_name from part order by p_retailprice, p_partkey limit 12 offset 24")
def page_slice(spark, sf):
    return ordering.page(table(spark, sf, "part"), 3, "p_retailprice", "p_partkey").rows.select("p_partkey", "p_name")


@query("select p_partkey, row_number() over (order by case when p_size = 7 then 0 else 1 end, p_partkey) - 1 as row_number from part")
def stable_priority_sort(spark, sf):
    p = table(spark, sf, "part").withColumn("first", F.when(F.col("p_size") == 7, 0).otherwise(1))
    return ordering.row_numbers(p, "first", "p_partkey").select("p_partkey", F.col("row_number").cast("long").alias("row_number"))


@query("select n_name, row_number() over (order by n_name) as place from nation")
def collation_rank(spark, sf):
    from pyspark.sql import Window

    # 25 rows by definition of the table
    return table(spark, sf, "nation").select("n_name", F.row_number().over(Window.orderBy(ordering.collated(F.col("n_name")))).cast("long").alias("place"))


@query("""select p_partkey, h from (select p_partkey, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(p_name, ''), lambda c: ord(c)::bigint)), lambda h, c: ((xor(h, c)::hugeint * 16777619) % 4294967296)::bigint) as h from part) where h % 37 = 0""")
def hash_sample_fnv(spark, sf):
    return ordering.hash_sample(table(spark, sf, "part"), "p_name", most=None).select("p_partkey", fnv1a(F.col("p_name")).alias("h"))


@query("""with n as (select greatest(1, count(*) // 40) as stride from documents), r as (select doc_id, row_number() over (order by doc_id) - 1 as k from documents)
select doc_id from r, n where k % stride = 0 and k < stride * 40""")
def systematic_sample(spark, sf):
    return ordering.systematic_sample(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("""select doc_id, array_to_string(list_filter([case when contains(text, '$') then 'symbols' end, case when n_chars > 2000 then 'long' end, case when lang = 'de' then 'german' end, case when n_chars > 5000 then 'long' end], lambda x: x is not null).list_distinct().list_sort(), '|') as tags from documents""")
def multi_label(spark, sf):
    d = table(spark, sf, "documents")
    tags = all_matches([Rule(F.col("text").contains("$"), "symbols"), Rule(F.col("n_chars") > 2000, "long"), Rule(F.col("lang") == "de", "german"), Rule(F.col("n_chars") > 5000, "long")])
    return d.select("doc_id", F.array_join(F.sort_array(tags), "|").alias("tags"))


@query("select doc_id, (case when contains(text, '$') then -10 else 0 end) + (case when n_chars > 2000 then 4 else 0 end) + (case when lang = 'en' then 6 else 0 end) as score from documents")
def score_sum(spark, sf):
    s = score([Rule(F.col("text").contains("$"), -10), Rule(F.col("n_chars") > 2000, 4), Rule(F.col("lang") == "en", 6)])
    return table(spark, sf, "documents").select("doc_id", s.alias("score"))


@query("""select d.doc_id, case when d.text = '' then 'empty' when l.toxic = 1 then 'toxic' when l.quality = 0 then 'junk' when d.n_chars < 200 then 'short' else 'accepted' end as reason from documents d left join labels l using (doc_id)""")
def decision_cascade(spark, sf):
    d = joins.lookup(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")
    rules = [Rule(F.col("text") == "", "empty"), Rule(F.col("toxic") == 1, "toxic"), Rule(F.col("quality") == 0, "junk"), Rule(F.col("n_chars") < 200, "short")]
    return d.select("doc_id", first_match(rules, "accepted").alias("reason"))


@query("""with x as (select case when l.toxic = 1 then 'rejected' when d.n_chars < 200 then 'duplicate' when l.quality = 0 then 'failed' else 'accepted' end as s from documents d left join labels l using (doc_id))
select count(*) as input, count(*) filter (where s = 'accepted') as accepted, count(*) filter (where s = 'rejected') as rejected, count(*) filter (where s = 'duplicate') as duplicates, count(*) filter (where s = 'failed') as failed, true as balanced from x""")
def decision_audit(spark, sf):
    d = joins.lookup(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")
    status = first_match([Rule(F.col("toxic") == 1, "rejected"), Rule(F.col("n_chars") < 200, "duplicate"), Rule(F.col("quality") == 0, "failed")], "accepted")
    return agg.audit(d.withColumn("status", status))


@query(f"select doc_id, 'ddl-title-' || left(sha256({TEXT_KEY}), 18) as id from documents")
def stable_ids(spark, sf):
    return texts(spark, sf).select("doc_id", stable_id(F.col("key")).alias("id"))


@query("""select page_id, regexp_replace(trim(url), '/+$', '') as url_key, nullif(regexp_extract(url, '(?i)^https?://([^/]+)', 1), '') as host, cast(null as varchar) as post, replace(url_encode(regexp_extract(url, '([^/]*)$', 1)), '%20', '%20') as encoded from pages""")
def url_keys(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", url_key(F.col("url")).alias("url_key"), F.nullif(F.regexp_extract("url", "(?i)^https?://([^/]+)", 1), F.lit("")).alias("host"), telegram_post_key(F.col("url")).alias("post"), encode_component(F.regexp_extract("url", "([^/]*)$", 1)).alias("encoded"))


@query("select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) as text from pages")
def html_fields(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\n\r\f\x0B]+", " ")).alias("text"))


@query("""with t as (select doc_id, (case when doc_id % 3 = 0 then '00012_' || cast(doc_id as varchar) || '-' when doc_id % 3 = 1 then cast(doc_id + 10000 as varchar) || ' _' else '' end) || split_part(text, chr(10), 1) as title from documents)
select doc_id, nullif(regexp_extract(title, '^(\\d{4,})(?:[_\\s-]+|$)', 1), '') as identifier, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(title, '^\\d{4,}[_\\s-]+', ''), '_', ' ', 'g'), '\\s+', ' ', 'g')), ''), title) as shown from t""")
def title_clean(spark, sf):
    prefix = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("00012_"), F.col("doc_id").cast("string"), F.lit("-"))).when(F.col("doc_id") % 3 == 1, F.concat((F.col("doc_id") + 10000).cast("string"), F.lit(" _"))).otherwise("")
    t = lines(spark, sf).withColumn("title", F.concat(prefix, "title"))
    return t.select("doc_id", catalog_identifier(F.col("title")).alias("identifier"), shown_title(F.col("title")).alias("shown"))


@query("select doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as latin, length(regexp_replace(text, '[^0-9]', '', 'g')) as digits, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0.9 * length(regexp_replace(text, '[\\s\\d]', '', 'g')) as mostly_latin from documents")
def letter_ratio(spark, sf):
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    return table(spark, sf, "documents").select("doc_id", n("[A-Za-z]").alias("latin"), n("[0-9]").alias("digits"), (n("[A-Za-z]") > 0.9 * n(r"[^\s\d]")).alias("mostly_latin"))


@query(f"""with d as (select doc_id, list_filter(list_distinct(string_split({TEXT_KEY}, ' ')), lambda x: length(x) > 1) as t from documents)
select a.doc_id, len(list_intersect(a.t, b.t)) as overlap from d a join d b on b.doc_id = a.doc_id + 1""")
def token_overlap(spark, sf):
    from ..functions.text import token_overlap as overlap

    d = texts(spark, sf).select("doc_id", "key")
    other = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("key").alias("next"))
    return d.join(other, "doc_id").select("doc_id", overlap(F.col("key"), F.col("next")).cast("long").alias("overlap"))


@query("select d.doc_id, coalesce(l.quality, -1) as quality, case when l.toxic is null then 'unknown' when l.toxic = 1 then 'toxic' else 'clean' end as state from documents d left join labels l using (doc_id)")
def lookup_default(spark, sf):
    d = joins.lookup(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")
    return d.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.when(F.col("toxic").isNull(), "unknown").when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("state"))


@query(f"select count(*) as n from (select nullif({TEXT_KEY}, '') as k from documents where lang = 'en' intersect select nullif({TEXT_KEY}, '') from documents where lang <> 'en') where k is not null")
def set_intersections(spark, sf):
    d = digests(spark, sf)
    return joins.common_keys(d.filter("lang = 'en'"), d.filter("lang <> 'en'"), F.col("key"))


@query("select doc_id from documents where not (doc_id in (select doc_id from labels where quality = 0) and doc_id not in (select doc_id from labels where toxic = 1))")
def retraction(spark, sf):
    labels = table(spark, sf, "labels")
    return joins.retract(table(spark, sf, "documents").select("doc_id"), labels.filter("quality = 0").select("doc_id"), labels.filter("toxic = 1").select("doc_id"), "doc_id")


@query("""with r as (select conv_id, turn, text, sum(strlen(text) + 1) over (partition by role order by conv_id * 1000 + turn desc) as run, sum(strlen(text) + 1) over (partition by role) as size from conversations)
select conv_id, turn from r where size <= 20000 or run <= 12000""")
def log_retention(spark, sf):
    c = table(spark, sf, "conversations").withColumn("ord", F.col("conv_id") * 1000 + F.col("turn"))
    return trim_log(c, "text", "ord", ["role"], 20_000, 0.6).select("conv_id", "turn")


@query("select event_id, row_number() over (partition by user_id, event_type order by event_id) > 1 as seen from events")
def seen_before(spark, sf):
    return table(spark, sf, "events").select("event_id", ordering.seen_before(["user_id", "event_type"], "event_id").alias("seen"))


@query("""select event_id, case when props is null then null else '[REDACTED]' end as k from events""")
def redact_props(spark, sf):
    renamed = F.replace(F.col("props"), F.lit('"k"'), F.lit('"apiKey"'))
    return table(spark, sf, "events").select("event_id", F.try_element_at(telemetry.redact_flat(renamed), F.lit("apiKey")).alias("k"))


@query("""select event_id, case when event_type = 'view' then 'streaming' when value > 50 then 'too_large' when event_type = 'click' then 'binary' else 'text' end as class from events""")
def response_class(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "view", "text/event-stream").when(F.col("event_type") == "click", "image/png").otherwise("text/html")
    return e.select("event_id", telemetry.response_class(kind, F.when(F.col("value") > 50, 20_000).otherwise(10)).alias("class"))


@query("select event_id, 'network_error' as kind, cast(400 + event_id % 100 as int) as status from events where event_type = 'error'")
def derived_errors(spark, sf):
    e = table(spark, sf, "events").withColumn("status", F.when(F.col("event_type") == "error", 400 + F.col("event_id") % 100).otherwise(200).cast("int"))
    e = e.withColumn("error", F.lit(None).cast("string")).withColumn("method", F.col("event_id").cast("string")).withColumn("url", F.lit("https://example.org/"))
    return telemetry.network_errors(e).select(F.col("method").cast("long").alias("event_id"), "kind", "status")


@query("""with recursive e as (select event_id, user_id, epoch_ms(ts) as ms, row_number() over (partition by user_id order by ts, event_id) as r from events),
k as (select event_id, user_id, ms, r, ms as last, true as kept from e where r = 1 union all
select e.event_id, e.user_id, e.ms, e.r, case when e.ms - k.last >= 3600000 then e.ms else k.last end, e.ms - k.last >= 3600000 from e join k on e.user_id = k.user_id and e.r = k.r + 1)
select event_id from k where kept""")
def throttle_events(spark, sf):
    return telemetry.throttle(table(spark, sf, "events"), "user_id", "ts", "event_id", 3_600_000).select("event_id")


@query("""with i as (select o_custkey, o_orderkey, o_orderdate as a, max(l_shipdate) as z from orders join lineitem on l_orderkey = o_orderkey group by all)
select o.o_orderkey, i.o_orderkey as open_order from orders o join i on i.o_custkey = o.o_custkey and i.a <= o.o_orderdate and o.o_orderdate < i.z""")
def open_orders(spark, sf):
    """The customer's orders that are placed and not all shipped when an order comes in: points to the intervals that hold them."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"))
    shipped = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.unix_micros(F.max("l_shipdate").cast("timestamp")).alias("z"))
    i = o.join(dealt(shipped), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", F.col("o_orderkey").alias("open_order"), F.col("at").alias("a"), "z")
    return interval_join(o, i, ["o_custkey"], "at", "a", "z").select("o_orderkey", "open_order")


@query("""with v as (select * from events where event_type <> 'error'), e as (select * from events where event_type = 'error')
select e.event_id, arg_max(v.event_id, (v.ts, v.event_id)) as before from e left join v on v.user_id = e.user_id and v.ts <= e.ts group by e.event_id""")
def last_event_before_error(spark, sf):
    """Each error with the user's last other event up to it."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    other = e.filter("event_type <> 'error'").select("user_id", F.col("ts").alias("other_ts"), F.col("event_id").alias("before"))
    return as_of(e.filter("event_type = 'error'").select("event_id", "user_id", "ts"), other, ["user_id"], "ts", "other_ts", ["before"], "before").select("event_id", "before")


@query("select event_type, event_id from events qualify row_number() over (partition by event_type order by ts desc, event_id desc) <= 200")
def ring_buffer(spark, sf):
    return telemetry.newest(table(spark, sf, "events"), ["event_type"], 200, "ts", "event_id").select("event_type", "event_id")


@query("select cast(floor(epoch_us(ts) // 1000 / 2000) as bigint) as flush, event_type as stream, count(*) as n from events group by 1, 2")
def flush_batches(spark, sf):
    return table(spark, sf, "events").groupBy(telemetry.flush_number(F.col("ts").cast("timestamp")).alias("flush"), F.col("event_type").alias("stream")).agg(F.count("*").alias("n"))


@query("""with s as (select user_id, event_type, event_id, ts, length(props) as n, sum(length(props)) over (partition by user_id) as size, row_number() over (partition by user_id, case event_type when 'click' then 'console' when 'view' then 'network' else 'ui' end order by ts desc, event_id desc) as r, case event_type when 'click' then 50 when 'view' then 20 else 100 end as keep from events)
select event_id from s where size <= 60000 or r <= keep""")
def final_flush(spark, sf):
    e = table(spark, sf, "events").withColumn("stream", F.when(F.col("event_type") == "click", "console").when(F.col("event_type") == "view", "network").otherwise("ui"))
    return telemetry.final_flush(e, "user_id", "stream", "props", "ts", "event_id").select("event_id")


@query("""with t as (select conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from conversations) select conv_id, turn, case when length(t) > 80 then left(t, 80) || '...' else t end as text from t""")
def text_compact(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", telemetry.compact_text(F.col("text")).alias("text"))


@query("""select conv_id, turn, role = 'user' as masked, length(text) as length, case when role <> 'user' then left(text, 200) end as value from conversations""")
def mask_inputs(spark, sf):
    m = telemetry.mask_input(F.when(F.col("role") == "user", "authToken").otherwise("note"), F.lit("text"), F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", m["masked"].alias("masked"), m["length"].cast("long").alias("length"), m["value"].alias("value"))


@query("select 'positive' as name, count(*) filter (where not coalesce(p_retailprice > 0, false)) as failed from part union all select 'small', count(*) filter (where not coalesce(p_size <= 25, false)) from part")
def constraint_checks(spark, sf):
    return constraints(table(spark, sf, "part"), {"positive": F.col("p_retailprice") > 0, "small": F.col("p_size") <= 25})


@query("select p_partkey, '| ' || p_partkey || ' | ' || replace(p_name || '|x', '|', '\\|') || ' | — |' as line from part")
def markdown_lines(spark, sf):
    p = table(spark, sf, "part").withColumn("t", F.concat("p_name", F.lit("|x"))).withColumn("none", F.lit(None).cast("string"))
    return markdown_rows(p, "p_partkey", ["t", "none"])


@query("select p_brand, format('{:,}', count(*)) as shown, count(distinct p_type) as types from part group by p_brand")
def shown_counts(spark, sf):
    from ..operators.projections import shown_count

    return table(spark, sf, "part").groupBy("p_brand").agg(shown_count(F.count("*")).alias("shown"), F.count_distinct("p_type").alias("types"))


@query("select event_type, bool_and(value >= 0) as all_positive, bool_or(value > 99) as some_large from events group by 1")
def every_some(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(agg.every(F.col("value") >= 0).alias("all_positive"), agg.some(F.col("value") > 99).alias("some_large"))


@query(f"select doc_id, key, n_chars from (select doc_id, {TEXT_KEY} as key, n_chars, row_number() over (partition by {TEXT_KEY} order by n_chars % 7 desc, doc_id) as r from documents) where r = 1")
def keep_best_score(spark, sf):
    return agg.keep_best(texts(spark, sf).withColumn("s", F.col("n_chars") % 7), ["key"], "s", "doc_id").select("doc_id", "key", "n_chars")


@query(f"select doc_id, case when {TEXT_KEY} <> '' then {TEXT_KEY} || '::' || source end as key from documents")
def composite_keys(spark, sf):
    return texts(spark, sf).select("doc_id", title_author_key(F.col("key"), F.col("source")).alias("key"))


#: The catalog side is every labelled document, the other side all others: both grow with the tables.
SIDES = f"""with d as (select doc_id, doc_id in (select doc_id from labels) as old, nullif(text, '') as t, nullif({TEXT_KEY}, '') as k, cast(n_chars as varchar) as u, cast(n_chars as varchar) || lang as v from documents),
e as (select * from d where old), x as (select * from d where not old), h as (select doc_id, coalesce(t in (select t from e where t is not null), false) as by_t, coalesce(k in (select k from e where k is not null), false) as by_k, coalesce(u in (select u from e where u is not null), false) as by_u, coalesce(v in (select v from e where v is not null), false) as by_v from x)"""


def sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Documents without and with a label."""
    d, labels = digests(spark, sf), table(spark, sf, "labels").select("doc_id")
    return d.join(labels, "doc_id", "left_anti"), d.join(labels, "doc_id", "left_semi")


def by_keys(*names: str) -> dict:
    chars = F.col("n_chars").cast("string")
    return {n: {"title": F.col("title"), "key": F.col("key"), "chars": chars, "size": F.concat(chars, F.col("lang"))}[n] for n in names}


@query(f"{SIDES} select doc_id from h where not by_t and not by_k")
def anti_two_keys(spark, sf):
    return joins.anti_keys(*sides(spark, sf), by_keys("title", "key")).select("doc_id")


@query(f"{SIDES} select doc_id from h where not by_t and not by_k and not by_v")
def anti_three_keys(spark, sf):
    return joins.anti_keys(*sides(spark, sf), by_keys("title", "key", "size")).select("doc_id")


@query(f"{SIDES} select doc_id, case when by_u then 'chars' when by_t then 'title' when by_k then 'key' end as reason from h")
def first_reason(spark, sf):
    return joins.first_reason(*sides(spark, sf), by_keys("chars", "title", "key")).select("doc_id", "reason")


@query(f"{SIDES} select count(*) filter (where by_t) as by_title, count(*) filter (where by_u) as by_chars, count(*) filter (where by_t or by_u) as any_key, count(*) filter (where not (by_t or by_u)) as no_key from h")
def collision_tally(spark, sf):
    return joins.collision_tally(*sides(spark, sf), by_keys("title", "chars"))


@query("""with old as (select s_suppkey as id, s_name as name, s_suppkey as ord from supplier), new as (select c_custkey as id, upper(c_name) || '!' as name, row_number() over (order by c_custkey) - 1 as k from customer), m as (select max(ord) as last from old)
select id, name, ord from old where id not in (select id from new) union all select n.id, n.name, coalesce(o.ord, n.k + m.last + 1) from new n cross join m left join old o on o.id = n.id""")
def upsert_union(spark, sf):
    """All suppliers, then all customers."""
    from ..sources.sinks import upsert_in_order

    old = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"))
    new = ordering.row_numbers(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.upper("c_name"), F.lit("!")).alias("name")), "id", name="ord")
    return upsert_in_order(old, new, "id").select("id", "name", F.col("ord").cast("long").alias("ord"))


def assembly_sql() -> str:
    """All batches of the catalog one after another: id and url keys always, the normalised title where the batch lists it."""
    from .assemble import ORDER

    key = f"lower(trim(regexp_replace(title, '\\s+', ' ', 'g')))"
    ctes = [f"d as (select doc_id, doc_id % {len(ORDER)} as b, cast(doc_id % 701 as varchar) as id, case when doc_id % 5 > 0 then source || cast(n_chars % 97 as varchar) || lang else '' end as url, {LINE} as title from documents)", f"k as (select doc_id, b, nullif(id, '') as id, nullif(url, '') as url, nullif({key}, '') as title from d)", "a0 as (select * from k where b = 0)"]
    for i, batch in enumerate(ORDER[1:], 1):
        tests = " and ".join(f"({c} is null or {c} not in (select {c} from a{i - 1} where {c} is not null))" for c in batch.keys)
        ctes.append(f"a{i} as materialized (select * from a{i - 1} union all select * from k where b = {i} and {tests})")
    return f"with {', '.join(ctes)} select doc_id, b from a{len(ORDER) - 1}"


@query(assembly_sql())
def catalog_assembly(spark, sf):
    """The catalog's whole order of batches."""
    from .assemble import ORDER, assemble

    d = table(spark, sf, "documents").select(
        "doc_id", (F.col("doc_id") % len(ORDER)).alias("b"), (F.col("doc_id") % 701).cast("string").alias("id"),
        F.when(F.col("doc_id") % 5 > 0, F.concat("source", (F.col("n_chars") % 97).cast("string"), "lang")).otherwise("").alias("sourceUrl"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
    )
    return assemble({batch.name: d.filter(F.col("b") == k) for k, batch in enumerate(ORDER)}).select("doc_id", "b")


@query("with r as (select mod(conv_id, 3) as log, conv_id, turn, sum(strlen(text) + 1) over (partition by mod(conv_id, 3) order by conv_id, turn) as run from conversations) select conv_id, turn, cast(run as bigint) as run from r")
def running_sums(spark, sf):
    c = table(spark, sf, "conversations").withColumn("log", F.col("conv_id") % 3)
    return ordering.running_sum(c, F.octet_length("text") + 1, ["log"], F.col("conv_id"), F.col("turn"), name="run").select("conv_id", "turn", F.col("run").cast("long").alias("run"))
