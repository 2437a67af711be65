"""The catalog's rules, normalisers and predicates on Arabic records, each with the SQL that must give the same rows.

The test tables hold no Arabic text, so every document carries one of the
records below (by its id) and, in its titles, its own source. The SQL states the
rules again, over regular expressions of another engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import packs
from ..functions import text as T
from ..functions.regexjs import SPACES
from ..operators import aggregates as agg
from ..operators import early_rules, filters, joins, ordering, projections, rules
from ..streaming import telemetry
from . import search
from .queries import query, table

FIELDS = ("title", "archive_title", "identifier", "url", "error", "language", "subject", "description", "creator", "category")
#: Invented records that meet the rules in different ways.
RECORDS = (
    ("كتاب النحو الواضح في قواعد اللغة العربية", "النحو الواضح", "nahw1", "https://archive.org/details/nahw1", None, ["ara"], "نحو وصرف", "كتاب في قواعد اللغة العربية", "علي الجارم", "النحو والإعراب"),
    ("ديوان المتنبي", "ديوان أبي الطيب المتنبي", "d2", "https://archive.org/details/d2", None, ["Arabic"], "شعر عربي", "ديوان المتنبي مجموعة شعرية", "أحمد المتنبي", "البلاغة والأسلوبية"),
    ("أساس البلاغة", None, "b3", "http://archive.org/details/b3", None, ["ara"], "بلاغة", "معجم في اللغة العربية", "الزمخشري", "البلاغة والأسلوبية"),
    ("لسان العرب معجم لغوي", "Lisan", "m4", "https://archive.org/details/m4", None, ["Arabic"], "معجم اللغة العربية", "معجم لغوي شامل", "ابن منظور", "المعاجم والقواميس"),
    ("شذا العرف في فن الصرف", "", "s5", "https://archive.org/details/s5", None, ["العربية"], "صرف", "تصريف الأفعال", "الحملاوي", "الصرف والاشتقاق"),
    ("English Grammar", "English Grammar", "e6", "https://archive.org/details/e6", None, ["eng"], "grammar", "a book", "Smith", "x"),
    ("مذكرة مراجعة النحو للصف الثالث اختبار", None, "w7", "https://archive.org/details/w7", None, ["ara"], "نحو", "مراجعة", "معلم", "النحو والإعراب"),
    ("قواعد اللغة الفارسية للمبتدئين", None, "f8", "https://archive.org/details/f8", None, ["per"], "لغة فارسية", "الأدب الفارسي", "مؤلف", "x"),
    ("معجم المصطلحات الطبية", None, "t9", "https://archive.org/details/t9", None, ["ara"], "معجم طبي", "طب", "طبيب", "المعاجم والقواميس"),
    ("بلاغة القرآن الكريم", None, "n10", "https://archive.org/details/n10", "timeout", ["ara"], "بلاغة", "بلاغة", "كاتب", "البلاغة والأسلوبية"),
    ("النحو الوافي", None, None, "https://archive.org/details/n11", None, ["ara"], "نحو", "نحو", "عباس حسن", "النحو والإعراب"),
    ("علم العروض والقافية", None, "a12", "https://example.org/a12", None, ["ara"], "عروض", "علم العروض في الشعر العربي", "عتيق", "x"),
    ("تاريخ مصر الحديث", None, "h13", "https://archive.org/details/h13", None, ["ara"], "تاريخ", "تاريخ مصر", "الرافعي", "x"),
    ("ديوان الحماسة لأبي تمام شرح التبريزي", "ديوان الحماسة", "d14", "https://archive.org/details/d14", None, ["ara"], "شعر", "شرح ديوان الحماسة", "أبو تمام", "x"),
    ("قصائد مختارة الجزء الأول", "قصائد", "q15", "https://archive.org/details/q15", None, ["ara"], "شعر", "ديوان شعري قصائد مختارة الجزء الأول من قصائد الشاعر", "نزار قباني", "x"),
    ("اشعار العشاق", "أشعار العشاق", "q16", "https://archive.org/details/q16", None, ["ara", "eng"], "مجموعة شعرية اشعار العشاق", "مجموعه شعريه تضم اشعار العشاق للشاعر", "محمود درويش", "x"),
    ("رسالة ماجستير في البلاغة العربية", None, "r17", "https://archive.org/details/r17", None, ["ara"], "رسالة علمية بلاغة", "جامعة", "باحث", "البلاغة والأسلوبية"),
    ("أطروحة دكتوراه في النقد الادبي", None, "r18", "https://archive.org/details/r18", None, [], "نقد", "في اللغة العربية وآدابها", "باحثة", "x"),
    ("زراعة الشعر بالليزر", None, "x19", "https://archive.org/details/x19", None, ["ara"], "طب", "زراعة الشعر", "طبيب", "x"),
    ("دراسة في الهندسة المدنية", None, "x20", "https://archive.org/details/x20", None, ["ara"], "هندسة", "الهندسة", "مهندس", "x"),
    ("١٢٣ كـتـابٌ جديدٌ (مُشَكَّل)، ط.١", "كتاب أقسام الكلام", "y21", "https://archive.org/details/y21/", None, None, None, None, None, "النحو والإعراب"),
    ("أقسام الكلام", None, "y22", "https://archive.org/details/y22", None, ["ara"], "نحو", None, "", "النحو والإعراب"),
    ("اللغة الشاعرة", "اللغة_الشاعرة", "y23", "https://archive.org/details/y23", None, ["ara"], "لغة", "العقاد", "العقاد", "علم الدلالة"),
    ("", "", "z24", "https://archive.org/details/z24", None, ["ara"], "", "", "", "x"),
    ("ديوان الوزارة سجل إداري pdf", "ديوان الوزارة", "g25", "https://archive.org/details/g25", None, ["ara"], "ادارة", "سجل", "وزارة", "x"),
    ("ديوان أحمد شوقي تحقيق محمد", "ديوان شوقي", "g26", "https://archive.org/details/g26", None, ["ara"], "شعر", "ديوان أحمد شوقي أمير الشعراء وقصائده الكاملة", "شوقي (1868-1932)", "x"),
    ("ٱلبيان والتبيين مؤلَّف إنشائيّ فيه ؤ ئ ى ة", "البيان", "g27", "https://t.me/Arsail2020/77/", None, ["ara"], "أدب", "الجاحظ", "الجاحظ", "تعليم العربية واللسانيات التطبيقية"),
    ("كتاب الأغاني المجلد الثالث", "الأغاني", "g28", "https://archive.org/details/g28", None, ["ara", "Arabic"], "أدب", "شعر وأخبار", "الأصفهاني", "x"),
    ("الغريب المصنف في اللغة", "الغريب", "g29", "https://archive.org/details/g29", None, ["ara"], "معجم", "غريب اللغة العربية", "أبو عبيد", "المعاجم والقواميس"),
)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _value(v) -> str:
    if v is None:
        return "null"
    return f"[{', '.join(map(q, v))}]::varchar[]" if isinstance(v, list) else q(v)


_VALUES = ", ".join(f"({k}, {', '.join(map(_value, r))})" for k, r in enumerate(RECORDS))
#: Relation x: one row per document. ``raw`` is the record's title; ``title`` ends with the document's source for every seventh document.
BASE = f"""s(k, raw, {', '.join(FIELDS[1:])}) as (values {_VALUES}),
x as (select d.doc_id, d.source as src, d.lang as lang, raw || case when d.doc_id % 7 = 0 then ' ' || d.source else '' end as title, s.* from documents d join s on s.k = d.doc_id % {len(RECORDS)})"""


def records(spark, sf) -> DataFrame:
    schema = "k long, raw string, archive_title string, identifier string, url string, error string, language array<string>, subject string, description string, creator string, category string"
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(RECORDS)], schema)
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("src"), "lang", (F.col("doc_id") % len(RECORDS)).alias("k"))
    return d.join(F.broadcast(rows), "k").withColumn("title", F.concat("raw", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(" "), "src")).otherwise("")))


def on_records(name: str, columns: dict[str, tuple[Callable[[], Column], str]], where: tuple[Callable[[], Column], str] | None = None) -> None:
    """Register a query over the records: of each column its expression and its SQL."""

    def run(spark, sf):
        df = records(spark, sf)
        df = df.filter(where[0]()) if where else df
        return df.select("doc_id", *(c().alias(k) for k, (c, _) in columns.items()))

    run.__name__ = name
    query(f"with {BASE} select doc_id, {', '.join(f'{s} as {k}' for k, (_, s) in columns.items())} from x" + (f" where {where[1]}" if where else ""))(run)


# SQL of the building blocks
WS = f"[{SPACES}]"


def sql_squeeze(c: str) -> str:
    return f"trim(regexp_replace({c}, {q(WS + '+')}, ' ', 'g'))"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def sql_normalize(c: str, p: N.Profile) -> str:
    """A profile for text that is its own NFKC form."""
    out = f"lower({c})" if p.lower_first else c
    out = sql_squeeze(out) if p.squeeze_first else out
    if p.delete:
        out = f"regexp_replace({out}, {q(f'[{p.delete}]')}, '', 'g')"
    if p.fold:
        out = f"translate({out}, {q(''.join(a for a, _ in p.fold))}, {q(''.join(b for _, b in p.fold))})"
    if p.delete_after:
        out = f"regexp_replace({out}, {q(f'[{p.delete_after}]')}, '', 'g')"
    if p.blank:
        out = f"regexp_replace(regexp_replace({out}, {q(WS)}, ' ', 'g'), {q(p.blank)}, ' ', 'g')"
    return f"lower({sql_squeeze(out)})"


def sql_test(c: str, rule: tuple[str, str]) -> str:
    flags = "i" if "i" in rule[1] else "c"
    pattern = re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", rule[0])
    return f"coalesce(regexp_matches({c}, {q(pattern)}, '{flags}'), false)"


def sql_any(c: str, pack: dict, *names: str) -> str:
    return sql_test(c, ("|".join(f"(?:{pack[n][0]})" for n in names), "i"))


def sql_steps(c: str, steps: Iterable[tuple[str, str, str]]) -> str:
    for pattern, flags, new in steps:
        c = f"regexp_replace({c}, {q(pattern)}, {q(new.replace("$1", r"\1"))}, '{'gi' if 'i' in flags else 'g'}')"
    return c


def sql_join(*c: str) -> str:
    return f"concat_ws(' ', {', '.join(c)})"


def sql_tags(rules_: Iterable[tuple[str, str]]) -> str:
    """Distinct values of the conditions that hold, in order, as a list; repeats are left out by the callers' rules."""
    return f"list_filter([{', '.join(f'case when {c} then {q(v)} end' for c, v in rules_)}], lambda v: v is not null)"


def sql_first(rules_: Iterable[tuple[str, str]], other: str = "null") -> str:
    return f"case {' '.join(f'when {c} then {q(v)}' for c, v in rules_)} else {other} end"


def sql_arabic_title(c: str) -> str:
    letters = f"length(regexp_replace({c}, '[^\\x{{0621}}-\\x{{063A}}\\x{{0641}}-\\x{{064A}}]', '', 'g'))"
    return f"coalesce({letters} >= 6 and {letters} > length(regexp_replace({c}, '[^A-Za-z]', '', 'g')), false)"


def sql_arabic_text(c: str, share: float = 0.55, foreign: tuple[str, str] | None = packs.DIWAN["foreign_script"]) -> str:
    raw = sql_squeeze(f"coalesce({c}, '')")
    letters = f"length(regexp_replace({raw}, '[^\\x{{0621}}-\\x{{064A}}]', '', 'g'))"
    latin = f"length(regexp_replace({raw}, '[^A-Za-z]', '', 'g'))"
    out = f"({letters} >= 3 and {letters} / greatest({latin}, 1) >= {share})"
    return out if foreign is None else f"({out} and not {sql_test(raw, foreign)})"


def sql_values(c: str) -> str:
    return f"list_filter(list_transform(coalesce({c}, []::varchar[]), lambda v: {sql_trim('v')}), lambda v: v <> '')"


def sql_all_arabic(c: str = "language") -> str:
    some = sql_values(c)
    return f"(len({some}) > 0 and len(list_filter({some}, lambda v: not {sql_test('v', packs.LITERATURE['arabic_language'])})) = 0)"


def sql_other_language(c: str = "language") -> str:
    return f"len(list_filter({sql_values(c)}, lambda v: {sql_test('v', packs.LITERATURE['non_arabic_language'])})) > 0"


def sql_record_arabic(c: str = "language") -> str:
    return f"len(list_filter({sql_values(c)}, lambda v: lower(v) in ('ara', 'arabic'))) > 0"


def sql_word(c: str, word: str) -> str:
    return f"contains(' ' || {c} || ' ', {q(f' {word} ')})"


def joined(tags: Column) -> Column:
    return F.array_join(tags, "|")


def sql_joined(tags: str) -> str:
    return f"array_to_string({tags}, '|')"


col = F.col

# Normalisers: whole titles under each profile
for _p in N.PROFILES.values():
    on_records(f"normalize_{_p.name}", {
        "title": (lambda p=_p: N.normalize(col("title"), p), sql_normalize("title", _p)),
        "description": (lambda p=_p: N.normalize(col("description"), p), sql_normalize("description", _p)),
    })

# Script and language predicates
on_records("arabic_title_test", {"title": (lambda: F.coalesce(T.arabic_title(col("title")), F.lit(False)), sql_arabic_title("title")), "subject": (lambda: F.coalesce(T.arabic_title(col("subject")), F.lit(False)), sql_arabic_title("subject"))})
on_records("arabic_text_test", {"title": (lambda: T.arabic_text(col("title")), sql_arabic_text("title")), "plain": (lambda: T.arabic_text(col("subject"), 0.58, None), sql_arabic_text("subject", 0.58, None))})
on_records("arabic_share_title", {"ok": (lambda: T.arabic_share_title(col("title")), f"(length(regexp_replace({sql_squeeze('title')}, '[^\\x{{0621}}-\\x{{064A}}]', '', 'g')) >= 3 and length(regexp_replace({sql_squeeze('title')}, '[^\\x{{0621}}-\\x{{064A}}]', '', 'g')) / greatest(length(regexp_replace({sql_squeeze('title')}, '[^\\p{{L}}]', '', 'g')), 1) >= 0.55)")})
on_records("any_arabic", {"ok": (lambda: T.any_arabic(F.concat_ws(" ", "archive_title", "error")), sql_test(sql_join("archive_title", "error"), ("[\\x{0621}-\\x{064A}]", "")))})
on_records("truncated_titles", {"ok": (lambda: T.truncated_title(col("title")), f"(length({sql_squeeze('title')}) < 12 or {sql_test(sql_squeeze('title'), (T.TRUNCATED, ''))})")})
on_records("language_tests", {
    "arabic": (lambda: filters.all_arabic_languages(col("language")), sql_all_arabic()), "other": (lambda: filters.any_other_language(col("language")), sql_other_language()),
    "record": (lambda: filters.record_is_arabic(col("language")), sql_record_arabic()), "proof": (lambda: filters.arabic_proof(col("language"), F.concat_ws(" ", "subject", "description")), f"({sql_record_arabic()} or {sql_arabic_text(sql_join('subject', 'description'))})"),
})

# Addresses and kinds of records
on_records("address_tests", {
    "details": (lambda: filters.is_archive_details(col("url")), "regexp_matches(url, '^https://archive\\.org/details/', 'i')"), "post": (lambda: filters.is_telegram_post(col("url")), "regexp_matches(trim(url), '^https://t\\.me/Arsail2020/\\d+/?$', 'i')"),
    "post_key": (lambda: T.telegram_post_key(col("url")), "nullif(regexp_extract(regexp_replace(trim(url), '/+$', ''), '^https://t\\.me/Arsail2020/(\\d+)/?$', 1, 'i'), '')"),
    "prefixed": (lambda: filters.prefixed("identifier", "g2"), "coalesce(starts_with(identifier, 'g2'), false)"),
})
on_records("message_tests", {
    "texts": (lambda: filters.is_texts(col("lang")), "lang = 'texts'"),
    "pdf": (lambda: filters.is_pdf_message(F.when(col("k") % 3 > 0, "message").otherwise("service"), F.when(col("k") % 2 == 0, "application/pdf"), F.concat("identifier", F.when(col("k") % 5 == 0, ".PDF").otherwise(".doc"))), "(k % 3 > 0 and (k % 2 = 0 or coalesce(identifier is not null and k % 5 = 0, false)))"),
})
_diwan = sql_normalize("title", N.DIWAN)
_metadata = sql_normalize(sql_join("subject", "description"), N.DIWAN)
_COLLECTION, _NOT_ALONE = filters.PART, filters.NOT_ALONE
on_records("diwan_title_tests", {
    "alone": (lambda: filters.standalone_diwan_title(col("title")), f"({sql_test('title', (r"^ديوان\s+", ""))} and not {sql_test('title', (_NOT_ALONE, ''))})"),
    "part": (lambda: filters.part_of_collection(N.normalize(col("title"), N.DIWAN)), sql_test(_diwan, (_COLLECTION, ""))),
    "referenced": (lambda: filters.referenced_title(N.normalize(col("title"), N.DIWAN), N.normalize(F.concat_ws(" ", "subject", "description"), N.DIWAN)), f"(length({_diwan}) >= 6 and contains({_metadata}, {_diwan}))"),
    "beside": (lambda: filters.title_beside_diwan(N.normalize(col("archive_title"), N.DIWAN), N.normalize(F.concat_ws(" ", "subject", "description"), N.DIWAN)), f"coalesce(len(string_split({sql_normalize('archive_title', N.DIWAN)}, ' ')) >= 2 and (contains({_metadata}, 'ديوان ' || {sql_normalize('archive_title', N.DIWAN)}) or contains({_metadata}, {sql_normalize('archive_title', N.DIWAN)} || ' ديوان')), false)"),
})

# Cleaners. RE2 has no lookahead: the two steps that use it are stated without.
_LOOK = {r"^\s*\d+\s*(?=[ء-غف-ي])": (r"^\s*\d+\s*([ء-غف-ي])", "", "$1"), r"^\d+\s+(?=ديوان\b)": None}


def re2(steps) -> list[tuple[str, str, str]]:
    return [s for s in (_LOOK.get(x[0], x) for x in steps) if s]


_numbered = "case when k % 3 = 0 then '00123_' || title || ' pdf' when k % 3 = 1 then '12 كتاب ' || title else title end"


def numbered() -> Column:
    return F.when(col("k") % 3 == 0, F.concat(F.lit("00123_"), "title", F.lit(" pdf"))).when(col("k") % 3 == 1, F.concat(F.lit("12 كتاب "), "title")).otherwise(col("title"))


on_records("clean_diwan_title", {"title": (lambda: T.clean_title(numbered()), sql_trim(sql_steps(sql_squeeze(f"coalesce({_numbered}, '')"), T.DIWAN_TITLE)))})
on_records("clean_refined_title", {"title": (lambda: T.clean_title(numbered(), T.REFINE_TITLE), sql_trim(sql_steps(sql_squeeze(f"coalesce({_numbered}, '')"), T.REFINE_TITLE)))})
on_records("clean_catalog_title", {"title": (lambda: T.clean_catalog_title(numbered()), sql_trim(sql_steps(sql_squeeze(f"coalesce({_numbered}, '')"), re2(T.CATALOG_TITLE))))})
on_records("clean_literature_title", {"title": (lambda: T.clean_literature_title(numbered()), sql_squeeze(sql_steps(f"coalesce({_numbered}, '')", re2(T.LITERATURE_TITLE))))})
on_records("clean_display_title", {"title": (lambda: T.clean_display_title(col("archive_title")), sql_squeeze("regexp_replace(coalesce(archive_title, ''), '_+', ' ', 'g')"))})
on_records("clean_telegram_title", {"title": (lambda: T.clean_telegram_title(F.concat("title", F.lit("_noor-book.com ❀.pdf"))), sql_trim(sql_steps("coalesce(title || '_noor-book.com ❀.pdf', '')", T.TELEGRAM_TITLE)))})
_person = lambda c: sql_trim(sql_steps(sql_squeeze(f"coalesce({c}, '')"), T.PERSON))
on_records("clean_person", {"name": (lambda: T.clean_person(col("creator")), _person("creator"))})
on_records("canonical_list_title", {"title": (lambda: T.canonical_list_title(col("archive_title")), sql_normalize("regexp_replace(coalesce(archive_title, ''), '_+', ' ', 'g')", N.IMPORT))})
_words = (T.FORMAT_WORDS[0].replace("(?=$|\\s)", "($|\\s)"), "i", " $1")
on_records("canonical_archive_title", {
    "title": (lambda: T.canonical_archive_title(numbered()), sql_normalize(sql_squeeze(sql_steps(f"coalesce({_numbered}, '')", (*T.ARCHIVE_PREFIXES, _words, _words, _words))), N.IMPORT)),
    "rhetoric": (lambda: T.canonical_archive_title(numbered(), T.FORMAT_WORDS_RHETORIC), sql_normalize(sql_squeeze(sql_steps(f"coalesce({_numbered}, '')", (*T.ARCHIVE_PREFIXES, T.FORMAT_WORDS_RHETORIC))), N.IMPORT)),
})
_clean = sql_trim(sql_steps(sql_squeeze("coalesce(title, '')"), T.DIWAN_TITLE))
on_records("canonical_diwan_title", {"title": (lambda: T.canonical_diwan_title(col("title")), sql_trim(sql_steps(sql_normalize(_clean, N.DIWAN), (T.EDITION,))))})
_author = sql_normalize("coalesce(creator, '')", N.UPLOAD)
on_records("canonical_person", {"name": (lambda: T.canonical_person(col("creator")), f"case when {sql_test(_author, packs.MERGE['generic_author'])} then '' else {_author} end")})

# Keys
_tokens = lambda c: f"list_distinct(list_filter(string_split({c}, ' '), lambda v: length(v) > 1 and v not in ('ديوان', 'الشعر', 'شعري')))"
_ktitle, _kname = sql_normalize("title", N.UPLOAD), sql_normalize("creator", N.UPLOAD)
on_records("title_tokens", {"tokens": (lambda: F.array_join(F.sort_array(T.tokens(N.normalize(col("title"), N.UPLOAD))), "|"), f"array_to_string(list_sort({_tokens(_ktitle)}), '|')")})
_poet = f"regexp_extract({_ktitle}, '(?:^|\\s)ديوان\\s+(.+)$', 1)"
on_records("work_identity", {
    "identity": (lambda: T.identity(N.normalize(col("title"), N.UPLOAD), N.normalize(col("creator"), N.UPLOAD)), f"case when {_poet} <> '' and {_kname} <> '' and len(list_intersect({_tokens(_poet)}, {_tokens(_kname)})) >= 2 then 'poet-diwan::' || {_kname} else 'work::' || {_ktitle} || '::' || coalesce(nullif({_kname}, ''), 'author-unavailable') end"),
    "material": (lambda: T.identity_material(N.normalize(col("title"), N.UPLOAD), N.normalize(F.coalesce("creator", F.lit("")), N.UPLOAD)), f"case when {_author} <> '' then {_ktitle} || '::' || {_author} else {_ktitle} end"),
})
on_records("search_addresses", {"url": (lambda: T.search_url(col("title")), "'https://ddl.ae/search/results/1?queries=' || replace(replace(replace(url_encode('or|all|' || title), '%20', '+'), '~', '%7E'), '%2A', '*')"), "back": (lambda: T.parse_search_url(T.search_url(col("title"))), "title")})
on_records("safe_paths", {"path": (lambda: T.safe_path(F.concat("title", F.lit('/a:b*"<c>|?'))), sql_squeeze("regexp_replace(title || '/a:b*\"<c>|?', '[\\\\/:*?\"<>|]', ' ', 'g')"))})
# the other engine counts bytes: ASCII columns
on_records("title_distances", {"distance": (lambda: T.edit_distance(col("identifier"), col("src")), "levenshtein(identifier, src)::int"), "near": (lambda: T.edit_distance(col("url"), F.concat(F.lit("https://archive.org/details/"), "src"), 3), "case when levenshtein(url, 'https://archive.org/details/' || src) > 3 then -1 else levenshtein(url, 'https://archive.org/details/' || src) end::int"), "compact": (lambda: T.compact_key(col("title")), f"regexp_replace(title, {q(WS + '+')}, '', 'g')")})
on_records("value_lists", {
    "textified": (lambda: T.textify(col("language")), "array_to_string(coalesce(language, []), ' | ')"), "values": (lambda: joined(T.value_list(col("language"))), sql_joined(sql_values("language"))),
    "as_list": (lambda: F.array_join(T.as_list(F.when(col("k") % 2 == 0, F.concat(F.lit('["'), "identifier", F.lit('","b"]'))).otherwise(col("identifier"))), "|"), "case when identifier is null then '' when k % 2 = 0 then identifier || '|b' else identifier end"),
    "flat": (lambda: T.flatten_json(F.concat(F.lit('["a",{"text":"'), col("lang"), F.lit('"},{"other":"x"},["b",null]]'))), "'a ' || lang || ' b'"),
    "volumes": (lambda: T.capture_int(F.concat(F.lit("المجلدات: "), col("k").cast("string")), r"المجلدات:\s*(\d+)"), "k::int"),
    "short": (lambda: T.shorten(col("description"), 10), "left(description, 10)"),
})

# Tags, categories and reasons
_LIT = packs.LITERATURE
_text = sql_join("title", "subject", "description")


def text_of() -> Column:
    return F.concat_ws(" ", "title", "subject", "description")


def sql_lexical(c: str, p: dict = _LIT) -> str:
    return f"({sql_test(c, p['lexical_dictionary'])} or ({sql_test(c, p['dictionary_cue'])} and {sql_test(c, p['lexical_dictionary_context'])} and not {sql_test(c, p['non_language_dictionary'])}))"


def sql_literature_tags(c: str, p: dict = _LIT) -> str:
    rhetoric = sql_test(c, p["rhetoric"])
    return sql_tags([
        (sql_lexical(c, p), rules.DICTIONARY), (rhetoric, rules.RHETORIC), (sql_test(c, p["grammar"]), rules.GRAMMAR), (sql_test(c, p["morphology"]), rules.MORPHOLOGY),
        (f"({sql_test(c, p['linguistics'])} and not {rhetoric})", rules.LINGUISTICS), (sql_test(c, p["literature"]), rules.LITERATURE), (sql_test(c, p["thesis"]), rules.THESIS_TAG),
    ])


def sql_subject_tags(c: str, p: dict) -> str:
    d, r, g, m = (sql_test(c, p[n]) for n in ("dictionary", "rhetoric", "grammar", "morphology"))
    return sql_tags([(d, rules.DICTIONARY), (r, rules.RHETORIC), (g, rules.GRAMMAR), (m, rules.MORPHOLOGY), (f"({sql_test(c, p['linguistics'])} and not {r})", rules.LINGUISTICS), (f"({sql_test(c, p['literature'])} and not ({d} or {r} or {g} or {m}))", rules.LITERATURE)])


on_records("lexical_dictionary", {"ok": (lambda: rules.lexical_dictionary(text_of()), sql_lexical(_text))})
on_records("literature_tags", {"tags": (lambda: joined(rules.literature_tags(text_of())), sql_joined(sql_literature_tags(_text)))})
on_records("grammar_tags", {"tags": (lambda: joined(rules.subject_tags(text_of(), packs.GRAMMAR)), sql_joined(sql_subject_tags(_text, packs.GRAMMAR)))})
on_records("rhetoric_tags", {"tags": (lambda: joined(rules.subject_tags(text_of(), packs.RHETORIC)), sql_joined(sql_subject_tags(_text, packs.RHETORIC)))})
on_records("fallback_tags", {"tags": (lambda: joined(rules.with_fallback(rules.literature_tags(col("archive_title")), rules.literature_tags(col("subject")))), f"case when len({sql_literature_tags('archive_title')}) = 0 then {sql_joined(sql_literature_tags('subject'))} else {sql_joined(sql_literature_tags('archive_title'))} end")})
_category = lambda tags, theses=True: (f"case when list_contains({tags}, {q(rules.THESIS_TAG)}) then 'academic_theses' " if theses else "case ") + f"when list_contains({tags}, {q(rules.DICTIONARY)}) then 'dictionaries' else 'references' end"
on_records("primary_category", {"category": (lambda: rules.primary_category(rules.literature_tags(text_of())), _category(sql_literature_tags(_text))), "short": (lambda: rules.primary_category(rules.literature_tags(text_of()), False), _category(sql_literature_tags(_text), False))})


def record_columns(tags: Column) -> dict[str, Column]:
    names = ("title", "archive_title", "identifier", "url", "error", "language", "subject", "description", "creator")
    return {n: col(n) for n in names} | {"raw_title": col("raw"), "tags": tags}


_complete = "(coalesce(raw <> '', false) and coalesce(identifier <> '', false) and coalesce(regexp_matches(url, '^https://archive\\.org/details/', 'i'), false))"
_proof = f"({sql_all_arabic()} or {sql_test('subject', _LIT['arabic_language_text'])} or {sql_test('description', _LIT['arabic_language_text'])})"


def sql_literature_reason() -> str:
    p, titles = _LIT, sql_join("title", "raw", "archive_title", "subject")
    everything = sql_join(titles, "description", "creator")
    tags = sql_literature_tags(titles)
    topic = sql_any(titles, p, "rhetoric", "grammar", "morphology", "dictionary_cue", "linguistics", "literature")
    other = f"(({sql_test(titles, p['non_language_dictionary'])} or {sql_test(titles, p['non_core_reference'])}) and not {sql_test(titles, p['literary_biography'])})"
    return sql_first([
        (f"not {_complete}", "incomplete"), ("error is not null", "failed"), (f"not {sql_arabic_title('title')}", "not_arabic_title"), (sql_test(sql_join("title", "raw", "subject"), p["educational_worksheet"]), "worksheet"),
        (sql_other_language(), "other_language"), (sql_test(everything, p["non_arabic_subject"]), "other_subject"), (other, "other_dictionary"), (sql_test(f"replace({everything}, '_', ' ')", p["non_prosody_arood"]), "not_prosody"),
        (f"not {_proof}", "no_evidence"), (f"(len({tags}) = 0 or not {topic} or {sql_test(everything, p['excluded_topic'])})", "off_topic"),
    ])


def sql_subject_reason(p: dict, topic: str | None, forgiven: str | None) -> str:
    titles = sql_join("title", "raw")
    whole = sql_join(titles, "subject", "description")
    everything = sql_join(whole, "creator")
    on_topic = sql_test(whole, p[topic]) if topic else sql_any(whole, p, "rhetoric", "grammar", "morphology", "dictionary", "linguistics", "literature")
    excluded = sql_test(everything, p["excluded_topic"])
    if forgiven:
        excluded = f"({excluded} and not {sql_test(whole, p[forgiven])})"
    proof = f"({sql_all_arabic()} or {sql_test('subject', p['arabic_language_text'])} or {sql_test('description', p['arabic_language_text'])})"
    steps = [(f"not {_complete}", "incomplete"), ("error is not null", "failed"), (f"not {sql_arabic_title('title')}", "not_arabic_title"), (sql_test(sql_join(titles, "subject"), p["educational_worksheet"]), "worksheet"), (sql_other_language(), "other_language")]
    if "non_arabic_subject" in p:
        steps.append((sql_test(everything, p["non_arabic_subject"]), "other_subject"))
    return sql_first([*steps, (f"not {proof}", "no_evidence"), (f"(len({sql_subject_tags(whole, p)}) = 0 or not {on_topic} or {excluded})", "off_topic")])


on_records("literature_reason", {"reason": (lambda: rules.literature_reason(record_columns(rules.literature_tags(F.concat_ws(" ", "title", "raw", "archive_title", "subject")))), sql_literature_reason())})
on_records("grammar_reason", {"reason": (lambda: rules.subject_reason(record_columns(rules.subject_tags(F.concat_ws(" ", "title", "raw", "subject", "description"), packs.GRAMMAR)), packs.GRAMMAR, "nahw_irab"), sql_subject_reason(packs.GRAMMAR, "nahw_irab", None))})
on_records("rhetoric_reason", {"reason": (lambda: rules.subject_reason(record_columns(rules.subject_tags(F.concat_ws(" ", "title", "raw", "subject", "description"), packs.RHETORIC)), packs.RHETORIC, None, "rhetoric"), sql_subject_reason(packs.RHETORIC, None, "rhetoric"))})

# Title lists
_KEYS = dict(zip(rules.canonical_keys(list(packs.MANUAL_TITLE_TAGS)), packs.MANUAL_TITLE_TAGS.values(), strict=True))
_RELEVANT = rules.canonical_keys(packs.RELEVANT_TITLES)
_key = sql_normalize("regexp_replace(coalesce(raw, ''), '_+', ' ', 'g')", N.IMPORT)
_listed = f"({_key} in ({', '.join(map(q, [*_KEYS, *_RELEVANT]))}))"


def list_columns() -> tuple[Column, Column, Column]:
    return col("title"), T.canonical_list_title(col("raw")), col("category")


def sql_list_tags() -> str:
    p = packs.TITLES
    own = [(f"{_key} = {q(k)}", tag) for k, tag in _KEYS.items()]
    own += [(sql_test("title", p["dictionary"]), rules.DICTIONARY), (sql_test("title", p["rhetoric"]), rules.RHETORIC), (sql_test("title", p["grammar"]), rules.GRAMMAR), (sql_test("title", p["morphology"]), rules.MORPHOLOGY)]
    own += [(f"({sql_test('title', p['linguistics'])} or {sql_test('title', p['education_language'])})", rules.LINGUISTICS), (sql_test("title", p["literature"]), rules.LITERATURE)]
    of_category = sql_first([(f"category = {q(k)}", v) for k, v in packs.CATEGORY_TAG.items()])
    tags = sql_tags(own)
    return f"list_filter(list_concat({tags}, [case when len({tags}) > 0 or {_listed} then {of_category} end]), lambda v: v is not null)"


def sql_list_relevant() -> str:
    p = packs.TITLES
    both = lambda n: f"({sql_test('title', p[n])} or {sql_test(_key, p[n])})"
    topics = sql_any("title", p, "rhetoric", "grammar", "morphology", "dictionary", "linguistics", "literature", "education_language")
    short = f"(category = 'النحو والإعراب' and {sql_test('title', (rules.SHORT_GRAMMAR, 'i'))})"
    return f"case when {both('vague_title')} or {both('explicit_exclusion')} or {sql_test('title', p['non_language_context'])} then false when {_listed} or {topics} then true else {short} end"


def list_reason() -> Column:
    t, k, c = list_columns()
    listed = [*_KEYS, *_RELEVANT]
    return rules.list_reason(t, k, c, rules.list_tags(t, k, c, _KEYS, _RELEVANT), listed)


# a set of tags: the order of repeated ones is not compared
on_records("title_list_tags", {"tags": (lambda: joined(F.sort_array(rules.list_tags(*list_columns(), _KEYS, _RELEVANT))), f"array_to_string(list_sort(list_distinct({sql_list_tags()})), '|')")})
on_records("title_list_relevant", {"ok": (lambda: rules.list_relevant(*list_columns(), [*_KEYS, *_RELEVANT]), sql_list_relevant())})
on_records("title_list_reason", {"reason": (list_reason, sql_first([(f"{_key} = ''", "empty"), (f"not {sql_arabic_title('title')}", "not_arabic_title"), (f"not {sql_list_relevant()}", "off_topic"), (f"len({sql_list_tags()}) = 0", "no_tag")]))})

# Diwans
_D = packs.DIWAN


def sql_plausible(c: str, p: dict = _D) -> str:
    person = _person(c)
    key = sql_normalize(person, N.DIWAN)
    return f"({person} <> '' and {sql_arabic_text(person, foreign=p['foreign_script'])} and not {sql_test(key, p['generic_poet'])} and not {sql_test(key, p['reject_title'])})"


_after = _person(sql_steps(f"regexp_extract({_clean}, {q(rules.POET_AFTER)}, 1)", [T.EDITION]))
_ahead = _person(f"regexp_extract({_clean}, {q(rules.POET_BEFORE)}, 1)")
_words_in = lambda c: f"len(string_split({sql_squeeze(c)}, ' '))"
_sql_poet = f"case when {sql_plausible('creator')} then {_person('creator')} when {sql_plausible(_after)} and {_words_in(_after)} <= 5 then {_after} when {sql_plausible(_ahead)} and {_words_in(_ahead)} <= 6 then {_ahead} else '' end"
_poetry = f"({sql_word(_diwan, 'قصائد')} or {sql_word(_diwan, 'اشعار')} or {sql_word(_diwan, 'شعر')})"
_referenced = f"(length({_diwan}) >= 6 and contains({_metadata}, {_diwan}))"
_evidence = sql_first([
    (sql_word(_diwan, "ديوان"), rules.EVIDENCE[0]), (f"({sql_word(_metadata, 'ديوان')} and {_referenced} and {_poetry})", rules.EVIDENCE[1]),
    (f"({sql_test(_metadata, (rules.COLLECTION, ''))} and {_referenced} and {sql_plausible('creator')} and {_poetry})", rules.EVIDENCE[2]),
], "''")


def evidence() -> Column:
    return rules.diwan_evidence(col("title"), col("subject"), col("description"), col("creator"))


def sql_diwan_reason() -> str:
    foreign = f"({sql_test(_metadata, _D['foreign_language_signal'])} or {sql_test(_diwan, _D['foreign_language_signal'])})"
    false = f"({sql_test(_diwan, _D['reject_title'])} or {sql_test(_diwan, _D['contextual_reject_title'])})"
    steps = ("title = ''", f"not {sql_arabic_text('title', foreign=_D['foreign_script'])}", foreign, false, sql_test(_diwan, (_COLLECTION, "")), f"{_evidence} = ''")
    return sql_first(list(zip(steps, rules.DIWAN_REASONS, strict=True)))


def sql_upload_reason() -> str:
    p, context = packs.UPLOAD, sql_join("subject", "description")
    key = sql_normalize("title", N.UPLOAD)
    return sql_first([
        ("coalesce(identifier, '') = ''", "معرّف مفقود"), ("title = ''", rules.DIWAN_REASONS[0]), (f"not {sql_arabic_text('title', foreign=p['foreign_script'])}", rules.DIWAN_REASONS[1]),
        (sql_test(sql_normalize(sql_join("title", context), N.UPLOAD), p["foreign_language_signal"]), rules.DIWAN_REASONS[2]), (f"not ({sql_record_arabic()} or {sql_arabic_text(context)})", "لا تثبت البيانات عربية السجل"),
        (f"({sql_test(key, p['reject_title'])} or {sql_test(key, p['contextual_reject_title'])})", rules.DIWAN_REASONS[3]), (sql_test(key, (_COLLECTION, "")), rules.DIWAN_REASONS[4]), (f"{_evidence} = ''", rules.DIWAN_REASONS[5]),
    ])


_score = lambda second: f"case when starts_with({_evidence}, 'العنوان') then 10 when {second} then 8 else 6 end + case when {_sql_poet} <> '' then 4 else 0 end + case when length(subject) > 10 then 2 else 0 end + case when length(description) > 30 then 1 else 0 end + case when {sql_record_arabic()} then 1 else 0 end"


def diwan_score(faithful: bool) -> Column:
    return rules.diwan_score(evidence(), rules.poet(col("title"), col("creator")), col("subject"), col("description"), col("language"), faithful)


on_records("plausible_person", {"ok": (lambda: rules.plausible_person(col("creator")), sql_plausible("creator"))})
on_records("poet_of_title", {"poet": (lambda: rules.poet(col("title"), col("creator")), _sql_poet)})
on_records("diwan_evidence", {"evidence": (evidence, _evidence)})
on_records("diwan_reason", {"reason": (lambda: rules.diwan_reason(col("title"), col("subject"), col("description"), evidence()), sql_diwan_reason())})
on_records("upload_reason", {"reason": (lambda: rules.upload_reason(col("identifier"), col("title"), col("subject"), col("description"), col("language"), evidence()), sql_upload_reason())})
on_records("diwan_score", {"score": (lambda: diwan_score(False), _score(f"starts_with({_evidence}, 'البيانات الوصفية تثبت')")), "score_v4": (lambda: diwan_score(True), _score("false"))})
_cat = sql_trim(sql_steps(sql_squeeze("coalesce(title, '')"), re2(T.CATALOG_TITLE)))
_name = sql_squeeze("coalesce(creator, '')")
_merge_steps = (
    f"not {sql_arabic_text(_cat, 0.58, packs.MERGE['foreign_script'])}", sql_test(sql_join(_cat, _name, sql_squeeze("subject")), packs.MERGE["foreign_language_signal"]), sql_test(sql_normalize(_cat, N.UPLOAD), packs.MERGE["non_diwan_title"]),
    f"({sql_test(sql_normalize(_name, N.UPLOAD), packs.MERGE['generic_author'])} and not {sql_test(_cat, ('(?:ديوان|قصائد|اشعار|أشعار)', ''))})",
)
on_records("merge_reason", {"reason": (lambda: rules.merge_reason(col("title"), col("creator"), col("subject")), sql_first(list(zip(_merge_steps, rules.MERGE_REASONS, strict=True))))})
_named = f"({_name} <> '' and not {sql_test('creator', (r"لم\s+يثبت", ""))})"
on_records("record_confidence", {"n": (lambda: rules.confidence(col("title"), col("creator"), evidence(), col("url")), f"case when contains({_evidence}, 'العنوان يصرح') then 8 else 5 end + case when {_named} then 3 else 0 end + case when length(title) > 8 then 1 else 0 end + case when coalesce(url, '') <> '' then 1 else 0 end")})
_refined = sql_trim(sql_steps(sql_squeeze("coalesce(title, '')"), T.REFINE_TITLE))
_rkey = sql_normalize(_refined, N.REFINE)
on_records("refine_reason", {"reason": (lambda: rules.refine_reason(T.clean_title(col("title"), T.REFINE_TITLE)), sql_first([(f"{_refined} = ''", rules.REFINE_REASONS[0]), (sql_test(_rkey, packs.REFINE["reject"]), rules.REFINE_REASONS[1]), (f"({sql_test(_rkey, packs.REFINE['obvious_download_noise'])} and not {sql_test(_rkey, (r"^ديوان\s+", ""))})", rules.REFINE_REASONS[2])]))})
_ukey = sql_normalize("title", N.UPLOAD)
on_records("risk_flags", {"flags": (lambda: joined(rules.risk_flags(N.normalize(col("title"), N.UPLOAD))), sql_joined(sql_tags([(sql_test(_ukey, (p, "")), v) for v, p in packs.RISK_RULES]))), "suspicious": (lambda: joined(rules.risk_flags(N.normalize(col("title"), N.UPLOAD), packs.SUSPICIOUS_RULES)), sql_joined(sql_tags([(sql_test(_ukey, (p, "")), v) for v, p in packs.SUSPICIOUS_RULES])))})

# Theses
_tkey = sql_normalize("title", N.THESIS)
_signal = lambda words, patterns: "(" + " or ".join([*(f"contains({_tkey}, {q(w)})" for w in words), *(sql_test(_tkey, (p, "")) for p in patterns)]) + ")"
_signals = [(n, tag, s, _signal(w, p)) for n, tag, s, w, p in packs.THESIS_SIGNALS]
_strong = "(" + " or ".join(c for _, _, s, c in _signals if s >= 6) + ")"
on_records("thesis_signals", {
    "score": (lambda: rules.thesis_signals(col("title"))[0], f"case when {_signal((), packs.THESIS_FALSE_TOPICS)} or ({_signal(packs.THESIS_EXCLUSIONS, ())} and not {_strong}) then -10 else {' + '.join(f'case when {c} then {s} else 0 end' for _, _, s, c in _signals)} end"),
    "tags": (lambda: joined(F.sort_array(rules.thesis_signals(col("title"))[1])), f"array_to_string(list_sort(list_distinct({sql_tags([(c, tag) for _, tag, _, c in _signals])})), '|')"),
    "names": (lambda: joined(rules.thesis_signals(col("title"))[2]), sql_joined(sql_tags([(c, n) for n, _, _, c in _signals]))),
})
on_records("thesis_level", {"level": (lambda: rules.thesis_level(col("title")), f"case when contains({_tkey}, {q(rules.LEVELS[0])}) then {q(rules.LEVELS[0])} when contains({_tkey}, {q(rules.LEVELS[1])}) then {q(rules.LEVELS[1])} else {q(rules.LEVELS[2])} end")})

# Projections
_best = lambda c: f"case when {c} = '' then -1 else length(regexp_replace({c}, '[^\\x{{0621}}-\\x{{064A}}]', '', 'g')) * 1000 + length({c}) end"
on_records("chosen_titles", {
    "chosen": (lambda: projections.chosen_title(col("title"), col("archive_title")), f"case when {sql_trim("coalesce(archive_title, '')")} <> '' and {sql_arabic_title(sql_trim('archive_title'))} then {sql_trim('archive_title')} else {sql_trim("coalesce(title, '')")} end"),
    "better": (lambda: projections.better_title(col("title"), F.coalesce("archive_title", F.lit("")), lambda t: T.arabic_letters(t, r"[\x{0621}-\x{064A}]")), f"case when title = '' and coalesce(archive_title, '') = '' then null when {_best('title')} >= {_best("coalesce(archive_title, '')")} then title else archive_title end"),
})


def catalog_rows(spark, sf) -> DataFrame:
    """The records as catalog records."""
    d = records(spark, sf)
    kind = F.element_at(F.array(*map(F.lit, ("diwans", "references", "dictionaries", "scientific_poems", "academies"))), (col("k") % 5 + 1).cast("int"))
    source = F.when(col("k") % 4 == 0, filters.POEM_SOURCE).when(col("k") % 4 == 1, filters.ARCHIVE_SOURCE).when(col("k") % 4 == 2, projections.SEARCH_SOURCE).otherwise("كتب")
    tags = F.array(F.when(col("k") % 3 == 0, "نحو").when(col("k") % 3 == 1, "بلاغة").otherwise("تاريخ"), F.lit("عام"))
    signals = F.array(F.when(col("k") % 10 == 0, filters.DIWAN_SIGNALS[0]).when(col("k") % 10 == 5, filters.DIWAN_SIGNALS[1]).otherwise("x"))
    return d.select(
        "doc_id", "k", col("doc_id").cast("string").alias("id"), "title", F.nullif(F.coalesce("creator", F.lit("")), F.lit("")).alias("author"), source.alias("source"), col("url").alias("relativePath"), F.when(col("k") % 6 > 0, col("url")).otherwise("").alias("sourceUrl"),
        kind.alias("primaryCategory"), tags.alias("tags"), projections.evidence(signals, F.array(F.lit("y"))).alias("matchEvidence"),
    )


CATALOG = f"""{BASE}, c as (select doc_id, k, title, nullif(coalesce(creator, ''), '') as author, case k % 4 when 0 then {q(filters.POEM_SOURCE)} when 1 then {q(filters.ARCHIVE_SOURCE)} when 2 then {q(projections.SEARCH_SOURCE)} else 'كتب' end as source,
case when k % 6 > 0 then url else '' end as url, case k % 5 when 0 then 'diwans' when 1 then 'references' when 2 then 'dictionaries' when 3 then 'scientific_poems' else 'academies' end as kind,
case k % 3 when 0 then 'نحو' when 1 then 'بلاغة' else 'تاريخ' end as tag, k % 10 in (0, 5) as signed from x)"""
_POEM = f"(kind = 'scientific_poems' or (kind = 'diwans' and source = {q(filters.POEM_SOURCE)}))"
_DIWAN = "(kind = 'diwans' and signed)"


def on_catalog(name: str, columns: dict[str, tuple[Callable[[], Column], str]]) -> None:
    def run(spark, sf):
        return catalog_rows(spark, sf).select("doc_id", *(c().alias(k) for k, (c, _) in columns.items()))

    run.__name__ = name
    query(f"with {CATALOG} select doc_id, {', '.join(f'{s} as {k}' for k, (_, s) in columns.items())} from c")(run)


on_catalog("category_tests", {
    "every": (lambda: filters.category("all"), "true"), "diwans": (lambda: filters.category("diwans"), f"({_DIWAN} and not {_POEM})"), "poems": (lambda: filters.category("scientific_poems"), _POEM), "academies": (lambda: filters.category("academies"), "kind = 'academies'"),
    "bilingual": (lambda: filters.category("bilingual_dictionaries", ("3", "30", "300")), "doc_id in (3, 30, 300)"), "none": (lambda: filters.category("bilingual_dictionaries"), "false"), "classical": (filters.is_classical_book, f"(source = {q(filters.ARCHIVE_SOURCE)} and kind in ('references', 'dictionaries'))"),
    "alone": (filters.is_standalone_diwan, _DIWAN), "listed": (lambda: filters.in_list("id", ["5", "6"]), "doc_id in (5, 6)"),
})
on_catalog("stat_tests", {"every": (lambda: filters.stat("all"), "true"), "linguistics": (lambda: filters.stat("linguistics"), "tag = 'نحو'"), "lexicon": (lambda: filters.stat("lexicon-literature-rhetoric"), "tag = 'بلاغة'"), "diwans": (lambda: filters.stat("diwans"), f"({_DIWAN} or {_POEM})")})
on_catalog("default_view", {"ok": (lambda: filters.default_view(N.normalize(col("title"), N.SEARCH), "ديوان"), f"contains({sql_normalize('title', N.SEARCH)}, 'ديوان')")})
on_catalog("facet_values", {"facet": (lambda: F.concat_ws("|", projections.facet_struct("author", "source")["author"], projections.facet_struct("author", "source")["source"]), "coalesce(nullif(trim(author), ''), 'غير محدد') || '|' || source")})
_haystack = sql_normalize("concat_ws(' ', nullif(title, ''), author, source, tag || ' عام')", N.SEARCH)
on_catalog("search_haystack", {"key": (projections.haystack, _haystack), "found": (lambda: filters.tokens_and(projections.haystack(), "نحو، عام!"), f"(contains({_haystack}, 'نحو') and contains({_haystack}, 'عام'))")})
_labels = " ".join(f"when kind = {q(k)} then {q(v)}" for k, v in projections.CATEGORY_LABELS.items())
on_catalog("result_cards", {
    "label": (projections.category_label, f"case when {_POEM} then {q(projections.CATEGORY_LABELS['scientific_poems'])} {_labels} end"),
    "action": (projections.link_action, f"case when url = '' then 'none' when source = {q(projections.SEARCH_SOURCE)} then 'search' when regexp_matches(url, '^https?://t\\.me/', 'i') then 'telegram' when regexp_matches(url, '^https?://(?:www\\.)?archive\\.org/', 'i') then 'archive' else 'open' end"),
})


_safe = sql_squeeze("regexp_replace(title, '[\\\\/:*?\"<>|]', ' ', 'g')")


@query(f"with {CATALOG} select doc_id, 'archive-' || doc_id as id, {q(filters.ARCHIVE_SOURCE)} as source, 'أرشيف/مواد عربية/' || doc_id || '/' || {_safe} || '.pdf' as path, author || '|y' as signals from c")
def archive_candidates(spark, sf):
    d = catalog_rows(spark, sf).withColumn("identifier", col("id"))
    out = projections.archive_candidate(d, F.array("author"), F.array(F.lit("y")), F.lit(True))
    return out.select("doc_id", "id", "source", col("relativePath").alias("path"), F.concat(out["matchEvidence.strongSignals"][0], F.lit("|"), out["matchEvidence.supportingSignals"][0]).alias("signals"))


@query(f"with {CATALOG} select doc_id, 'ddl-title-' || left(sha256(title), 18) as id, {q(projections.SEARCH_SOURCE)} as source, 'f/' || {_safe} as path, 'تصنيف الملف الأولي: ' || kind as supporting from c")
def list_candidates(spark, sf):
    out = projections.list_candidate(catalog_rows(spark, sf).withColumn("sourceCategory", col("primaryCategory")), "title", "s", "f/")
    return out.select("doc_id", "id", "source", col("relativePath").alias("path"), out["matchEvidence.supportingSignals"][0].alias("supporting"))


@query(f"with {CATALOG} select doc_id, 'دكتوراه|' || tag || '|عام' as tags, 'تيليجرام/رسائل/' || doc_id as path, 'https://t.me/ch/' || doc_id as url from c")
def thesis_records(spark, sf):
    out = projections.thesis_record(catalog_rows(spark, sf).withColumn("level", F.lit("دكتوراه")).withColumn("messageId", col("doc_id")), "ch")
    return out.select("doc_id", joined(col("tags")).alias("tags"), col("relativePath").alias("path"), col("sourceUrl").alias("url"))


@query(f"with {CATALOG} select doc_id, case when k % 3 = 0 then k end::int as volumes, 'https://archive.org/details/a%20' || doc_id as link from c")
def diwan_records(spark, sf):
    d = catalog_rows(spark, sf).withColumn("identifier", F.concat(F.lit("a "), col("id"))).withColumn("volumes", F.when(col("k") % 3 == 0, col("k")).cast("int")).withColumn("pages", F.lit(None).cast("int"))
    return projections.diwan_record(d).select("doc_id", "volumes", col("archiveUrl").alias("link"))


@query(f"with {CATALOG} select doc_id, case when signed then {q(filters.DIWAN_SIGNALS[0])} || case when k % 10 = 5 then '|x' else '' end end as signals from c where false union all select doc_id, case k % 10 when 0 then {q(filters.DIWAN_SIGNALS[0])} when 5 then {q(filters.DIWAN_SIGNALS[1])} || '|' || {q(filters.DIWAN_SIGNALS[0])} else 'x|' || {q(filters.DIWAN_SIGNALS[0])} end from c where doc_id <> 7")
def diwan_adapter(spark, sf):
    out = projections.diwans(catalog_rows(spark, sf), ("7",))
    return out.select("doc_id", joined(out["matchEvidence.strongSignals"]).alias("signals"))


@query("""with d as (select doc_id, nullif(trim(case when doc_id % 4 = 0 then ' ' else source end), '') as org, lang, n_chars from documents)
select 'curricula-' || doc_id as id, org as author, coalesce(org, nullif(lang, ''), 'مجموعة') as source, array_to_string(list_distinct_in_order, '|') as tags from (
select *, list_filter(['المناهج والمقررات', 'كتاب', 'متوسط', case when doc_id % 2 = 0 then 'طلاب' end, lang, 'موثق', lang || '2'], lambda v: v is not null and v <> '') as list_distinct_in_order from d)""")
def curricula_adapter(spark, sf):
    d = table(spark, sf, "documents")
    from ..schema import CURRICULUM_NAMES

    back = {v: k for k, v in CURRICULUM_NAMES.items()}
    rows = d.select(
        F.col("doc_id").alias(back["number"]), F.col("source").alias(back["title"]), F.lit("كتاب").alias(back["type"]), F.when(F.col("doc_id") % 4 == 0, " ").otherwise(F.col("source")).alias(back["organization"]), F.col("lang").alias(back["country"]),
        F.lit("متوسط").alias(back["stage"]), F.when(F.col("doc_id") % 2 == 0, "طلاب").alias(back["audience"]), F.lit("موثق").alias(back["verification"]), F.lit("u").alias(back["url"]), F.array(F.concat("lang", F.lit("2"))).alias(back["labels"]),
    )
    return projections.curricula(rows, "مجموعة").select("id", "author", "source", joined(F.col("tags")).alias("tags"))


_INSTITUTION = "array_to_string(list_filter([{kind}, 'كتاب', lang{extra}, case when doc_id % 15 = 0 then '' when doc_id % 3 = 0 then 'غير محدد' else 'سنة ' || (1900 + doc_id % 100) end, 'يعمل'], lambda v: v <> ''), '|')"


def institutions(spark, sf, place: str) -> DataFrame:
    d = table(spark, sf, "documents")
    year = F.when(F.col("doc_id") % 3 == 0, "غير محدد").otherwise((1900 + F.col("doc_id") % 100).cast("string"))
    country = F.when(F.col("doc_id") % 5 == 0, "غير محدد").otherwise(F.col("lang"))
    return d.select("doc_id", F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), F.col("source").alias(place), country.alias("country"), F.lit("مكان").alias("city"), F.lit("كتاب").alias("materialType"), year.alias("year"), F.lit("يعمل").alias("linkStatus"), F.when(F.col("doc_id") % 2 == 0, "u").alias("url"), F.lit("f").alias("sourceFile"))


@query(f"with d as (select doc_id, case when doc_id % 5 = 0 then 'غير محدد' else lang end as lang, case when doc_id % 2 = 0 then 'u' end as url from documents) select 'academies-' || doc_id as id, nullif(lang, 'غير محدد') as author, url, {_INSTITUTION.format(kind=q('المجامع اللغوية'), extra='')} as tags from d")
def academies_adapter(spark, sf):
    return projections.academies(institutions(spark, sf, "academy")).select("id", "author", F.col("sourceUrl").alias("url"), joined(F.col("tags")).alias("tags"))


@query(f"with d as (select doc_id, case when doc_id % 5 = 0 then 'غير محدد' else lang end as lang, case when doc_id % 2 = 0 then 'u' else '' end as url from documents) select 'literary-clubs-' || doc_id as id, nullif(lang, 'غير محدد') as author, url, {_INSTITUTION.format(kind=q('الأندية الأدبية'), extra=', ' + q('مكان'))} as tags from d")
def literary_clubs_adapter(spark, sf):
    return projections.literary_clubs(institutions(spark, sf, "club")).select("id", "author", F.col("sourceUrl").alias("url"), joined(F.col("tags")).alias("tags"))


# Superseded criteria
_c1, _c2 = (sql_trim(sql_steps(sql_squeeze("coalesce(title, '')"), s)) for s in (early_rules.TITLE_1, early_rules.TITLE_2))
_light = lambda c: sql_normalize(f"coalesce({c}, '')", N.LIGHT_BUILDER)
_deep = lambda c: sql_normalize(f"coalesce({c}, '')", N.DIWAN)
_says = lambda c: sql_word(_light(c), "ديوان")
_k2, _context2 = _deep(_c2), f"({_deep('subject')} || ' ' || {_deep('description')})"
_beside2 = f"(len(string_split({_k2}, ' ')) >= 2 and (contains({_context2}, 'ديوان ' || {_k2}) or contains({_context2}, {_k2} || ' ديوان')))"
_before3 = f"(length({_k2}) > 3 and (contains({_deep('subject')}, 'ديوان ' || {_k2}) or contains({_deep('description')}, 'ديوان ' || {_k2})))"
_poetic = lambda c, p: sql_test(c, (p, ""))
_sql_reason_1 = sql_first(list(zip((f"{_c1} = ''", f"not ({_says(_c1)} or {_says('subject')} or {_says('description')})", _poetic(_light(_c1), early_rules.NOT_ALONE_1), _poetic(_light(_c1), early_rules.CONTAINER_1), f"not {_poetic(_light(sql_join('title', 'subject', 'description')), early_rules.POETRY_1)}"), early_rules.REASONS_1, strict=True)))
_sql_reason_2 = sql_first(list(zip((f"{_c2} = ''", f"not {sql_arabic_text(_c2, foreign=None)}", f"not ({sql_word(_k2, 'ديوان')} or {_beside2})", f"not {_poetic(_context2, early_rules.POETRY_2)}", _poetic(_k2, early_rules.NOT_DIWAN_2)), early_rules.REASONS_2, strict=True)))
_sql_reason_3 = sql_first(list(zip((f"{_c2} = ''", f"not {sql_arabic_text(_c2, foreign=None)}", f"not ({sql_word(_k2, 'ديوان')} or {_before3})", f"not {_poetic(sql_join(_deep('subject'), _deep('description'), _k2), early_rules.POETRY_2)}", _poetic(_k2, early_rules.NOT_DIWAN_3)), early_rules.REASONS_3, strict=True)))
_fields = lambda: (col("title"), col("subject"), col("description"))
on_records("diwan_reason_v1", {"reason": (lambda: early_rules.reason_1(*_fields()), _sql_reason_1), "basis": (lambda: early_rules.basis_1(*_fields()), f"case when {_says(_c1)} then 'العنوان' when {_says('subject')} then 'الموضوع' when {_says('description')} then 'الوصف' else '' end")})
on_records("diwan_reason_v2", {"reason": (lambda: early_rules.reason_2(*_fields()), _sql_reason_2)})
on_records("diwan_reason_v3", {"reason": (lambda: early_rules.reason_3(*_fields()), _sql_reason_3)})
on_records("diwan_score_v1", {"score": (lambda: early_rules.score_1(*_fields(), col("creator"), F.try_element_at("language", F.lit(1))), f"case when {_says(_c1)} then 8 else 0 end + case when {_says('subject')} then 4 else 0 end + case when {_says('description')} then 3 else 0 end + case when {_person('creator')} <> '' then 3 else 0 end + case when length(coalesce(description, '')) > 40 then 2 when length(coalesce(description, '')) > 0 then 1 else 0 end + case when length(subject) > 10 then 1 else 0 end + case when lower(language[1]) = 'ara' then 1 else 0 end")})
_part2 = sql_squeeze(sql_steps(sql_trim(sql_steps(sql_normalize(_c2, N.DIWAN), [(r"^\d+\s*", "", "")])), [(early_rules.PART_2, "", " ")]))
_end2 = f"regexp_extract({_part2}, '(?:^|\\s)(ديوان\\s+.+)$', 1)"
on_records("canonical_title_v2", {"title": (lambda: early_rules.canonical_title_2(col("title")), sql_squeeze(sql_steps(f"case when {_end2} <> '' then {_end2} else {_part2} end", [(early_rules.EDITION_2, "", "")])))})
_names1 = [sql_tags([(sql_test(_tkey, (p, "")), n) for n, p in some]) for some in (early_rules.LINGUISTIC, early_rules.LITERARY)]
_own1 = f"list_filter({_value(list(early_rules.NAMED_TAGS))}, lambda v: list_contains({_names1[0]}, v))"
on_records("thesis_selection_v1", {
    "linguistic": (lambda: joined(early_rules.thesis_names_1(col("title"))[0]), sql_joined(_names1[0])), "literary": (lambda: joined(early_rules.thesis_names_1(col("title"))[1]), sql_joined(_names1[1])),
    "tags": (lambda: joined(early_rules.thesis_tags_1(col("title"))), f"case when len({_names1[0]}) > 0 then case when len({_own1}) > 0 then {sql_joined(_own1)} else {q(early_rules.OTHER_TAG)} end when len({_names1[1]}) > 0 then {q(early_rules.LITERARY[0][0])} end"),
})


@query(f"with {CATALOG} select doc_id from c where kind = 'academies' and doc_id % 4 <> 0 and doc_id % 3 = 1")
def facet_lookup(spark, sf):
    """Facets of a kind lie in a table of their own; rows without an entry there are left out."""
    entries = table(spark, sf, "documents").filter("doc_id % 4 <> 0").select(F.col("doc_id").cast("string").alias("id"), (F.col("doc_id") % 3).cast("string").alias("country"))
    return search.by_facet_table(catalog_rows(spark, sf), entries, "academies", {"country": "1", "year": "all"}).select("doc_id")


@query("select value, n, row_number() over (order by n desc, value) - 1 as place from (select source as value, count(*) as n from documents group by 1)")
def count_order(spark, sf):
    counts = agg.histogram(table(spark, sf, "documents"), F.col("source"), "x")
    return ordering.row_numbers(ordering.by_count(counts), "_less", "value", name="place").select("value", "n", F.col("place").cast("long").alias("place"))


@query("select count(*) as n from documents where doc_id % 3 = 0 and doc_id in (select doc_id from labels)")
def merge_overlap(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return joins.overlap(d.filter("id % 3 = 0"), table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id")


@query("select event_id from events where event_type <> 'error' and props not like '%1%' qualify row_number() over (partition by event_type order by event_id desc) <= 40")
def requeued_buffer(spark, sf):
    """Entries of a failed flush come back before the newer ones and the buffers are cut to their newest; ignored ones are gone."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_type") == "error", "/__manus__/logs").otherwise("/").alias("url"), F.when(F.col("props").contains("1"), "a no-record b").otherwise("x").alias("classes"))
    seen = telemetry.recorded(e, "url", "classes", "no-record")
    return telemetry.requeue(seen.filter("event_id % 2 = 0"), seen.filter("event_id % 2 = 1"), ["event_type"], 40, "event_id").select("event_id")


#: Titles with the labels that a reader gives them in the two reviews; the SQL states these, not the patterns.
REVIEWED = (
    ("كتاب الطالب في النحو", "school-like", ""),
    ("مذكرة الصف الأول الثانوي", "school-like", "school-like"),
    ("اقرأ اونلاين معجم المعاني", "noisy", ""),
    ("طرائق تدريس اللغة العربية", "pedagogic", ""),
    ("تعليم النحو في مدارس مصر", "school-like", ""),
    ("معجم تراجم الأعلام", "", "suspicious"),
    ("ورقة عمل في الإملاء", "school-like", "school-like"),
    ("لسان العرب pdf", "noisy", "malformed"),
    ("2024 معجم تاريخ الطب", "noisy", "suspicious|malformed"),
    ("لسان العرب", "", ""),
    ("معجم_المعاني", "", "malformed"),
    ("lexicon pdfs", "", ""),
)
_REVIEW_SQL = " ".join(f"when {k} then [{q(a)}, {q(b)}]" for k, (_, a, b) in enumerate(REVIEWED))


def reviewed(spark, sf) -> DataFrame:
    titles = F.array(*(F.lit(t) for t, _, _ in REVIEWED))
    return table(spark, sf, "documents").select("doc_id", F.element_at(titles, (F.pmod("doc_id", F.lit(len(REVIEWED))) + 1).cast("int")).alias("title"))


@query(f"select doc_id, l[1] as linguistics, l[2] as dictionary from (select doc_id, case doc_id % {len(REVIEWED)} {_REVIEW_SQL} end as l from documents)")
def title_reviews(spark, sf):
    """School-like, noisy, pedagogic, suspicious and malformed titles of accepted records."""
    labels = lambda rules_: F.array_join(rules.title_review(col("title"), rules_), "|")
    return reviewed(spark, sf).select("doc_id", labels(packs.LINGUISTICS_REVIEW).alias("linguistics"), labels(packs.DICTIONARY_REVIEW).alias("dictionary"))


@query(f"""with l as (select case doc_id % {len(REVIEWED)} {_REVIEW_SQL} end as l from documents)
select label, count(*) filter (where contains('|' || l[2] || '|', '|' || label || '|')) as n from l, (values ('suspicious'), ('school-like'), ('malformed')) v(label) group by label""")
def title_review_counts(spark, sf):
    return rules.review_counts(reviewed(spark, sf), "title", packs.DICTIONARY_REVIEW)
