"""Sources, assembly, search, imports, the diwan chain, sinks and streams, end to end on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from daftar import schema
from daftar.operators import projections, report
from daftar.plans import assemble, diwans, importer, search
from daftar.sources import catalogs, paged, sinks
from daftar.streaming import telemetry


def record(id_, title, url="", category="references", tags=("نحو",), source="s", author=None, signals=()):
    return (id_, title, author, source, "p", url, category, list(tags), (list(signals), [], True))


def frame(spark, rows):
    df = spark.createDataFrame(rows, schema.RECORD)
    return df.withColumn("ord", F.monotonically_increasing_id())


@pytest.fixture(scope="module")
def catalog(spark):
    base = frame(spark, [record("1", "كتاب النحو", "u1"), record("2", "معلقة امرئ القيس", "u2", "diwans", ("شعر وأدب",), signals=("سجل ديوان موثّق",)), record("3", "ألفية", "u3", "diwans", source="المنظومات العلمية")])
    extra = frame(spark, [record("1", "نسخة"), record("9", "كتابٌ جديد", "u1"), record("10", "بلاغة", "", tags=("بلاغة",)), record("10", "بلاغة", "")])
    titled = frame(spark, [record("20", "كتابُ النّحو", "zz"), record("21", "صرف", "", tags=("صرف",))])
    return assemble.silver(assemble.assemble({"base": base, "rhetorical": extra, "gap": titled})).cache()


def test_assembly(catalog):
    assert sorted(r["id"] for r in catalog.collect()) == ["1", "10", "10", "2", "21", "3"]


def test_search(catalog):
    ids = lambda **k: sorted(r["id"] for r in search.results(catalog, search.Request(**k)).collect())
    assert ids() == ["2"]
    assert ids(query="النحو كتاب") == ["1"]
    assert ids(query="!!") == ["1", "10", "10", "2", "21", "3"]
    assert ids(category="scientific_poems") == ["3"] and ids(category="diwans") == ["2"]
    assert ids(stat="linguistics") == ["1", "10", "21", "3"] and ids(stat="diwans") == ["2", "3"]
    counts = {r["name"]: r["n"] for r in search.category_counts(catalog).collect()}
    assert counts["all"] == 6 and counts["diwans"] == 1 and counts["references"] == 4
    assert {r["name"]: r["n"] for r in search.stat_cards(catalog).collect()}["all"] == 6
    assert search.ordered_page(catalog, search.Request(query="!!", page=7)).number == 1
    assert {r["name"]: r["n"] for r in search.global_counts(catalog).collect()}["poems"] == 1


def test_cards(catalog):
    r = {x["id"]: x for x in projections.card(catalog).collect()}
    assert r["3"]["categoryLabel"] == "المنظومات العلمية" and r["1"]["action"] == "open" and r["10"]["action"] == "none"


def test_adapters(spark):
    academy = spark.createDataFrame([("7", "عنوان", "مجمع", "غير محدد", "مجلة", "1999", "يعمل", "http://x", None, "f")], schema.ACADEMY)
    a = projections.academies(academy).collect()[0]
    assert (a["id"], a["author"], a["tags"][-2:]) == ("academies-7", None, ["سنة 1999", "يعمل"])
    club = spark.createDataFrame([("7", "عنوان", "ناد", "جدة", "السعودية", "كتاب", "غير محدد", "يعمل", None, None, "f")], schema.CLUB)
    c = projections.literary_clubs(club).collect()[0]
    assert (c["sourceUrl"], "غير محدد" in c["tags"]) == ("", True)
    course = spark.createDataFrame([(3, " منهج ", "كتاب", " ", "مصر", "ثانوي", "طلاب", "محقق", " http://y ", ["نحو", "كتاب"])], schema.CURRICULUM)
    m = projections.curricula(course, "مجموعة").collect()[0]
    assert (m["id"], m["title"], m["author"], m["source"], m["tags"].count("كتاب")) == ("curricula-3", "منهج", None, "مصر", 1)


def test_json_sources(spark, tmp_path):
    rows = [{"id": "a", "title": "t"}, {"id": "b"}]
    for name, value in (("wrapped", {"metadata": {"x": 1}, "materials": rows}), ("bare", rows), ("odd", {"x": 1}), ("groups", {"titles_by_category": {"c": ["x", "y"], "d": "z"}}), ("chat", {"messages": [{"type": "message", "id": 4, "text": ["a", {"text": "b"}]}]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(value, ensure_ascii=False))
    p = lambda n: str(tmp_path / f"{n}.json")
    assert [(r["id"], r["ord"]) for r in catalogs.read_catalog(spark, p("wrapped")).collect()] == [("a", 0), ("b", 1)]
    for n in ("wrapped", "bare"):
        assert [r["id"] for r in catalogs.read_array_or_wrapped(spark, p(n), schema.RECORD, "books", "materials").orderBy("ord").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="neither an array"):
        catalogs.read_array_or_wrapped(spark, p("odd"), schema.RECORD, "materials").collect()
    assert [(r[0], r[1]) for r in catalogs.read_title_groups(spark, p("groups")).orderBy("ord").collect()] == [("c", "x"), ("c", "y")]
    assert catalogs.read_messages(spark, p("chat")).collect()[0]["id"] == 4
    docs = spark.createDataFrame([(json.dumps({"identifier": "i", "title": ["a", "b"], "subject": "s"}),)], "json string")
    d = catalogs.archive_documents(docs).collect()[0]
    assert (d["title"], d["subject"], d["creator"]) == (["a", "b"], ["s"], [])


def test_html_cards(spark):
    card = '<div class="bg-card rounded-xl border shadow"><h3><a href="/ar/1">ديوان <b>أ</b></a></h3><a href="/ar/authors/2">شاعر</a><p>المجلدات: 3</p><p>الصفحات: 120</p></div>'
    df = spark.createDataFrame([(1, f"<html>{card}<div class='card'><h3><a href='/ar/9'>x</a></h3></div>{card.replace('/ar/1', '/en/1')}</html>"), (2, None)], "page_id long, html string")
    rows = [tuple(r) for r in catalogs.html_cards(df).collect()]
    assert rows == [(1, 0, "ديوان أ", "/ar/1", "شاعر", 3, 120)]


@pytest.mark.parametrize(("paging", "most", "asked", "got"), [("fixed", 9, [1, 2, 3], "abcde"), ("fixed", 2, [1, 2], "abcd"), ("cursor", 9, [1, 2, 3], "abcde")])
def test_pages_end_by_themselves(paging, most, asked, got):
    """Pages of two, the third one short: no page after it is asked for."""
    pages, seen = {1: "ab", 2: "cd", 3: "e", 4: ""}, []

    def fetch(url):
        seen.append(int(url.split("page=")[1].split("&")[0]))
        return {"response": {"numFound": 5, "docs": [{"identifier": x} for x in pages[seen[-1]]]}}

    reader = paged.PagedReader({"url": "http://stub", "queries": '["q"]', "rows": "2", "paging": paging, "maxPages": str(most), "pauseSeconds": "0"}, fetch)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert "".join(json.loads(r[3])["identifier"] for r in rows) == got and seen == asked
    limited = paged.PagedReader({"url": "http://stub", "queries": '["q"]', "rows": "2", "paging": "cursor", "maxResults": "3", "pauseSeconds": "0"}, fetch)
    assert "".join(json.loads(r[3])["identifier"] for p in limited.partitions() for r in limited.read(p)) == "abc"
    assert list(paged.pages_until_empty(pages.get, list)) == [(1, "ab"), (2, "cd"), (3, "e")]


def test_views_are_kept_until_the_catalog_changes(catalog):
    views = search.Views(catalog)
    first = views.results(search.Request(query="النحو"))
    assert views.results(search.Request(query="النحو ")) is first and views.results(search.Request(query="صرف")) is not first
    few = search.Views(catalog, most=2)
    a, b = few.results(search.Request(query="النحو")), few.results(search.Request(query="صرف"))
    assert few.results(search.Request(query="النحو")) is a and few.results(search.Request(query="شعر")) is not b
    assert len(few.kept) == 2 and a.storageLevel.useMemory and not b.storageLevel.useMemory  # the least recently asked one went
    views.replace(catalog)
    assert not first.storageLevel.useMemory and views.results(search.Request(query="النحو")) is not first


def test_all_batches_are_planned_in_linear_size(spark):
    base = frame(spark, [record(str(k), f"عنوان {k}", f"u{k}") for k in range(3)])
    batches = {b.name: base.withColumn("id", F.concat("id", F.lit(b.name))).withColumn("sourceUrl", F.concat("sourceUrl", F.lit(b.name))) for b in assemble.ORDER}
    out = assemble.assemble(batches)
    titled = sum("title" in b.keys for b in assemble.ORDER)
    assert out.count() == 3 * (len(assemble.ORDER) - titled) and out._jdf.queryExecution().optimizedPlan().toString().count("\n") < 20


def test_paged_source_and_hydration(spark):
    pages = {1: ["a", "b"], 2: ["c"]}
    fetch = lambda url: {"response": {"numFound": 3, "docs": [{"identifier": x} for x in pages[int(url.split("page=")[1].split("&")[0])]]}}
    options = {"url": "http://stub", "queries": '["q"]', "rows": "2", "paging": "count", "pauseSeconds": "0"}
    reader = paged.PagedReader(options, fetch)
    assert [json.loads(r[3])["identifier"] for p in reader.partitions() for r in reader.read(p)] == ["a", "b", "c"]
    with pytest.raises(ValueError, match="without response"):
        list(paged.PagedReader({**options, "paging": "single"}, lambda u: {}).read(paged._Page("q", 1)))
    answers = {None: {"items": [1, 2], "cursor": "x"}, "x": {"items": [3]}}
    assert list(paged.cursor_pages(answers.get)) == [1, 2, 3]
    ids = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "identifier string")
    cache = spark.createDataFrame([("a", "{}")], "identifier string, json string")
    got = {r[0]: r[1] for r in paged.hydrate(ids, cache, lambda part: {i: {"title": i} for i in part}).collect()}
    assert got == {"a": "{}", "b": '{"title": "b"}'}

    def broken(part):
        raise OSError("down")

    assert "_fetchError" in paged.hydrate(ids, cache, broken).filter("identifier = 'b'").collect()[0]["json"]


BOOKS = [
    ("good", "شرح قواعد النحو العربي", "https://archive.org/details/good", ["ara"], ["نحو"], None), ("noid", "كتاب النحو العربي", "http://x", ["ara"], ["نحو"], None), ("latin", "Arabic Grammar", "https://archive.org/details/latin", ["ara"], ["نحو"], None),
    ("exam", "اختبار النحو للطلاب", "https://archive.org/details/exam", ["ara"], ["نحو"], None), ("eng", "كتاب النحو القديم", "https://archive.org/details/eng", ["eng"], ["نحو"], None), ("topic", "كتاب الطبخ الحديث", "https://archive.org/details/topic", ["ara"], ["طبخ"], None),
    ("proof", "كتاب النحو الكبير", "https://archive.org/details/proof", [], ["نحو"], None), ("copy", "شرح قواعد النحو العربي", "https://archive.org/details/copy", ["ara"], ["نحو"], None), ("known", "المعجم اللغوي المعروف", "https://archive.org/details/known", ["ara"], ["معجم"], None),
    ("gone", "كتاب النحو الغائب", "https://archive.org/details/gone", ["ara"], ["نحو"], "timeout"), ("none", None, None, None, None, None),
]


def test_archive_import_gives_one_decision_per_row(spark):
    books = spark.createDataFrame([(k, b[0], b[1], b[2]) for k, b in enumerate(BOOKS)], "ord long, identifier string, title string, archive_item_url string")
    meta = spark.createDataFrame([(b[0], None, None, b[3], b[4], None, b[5]) for b in BOOKS], "identifier string, title array<string>, creator array<string>, language array<string>, subject array<string>, description array<string>, _fetchError string")
    known = frame(spark, [record("archive-known", "x", "y")])
    out = importer.archive_import(books, meta, known)
    got = {r["identifier"]: (r["status"], r["reason"]) for r in out.decisions.collect()}
    assert got == {
        "good": ("accepted", None), "noid": ("rejected", "incomplete"), "latin": ("rejected", "not_arabic_title"), "exam": ("rejected", "worksheet"), "eng": ("rejected", "other_language"), "topic": ("rejected", "off_topic"),
        "proof": ("rejected", "no_evidence"), "copy": ("duplicate", "batch_near"), "known": ("duplicate", "existing_exact"), "gone": ("failed", "failed"), "none": ("rejected", "incomplete"),
    }
    a = out.audit.collect()[0]
    assert a["balanced"] and a["input"] == len(BOOKS)
    assert {r["tag"] for r in importer.accepted_by_tag(out).collect()} >= {"نحو"}
    for pack in ("grammar", "rhetoric"):
        assert importer.archive_import(books, meta, known, pack).audit.collect()[0]["balanced"]


def test_title_list_import(spark):
    rows = [("النحو والإعراب", "الإعراب_في النحو العربي", 0), ("x", "تساؤلات", 1), ("x", "Short", 2), ("x", "إعراب النحو العربى الحديث والقديم", 3), ("x", "اعراب النحو العربي الحديث والقديم", 4), (None, None, 5)]
    out = importer.title_list_import(spark.createDataFrame(rows, "sourceCategory string, title string, ord long"), frame(spark, [record("z", "غير ذلك")]))
    assert [r["status"] for r in out.decisions.orderBy("ord").collect()] == ["accepted", "rejected", "rejected", "accepted", "duplicate", "rejected"]
    assert out.audit.collect()[0]["balanced"]


def test_theses(spark):
    rows = [("message", 1, "النحو_العربي رسالة ماجستير.pdf", "application/pdf", '""'), ("message", 2, "x.pdf", None, '["ديوان المتنبي ", {"text": "رسالة دكتوراه"}]'), ("service", 3, "y.pdf", None, '""'), ("message", 4, "photo.png", "image/png", '""')]
    m = spark.createDataFrame(rows, "type string, id long, file_name string, mime_type string, text string")
    got = {r["id"]: r for r in importer.thesis_candidates(m, "c").collect()}
    assert set(got) == {1, 2} and got[1]["level"] == "ماجستير" and got[2]["level"] == "دكتوراه" and got[2]["title"].startswith("ديوان")
    theses = frame(spark, [record("t1", "أ", "https://t.me/Arsail2020/1"), record("t2", "ب", "https://t.me/Arsail2020/1/"), record("t3", "كتاب النحو", "u")])
    out = importer.thesis_import(theses, frame(spark, [record("1", "كتاب النحو", "u1")]))
    assert sorted((r["id"], r["status"], r["reason"]) for r in out.decisions.collect()) == [("t1", "accepted", None), ("t2", "duplicate", "batch_url"), ("t3", "duplicate", "existing_title")]


def test_diwan_chain(spark):
    kinds = "identifier string, title array<string>, creator array<string>, language array<string>, subject array<string>, description array<string>, mediatype string, ord long"
    rows = [
        ("a", ["ديوان المتنبي"], ["المتنبي"], ["ara"], ["شعر"], None, "texts", 0), ("a", ["ديوان المتنبي pdf"], ["المتنبي"], ["ara"], ["شعر عربي قديم"], None, "texts", 1), ("b", ["ديوان المتنبي"], None, None, None, None, "texts", 2),
        ("c", ["شرح ديوان المتنبي"], None, None, None, None, "texts", 3), ("d", ["ديوان"], None, None, None, None, "audio", 4), ("e", ["كتاب عربي"], None, None, None, None, "texts", 5), ("f", ["Diwan"], None, None, None, None, "texts", 6), ("g", ["ديوان الشاعر الجزء الثاني"], None, None, None, None, "texts", 7),
    ]
    docs = spark.createDataFrame(rows, kinds)
    reasons = {r["identifier"]: r["reason"] for r in diwans.classify(docs).collect()}
    assert reasons == {"a": None, "b": None, "c": "دراسة أو سجل غير ديواني", "e": "البيانات لا تثبت أن السجل ديواناً مستقلاً", "f": "عنوان غير عربي", "g": "مجموعة أو جزء غير مستقل"}
    assert [r["identifier"] for r in diwans.harvest(docs).collect()] == ["a"]
    archive = frame(spark, [record("archive-old", "ديوان قديم", category="diwans"), record("archive-keep", "ديوان باق", category="diwans")])
    new, _ = diwans.upload(docs, archive, archive.filter("id = 'archive-old'"))
    assert sorted(r["id"] for r in new.collect()) == ["archive-a", "archive-keep"]
    merged, rejected = diwans.catalog(spark.createDataFrame([("1", "ديوان البحتري", "البحتري", "الجامع", "u1", ["x"], 2, None, 0), ("2", "ديوان البحتري", "البحتري", "Internet Archive", "u2", None, None, 9, 1), ("3", "فهرس", "x", "الجامع", "u", None, None, None, 2)], "id string, title string, author string, source string, sourceUrl string, signals array<string>, volumes int, pages int, ord long"))
    r = merged.collect()
    assert len(r) == 1 and r[0]["id"] == "2" and r[0]["sourceCount"] == 2 and rejected.count() == 1
    refined = diwans.refine(frame(spark, [record("1", "12345_ديوان أ pdf"), record("2", "ديوان أ", "u"), record("3", "  ")]))
    assert {r["id"]: r["reason"] for r in refined.collect()} == {"2": None, "3": "عنوان فارغ بعد التنظيف"}
    both = diwans.merge_batches(frame(spark, [record("1", "a"), record("2", "b")]), frame(spark, [record("2", "c"), record("3", "d")]))
    assert sorted((r["id"], r["title"]) for r in both.collect()) == [("1", "a"), ("2", "c"), ("3", "d")]


def test_sinks(spark, tmp_path):
    meta = spark.createDataFrame([({"notes": "old", "x": "1"},)], "metadata map<string,string>")
    once = sinks.patch_metadata(meta, "new", 7)
    assert sinks.patch_metadata(once, "new", 7).collect()[0][0] == {"notes": "old new", "x": "1", "totalMaterials": "7"}
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    sinks.commit(df, df, str(tmp_path / "c"), str(tmp_path / "a"))
    assert (tmp_path / "a").exists() and not (tmp_path / "c").exists()
    got = sinks.upsert(df, spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int"), "k").collect()
    assert sorted((r["k"], r["v"]) for r in got) == [("a", 2), ("b", 3)]
    table = report.markdown_table(spark.createDataFrame([(1, "a|b", None)], "n int, t string, u string"), "n", ["t", "u"], ["T", "U"])
    assert table.splitlines()[-1] == "| 1 | a\\|b | — |"


def test_redaction(spark):
    value = {"userToken": "x", "a": {"b": [1] * 200}, "s": "y" * 1001, "deep": [[[[[[[1]]]]]]]}
    got = telemetry.redact(value)
    assert got["userToken"] == "[REDACTED]" and len(got["a"]["b"]) == 100 and got["s"].endswith("...[truncated]") and "[Max Depth]" in json.dumps(got)
    df = spark.createDataFrame([(json.dumps(value),), ("no json",), (None,)], "t string")
    assert [r[0] for r in df.select(telemetry.redact_json("t")).collect()] == [json.dumps(got, separators=(",", ":")), "no json", None]


def test_streams(spark, tmp_path):
    rows = [(1, k, f"2024-01-01 00:00:00.{ms:03d}", "ui", f"e{k}") for k, ms in enumerate((0, 400, 499, 500, 999))]
    spark.createDataFrame(rows, "user_id long, event_id long, t string, stream string, payload string").select("user_id", "event_id", F.to_timestamp("t").alias("ts"), "stream", "payload").write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    assert sorted(r["event_id"] for r in telemetry.throttle(batch, "user_id", "ts", "event_id").collect()) == [0, 3]
    stream = lambda: spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("kept", telemetry.throttle_stream(stream(), "user_id", "ts", "event_id"), "append"), ("ring", telemetry.ring_buffer_stream(stream(), "user_id", "event_id", 3), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r["event_id"] for r in spark.table("kept").collect()) == [0, 3]
    assert spark.table("ring").collect()[0]["ids"] == [2, 3, 4]
    telemetry.start_flushes(stream(), str(tmp_path / "logs"), str(tmp_path / "ck"), available_now=True).awaitTermination(120)
    for name in ("sessionReplay", "uiEvents"):
        assert catalogs.read_log(spark, str(tmp_path / "logs" / name)).count() == 5


def test_settings_of_a_run():
    from daftar.plans.settings import Settings, settings

    assert settings({}, []) == Settings()
    assert settings({"INPUT_PATH": "a", "CORPUS_PATH": "b", "APPLY": "1", "CONCURRENCY": "3"}, ["x"]) == Settings("x", "b", True, False, 3)
    assert settings({"DRY_RUN": "1", "APPLY": "yes"}, ["x", "y", "z"]) == Settings("x", "y", False, True, 6)
