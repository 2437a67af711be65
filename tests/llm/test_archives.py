"""Archives with headers of any length, repeated rows, ties and nulls."""

import pytest

from daftar.llm import warc


@pytest.mark.parametrize("size", [1_000, 100_000, 8 << 20])
def test_headers_of_any_length(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(warc, "RANGE", min(size, warc.RANGE))
    rows = [(k, "http://a/" + "x" * (70_000 * (k % 3)) + f" {k} ", f"<p>{k // 2}</p>" + "WARC/1.0\r\nContent-Length: 5\r\n" * (k % 4)) for k in range(40)] + [(99, "http://b", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path)
    got = {r["page_id"]: r for r in warc.read_warc(spark, path, with_html=True, task_bytes=size).collect()}
    assert {k: (r["url"], r["html"]) for k, r in got.items() if r["record_type"] == "response"} == {k: (u, h) for k, u, h in rows if got[k]["record_type"] == "response"}
    assert {k: r["url"] for k, r in got.items()} == {k: u for k, u, _ in rows}
    assert all(got[r["refers_to"]]["payload_digest"] == r["payload_digest"] for r in got.values() if r["record_type"] == "revisit")


def test_repeats_ties_and_nulls(spark, tmp_path):
    rows = [(1, "u", "same"), (5, "v", "same"), (5, "v", "same"), (None, "w", "same"), (None, None, "alone"), (None, "x", "alone"), (7, "y", None), (8, "y", "")]
    pages = spark.createDataFrame([(*r, "response", 3, 4) for r in rows], "page_id long, url string, html string, record_type string, payload_bytes int, d int")
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_warc(spark, path).collect()), key=str)
    want = [(1, "revisit", 5, 4), (5, "response", None, 4), (5, "response", None, 4), (None, "revisit", 5, 4), (None, "response", None, 5), (None, "response", None, 5), (7, "revisit", 8, 0), (8, "response", None, 0)]
    assert got == sorted(want, key=str)


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path)
    assert warc.read_warc(spark, path).count() == 0
