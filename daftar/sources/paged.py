"""Remote paged search as a Spark data source, and keyed metadata fetches.

The network client is a parameter, so tests pass a stub and nothing is fetched
unless a caller asks for it.
"""

from __future__ import annotations

import itertools
import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# --- fixed values: the remote service's limits ---
ROWS, MAX_PAGES, MAX_RESULTS, PAUSE_S, TIMEOUT_S, ATTEMPTS, CHUNK, WORKERS = 1000, 5, 5000, 0.25, 30, 3, 25, 6
#: Tasks of a batch of a cursor feed.
TASKS = 64


def http_json(url: str, timeout: float = TIMEOUT_S) -> dict:
    with urllib.request.urlopen(url, timeout=timeout) as r:
        return json.load(r)


def search_address(base: str, query: str, page: int, rows: int, fields: Sequence[str]) -> str:
    pairs = [("q", query), *(("fl[]", f) for f in fields), ("sort[]", "downloads desc"), ("rows", rows), ("page", page), ("output", "json")]
    return f"{base}?{urllib.parse.urlencode(pairs)}"


def retried(call: Callable[[], dict], attempts: int = ATTEMPTS, pause: float = PAUSE_S) -> dict:
    """``call`` with linear back-off; the last error is raised."""
    for k in range(1, attempts + 1):
        try:
            return call()
        except Exception:
            if k == attempts:
                raise
            time.sleep(pause * k)
    raise AssertionError


class _Page(InputPartition):
    def __init__(self, query: str, page: int):
        super().__init__((query, page))
        self.query, self.page = query, page


class PagedReader(DataSourceReader):
    """One partition per query and page, or per query where a page decides about the next.

    ``paging``: ``fixed`` reads pages of a query until a short one or maxPages;
    ``cursor`` until as many results as numFound or maxResults have come;
    ``count`` asks numFound first and plans as many pages as it needs, up to
    maxResults, to be read side by side; ``single`` is one large page.
    """

    def __init__(self, options, fetch: Callable[[str], dict] = http_json):
        self.base, self.queries = options["url"], json.loads(options["queries"])
        self.rows, self.max_pages = int(options.get("rows", ROWS)), int(options.get("maxPages", MAX_PAGES))
        self.max_results, self.paging = int(options.get("maxResults", MAX_RESULTS)), options.get("paging", "fixed")
        self.fields = json.loads(options.get("fields", '["identifier", "title"]'))
        self.pause, self.fetch = float(options.get("pauseSeconds", PAUSE_S)), fetch

    def get(self, query: str, page: int, rows: int | None = None) -> dict:
        payload = retried(lambda: self.fetch(search_address(self.base, query, page, rows or self.rows, self.fields)), pause=self.pause)
        if not isinstance(payload.get("response", {}).get("docs"), list):
            raise ValueError("the search answered without response.docs")
        return payload["response"]

    def partitions(self):
        if self.paging in ("fixed", "cursor"):
            return [_Page(q, 0) for q in self.queries]
        pages = {"single": lambda q: 1, "count": lambda q: -(-min(int(self.get(q, 1, 1)["numFound"]), self.max_results) // self.rows)}[self.paging]
        return [_Page(q, p) for q in self.queries for p in range(1, pages(q) + 1)]

    def pages(self, query: str) -> Iterator[tuple[int, list]]:
        """The pages of a query, one after another, until the paging ends them."""
        seen = 0
        for page in itertools.count(1):
            time.sleep(self.pause)
            answer = self.get(query, page)
            docs = answer["docs"]
            most = min(int(answer["numFound"]), self.max_results) if self.paging == "cursor" else None
            yield page, docs if most is None else docs[: most - seen]
            seen += len(docs)
            if not docs or (seen >= most if most is not None else len(docs) < self.rows or page >= self.max_pages):
                return

    def read(self, partition: _Page) -> Iterator[tuple]:
        if partition.page:
            time.sleep(self.pause)
            pages = [(partition.page, self.get(partition.query, partition.page)["docs"])]
        else:
            pages = self.pages(partition.query)
        for page, docs in pages:
            for k, doc in enumerate(docs):
                yield partition.query, page, k, json.dumps(doc, ensure_ascii=False)


class PagedSearch(DataSource):
    """``spark.read.format("paged_search")``: query, page, place, json."""

    @classmethod
    def name(cls):
        return "paged_search"

    def schema(self):
        return "query string, page int, place int, json string"

    def reader(self, schema):
        return PagedReader(self.options)


def pages_until_empty(fetch: Callable[[int], str], cards: Callable[[str], list]) -> Iterator[tuple[int, str]]:
    """(number, html) of the pages of a list, until the first that has no cards."""
    for page in itertools.count(1):
        html = fetch(page)
        if not cards(html):
            return
        yield page, html


class _Answers(InputPartition):
    def __init__(self, n: int, cursors: list[str]):
        super().__init__((n, cursors))
        self.n, self.cursors = n, cursors


class CursorStreamReader(DataSourceStreamReader):
    """A cursor interface as a stream: an answer holds items and the cursor of the next answer.

    An offset holds the number of answers so far, the next cursor and the
    cursors of its batch, so a batch that is tried again reads the same answers.
    A batch holds ``answersPerBatch``; up to ``catchUpAnswers``, if that is more,
    each batch is twice the one before, so that a long feed takes few. A task
    reads one answer, or several where a batch has more than TASKS. Only cursors pass through planning. Spark does
    not tell a restarted reader where it stood, so the place is also kept in
    ``stateLocation``, written when a batch is planned, after Spark has logged
    its offset: it is the last logged place, or one batch behind it, and that
    batch is then planned again before any other.
    """

    def __init__(self, options, fetch: Callable[[str], dict] = http_json):
        self.base, self.per_batch = options["url"], int(options.get("answersPerBatch", 10))
        self.most = max(self.per_batch, int(options.get("catchUpAnswers", 0)))
        self.state, self.pause, self.fetch = options["stateLocation"].rstrip("/"), float(options.get("pauseSeconds", PAUSE_S)), fetch
        self.place: dict | None = None

    def get(self, cursor: str) -> dict:
        time.sleep(self.pause)
        return retried(lambda: self.fetch(f"{self.base}?{urllib.parse.urlencode([('cursor', cursor)])}"), pause=self.pause)

    def _file(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.state)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0, "next": "", "batch": "[]", "done": False}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.place is None:
            files, path = self._file()
            with_state = files.get_file_info(f"{path}/place.json").is_file
            self.place = json.loads(files.open_input_stream(f"{path}/place.json").read()) if with_state else self.initialOffset()
        cursor, batch, done = self.place["next"], [], self.place["done"]
        wanted = max(self.per_batch, min(self.most, 2 * len(json.loads(self.place["batch"]))))
        while not done and len(batch) < wanted:
            answer = self.get(cursor)
            batch.append(cursor)
            cursor, done = answer.get("cursor") or "", not answer.get("cursor")
        if not batch:
            return self.place
        return {"n": self.place["n"] + len(batch), "next": cursor, "batch": json.dumps(batch), "done": done}

    def partitions(self, start: dict, end: dict):
        self.place = end
        files, path = self._file()
        files.create_dir(path, recursive=True)
        with files.open_output_stream(f"{path}/place.new") as out:
            out.write(json.dumps(end).encode())
        files.move(f"{path}/place.new", f"{path}/place.json")
        if start["n"] >= end["n"]:
            return []
        batch = json.loads(end["batch"])
        size = -(-len(batch) // TASKS)
        return [_Answers(end["n"] - len(batch) + k, batch[k : k + size]) for k in range(0, len(batch), size)]

    def read(self, partition: _Answers) -> Iterator[tuple]:
        for n, cursor in enumerate(partition.cursors, partition.n):
            for k, item in enumerate(self.get(cursor).get("items", [])):
                yield n, k, json.dumps(item, ensure_ascii=False)


class CursorFeed(DataSource):
    """``spark.readStream.format("cursor_feed")``: answer, place, json."""

    @classmethod
    def name(cls):
        return "cursor_feed"

    def schema(self):
        return "answer int, place int, json string"

    def streamReader(self, schema):  # noqa: N802
        return CursorStreamReader(self.options)


def cursor_pages(fetch: Callable[[str | None], dict], most: int = MAX_RESULTS) -> Iterator[dict]:
    """Items of a cursor interface, request after request, until it ends or ``most`` are read."""
    cursor, seen = None, 0
    while seen < most:
        answer = fetch(cursor)
        items = answer.get("items", [])
        yield from items[: most - seen]
        seen += len(items)
        cursor = answer.get("cursor")
        if not cursor or not items:
            return


def hydrate(ids: DataFrame, cache: DataFrame, fetch: Callable[[list[str]], dict[str, dict]], key: str = "identifier", workers: int = WORKERS, attempts: int = ATTEMPTS) -> DataFrame:
    """``cache`` (identifier, json) with rows for the ids it lacks.

    Only missing ids are fetched, ``CHUNK`` at a time on ``workers`` partitions;
    a chunk that keeps failing gives rows with ``_fetchError``.
    """
    missing = ids.select(F.col(key).alias("identifier")).filter("identifier is not null").distinct().join(cache.select("identifier"), "identifier", "left_anti").repartition(workers)

    def run(batches):
        for pdf in batches:
            names = pdf["identifier"].tolist()
            for k in range(0, len(names), CHUNK):
                part = names[k : k + CHUNK]
                try:
                    found = retried(lambda p=part: fetch(p), attempts, 0.01)
                    rows = [(i, json.dumps(found.get(i, {"_fetchError": "missing"}), ensure_ascii=False)) for i in part]
                except Exception as e:
                    rows = [(i, json.dumps({"_fetchError": str(e)})) for i in part]
                yield pd.DataFrame(rows, columns=["identifier", "json"])

    return cache.select("identifier", "json").unionByName(missing.mapInPandas(run, "identifier string, json string"))
