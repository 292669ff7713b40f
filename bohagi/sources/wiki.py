"""A data source for MediaWiki interfaces, through a cache of responses.

Options: endpoint, cache (a folder all executors share, of any file system that Arrow knows by its URI), retries and kind:
list (namespace, prefixes, a partition each), pages and details (titles, in batches of 25), index (titles), texts
(revisions) or files (names, batches of 25). A response is kept under the hash of its request, so a
repeated or retried task asks for nothing twice; an answer that is an error is raised, never kept.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Titles asked for at once; seconds an answer may take; how requests name their sender.
BATCH, TIMEOUT, AGENT = 25, 60, "bohagi (corpus preparation)"


class WikiError(RuntimeError):
    """The interface answered with an error."""


class Cache:
    """Answers by the hash of their request in a folder."""

    def __init__(self, path: str) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))

    def _at(self, request: str) -> str:
        return f"{self.root.rstrip('/')}/{hashlib.sha256(request.encode()).hexdigest()}.json"

    def get(self, request: str) -> dict | None:
        at = self._at(request)
        if self.fs.get_file_info(at).type == pafs.FileType.NotFound:
            return None
        with self.fs.open_input_stream(at) as f:
            return json.loads(f.read())

    def put(self, request: str, answer: dict) -> None:
        """Written beside and moved, so that no task reads half of it."""
        at = self._at(request)
        self.fs.create_dir(self.root, recursive=True)
        with self.fs.open_output_stream(f"{at}.{os.getpid()}") as f:
            f.write(json.dumps(answer, ensure_ascii=False).encode())
        self.fs.move(f"{at}.{os.getpid()}", at)


class Client:
    """Cached requests with back-off: 429 waits as told; failures of the server or the line and answers that are no JSON
    wait twice as long each time; other refusals and errors in an answer are raised at once."""

    def __init__(self, endpoint: str, cache: str | None, retries: int = 6, pause: float = 0.25, opener=urllib.request.urlopen, sleep=time.sleep) -> None:
        self.endpoint, self.retries, self.pause, self.opener, self.sleep = endpoint, retries, pause, opener, sleep
        self.cache = Cache(cache) if cache else None

    def _fetch(self, url: str) -> dict:
        for n in range(self.retries):
            last = n == self.retries - 1
            try:
                with self.opener(urllib.request.Request(url, headers={"User-Agent": AGENT}), timeout=TIMEOUT) as r:
                    return json.loads(r.read())
            except urllib.error.HTTPError as e:
                if last or e.code < 500 and e.code != 429:
                    raise
                self.sleep(float(e.headers.get("Retry-After") or 2**n * self.pause))
            except (urllib.error.URLError, TimeoutError, json.JSONDecodeError):
                if last:
                    raise
                self.sleep(2**n * self.pause)
        raise ValueError("retries must be 1 or more")

    def ask(self, **query: str) -> dict:
        url = self.endpoint + "?" + urllib.parse.urlencode(sorted({"format": "json", "formatversion": "2", **query}.items()))
        if self.cache and (kept := self.cache.get(url)) is not None:
            return kept
        got = self._fetch(url)
        if "error" in got:
            raise WikiError(str(got["error"]))
        if self.cache:
            self.cache.put(url, got)
        return got

    def answers(self, **query: str) -> Iterator[dict]:
        """The query part of an answer and of all its continuations."""
        more: dict = {}
        while True:
            got = self.ask(action="query", **query, **more)
            yield got.get("query", {})
            more = {k: str(v) for k, v in got.get("continue", {}).items()}
            if not more:
                return

    def _merged(self, **query: str) -> list[dict]:
        """The pages of an answer, whose parts come in several continuations."""
        pages: dict[str, dict] = {}
        for a in self.answers(**query):
            for p in a.get("pages", []):
                pages.setdefault(p["title"], {}).update(p)
        return list(pages.values())

    def titles(self, prefix: str, namespace: str) -> Iterator[tuple[str]]:
        for a in self.answers(list="allpages", apnamespace=namespace, apprefix=prefix, aplimit="500"):
            yield from ((p["title"],) for p in a.get("allpages", []))

    def pages(self, titles: list[str]) -> Iterator[tuple]:
        """(title, revision, text) of pages; pages that aren't there have neither."""
        for p in self._merged(prop="revisions", rvprop="ids|content|timestamp", rvslots="main", titles="|".join(titles)):
            r = (p.get("revisions") or [{}])[0]
            yield p["title"], r.get("revid"), r.get("slots", {}).get("main", {}).get("content")

    def index(self, title: str) -> Iterator[tuple]:
        """(index, title, number, position) of the pages of a book's index, position counted from 0."""
        at = 0
        for a in self.answers(list="proofreadpagesinindex", prppiititle=title, prppiiprop="ids|title|formattedpagenumber"):
            for p in a.get("proofreadpagesinindex", []):
                yield title, p.get("title"), p.get("formattedPageNumber"), at
                at += 1

    def details(self, titles: list[str]) -> Iterator[tuple]:
        """(title, quality, revision, revised_at, image) of pages; null where there is none."""
        for p in self._merged(prop="proofread|imageforpage|revisions", prppifpprop="filename|size|fullsize", rvprop="ids|timestamp", titles="|".join(titles)):
            r = (p.get("revisions") or [{}])[0]
            image = p.get("imagesforpage") or {}
            yield p["title"], p.get("proofread", {}).get("quality"), r.get("revid"), r.get("timestamp"), image.get("fullsize") or image.get("size")

    def text(self, revision: str) -> Iterator[tuple]:
        """(revision, markup) of a parsed revision."""
        got = self.ask(action="parse", oldid=revision, prop="text", disableeditsection="1", disablelimitreport="1")
        yield int(revision), got.get("parse", {}).get("text")

    def files(self, names: list[str]) -> Iterator[tuple]:
        """(title, url, sha1, license, license_url, artist, credit) of files; artist and credit are mark-up."""
        for p in self._merged(prop="imageinfo", iiprop="url|sha1|extmetadata", titles="|".join(f"File:{n}" for n in names)):
            x = (p.get("imageinfo") or [{}])[0]
            m = x.get("extmetadata", {})
            yield p["title"], x.get("url"), x.get("sha1"), *(m.get(k, {}).get("value") for k in ("LicenseShortName", "LicenseUrl", "Artist", "Credit"))


#: Of each kind: the option with its values, how many go in a partition, and the columns.
KINDS = {
    "list": ("prefixes", 1, "title string"),
    "pages": ("titles", BATCH, "title string, revision long, text string"),
    "index": ("titles", 1, "index string, title string, number string, position int"),
    "details": ("titles", BATCH, "title string, quality int, revision long, revised_at string, image string"),
    "texts": ("revisions", 1, "revision long, markup string"),
    "files": ("names", BATCH, "title string, url string, sha1 string, license string, license_url string, artist string, credit string"),
}


class _Part(InputPartition):
    def __init__(self, values: list[str]) -> None:
        super().__init__(None)
        self.values = values


class WikiReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.o = dict(options)

    def partitions(self):
        option, size, _ = KINDS[self.o.get("kind", "list")]
        values = [str(x) for x in json.loads(self.o.get(option, '[""]' if option == "prefixes" else "[]"))]
        return [_Part(values[i : i + size]) for i in range(0, len(values), size)] or [_Part([])]

    def read(self, partition):
        c, kind = Client(self.o["endpoint"], self.o.get("cache"), int(self.o.get("retries", "6"))), self.o.get("kind", "list")
        if not partition.values:
            return
        if kind == "list":
            yield from c.titles(partition.values[0], self.o.get("namespace", "106"))
        elif kind in ("index", "texts"):
            yield from (c.index if kind == "index" else c.text)(partition.values[0])
        else:
            yield from {"pages": c.pages, "details": c.details, "files": c.files}[kind](partition.values)


class WikiSource(DataSource):
    """spark.dataSource.register(WikiSource); spark.read.format("wiki")."""

    @classmethod
    def name(cls) -> str:
        return "wiki"

    def schema(self) -> str:
        return KINDS[self.options.get("kind", "list")][2]

    def reader(self, schema):
        return WikiReader(self.options)
