"""A paged service as a source: each page comes with the token of the next, as a table or as a stream.

`fetch(token, limit)` returns (rows, next token or None) and raises Busy where the service
asks to wait. It is named by the option `fetch` as `module:function`; other options whose
names begin with `fetch.` are passed on to it by keyword.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

PAGE = 500
TRIES = 5


class Busy(Exception):
    """The service is busy; try again after so many seconds."""

    def __init__(self, seconds: float = 1.0):
        super().__init__(f"busy for {seconds} s")
        self.seconds = seconds


def fetcher(options) -> tuple[Callable, int, int, str]:
    """(fetch with its keywords, page size, tries, first token)."""
    module, _, name = options["fetch"].partition(":")
    given = {k.removeprefix("fetch."): v for k, v in dict(options).items() if k.startswith("fetch.")}
    function = getattr(importlib.import_module(module), name)
    return (lambda token, limit: function(token, limit, **given)), int(options.get("page", PAGE)), int(options.get("tries", TRIES)), options.get("token", "")


def one_page(fetch: Callable, token: str, limit: int, tries: int, sleep: Callable = time.sleep) -> tuple[list, str | None]:
    """A page, asked for again while the service is busy; the last refusal is passed on."""
    for attempt in range(tries):
        try:
            return fetch(token, limit)
        except Busy as e:
            if attempt == tries - 1:
                raise
            sleep(e.seconds)
    raise ValueError("at least one try is needed")


class From(InputPartition):
    def __init__(self, token: str):
        super().__init__(token)
        self.token = token


class PagedReader(DataSourceReader):
    """All pages, one after the other: each token is known only from the page before."""

    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [From(self.options.get("token", ""))]

    def read(self, partition) -> Iterator[tuple]:
        fetch, limit, tries, _ = fetcher(self.options)
        token: str | None = partition.token
        while token is not None:
            rows, token = one_page(fetch, token, limit, tries)
            yield from map(tuple, rows)


class PagedStream(SimpleDataSourceStreamReader):
    """A page for each micro-batch; the offset is the token, so a restarted query goes on where it stopped."""

    def __init__(self, options):
        self.fetch, self.limit, self.tries, self.first = fetcher(options)

    def initialOffset(self) -> dict:
        return {"token": self.first, "end": 0}

    def read(self, start: dict):
        if start["end"]:
            return iter(()), start
        rows, token = one_page(self.fetch, start["token"], self.limit, self.tries)
        return iter([tuple(r) for r in rows]), {"token": token or start["token"], "end": int(token is None)}

    def readBetweenOffsets(self, start: dict, end: dict):
        out, at = [], start
        while at != end:
            rows, at = self.read(at)
            out += rows
        return iter(out)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ordwell_paged"

    def schema(self) -> str:
        return self.options.get("schema", "name string, url string")

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return PagedStream(self.options)


def made_up(token: str, limit: int, rows: str = "0") -> tuple[list[tuple[str, str]], str | None]:
    """A service with so many pictures, in order; for tests and queries, as there is no network here."""
    first, total = int(token or 0), int(rows)
    after = min(total, first + limit)
    return [(f"Picture_{i:06d}.png", f"https://example.org/{i}") for i in range(first, after)], str(after) if after < total else None
