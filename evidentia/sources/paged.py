"""A paged search as a data source: one partition for each page, bounded retries, and offsets for reading on as pages are added.

A page is a JSON document with its items in a list. Where it is comes from a template with {page}, from 1 on: an http(s) address, or a path of a folder that
all executors see, which stands for the network in tests. Register with spark.dataSource.register(PagedSource), then

    spark.read.format("paged").schema(...).option("location", "https://host/search?q=x&page={page}").option("pages", 10).load()

Options: location; pages (how many there are; 0: as many as a first request says in the field `total`, at `perPage` items each); perPage (100); items (the list's field, "items"); most (items wanted at
most, 0: all); tries (4) and wait (seconds before the second try, doubled each time, at most 90; a server's Retry-After counts, within that bound); failures: "fail" stops the read when a page
has failed `tries` times, "row" gives a row that has nothing but the failure in the column `_failure`, which the schema must have.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import ArrayType, DataType, StructType

LONGEST_WAIT = 90.0
FAILURE = "_failure"


@dataclass
class Page(InputPartition):
    number: int


class PageError(RuntimeError):
    """A page that didn't come within its tries."""


def fetched(location: str, page: int, tries: int, wait: float, timeout: float = 30.0) -> dict:
    """The document of a page. What can't get better with time (a wrong address, no permission) isn't tried again."""
    where, last = location.format(page=page), ""
    for k in range(tries):
        try:
            if where.startswith(("http://", "https://")):
                with urllib.request.urlopen(where, timeout=timeout) as answer:  # noqa: S310  the scheme is one of the two
                    return json.load(answer)
            with open(where.removeprefix("file://"), encoding="utf-8") as f:
                return json.load(f)
        except urllib.error.HTTPError as e:
            last, told = f"HTTP {e.code}", e.headers.get("Retry-After", "")
            if e.code not in (403, 408, 425, 429) and e.code < 500:
                break
            pause = float(told) if told.replace(".", "", 1).isdigit() else wait * 2**k
        except (OSError, json.JSONDecodeError) as e:
            last, pause = f"{type(e).__name__}: {e}", wait * 2**k
        if k + 1 < tries:
            time.sleep(min(pause, LONGEST_WAIT))
    raise PageError(f"page {page} of {location}: {last}, after {k + 1} tries")


def _value(x, kind: DataType):
    if isinstance(kind, StructType) and isinstance(x, dict):
        return tuple(_value(x.get(f.name), f.dataType) for f in kind)
    if isinstance(kind, ArrayType) and isinstance(x, list):
        return [_value(v, kind.elementType) for v in x]
    return x


class _Pages:
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.location = schema, options["location"]
        self.per_page, self.most = int(options.get("perpage", options.get("perPage", 100))), int(options.get("most", 0))
        self.pages, self.items = int(options.get("pages", 0)), options.get("items", "items")
        self.tries, self.wait = max(1, int(options.get("tries", 4))), float(options.get("wait", 1.0))
        self.lenient = options.get("failures", "fail") == "row"

    def count(self) -> int:
        pages = self.pages
        if not pages:
            total = int(fetched(self.location, 1, self.tries, self.wait).get("total", 0))
            pages = -(-total // self.per_page)
        return min(pages, -(-self.most // self.per_page)) if self.most else pages

    def rows(self, page: int) -> Iterator[tuple]:
        try:
            found = fetched(self.location, page, self.tries, self.wait).get(self.items) or []
        except PageError as e:
            if not self.lenient:
                raise
            yield tuple(str(e) if f.name == FAILURE else None for f in self.schema)
            return
        wanted = len(found) if not self.most else max(0, min(len(found), self.most - (page - 1) * self.per_page))
        for item in found[:wanted]:
            yield _value(item, self.schema)


class _Reader(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return [Page(k) for k in range(1, self.count() + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.rows(partition.number)


class _StreamReader(_Pages, DataSourceStreamReader):
    """Offsets are numbers of whole pages: a page is read once it is there."""

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        return {"page": self.count()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(k) for k in range(start["page"] + 1, end["page"] + 1)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.rows(partition.number)

    def commit(self, end: dict) -> None:
        """Pages stay where they are."""


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return f"{FAILURE} string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(schema, self.options)
