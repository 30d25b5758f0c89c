"""Paged sources as a Spark data source: one partition for each page, transient failures tried again."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TRANSIENT = (429, 500, 502, 503, 504)


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.pages, self.pages_field = options["url"], int(options.get("pages", 0)), options.get("pagesfield", options.get("pagesField", ""))
        if not self.pages and not self.pages_field:
            raise ValueError("pages or pagesField must be given")
        self.timeout = float(options.get("timeout", 30))
        self.first, self.tries, self.wait = int(options.get("first", 1)), int(options.get("tries", 4)), float(options.get("wait", 0.5))
        self.field = options.get("field", "")

    def partitions(self) -> list[Page]:
        pages = self.pages or int(self.fetch(self.first)[self.pages_field])
        return [Page(self.first + i) for i in range(pages)]

    def fetch(self, number: int):
        """A page as JSON; answers that may be better next time, and connections that fail, are tried again."""
        url = self.url.replace("{page}", str(number))
        for attempt in range(self.tries):
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as answer:
                    return json.load(answer)
            except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
                if (isinstance(e, urllib.error.HTTPError) and e.code not in TRANSIENT) or attempt == self.tries - 1:
                    raise
                time.sleep(self.wait * 2**attempt)
        raise ValueError("tries must be positive")

    def read(self, partition: Page) -> Iterator[tuple]:
        found = self.fetch(partition.number)
        for row in found[self.field] if self.field else found:
            yield partition.number, json.dumps(row, ensure_ascii=False)


class PagedSource(DataSource):
    """``spark.dataSource.register(PagedSource)``; then ``spark.read.format("paged")`` with url (holding ``{page}``), field, and pages or pagesField.

    ``pagesField`` names the field of the first page that holds their number. Further options: first, tries, wait, timeout.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, row string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)
