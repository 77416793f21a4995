"""Fetched pages as a batch data source: a list of addresses is read in partitions, each page one row."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Addresses(InputPartition):
    def __init__(self, urls: list[str]):
        self.urls = urls


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = [u for u in options.get("urls", "").split("\n") if u.strip()]
        self.parts = max(1, int(options.get("partitions", "8")))
        self.timeout = float(options.get("timeout", "25"))
        self.low, self.high = float(options.get("mindelay", "0")), float(options.get("maxdelay", "0"))

    def partitions(self):
        return [Addresses(self.urls[i :: self.parts]) for i in range(min(self.parts, max(1, len(self.urls))))]

    def read(self, partition):
        """(url, status, html, error); a page that fails is a row with its error, never a failed task."""
        for u in partition.urls:
            if self.high > 0:
                time.sleep(random.uniform(self.low, self.high))
            try:
                with urllib.request.urlopen(u, timeout=self.timeout) as r:
                    yield u, r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), None
            except urllib.error.HTTPError as e:
                yield u, e.code, None, str(e)
            except (OSError, ValueError) as e:
                yield u, None, None, str(e)


class PageSource(DataSource):
    """spark.dataSource.register(PageSource); spark.read.format("pages").option("urls", "\\n".join(urls)).load()"""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "url string, status int, html string, error string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)
