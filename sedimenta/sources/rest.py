"""A paginated REST listing as a Spark data source.

``spark.read.format("paged_rest")`` with the options ``url`` (one or several, separated by blanks: one
partition each), ``param.<name>`` for query parameters (such as ``since``), ``token`` and ``transport``
(``module:function`` of a callable from (url, headers) to (status, headers, body); plain HTTP if left
out). A partition follows the links to its next pages and yields items as they come: ``item`` is the JSON
of one element, ``page`` the number of its page. Columns are read with ``from_json``.
"""

from __future__ import annotations

import importlib
import json
import re
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

PAGE_SIZE = 100


def next_link(header: str | None) -> str | None:
    """The address that a Link header calls the next page."""
    for part in (header or "").split(","):
        if re.search(r';\s*rel="next"', part):
            return part.split(";", 1)[0].strip().lstrip("<").rstrip(">")
    return None


def _http(url: str, headers: dict[str, str]) -> tuple[int, dict[str, str], bytes]:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=120) as r:
        return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read()


class PagedPartition(InputPartition):
    def __init__(self, url: str):
        self.url = url


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        params = {k[6:]: v for k, v in self.options.items() if k.startswith("param.")}
        query = urllib.parse.urlencode({"per_page": self.options.get("page_size", PAGE_SIZE), **params})
        return [PagedPartition(f"{u}?{query}") for u in self.options["url"].split()]

    def read(self, partition: PagedPartition) -> Iterator[tuple[str, int]]:
        transport = _http
        if "transport" in self.options:
            module, name = self.options["transport"].split(":")
            transport = getattr(importlib.import_module(module), name)
        headers = {"Accept": "application/vnd.github+json", "X-GitHub-Api-Version": "2022-11-28", "User-Agent": "sedimenta"}
        if self.options.get("token"):
            headers["Authorization"] = f"Bearer {self.options['token']}"
        url, page = partition.url, 0
        while url:
            status, got, body = transport(url, headers)
            if status != 200:
                raise OSError(f"{url}: status {status}")
            data = json.loads(body)
            for item in data if isinstance(data, list) else []:
                yield json.dumps(item), page
            url, page = next_link({k.lower(): v for k, v in got.items()}.get("link")), page + 1


class PagedRest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_rest"

    def schema(self) -> str:
        return "item STRING, page INT"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedRest)
