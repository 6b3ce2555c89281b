"""A paged JSON inventory on a loopback address as a Spark data source: one partition a page, read by the executors.

    spark.dataSource.register(Inventory)
    spark.read.format("inventory").schema("key string, version int").option("url", "http://127.0.0.1:8000/items").option("page", 100).load()

Options: url; page (rows of a page); total (rows; asked from the service's Total-Results header if it is not given).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlsplit
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LOCAL = ("127.0.0.1", "localhost", "::1")


class Page(InputPartition):
    def __init__(self, start: int):
        super().__init__(start)
        self.start = start


class Reader(DataSourceReader):
    def __init__(self, fields: list[str], options: dict):
        self.fields, self.url, self.page = fields, options["url"], int(options.get("page", 100))
        if urlsplit(self.url).hostname not in LOCAL:
            raise ValueError("an inventory is read from a loopback address only")
        self.total = options.get("total")

    def _get(self, start: int, limit: int):
        return urlopen(f"{self.url}?start={start}&limit={limit}", timeout=30)  # noqa: S310

    def partitions(self) -> list[Page]:
        total = int(self.total) if self.total else int(self._get(0, 1).headers.get("Total-Results", 0))
        return [Page(k) for k in range(0, total, self.page)]

    def read(self, partition: Page) -> Iterator[tuple]:
        for row in json.load(self._get(partition.start, self.page)):
            yield tuple(row.get(f) for f in self.fields)


class Inventory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "inventory"

    def reader(self, schema) -> Reader:
        return Reader(schema.names, dict(self.options))
