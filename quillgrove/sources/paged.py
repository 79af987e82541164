"""A paged JSON service as a Spark source: a partition for each page, bodies kept as they came.

    spark.dataSource.register(paged.Paged)
    spark.read.format("paged").option("url", "https://a.example/search?size={size}&page={page}").option("pages", 40).option("apart", 6007)
        .option("items", "decisions").option("cache", "hdfs://shared/bodies").load()

Results of such services come in order of time, so distant pages are distant weeks: `apart` samples them by number. A body is
written to the cache before it is read, and read from there from then on, so a lost task or a second run
doesn't ask again. Numbers keep the digits that they were written with. A page that can't be had is one row with `error`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import trees
from ..operators.nodes import written
from .fetched import ALWAYS, MISSING, NEVER, Bodies

SCHEMA = "page int, nth int, item string, error string"


class Page(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


class Paged(DataSource):
    """Options: url (with {page} and {size}), pages, apart (1), size (25), items (the field that lists them), cache (a folder's URI), fetch (missing, never, always), pause (seconds before a request), timeout."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return Reader(dict(self.options))


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.o = {"apart": "1", "size": "25", "items": "items", "fetch": MISSING, "pause": "0.3", "timeout": "60"} | options
        for need in ("pages", "cache"):
            if need not in self.o:
                raise ValueError(f"the paged source needs {need}")
        if self.o["fetch"] not in (MISSING, NEVER, ALWAYS) or (self.o["fetch"] != NEVER and "url" not in self.o):
            raise ValueError("the paged source needs a url, or fetch = never")

    def partitions(self) -> list[Page]:
        return [Page(k * int(self.o["apart"])) for k in range(int(self.o["pages"]))]

    def body(self, page: int) -> bytes:
        """From the cache, or asked for and written there."""
        bodies = Bodies(self.o["cache"], self.o["fetch"], float(self.o["pause"]), float(self.o["timeout"]), "application/json")
        url = self.o["url"].format(page=page, size=self.o["size"]) if "url" in self.o else None
        return bodies.get(f"page-{page}.json", url)

    def read(self, partition: Page) -> Iterator[tuple]:
        try:
            held = trees.load_json(self.body(partition.number))
            items = held.get(self.o["items"]) if isinstance(held, dict) else None
        except (OSError, ValueError) as e:
            yield partition.number, None, None, f"{type(e).__name__}: {e}"
            return
        for k, item in enumerate(items or []):
            yield partition.number, k, written(item), None


def cached_pages(bodies: dict[int, bytes], folder: str) -> None:
    """Write bodies to a cache, as the source would."""
    for page, raw in bodies.items():
        Bodies(folder).put(f"page-{page}.json", raw if isinstance(raw, bytes) else json.dumps(raw).encode())
