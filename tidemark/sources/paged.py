"""A batch data source over a paged exchange interface.

There is no network here: the page function is given by the caller as (since_ms, limit) -> rows of
(time_ms, open, high, low, close, volume). Paging stops at an empty page, a page shorter than the
limit, a last row at or after the end, or one before the page's start; the end is exclusive and
the next page starts one millisecond after the last row. Time slices are read by separate tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Page = Callable[[int, int], list[tuple]]


def pages(fetch: Page, start_ms: int, end_ms: int, limit: int = 1000) -> Iterator[tuple]:
    since = start_ms
    while True:
        rows = fetch(since, limit)
        if not rows:
            return
        yield from (r for r in rows if start_ms <= r[0] < end_ms)
        last = rows[-1][0]
        if len(rows) < limit or last >= end_ms or last < since:
            return
        since = last + 1


class Slice(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Slice]:
        start, end, n = int(self.options["start"]), int(self.options["end"]), int(self.options.get("slices", 1))
        edges = [start + (end - start) * i // n for i in range(n + 1)]
        return [Slice(a, b) for a, b in zip(edges, edges[1:])]

    def read(self, part: Slice) -> Iterator[tuple]:
        from datetime import datetime, timezone

        from pyspark import cloudpickle

        fetch = cloudpickle.loads(base64.b64decode(self.options["fetch"]))
        for ms, *values in pages(fetch, part.start, part.end, int(self.options.get("limit", 1000))):
            yield (self.options.get("symbol", ""), datetime.fromtimestamp(ms / 1000, timezone.utc), *map(float, values))


class PagedBars(DataSource):
    """spark.read.format("paged_bars").options(fetch=packed(f), start=ms, end=ms, symbol=..., limit=...)."""

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return "symbol string, ts timestamp, open double, high double, low double, close double, volume double"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def packed(fetch: Page) -> str:
    from pyspark import cloudpickle

    return base64.b64encode(cloudpickle.dumps(fetch)).decode()


def download(spark, fetch: dict[str, Page], start_ms: int, end_ms: int, path: str, slices: int = 8, limit: int = 1000) -> dict:
    """Bars of every symbol (symbol: page function) as Parquet under path, and a manifest of what came."""
    from pyspark.sql import functions as F

    from tidemark.sources import sinks

    spark.dataSource.register(PagedBars)
    manifest = {}
    for symbol, page in fetch.items():
        read = spark.read.format("paged_bars").options(fetch=packed(page), start=start_ms, end=end_ms, slices=slices, limit=limit, symbol=symbol).load()
        read.dropDuplicates(["symbol", "ts"]).write.mode("overwrite").parquet(f"{path}/{symbol}")
        n, first, last = spark.read.parquet(f"{path}/{symbol}").agg(F.count("*"), F.min("ts").cast("string"), F.max("ts").cast("string")).first()
        manifest[symbol] = {"rows": n, "first": first, "last": last}
    sinks.write_json(spark, manifest, f"{path}/manifest")
    return manifest
