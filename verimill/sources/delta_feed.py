"""A data source for delta feeds kept as page files: a partition a page, and a stream whose offset is the token of the last complete run."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..streaming.jobs import EVENT


@dataclass
class Page(InputPartition):
    run: int
    page: int
    path: str


def _under(path: str, name: str) -> list[tuple[int, fs.FileInfo]]:
    store, at = fs.FileSystem.from_uri(path)
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted(((int(f.base_name.split("=")[1]), f) for f in found if f.base_name.startswith(f"{name}=")), key=lambda x: x[0])


class Feed:
    """`path`/run=<token>/page=<number>/*.json with an item a line: id, deleted, title, content, at. A run is complete once it has _SUCCESS."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.source = options["path"], options.get("source", "feed")

    def complete(self) -> list[int]:
        store, at = fs.FileSystem.from_uri(self.path)
        return [run for run, f in _under(self.path, "run") if store.get_file_info(f"{f.path}/_SUCCESS").type != fs.FileType.NotFound]

    def pages(self, runs: list[int]) -> list[Page]:
        return [Page(run, page, f.path) for run in runs for page, f in _under(f"{self.path}/run={run}", "page")]

    def read(self, page: Page) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.path)
        n = 0
        for file in sorted(store.get_file_info(fs.FileSelector(page.path)), key=lambda f: f.path):
            if not file.base_name.endswith(".json"):
                continue
            with store.open_input_stream(file.path) as lines:
                rest = b""
                while block := lines.read(1 << 20):
                    *whole, rest = (rest + block).split(b"\n")
                    for line in whole:
                        n += 1
                        yield from self.item(line, f"{page.run}/{page.page}/{n}")
                yield from self.item(rest, f"{page.run}/{page.page}/{n + 1}")

    def item(self, line: bytes, key: str) -> Iterator[tuple]:
        """An event of a line; a line that isn't an item is an event of a kind that is refused downstream, so that it's seen in the audit."""
        if not line.strip():
            return
        try:
            x = json.loads(line)
            at = datetime.fromisoformat(x["at"]) if x.get("at") else None
            yield ("deleted" if x.get("deleted") else "updated", self.source, str(x["id"]), x.get("title"), x.get("content"), None, key, at)
        except (ValueError, KeyError, TypeError, AttributeError):
            yield ("damaged", self.source, None, None, line.decode("utf-8", "replace"), None, key, None)


class FeedReader(Feed, DataSourceReader):
    """All complete runs."""

    def partitions(self) -> Sequence[InputPartition]:
        return self.pages(self.complete())


class FeedStream(Feed, DataSourceStreamReader):
    """The offset is the last complete run's token, kept in the stream's checkpoint once its batch is done. A run that isn't complete is left for
    later. Where the run of the saved token is gone, its feed was cut off: all runs that are kept come again, and unchanged items, which
    have their old hash, change nothing."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"token": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"token": max(self.complete(), default=0)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if end["token"] <= start["token"]:
            return []
        runs = self.complete()
        known = start["token"] == 0 or start["token"] in runs
        return self.pages([r for r in runs if r <= end["token"] and (r > start["token"] or not known)])

    def commit(self, end: dict) -> None:
        """Nothing: the feed keeps its runs."""


class DeltaFeed(DataSource):
    """Format delta_feed: option path, and source, the name that its events bear."""

    @classmethod
    def name(cls) -> str:
        return "delta_feed"

    def schema(self) -> str:
        return EVENT

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return FeedStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DeltaFeed)
