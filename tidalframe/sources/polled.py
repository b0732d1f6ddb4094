"""A streaming source of polled feeds.

A fetcher outside Spark stores each answer as ``<path>/<source>/<cycle>/<endpoint>``
and, when a cycle is done, an empty ``_DONE`` beside it; cycles sort by name. The
source reads finished cycles. Of a cycle it takes the first endpoint, in the order
of the option ``endpoints`` (others after it, by name), whose answer holds items:
a dead or changed endpoint falls back to the next, a recovered one is taken again.

The offset is each source's last cycle, so a restart goes on exactly behind what
was processed. A cycle of a source is one partition, read by an executor; paths
are of any file system that Arrow knows.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .tables import feed_rows

SCHEMA = "source string, cycle string, endpoint string, at timestamp, headline string, url string"


class Cycle(InputPartition):
    def __init__(self, source: str, cycle: str):
        self.source, self.cycle = source, cycle


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def store(path: str, source: str, cycle: str, answers: dict[str, str]) -> None:
    """What a fetcher does with the answers of a finished cycle, by name; storing a cycle again changes nothing but its bytes."""
    files, root = _at(path.rstrip("/"))
    folder = f"{root}/{source}/{cycle}"
    files.create_dir(folder, recursive=True)
    for name, text in [*answers.items(), ("_DONE", "")]:
        with files.open_output_stream(f"{folder}/{name}") as f:
            f.write(text.encode())


class PolledReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.order = [e.strip() for e in options.get("endpoints", "").split(",") if e.strip()]

    def _folders(self, files: fs.FileSystem, root: str) -> list[str]:
        return sorted(x.base_name for x in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if x.type == fs.FileType.Directory)

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """Each source's last cycle before the first unfinished one."""
        files, root = _at(self.path)
        out = {}
        for source in self._folders(files, root):
            for cycle in self._folders(files, f"{root}/{source}"):
                if files.get_file_info(f"{root}/{source}/{cycle}/_DONE").type != fs.FileType.File:
                    break
                out[source] = cycle
        return out

    def partitions(self, start: dict, end: dict) -> list[Cycle]:
        files, root = _at(self.path)
        return [Cycle(s, c) for s in sorted(end) for c in self._folders(files, f"{root}/{s}") if start.get(s, "") < c <= end[s]]

    def read(self, partition: Cycle) -> Iterator[tuple[str, str, str, datetime | None, str, str | None]]:
        files, root = _at(self.path)
        folder = f"{root}/{partition.source}/{partition.cycle}"
        names = sorted(x.base_name for x in files.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.File and x.base_name != "_DONE")
        known = [n for e in self.order for n in names if n == e or n.startswith(f"{e}.")]
        for name in [*known, *[n for n in names if n not in known]]:
            with files.open_input_stream(f"{folder}/{name}") as f:
                rows = feed_rows(f.read().decode("utf-8", "replace"))
            if rows:
                for at, headline, url in rows:
                    yield partition.source, partition.cycle, name, at, headline, url
                return

    def commit(self, end: dict) -> None:
        """Nothing to do: cycles stay where they are."""


class PolledFeeds(DataSource):
    """``spark.readStream.format("polled_feeds").option("path", ...).option("endpoints", "first,second")``."""

    @classmethod
    def name(cls) -> str:
        return "polled_feeds"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> PolledReader:  # noqa: N802
        return PolledReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PolledFeeds)
