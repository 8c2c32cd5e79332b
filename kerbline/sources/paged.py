"""Captured result pages as a data source of Spark's: sources side by side, the pages of each in order up to
the first one without listings, which ends the reading and not only the result."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, pairwise
from operator import itemgetter

from pyarrow import fs, parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from kerbline.operators.spread import spread

FORMAT = "captured_pages"
#: Pages of one source at most, and what a page with listings holds.
MOST_PAGES = 20
#: Pages of a source that lie in one folder of files.
RANGE = 500
LISTING = r'"@type"\s*:\s*"(?:Car|Product)"|listingCard|usedCar|UsedListingCard|used-car-listing|/used-car-details/|itemBox'


@dataclass
class Pages(InputPartition):
    source: str
    first: int
    beyond: int


def capture(pages: DataFrame, root: str) -> None:
    """Adds captures (source, page from 1, html) below a path: a file for each range of pages of a source, in page order."""
    first = ((F.col("page") - 1) / RANGE).cast("int") * RANGE + 1
    placed = pages.select(F.coalesce("source", F.lit("")).alias("source"), first.alias("pages"), "page", "html")
    spread(placed, "source", "pages").sortWithinPartitions("source", "pages", "page").write.mode("append").partitionBy("source", "pages").parquet(root)


class _Folder:
    """Pages of a source below path/source=<name>/: files of pages=<first of a range>/ as `capture` writes them,
    and page=<number>/, a folder for each page, as Spark writes text by source and page."""

    def __init__(self, options: dict[str, str]):
        self.uri = options["path"]  # names of options come in lower case
        self.most = int(options.get("mostpages", MOST_PAGES))
        self.listing = options.get("listing", LISTING)

    def _files(self, below: str) -> list[str]:
        system, root = fs.FileSystem.from_uri(self.uri)
        files = system.get_file_info(fs.FileSelector(f"{root}{below}", allow_not_found=True))
        return sorted(f.path for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))

    def sources(self) -> list[str]:
        system, root = fs.FileSystem.from_uri(self.uri)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(f.base_name.removeprefix("source=") for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("source="))

    def _numbers(self, source: str, first: int) -> set[int]:
        """Numbers of the pages of one range; asks for their places, so what lies beyond is not even listed."""
        system, root = fs.FileSystem.from_uri(self.uri)
        places = system.get_file_info([f"{root}/source={source}/page={n}" for n in range(first, min(first + RANGE, self.most + 1))])
        numbers = {first + k for k, place in enumerate(places) if place.type == fs.FileType.Directory}
        for path in self._files(f"/source={source}/pages={first}"):
            with system.open_input_file(path) as file:
                numbers.update(parquet.read_table(file, columns=["page"])["page"].to_pylist())
        return numbers

    def beyond(self, source: str) -> int:
        """The number after the last of the pages that follow each other from 1."""
        for first in range(1, self.most + 1, RANGE):
            numbers = self._numbers(source, first)
            for n in range(first, min(first + RANGE, self.most + 1)):
                if n not in numbers:
                    return n
        return self.most + 1

    def _rows(self, path: str) -> Iterator[tuple[int, str]]:
        system, _ = fs.FileSystem.from_uri(self.uri)
        with system.open_input_file(path) as file:
            held = parquet.ParquetFile(file)
            numbers = held.read(columns=["page"])["page"].to_pylist()
            # a file that another writer left out of order is sorted; it holds one range at most
            in_order = all(a <= b for a, b in pairwise(numbers))
            for batch in held.iter_batches(batch_size=50, columns=["page", "html"]) if in_order else held.read(columns=["page", "html"]).sort_by("page").to_batches():
                yield from zip(batch.column("page").to_pylist(), batch.column("html").to_pylist(), strict=True)

    def _stored(self, source: str, first: int, beyond: int) -> Iterator[tuple[int, str]]:
        """Pages of the files of ranges, in order; what was captured of a page more than once is put together."""
        for start in range((first - 1) // RANGE * RANGE + 1, beyond, RANGE):
            rows = heapq.merge(*map(self._rows, self._files(f"/source={source}/pages={start}")), key=itemgetter(0))
            for page, same in groupby(rows, itemgetter(0)):
                yield page, "".join(html or "" for _, html in same)

    def html(self, source: str, page: int) -> str:
        """What the folder of a page holds, if it has one."""
        system, _ = fs.FileSystem.from_uri(self.uri)
        return "".join(system.open_input_stream(p).read().decode() for p in self._files(f"/source={source}/page={page}"))

    def read(self, partition: Pages) -> Iterator[tuple[str, int, str]]:
        has_listing = re.compile(self.listing)
        stored = self._stored(partition.source, partition.first, partition.beyond)
        ahead = next(stored, None)
        for page in range(partition.first, partition.beyond):
            while ahead and ahead[0] < page:
                ahead = next(stored, None)
            html = self.html(partition.source, page) + (ahead[1] if ahead and ahead[0] == page else "")
            if not has_listing.search(html):
                return
            yield partition.source, page, html


class _Reader(DataSourceReader):
    def __init__(self, folder: _Folder):
        self.folder = folder

    def partitions(self) -> list[Pages]:
        return [Pages(s, 1, self.folder.beyond(s)) for s in self.folder.sources()] or [Pages("", 1, 1)]

    def read(self, partition: Pages) -> Iterator[tuple[str, int, str]]:
        return self.folder.read(partition)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the next page of each source. Each batch reads a source's new pages up to the first empty one."""

    def __init__(self, folder: _Folder):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {s: self.folder.beyond(s) for s in self.folder.sources()}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return [Pages(s, start.get(s, 1), beyond) for s, beyond in sorted(end.items()) if beyond > start.get(s, 1)]

    def read(self, partition: Pages) -> Iterator[tuple[str, int, str]]:
        return self.folder.read(partition)


class CapturedPages(DataSource):
    """spark.read.format("captured_pages").load(path) -> source, page, html.

    Options: mostPages, the pages of a source at most; listing, a pattern that pages with listings match.
    Pages count from 1; a missing page ends its source as an empty one does. A stream reads the pages that
    have come since; pages that stand after an empty one in their batch are left out.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "source string, page int, html string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Folder(dict(self.options)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(_Folder(dict(self.options)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CapturedPages)
