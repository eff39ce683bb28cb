"""Result pages of queries as a data source that plans: pages of the queries and numbers that a filter asks for, and a stream of new pages."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

NAME, SCHEMA = "result_pages", "query string, page int, record string"
#: Pages that one task reads, and that one micro-batch takes of a query.
TOGETHER, EACH_TIME = 100, 1000


class ResultPages(DataSource):
    """Columns query, page and record (JSON) of the pages that queries have at an address with {query} and {page}.

    Options: address; queries (one a line, the stated set of what may be asked); records (key of the list in a page; default: the page
    is the list, or has a record on each line); first (number of the first page, 0); timeout (30). A page is an http(s) address, a
    file, or a folder of files; a query's pages end before the first one that is missing or empty.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Pages(_Store(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _NewPages(_Store(self.options))


class _Store:
    """What the options say, and how a page is read. None is a page that isn't there."""

    def __init__(self, options):
        self.address, self.records = options["address"], options.get("records")
        self.queries = [q for q in options.get("queries", "").splitlines() if q.strip()]
        self.first, self.timeout = int(options.get("first", "0")), float(options.get("timeout", "30"))

    def at(self, query: str, page: int) -> str:
        return self.address.replace("{query}", quote(query, safe="")).replace("{page}", str(page))

    def texts(self, url: str) -> list[str] | None:
        if url.startswith(("http://", "https://")):
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as r:
                    return [r.read().decode("utf-8")]
            except urllib.error.HTTPError as x:
                if x.code in (404, 410):
                    return None
                raise
        from pyarrow import fs  # files of any store that Arrow knows

        store, path = fs.FileSystem.from_uri(url)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            return None
        paths = [path]
        if info.type == fs.FileType.Directory:
            paths = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith((".", "_")))
        return [store.open_input_stream(p).readall().decode("utf-8") for p in paths]

    def page(self, query: str, number: int) -> list | None:
        texts = self.texts(self.at(query, number))
        if texts is None:
            return None
        rows = []
        for text in texts:
            try:
                whole = json.loads(text)
            except json.JSONDecodeError:
                whole = [json.loads(line) for line in text.splitlines() if line.strip()]
            found = whole.get(self.records, []) if isinstance(whole, dict) and self.records else whole
            rows += found if isinstance(found, list) else [found]
        return rows

    def rows(self, query: str, start: int, stop: int | None) -> Iterator[tuple[str, int, str]]:
        number = start
        while stop is None or number < stop:
            found = self.page(query, number)
            if not found:
                return
            for row in found:
                yield query, number, json.dumps(row, ensure_ascii=False)
            number += 1


class _Pages(DataSourceReader):
    """A task reads a run of one query's pages. Filters on query (equal, in) and page (bounds) decide which are read at all."""

    def __init__(self, store: _Store):
        self.store, self.queries = store, list(store.queries)
        self.start, self.stop = store.first, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("query",) and isinstance(f, EqualTo | In):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.queries = [q for q in self.queries if q in asked]
            elif column == ("page",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    self.start = max(self.start, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    last = f.value + (not isinstance(f, LessThan))
                    self.stop = last if self.stop is None else min(self.stop, last)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.stop is None:  # how many pages there are shows only as they are read
            return [InputPartition((q, self.start, None)) for q in self.queries] or [InputPartition(None)]
        runs = [(q, at, min(at + TOGETHER, self.stop)) for q in self.queries for at in range(self.start, self.stop, TOGETHER)]
        return [InputPartition(r) for r in runs] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, str]]:
        if partition.value is not None:
            yield from self.store.rows(*partition.value)


class _NewPages(DataSourceStreamReader):
    """An offset is the number of each query's next page. Pages are never changed once they are there."""

    def __init__(self, store: _Store):
        self.store, self.seen = store, None

    def initialOffset(self) -> dict:
        return {q: self.store.first for q in self.store.queries}

    def latestOffset(self) -> dict:
        if self.seen is None:
            self.seen = self.initialOffset()
        for q in self.store.queries:
            number = self.seen[q]
            while number < self.seen[q] + EACH_TIME and self.store.page(q, number):
                number += 1
            self.seen[q] = number
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.seen = {q: max(end.get(q, self.store.first), (self.seen or {}).get(q, self.store.first)) for q in self.store.queries}
        runs = [(q, at, min(at + TOGETHER, end[q])) for q in end for at in range(start.get(q, self.store.first), end[q], TOGETHER)]
        return [InputPartition(r) for r in runs] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, int, str]]:
        if partition.value is not None:
            yield from self.store.rows(*partition.value)

    def commit(self, end: dict) -> None:
        pass


def _source(reader, spark: SparkSession, address: str, queries: list[str], records: str | None, first: int):
    spark.dataSource.register(ResultPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    r = reader.format(NAME).option("address", address).option("queries", "\n".join(queries)).option("first", str(first))
    return (r.option("records", records) if records else r).load()


def read_pages(spark: SparkSession, address: str, queries: list[str], schema: str, records: str | None = None, first: int = 0) -> DataFrame:
    """(query, page, columns of schema) of the queries' result pages; filters on query and page choose the pages that are read.

    One filter always goes to the source: Spark plans a Python source without any filter from the last plan of the same DataFrame, so
    a frame that was filtered once would else go on with the pages of that filter.
    """
    return parsed(_source(spark.read, spark, address, queries, records, first).where("query IS NOT NULL"), schema)


def stream_pages(spark: SparkSession, address: str, queries: list[str], schema: str, records: str | None = None, first: int = 0) -> DataFrame:
    """The same as a stream: a run goes on after the last page that the checkpoint names."""
    return parsed(_source(spark.readStream, spark, address, queries, records, first), schema)


def parsed(pages: DataFrame, schema: str) -> DataFrame:
    return pages.select("query", "page", F.from_json("record", schema).alias("r")).select("query", "page", "r.*")
