"""A catalogue connector as a Python data source: JSON pages from HTTP or from files, deduplicated by key downstream."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class CatalogueSource(DataSource):
    """Options: urls (one a line; http, https or file), records (key of the list in each page, default: the page is the list)."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return "url string, record string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader([u for u in self.options.get("urls", "").splitlines() if u.strip()], self.options.get("records"), float(self.options.get("timeout", "30")))


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], records: str | None, timeout: float):
        self.urls, self.records, self.timeout = urls, records, timeout

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        with urllib.request.urlopen(partition.value, timeout=self.timeout) as r:
            page = json.load(r)
        for row in (page.get(self.records, []) if self.records else page):
            yield partition.value, json.dumps(row, ensure_ascii=False)


def read_catalogue(spark: SparkSession, urls: list[str], schema: str, records: str | None = None) -> DataFrame:
    """Records of all pages as columns."""
    spark.dataSource.register(CatalogueSource)
    r = spark.read.format("catalogue").option("urls", "\n".join(urls))
    r = r.option("records", records) if records else r
    return r.load().select("url", F.from_json("record", schema).alias("r")).select("url", "r.*")


def vocabulary(titles: DataFrame, title: str, stopwords: list[str], least: int = 2) -> DataFrame:
    """(term, n): words of titles by frequency without stop words, the queries of a sweep."""
    t = titles.select(F.explode(F.regexp_extract_all(F.lower(title), F.lit("[a-z]{3,}"), F.lit(0))).alias("term"))
    return t.where(~F.col("term").isin(*stopwords)).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def remaining(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a progress log doesn't hold yet."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def id_sample(spark: SparkSession, low: int, high: int, n: int, seed: int) -> DataFrame:
    """(id): n of the ids from low up to high (exclusive), by the order of a hash of seed and id, so that reruns draw the same."""
    ids = spark.range(low, high)
    return ids.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n)


def sweep(vocabulary: DataFrame, found: DataFrame, cap: int = 500) -> DataFrame:
    """(term, refine): the next queries of a sweep by vocabulary (term, n), whose results are (term, key).

    A term whose result reached the cap of a page is incomplete: it is asked again together with every other term (refine),
    the most frequent first; terms not asked yet are asked alone.
    """
    done = found.groupBy("term").agg(F.countDistinct("key").alias("hits"))
    t = vocabulary.join(done, "term", "left")
    alone = t.where("hits IS NULL").select("term", F.lit(None).cast("string").alias("refine"))
    full = t.where(F.col("hits") >= cap).select("term")
    # the vocabulary is a stated set of queries, and full terms are few of them
    pairs = full.join(vocabulary.select(F.col("term").alias("refine")), F.col("term") != F.col("refine"))
    return alone.unionByName(pairs)


def swept(pages: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key of a sweep's records: the first by order."""
    w = Window.partitionBy(key).orderBy(order)
    return pages.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
