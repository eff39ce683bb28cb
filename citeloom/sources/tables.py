"""Schemas and readers of the tables the engine works on, and the writers for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.designation import is_base, register_digits
from ..functions.text import null_if_sentinel


def _strings(names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names.split()]


REGISTER = T.StructType([*_strings("is_number title title_hi year status replaced_by supersedes family priority source_link flag provenance review_due overdue")])
DOCUMENTS = T.StructType([*_strings("doc_id family cited foreign n outdated any_outdated doc_type usability source_link unmatched category bid_id ministry department organisation office demands_mark")])
RULES = T.StructType([*_strings("is_number product category family mandatory scheme notification link is_base")])
EXPORTABLE = ("register", "documents", "edges", "rules", "backlog")


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table with header and embedded newlines; a byte order mark is dropped, sentinels become null, load_ord is the file order.

    The order is that of one file's rows; with several files, of their names. Columns are read by name, absent ones are null.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    cols = [null_if_sentinel(F.col(f"`{f.name}`")).alias(f.name) if f.name in raw.columns else F.lit(None).cast("string").alias(f.name) for f in schema]
    return raw.select(*cols, F.monotonically_increasing_id().alias("load_ord"))


def as_register(df: DataFrame) -> DataFrame:
    """Register rows with typed year and review date and with the lookup keys is_base and is_digits."""
    year = F.try_to_number(F.substring_index("year", ".", 1), F.lit("9999")).cast("int")
    return df.withColumns({"year": year, "review_due": F.to_date(F.try_to_timestamp("review_due")), "is_base": is_base(F.col("is_number")), "is_digits": register_digits(F.col("is_number"))})


def projected(df: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns that df has, in the list's order; optional ones that it lacks are left out."""
    return df.select(*[c for c in columns if c in df.columns])


def usable(documents: DataFrame) -> DataFrame:
    """The population of every statistic."""
    return documents.where("usability = 'Usable'")


def export_csv(df: DataFrame, name: str, path: str) -> None:
    """A table as CSV part files with header, if the name is on the allow-list."""
    if name not in EXPORTABLE:
        raise ValueError(f"{name} is not exportable")
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None, lines: bool = True) -> DataFrame:
    r = spark.read.option("multiLine", not lines)
    return (r.schema(schema) if schema is not None else r).json(path)


def write_lake(df: DataFrame, path: str, sort: list[str], partition: list[str] | None = None) -> None:
    """Parquet sorted inside its files, so that min and max statistics prune in place of indexes."""
    w = df.sortWithinPartitions(*sort).write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def save_table(df: DataFrame, name: str, path: str, keys: list[str], buckets: int) -> None:
    """A table of the catalogue at a path, bucketed and sorted by its lookup keys, with column statistics; joins on the keys of
    two tables with as many buckets need no shuffle."""
    df.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    df.sparkSession.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
