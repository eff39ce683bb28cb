"""Bounded labelled samples for fitting, and the fold rule of the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(doc_id: str | Column, count: int) -> Column:
    """crc32 of the id as text, modulo count; a null id has the value -1."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % count, F.lit(-1)).cast("int")


#: Characters of text that a fitting sample holds before its last row. Rows of any length take part, whole.
CHARACTERS = 64 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, balanced: bool, characters: int = CHARACTERS) -> list[tuple[str, int]]:
    """(text, label) of at most `bound` labelled rows, half of each label if balanced.

    Rows are taken in the order of a hash of their id, so the sample doesn't depend on partitions, and until their texts
    have `characters` characters in all; so the driver gets that much and one text more at most. Texts are taken whole,
    whatever their length. Labels that are null or not 0 or 1 are left out; of repeated labels the largest counts; of
    repeated documents the smallest text.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    order = [F.xxhash64(F.lit("sample"), "doc_id"), F.col("doc_id")]
    if balanced:
        parts = [known.where(F.col("y") == v).orderBy(*order).limit(bound) for v in (0, 1)]
        chosen = parts[0].unionByName(parts[1])
    else:
        chosen = known.orderBy(*order).limit(2 * bound)
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most 2 * bound rows of two numbers
        .where(F.length("text") > 0)
        .groupBy("doc_id", "y")
        .agg(F.min("text").alias("text"))
        .withColumn("h", order[0])
    )
    by = Window.partitionBy("part").orderBy("h", "doc_id")  # over at most 2 * bound rows
    rows = rows.withColumn("part", F.col("y") if balanced else F.lit(0))
    rows = rows.withColumns({"at": F.row_number().over(by), "before": F.sum(F.length("text")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.length("text")})
    parts_of = 2 if balanced else 1
    got = rows.where((F.col("at") <= bound // parts_of) & (F.col("before") < characters // parts_of)).select("h", "doc_id", "text", "y").collect()
    return [(r["text"], r["y"]) for r in sorted(got, key=lambda r: (r["h"], r["doc_id"]))]
