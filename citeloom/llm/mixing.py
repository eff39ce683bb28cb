"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..session import Scratch

#: Pieces that documents of one source and size class are dealt to by their id, for the prefix sums.
PIECES = 1024
#: Parts that rows equal in id, size and text are dealt to.
SALTS = 256


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """sizes (one row a source: _mix_sk, _mix_sn, source_size) with the words each source should give.

    Sources in code point order, the null source last, weigh `weights` in turn. They share `share` times all sizes by
    weight; a target stops at `most` times its source's size and the excess goes to the others by weight: the level, words
    for each unit of weight, is what the capped sources leave, shared by the other weights. Sources that the level caps are
    taken out until none is added, each round one aggregation; the sums are of whole numbers, so their order changes nothing.
    The turn of a source is its place in a range partition behind the partitions before it, so no task sees all sources.
    """
    scratch = Scratch(sizes.sparkSession, "sources")
    s = sizes.repartitionByRange("_mix_sn", "_mix_sk").sortWithinPartitions("_mix_sn", "_mix_sk")
    s = scratch.keep(s.withColumn("id", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("id", 33)
    counts = sorted((r["part"], r["n"]) for r in s.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    before, held = [], 0
    for p, n in counts:
        before += [F.lit(p), F.lit(held)]
        held += n
    if not held:
        return s.select("_mix_sk", "_mix_sn", "source_size", F.lit(0.0).alias("target"))
    place = F.create_map(*before)[part] + F.col("id").bitwiseAND((1 << 33) - 1)
    weight = F.array(*map(F.lit, weights))[(place % len(weights)).cast("int")]
    s = scratch.keep(s.select("_mix_sk", "_mix_sn", "source_size", weight.alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("cap")), "weighed")
    whole = s.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, capped, level = float(share) * whole["size"], -1, 0.0
    while True:
        out = s.where(F.col("cap") <= F.lit(level) * F.col("weight")) if capped >= 0 else s.limit(0)
        gone = out.agg(F.count(F.lit(1)).alias("n"), F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).first()
        if gone["n"] == capped or gone["n"] == held:
            break
        capped, level = gone["n"], (total - (gone["cap"] or 0.0)) / (whole["weight"] - (gone["weight"] or 0))
    return s.select("_mix_sk", "_mix_sn", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("weight")).alias("target"))


def word_count(text: Column) -> Column:
    """Number of words as a long, null as 0. Each word is replaced by one character, so no array of a text's words is built."""
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, text: str = "text", source: str = "source", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """docs with size, source_size, target and copies (times the mix takes the row) added in place of columns so named.

    Every document of a source is expected target / source_size times. Documents stand in an order by size class, piece
    (id modulo PIECES, or a hash of an id that is no whole number), id and size; their expected copies are prefix-summed,
    a source's offset in [0, 1) from a digest of its name is added, and a document is emitted once for each integer its
    interval crosses. Neighbours in this order are about equally long, so the words taken stay within about one document
    of the target.

    Texts are counted once and the rows are written with what orders them. Prefix sums have four levels, each over counts
    of the level below: classes of a source, pieces of a class, cells of a piece, rows of a cell. A cell holds the rows of
    one id, size and text that were dealt to one of SALTS salts as they were written. So rows that share an id, or have
    none, are spread too, however many there are. Rows of one cell are equal in id, size and text, so any order among
    them gives the same mix, and reruns agree.

    A null text has size 0, a null source is a source of its own, a null id is ordered first; repeated rows count each.
    Sources without words are expected 0 times. `keep` names the columns of docs to carry (default: all), by any name.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    new = ["size", "source_size", "target", "copies"]
    rest = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    col = lambda c: F.col(f"`{c}`")
    whole = isinstance(docs.schema[doc_id].dataType, IntegralType)
    piece = F.coalesce(col(doc_id), F.lit(0)) if whole else F.xxhash64(col(doc_id))
    d = docs.select(
        F.struct(*[col(c).alias(f"c{i}") for i, c in enumerate(rest)], F.lit(0).alias("none")).alias("row"),
        F.coalesce(col(source), F.lit("")).alias("_mix_sk"),
        col(source).isNull().alias("_mix_sn"),
        col(doc_id).alias("id"),
        word_count(col(text)).alias("size"),
        F.xxhash64(col(text)).alias("tie"),
        F.pmod(piece, F.lit(PIECES)).cast("int").alias("piece"),
    )
    d = d.withColumn("class", F.length(F.bin("size")) * 8 + F.expr("cast(shiftright(size, greatest(length(bin(size)) - 4, 0)) % 8 as int)"))
    d = scratch.keep(d.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")), "rows")
    of, cell = ["_mix_sk", "_mix_sn"], ["id", "size", "tie", "salt"]
    cells = scratch.keep(d.groupBy(*of, "class", "piece", *cell).agg(F.count(F.lit(1)).alias("n")), "cells")
    pieces = cells.groupBy(*of, "class", "piece").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("words"))
    classes = pieces.groupBy(*of, "class").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    goals = targets(classes.groupBy(*of).agg(F.sum("words").alias("source_size")), weights, share, most)

    def before(counts: DataFrame, keys: list[str], *order: Column | str) -> Column:
        w = Window.partitionBy(*of, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(w), F.lit(0))

    classes = classes.select(*of, "class", before(classes, [], "class").alias("in_source"))
    pieces = pieces.select(*of, "class", "piece", before(pieces, ["class"], "piece").alias("in_class"))
    cells = cells.select(*of, "class", "piece", *cell, before(cells, ["class", "piece"], F.col("id").asc_nulls_first(), "size", "tie", "salt").alias("in_piece"))
    cells = cells.join(pieces, [*of, "class", "piece"]).join(classes.join(goals, of), [*of, "class"])
    digest = F.conv(F.substring(F.md5(F.concat(F.lit("offset:"), F.col("_mix_sk"), F.col("_mix_sn").cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ahead = F.col("in_source") + F.col("in_class") + F.col("in_piece")
    known = {"known": F.coalesce("id", F.lit(0)) if whole else F.coalesce(F.col("id").cast("string"), F.lit("")), "null": F.col("id").isNull()}  # a null id joins too
    key = [*of, *known, "size", "tie", "salt"]
    cells = cells.withColumns(known).select(*key, ahead.alias("ahead"), "source_size", "target", rate.alias("rate"), digest.alias("offset"))
    d = d.withColumns(known).select("row", *key)
    placed = d.withColumn("at", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))).join(cells, key)
    rank = (F.col("ahead") + F.col("at")).cast("double")
    copies = F.floor(F.col("rate") * rank + F.col("offset")) - F.floor(F.col("rate") * (rank - 1.0) + F.col("offset"))
    return placed.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(rest)], "size", "source_size", "target", copies.cast("long").alias("copies"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS sk, source IS NULL AS sn,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT sk, sn, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY sk, sn),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY sn, sk) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s),
l AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
      - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, sn, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / CAST(sum(weight) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, sn, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w),
f AS (SELECT max(level) FILTER (WHERE cap > level * weight AND ord = firstord) AS first FROM
      (SELECT *, min(ord) FILTER (WHERE cap > level * weight) OVER () AS firstord FROM
        (SELECT *, row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, sn, sk) AS ord FROM l))),
t AS (SELECT sk, sn, source_size, CASE WHEN cap > level * weight THEN first * weight ELSE cap END AS target FROM l, f),
r AS (
  SELECT d.*, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
    CAST(row_number() OVER (PARTITION BY d.sk, d.sn ORDER BY
      length(bin(size)) * 8 + ((size >> CAST(greatest(length(bin(size)) - 4, 0) AS BIGINT)) % 8),
      ((coalesce(doc_id, 0) % 1024) + 1024) % 1024, doc_id NULLS FIRST, size) AS DOUBLE) AS rank,
    CAST(('0x' || substr(md5('offset:' || d.sk || CASE WHEN d.sn THEN 'true' ELSE 'false' END), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.sk = t.sk AND d.sn = t.sn)
SELECT doc_id, size, source_size, target,
  size * CAST(floor(rate * rank + u) - floor(rate * (rank - 1.0::DOUBLE) + u) AS BIGINT) AS taken
FROM r
"""
