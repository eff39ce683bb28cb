"""Filter interaction audit: what each filter removes in every order of the filters, by first-failure lookup."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .batches import add_columns, as_bytes, columns, quoted

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: FIRST[mask, order] is the step, from 0, at which a document that fails the filters in mask goes; STEPS if it stays.
FIRST = np.array([[next((i for i, f in enumerate(o) if m >> FILTERS.index(f) & 1), STEPS) for o in ORDERS] for m in range(1 << STEPS)])
#: Counts of a part: for all documents, the good and the toxic ones each order's steps, and then the masks.
CELLS = len(ORDERS) * (STEPS + 1)
MASKS = 3 * CELLS
#: Documents that are looked up at once, and parts whose counts a task holds before it hands them on.
ROWS, PARTS = 4096, 256

LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 100, 80, 10, b"#$%&*|"
_CAPITALS, _CONTINUING = bytes(range(65, 91)), bytes(range(0x80, 0xC0))


def own_failures(text: bytes) -> int:
    """The failures that a text's own content decides, a bit each: A few words, B repeated words, C capitals, D symbols.

    bytes.split() separates at the blanks 0x20 and 0x09 to 0x0D, and at no other.
    """
    words = text.split()
    n, points = len(words), len(text.translate(None, _CONTINUING))
    few = n < LEAST_WORDS
    repeated = 100 * len(set(words)) < DISTINCT_PERCENT * n
    capital = 100 * (len(text) - len(text.translate(None, _CAPITALS))) > CAPITAL_PERCENT * points
    symbols = len(text.translate(None, SYMBOLS)) < len(text)
    return few | repeated << 1 | capital << 2 | symbols << 3


def _read(texts: pa.Array) -> list[pa.Array]:
    values = as_bytes(texts)
    return [pa.array(map(own_failures, values), pa.int32()), pa.array([hashlib.sha256(v).digest() for v in values], pa.binary())]


def failures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "lang") -> DataFrame:
    """(doc_id, part, mask): the filters that each document fails, bit i for FILTERS[i].

    E, identical to a smaller id's text, needs no text twice: texts become SHA-256 digests, each digest's smallest id is one
    aggregation with partial minima, and a document fails unless it has that id. That join's key holds the id, so a group of
    copies of any size is spread over all tasks. A null text is empty; a null part is the empty string; a document without an
    id isn't compared, nor is its text anyone's first; rows that share id and text are no copies of each other.
    """
    keep = Scratch(docs.sparkSession, "filters")
    rows = add_columns(docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.coalesce(F.col(quoted(part)).cast("string"), F.lit("")).alias("part"), F.col(quoted(text)).cast("binary").alias("text")), ["doc_id", "part"], [F.col("text")], _read, "mask int, digest binary")
    rows = keep.keep(rows, "read")
    first = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["doc_id", "digest"], "left").select("doc_id", "part", F.col("mask").bitwiseOR(F.when(copy, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial arrays of a task's rows (part, mask, good, toxic), one of each part, as (part, cell, n) where n isn't 0."""
    sums: dict[str, np.ndarray] = {}

    def given() -> pa.RecordBatch:
        cells = {p: np.flatnonzero(a) for p, a in sums.items()}
        names = pa.array([p for p, c in cells.items() for _ in range(len(c))], pa.string())
        joined = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        out = pa.RecordBatch.from_arrays([names, joined(list(cells.values())).cast(pa.int32()), joined([sums[p][c] for p, c in cells.items()])], ["part", "cell", "n"])
        sums.clear()
        return out

    place = CELLS // len(ORDERS) * np.arange(len(ORDERS))
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            rows = batch.slice(at, ROWS)
            code = rows.column(0).dictionary_encode()
            part, mask, names = code.indices.to_numpy(), rows.column(1).to_numpy(), code.dictionary.to_pylist()
            step = FIRST[mask] + place
            size = len(names) * CELLS
            cells = step + CELLS * part[:, None]
            kinds = [np.bincount(cells.ravel(), minlength=size)]
            for label in (2, 3):
                kinds.append(np.bincount(cells[rows.column(label).to_numpy(zero_copy_only=False)].ravel(), minlength=size))
            masks = np.bincount(part * len(FIRST) + mask, minlength=len(names) * len(FIRST))
            for i, name in enumerate(names):
                own = np.concatenate([*(k[i * CELLS : (i + 1) * CELLS] for k in kinds), masks[i * len(FIRST) : (i + 1) * len(FIRST)]])
                sums[name] = sums[name] + own if name in sums else own
            if len(sums) >= PARTS:
                yield given()
    yield given()


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each part (part, cells, counts): one of each order and step."""
    fails_in = [np.flatnonzero(np.arange(len(FIRST)) >> i & 1) for i in range(STEPS)]
    at = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
    for batch in batches:
        for part, cells, counts in zip(*(c.to_pylist() for c in batch.columns)):
            all_of = np.zeros(MASKS + len(FIRST), np.int64)
            all_of[cells] = counts
            every, good, toxic = all_of[:MASKS].reshape(3, len(ORDERS), STEPS + 1)
            masks = all_of[MASKS:]
            removed = every[:, :STEPS]
            kept = masks.sum() - np.cumsum(removed, axis=1)
            failing, only = (np.array(x) for x in ([masks[f].sum() for f in fails_in], [masks[1 << i] for i in range(STEPS)]))
            shapley = np.zeros(STEPS, np.int64)
            np.add.at(shapley, at, removed)
            n = len(ORDERS) * STEPS
            made = [kept, removed, failing[at] - removed, only[at], good[:, :STEPS], toxic[:, :STEPS], shapley[at]]
            orders = pa.array(ORDERS).take(pa.array(np.repeat(np.arange(len(ORDERS)), STEPS)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.string()), orders, pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))), *[pa.array(np.ascontiguousarray(x).ravel(), pa.int64()) for x in made]],
                ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
            )


def interactions(failing: DataFrame, labels: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): for every part, order of the
    filters and step, zeros included, the documents that are left after the step, removed in it, failing its filter but removed
    before, failing no other filter, removed with quality 1, removed with toxic 1; and what its filter removes in all
    orders together.

    failing: (doc_id, part, mask) as of `failures`; labels: doc_id, quality, toxic, where the largest of repeated ones counts
    and null ones don't. A document's mask is looked up in FIRST for all orders at once; each task counts what it finds and
    hands on one array of a part, so what is shuffled depends on the parts and tasks, not on the documents. A table
    without documents has no parts and so no rows.
    """
    known = labels.where(F.col(quoted(doc_id)).isNotNull()).groupBy(F.col(quoted(doc_id)).alias("doc_id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("x"))
    rows = failing.join(known, "doc_id", "left").select("part", "mask", F.coalesce(F.col("q") == 1, F.lit(False)).alias("good"), F.coalesce(F.col("x") == 1, F.lit(False)).alias("bad"))
    sums = rows.mapInArrow(_tally, "part string, cell int, n bigint").groupBy("part", "cell").agg(F.sum("n").alias("n"))
    whole = sums.groupBy("part").agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("counts"))  # MASKS + 32 at most
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    return whole.select(*columns(["part", "cells", "counts"])).mapInArrow(_report, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in names))


#: The same for the tables documents and labels.
SQL = r"""
WITH filters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, a.bit AS b1, b.bit AS b2, c.bit AS b3, d.bit AS b4, e.bit AS b5
  FROM filters a, filters b, filters c, filters d, filters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (
  SELECT filter_order, 1 AS step, b1 AS bit, 0 AS before FROM orders UNION ALL SELECT filter_order, 2, b2, b1 FROM orders UNION ALL
  SELECT filter_order, 3, b3, b1 | b2 FROM orders UNION ALL SELECT filter_order, 4, b4, b1 | b2 | b3 FROM orders UNION ALL
  SELECT filter_order, 5, b5, b1 | b2 | b3 | b4 FROM orders),
texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM texts),
masks AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first < doc_id THEN 16 ELSE 0 END AS mask
  FROM split),
known AS (SELECT doc_id, max(quality) AS q, max(toxic) AS x FROM labels GROUP BY doc_id),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (q = 1) AS good, count(*) FILTER (x = 1) AS bad FROM masks LEFT JOIN known USING (doc_id) GROUP BY part, mask),
found AS (
  SELECT part, filter_order, step, bit,
    CAST(coalesce(sum(n) FILTER ((mask & (bit | before)) = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER ((mask & bit) > 0 AND (mask & before) = 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER ((mask & bit) > 0 AND (mask & before) > 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER ((mask & bit) > 0 AND (mask & before) = 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(bad) FILTER ((mask & bit) > 0 AND (mask & before) = 0), 0) AS BIGINT) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM found
"""
