"""Ranked lexical search: MaxScore per shard."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.postings import TERMS, Segment, counted, frequencies, segments
from ..session import Scratch
from .batches import quoted

#: Items that the tasks get at once, and postings of a segment.
ITEMS, POSTINGS = 4096, 2_000_000
#: Documents of a segment's first range; each range is twice as long as the one before, up to the last.
FIRST_RANGE, LAST_RANGE = 512, 16_384
#: Each byte as a word has it: A-Z in lower case, other ASCII characters that aren't letters or digits as blanks, others as they are.
_AS_WORD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other characters beyond ASCII; only A-Z are lower-cased."""
    return text.translate(_AS_WORD).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """A posting's share of a score before the term's weight; grows with tf and falls with the document's length."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


class Shard:
    """A segment with its postings' impacts, and the largest impact of each term, which bounds what the term can add."""

    def __init__(self, segment: Segment, documents: int, length: int):
        self.of, self.place, self.ids, self.docs, self.size = segment.of, segment.place, segment.ids, segment.doc, len(segment.n)
        norm = 25 + (75 * segment.n * documents) // max(1, length)
        self.impact = impact(segment.tf.astype(np.int64), norm[segment.doc])
        self.most = np.maximum.reduceat(self.impact, segment.starts[:-1]) if len(self.impact) else self.impact

    def best(self, asked: list[tuple[int, int]], k: int, floor: int = 1) -> tuple[list[tuple[int, int]], int]:
        """The (score, row) of this shard that may be among the k best with `floor` or more, and how many postings were read.

        asked: (term, weight times its occurrences). Terms stand in the order of their bounds, the largest first. A suffix of
        them whose bounds together stay below the least score that still counts is non-essential: documents that hold only
        such terms are never looked at. Essential lists are read range by range; the others are probed, by binary search, for
        the documents that can still reach that score with all bounds left, which rises as documents are found. Documents that
        reach it exactly are kept, as ties are broken later.
        """
        lists = sorted(((w * int(self.most[self.place[t]]), t, w) for t, w in asked if t in self.place and w > 0), reverse=True)
        bounds = np.array([x[0] for x in lists], np.int64)
        left = np.append(np.cumsum(bounds[::-1])[::-1], 0)  # what the terms from i on can add
        parts = [(self.docs[s := self.of(t)], self.impact[s], w) for _, t, w in lists]
        heap: list[int] = []
        found, read, at, step = [], 0, 0, FIRST_RANGE
        while at < self.size and left[0] >= floor:
            end = min(self.size, at + step)
            essential = int(np.count_nonzero(left[:-1] >= floor))
            sums, seen = np.zeros(end - at, np.int64), np.zeros(end - at, bool)
            for docs, impacts, w in parts[:essential]:
                a, b = np.searchsorted(docs, (at, end))
                sums[docs[a:b] - at] += w * impacts[a:b]
                seen[docs[a:b] - at] = True
                read += int(b - a)
            rows = np.flatnonzero(seen)
            scores = sums[rows]
            for i in range(essential, len(parts)):
                able = scores + left[i] >= floor
                rows, scores = rows[able], scores[able]
                if not len(rows):
                    break
                docs, impacts, w = parts[i]
                place = np.minimum(np.searchsorted(docs, rows + at), len(docs) - 1)
                held = docs[place] == rows + at
                scores = scores + np.where(held, w * impacts[place], 0)
                read += len(rows)
            able = scores >= floor
            rows, scores = rows[able], scores[able]
            if len(rows) > k:  # of a range's rows only those with its k-th score or more can count
                able = scores >= np.partition(scores, -k)[-k]
                rows, scores = rows[able], scores[able]
            for s in scores.tolist():
                if len(heap) < k:
                    heapq.heappush(heap, s)
                else:
                    heapq.heappushpop(heap, s)
            found += zip(scores.tolist(), (rows + at).tolist())
            if len(heap) == k:
                floor = max(floor, heap[0])
            at, step = end, min(2 * step, LAST_RANGE)
        # rows are in the order of ids, so the first of equal scores are the ones that stay
        return heapq.nsmallest(k, ((-s, r) for s, r in found if s >= floor)), read


def _ranked(items: list[tuple[object, list[tuple[int, int]]]], documents: int, length: int, k: int, names: list[str]):
    """A function over a task's rows of `counted` that yields its k best documents of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: list[list[int]] = [[] for _ in items]  # the k best scores of each item so far, over the task's segments
        for segment in segments(batches, POSTINGS):
            shard = Shard(segment, documents, length)
            whose, scores, rows = [], [], []
            for j, (_, asked) in enumerate(items):
                best, _ = shard.best(asked, k, floors[j][0] if len(floors[j]) == k else 1)
                for s, r in best:
                    whose.append(j)
                    scores.append(-s)
                    rows.append(r)
                floors[j] = heapq.nlargest(k, [*floors[j], *(-s for s, _ in best)])[::-1]
            if whose:
                yield pa.RecordBatch.from_arrays([pa.array(whose, pa.int32()), shard.ids.take(pa.array(rows)), pa.array(scores, pa.int64())], names)

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = 10, text: str = "text", doc_id: str = "doc_id", query: str = "text", query_id: str = "item_id") -> DataFrame:
    """(query_id, rank, doc_id, score): the k documents of highest score for each query, equal scores by ascending doc_id.

    Words are those of `words`. N counts the documents with a word, L all words. A term that df documents hold weighs
    w = floor(1000 ln((2N+2) / (2df+1))); a document of n words has m = 25 + 75nN div L; a score sums
    w * (10^9 tf div (1000 tf + 8m)) over the query's words, repeats included. Only scores above 0 are returned.

    The texts are read once: the counts of the queries' terms are written, a row of each document. Then every task searches its own
    part of them as a shard, in segments of POSTINGS, with MaxScore (`Shard.best`); only a shard's k best of each query are
    shuffled. Queries are a stated set: they come to the tasks in blocks of ITEMS, and their terms in rounds of
    TERMS. The result has k rows of each query at most and is written; the counts are dropped.

    Null and empty texts have no words and are never found; queries without a word have no rows. Queries without an id are left out; of
    queries with one id the smallest text counts. Each row of docs is a document of its own, so repeated rows are found
    repeatedly; documents without an id come after others of their score. Other columns are ignored.
    """
    spark = docs.sparkSession
    keep = Scratch(spark, "search")
    asked = queries.select(F.col(quoted(query_id)).alias("q"), F.col(quoted(query)).alias("t")).where("q IS NOT NULL").groupBy("q").agg(F.min("t").alias("t"))
    asked, _ = keep.write(asked, "queries")
    size = asked.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    rounds = 1 + size // (2 * TERMS)  # a word and what ends it are two bytes at least
    kinds = [docs.schema[doc_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()]
    out = None
    for r in range(rounds):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(rounds)) == r).select("q", F.col("t").cast("binary")).toArrow().to_pydict()
        texts = [(q, Counter(words(t or b""))) for q, t in zip(*rows.values())]
        vocabulary = sorted(set().union(*[c for _, c in texts])) if texts else []
        place = {t: i for i, t in enumerate(vocabulary)}
        steps = Scratch(spark, "search-counts")
        counts = steps.keep(counted(docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text")), vocabulary, words), "counts")
        n, length = counts.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        weights = [weight(n, df) for df in frequencies(counts, len(vocabulary)).tolist()]
        items = [(q, [(place[t], times * weights[place[t]]) for t, times in sorted(c.items())]) for q, c in texts if c]
        found = None
        for at in range(0, max(1, len(items)), ITEMS):
            block = items[at : at + ITEMS]
            part = counts.where(F.size("terms") > 0).mapInArrow(_ranked(block, n, length or 0, k, ["j", "d", "s"]), f"j int, d {kinds[0]}, s bigint")
            ids = spark.createDataFrame([(j, q) for j, (q, _) in enumerate(block)], f"j int, q {kinds[1]}")
            part = part.join(F.broadcast(ids), "j").select("q", "d", "s")  # ITEMS rows at most
            found = part if found is None else found.unionByName(part)
        best = Window.partitionBy("q").orderBy(F.desc("s"), F.asc_nulls_last("d"))
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        part = keep.keep(ranked.select(F.col("q").alias(query_id), "rank", F.col("d").alias(doc_id), F.col("s").alias("score")), "found")
        steps.drop()
        out = part if out is None else out.unionByName(part)
    return out


#: The same for the tables documents and benchmark.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
s AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, CAST(coalesce(sum(len(t)), 0) AS BIGINT) AS n_terms FROM d),
p AS (SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
q AS (
  SELECT item_id, term, CAST(count(*) AS BIGINT) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
scored AS (
  SELECT item_id, p.r, p.doc_id, CAST(sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, p.r, p.doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
