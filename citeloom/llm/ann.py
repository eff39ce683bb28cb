"""Approximate nearest neighbours over balanced posting lists with boundary replication."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .batches import quoted

#: Classes that centroids are fitted on, and those that the reading is calibrated on where there are more; classes a list should
#: hold, and lists at most, as every task holds the centroids.
SAMPLE, HELD, LIST, LISTS = 20_000, 10_000, 10, 4096
#: Lists a class is put into at most, and the distance ratio up to which.
COPIES, CLOSE = 2, 1.06
#: Share of the sample's true neighbours that the lists read must hold, and the share within the distance ratio that prunes them.
RECALL, WITHIN = 0.96, 0.995
#: Lists that a query reads in any case; lists that it reads, as a share of all, and their distance ratio, where a sample is too small
#: to calibrate on (fewer than TOO_FEW classes).
LEAST, SHARE, REACH, TOO_FEW = 12, 0.35, 1.3, 200
#: Classes of neighbouring lists that are brought together, classes and queries of one task.
PART, BLOCK, ASKED = 4096, 20_000, 20_000


def probes(lists: int) -> tuple[int, int]:
    """Lists that a query reads, and at most, where nothing is calibrated."""
    least = max(LEAST, math.ceil(SHARE * lists))
    return least, least


@dataclass
class Centroids:
    """Unit centroids and a graph over them that is searched greedily with a beam."""

    points: np.ndarray
    graph: np.ndarray
    entries: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, k: int, seed: int = 42, degree: int = 16) -> Centroids:
        """Balanced spherical k-means: an assignment's cosine is reduced as its list outgrows the mean."""
        rng = np.random.default_rng(seed)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        k = max(1, min(k, len(x)))
        c = x[rng.choice(len(x), k, replace=False)]
        size = np.full(k, len(x) / k)
        for _ in range(8):
            near = np.concatenate([(p @ c.T - 0.05 * (size / size.mean() - 1)).argmax(axis=1) for p in np.array_split(x, max(1, len(x) // 2048))])
            size = np.bincount(near, minlength=k).astype(float)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            norm = np.linalg.norm(total, axis=1)
            spare = norm < 1e-9  # an empty list takes up a place in a crowded one
            total[spare] = x[rng.choice(len(x), int(spare.sum()))]
            c = total / np.linalg.norm(total, axis=1, keepdims=True)
        near = c @ c.T
        np.fill_diagonal(near, -2)
        degree = min(degree, max(k - 1, 1))
        graph = np.argsort(-near, axis=1, kind="stable")[:, :degree]
        graph = np.concatenate((graph, rng.integers(0, k, (k, 4))), axis=1)  # some long edges keep it connected
        return cls(c.astype(np.float32), graph.astype(np.int32), rng.choice(k, min(k, 32), replace=False))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroids found for each unit query, nearest first, with their distances; -1 fills short rows.

        A step expands the nearest of the beam's fresh centroids, a sixteenth of the beam at once.
        """
        k, b = len(self.points), len(q)
        beam = min(beam, k)
        width = max(1, beam // 16)
        rows = np.arange(b)[:, None]
        seen = np.zeros((b, k), bool)
        ids = np.repeat(self.entries[None, :], b, axis=0)
        seen[rows, ids] = True
        cos = q @ self.points[self.entries].T
        fresh = np.ones(ids.shape, bool)
        for _ in range(4 * beam):
            best = np.where(fresh, cos, -np.inf)
            n = min(width, best.shape[1])
            at = np.argpartition(-best, n - 1, axis=1)[:, :n]
            good = np.take_along_axis(best, at, axis=1) > -np.inf
            if not good.any():
                break
            np.put_along_axis(fresh, at, False, axis=1)
            near = self.graph[np.take_along_axis(ids, at, axis=1)].reshape(b, -1)
            new = ~seen[rows, near] & np.repeat(good, self.graph.shape[1], axis=1)
            # of one centroid that several bring, the first counts
            order = np.argsort(near, axis=1, kind="stable")
            sorted_near = np.take_along_axis(near, order, axis=1)
            first = np.ones(near.shape, bool)
            first[:, 1:] = sorted_near[:, 1:] != sorted_near[:, :-1]
            keep = np.empty(near.shape, bool)
            np.put_along_axis(keep, order, first, axis=1)
            new &= keep
            r, c = np.nonzero(new)
            seen[r, near[r, c]] = True
            found = np.full(near.shape, -np.inf, cos.dtype)
            found[r, c] = np.einsum("nd,nd->n", q[r], self.points[near[r, c]])
            ids, cos, fresh = np.concatenate((ids, np.where(new, near, -1)), 1), np.concatenate((cos, found), 1), np.concatenate((fresh, new), 1)
            if ids.shape[1] > beam:
                top = np.argpartition(-cos, beam - 1, axis=1)[:, :beam]
                ids, cos, fresh = ids[rows, top], cos[rows, top], fresh[rows, top]
        order = np.argsort(-cos, axis=1, kind="stable")
        ids, cos = ids[rows, order], cos[rows, order]
        return np.where(np.isfinite(cos), ids, -1), np.sqrt(np.maximum(2 - 2 * cos, 0))

    def lists(self, q: np.ndarray, beam: int, least: int, most: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists chosen by the distance ratio to the nearest centroid."""
        q = (q / np.linalg.norm(q, axis=1, keepdims=True)).astype(np.float32)
        ids, dist = self.search(q, beam)
        ids, dist = ids[:, :most], dist[:, :most]
        good = (ids >= 0) & ((dist <= ratio * dist[:, :1] + 1e-6) | (np.arange(ids.shape[1]) < least))
        row, col = np.nonzero(good)
        return row, ids[row, col]

    def calibrated(self, x: np.ndarray, k: int, recall: float = RECALL, queries: int = 256, seed: int = 1) -> tuple[int, float]:
        """How many lists a query has to read at most, and within which distance ratio, so that the share `recall` of the true k
        nearest of some sample vectors is read; by brute force over the sample x."""
        rng = np.random.default_rng(seed)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        asked = rng.choice(len(x), min(queries, len(x)), replace=False)
        row, to = self.lists(x, 24, 1, COPIES, CLOSE)
        cut = np.searchsorted(row, np.arange(len(x) + 1))  # rows come in order
        dist = np.sqrt(np.maximum(2 - 2 * (x[asked] @ self.points.T.astype(float)), 0))
        rank, ratio = np.argsort(np.argsort(dist, axis=1, kind="stable"), axis=1) + 1, dist / np.maximum(dist.min(axis=1, keepdims=True), 1e-9)
        ranks, ratios = [1], [1.0]
        for j, i in enumerate(asked):
            score = x @ x[i]
            score[i] = -np.inf
            for near in np.argsort(-score)[: min(k, len(x) - 1)]:
                held = to[cut[near] : cut[near + 1]]
                ranks.append(int(rank[j, held].min()))
                ratios.append(float(ratio[j, held].min()))
        return int(np.quantile(ranks, recall, method="higher")), float(np.quantile(ratios, WITHIN, method="higher"))


def usable(vector: Column) -> Column:
    """A vector that takes part: not null, without null or non-finite components, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, each scaled by a power of two so that its largest component is between 1/2 and 1. That
    changes no digit and no cosine, and keeps the norms of huge and tiny vectors in range."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0, keepdims=True))[1])


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def _best(q: np.ndarray, qn: np.ndarray, v: np.ndarray, vn: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, cosine) of the k + 1 nearest vectors of each query, ties by low. Those near the last place are
    computed again one by one, so a cosine doesn't depend on what else is compared."""
    rough = (q @ v.T) / (qn[:, None] * vn[None, :])
    if len(v) > k + 1:
        row, col = np.nonzero(rough >= np.partition(rough, -(k + 1), axis=1)[:, -(k + 1)][:, None] - 1e-12)
    else:
        row, col = np.nonzero(np.ones(rough.shape, bool))
    score = np.clip((q[row] * v[col]).sum(axis=1) / (qn[row] * vn[col]), -1, 1)
    order = np.lexsort((low[col], -score, row))
    row, col, score = row[order], col[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row, "left") <= k
    return row[keep], col[keep], score[keep]


def _compare(k: int):
    """The k nearest of each query over the lists that it reads, for a group of asked (id, v, lists) and held (list, ids, v) rows."""

    def run(ask: pa.Table, have: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if ask.num_rows and have.num_rows:
            q, v = (_matrix(t.column("v").combine_chunks()) for t in (ask, have))
            qn, vn = _norms(q), _norms(v)
            ids, qid = have.column("ids").combine_chunks(), ask.column("id").to_numpy()
            starts = ids.offsets.to_numpy()
            flat = ids.values.to_numpy()
            low = flat[starts[:-1]]
            lists = ask.column("lists").combine_chunks()
            wanted, asker = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
            order = np.argsort(wanted, kind="stable")
            wanted, asker = wanted[order], asker[order]
            held = have.column("list").to_numpy()
            by = np.argsort(held, kind="stable")
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            names, first = np.unique(held[by], return_index=True)
            for name, a, b in zip(names, first, np.append(first[1:], len(by))):
                who = asker[np.searchsorted(wanted, name, "left") : np.searchsorted(wanted, name, "right")]
                own = by[a:b]
                for j in range(0, len(who), 256):
                    some = who[j : j + 256]
                    row, col, score = _best(q[some], qn[some], v[own], vn[own], low[own], k)
                    found.append((some[row], own[col], score))
            if found:
                row, col, score = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((low[col], -score, row))
                row, col, score = row[order], col[order], score[order]
                once = np.concatenate(([True], (row[1:] != row[:-1]) | (low[col[1:]] != low[col[:-1]])))  # a class may be in two lists
                row, col, score = row[once], col[once], score[once]
                keep = np.arange(len(row)) - np.searchsorted(row, row, "left") <= k
                row, col, score = row[keep], col[keep], score[keep]
                times = starts[col + 1] - starts[col]
                at = np.repeat(starts[col], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                near, row, score = flat[at], np.repeat(row, times), np.repeat(score, times)
                real = near != qid[row]
                near, row, score = near[real], row[real], score[real]
                order = np.lexsort((near, -score, row))
                near, row, score = near[order], row[order], score[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
                out = qid[row[keep]], near[keep], score[keep]
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", exact: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row the k nearest vectors by cosine among all others.

    1. Equal vectors are one class with its k + 1 smallest ids, ranked inside the tasks before the shuffle, so a vector that a third of
       all rows share is one row of the index and no answer is lost.
    2. Centroids are fitted by balanced k-means on at most SAMPLE classes, about LIST classes a list. Every class is indexed:
       it goes to the nearest list, and from a boundary to up to COPIES lists within CLOSE times that distance.
    3. The centroids sit in a graph that every task holds in memory (LISTS at most). A query reads the lists within a distance
       ratio of its nearest centroid's, up to a number of them. Both are calibrated by brute force on a bounded sample that
       the centroids weren't fitted on, so that RECALL of its true neighbours are read; where vectors have clusters a few
       lists do, where they have none many.
    4. Neighbouring lists are parts of about PART classes: a query goes once to a part with the lists that it reads there.
       Parts of more than BLOCK classes are dealt to blocks by a hash, and more than ASKED queries too; so no task gets an
       unbounded side. Cosines are computed in double precision from the original vectors.

    With exact there is one list, and every query reads it: the same search by brute force, block by block.

    The row of a query is the row with its id: it is left out, also if repeated. Ties go to the smaller id. Vectors that are
    null, zero, or hold null or non-finite components take no part; null ids neither. A vector is compared with those of its
    own length only, as others have no cosine with it; those of another than the commonest length by brute force.
    A query whose lists hold fewer than k others reads all lists. Fewer candidates give fewer rows; empty tables give none.
    """
    spark = vectors.sparkSession
    result, scratch = Scratch(spark, "ann"), Scratch(spark, "ann-steps")
    schema = "query_id long, rank int, vec_id long, score double"
    pick = lambda df: df.select(F.col(quoted(vec_id)).cast("long").alias("id"), F.col(quoted(embedding)).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    rows, asked = pick(vectors).distinct(), scratch.keep(pick(queries).distinct(), "asked")
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # k + 1 rows each at most
    classes = scratch.keep(classes.withColumn("length", F.size("v")), "classes")
    common = classes.groupBy("length").count().orderBy(F.desc("count"), "length").first()
    if common is None:
        return spark.createDataFrame([], schema)
    usual = F.col("length") == common["length"]
    sample = _matrix(classes.where(usual).select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE + HELD).toArrow().column(0).combine_chunks())
    fitted = sample[:SAMPLE]
    index = Centroids.fit(fitted, 1 if exact else min(LISTS, max(1, round(common["count"] / LIST)), max(1, len(fitted) // 4)))
    if len(sample) < TOO_FEW:
        least, most = probes(len(index.points))
        ratio = REACH
    else:
        most, ratio = index.calibrated(fitted if len(sample) <= SAMPLE else sample[SAMPLE:], k)
        least, most = min(LEAST, len(index.points)), max(most, LEAST)
    parts = Centroids.fit(index.points.astype(float), max(1, round(common["count"] / PART)))
    part_of = parts.search(index.points, 24)[0][:, 0].astype(np.int32)
    shared = spark.sparkContext.broadcast((index, part_of))  # LISTS centroids at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, part_of = shared.value
        for batch in batches:
            for j in range(0, batch.num_rows, 1024):
                part = batch.slice(j, 1024)
                row, to = index.lists(_matrix(part.column(0)), 24, 1, COPIES, CLOSE)
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(part_of[to]), pa.array(to, pa.int32()), part.column(1).take(row), part.column(0).take(row)], ["part", "list", "ids", "v"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, part_of = shared.value
        for batch in batches:
            for j in range(0, batch.num_rows, 1024):
                some = batch.slice(j, 1024)
                row, to = index.lists(_matrix(some.column(1)), most + 32, least, most, ratio)
                order = np.lexsort((to, part_of[to], row))
                row, to = row[order], to[order]
                part = part_of[to]
                first = np.flatnonzero(np.concatenate(([True], (np.diff(row) != 0) | (np.diff(part) != 0))))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(to)), pa.int32()), pa.array(to, pa.int32()))
                own = pa.array(row[first])
                yield pa.RecordBatch.from_arrays([pa.array(part[first]), lists, some.column(0).take(own), some.column(1).take(own)], ["part", "lists", "id", "v"])

    # the other lengths are parts of their own, under negative numbers, with one list
    other = F.col("length") != common["length"]
    held = classes.where(usual).select("v", "ids").mapInArrow(assign, "part int, list int, ids array<long>, v array<double>")
    held = scratch.keep(held.unionByName(classes.where(other).select((-F.col("length")).alias("part"), F.lit(0).alias("list"), "ids", "v")), "held")
    mine = asked.withColumn("length", F.size("v"))
    wanted = mine.where(usual).select("id", "v").mapInArrow(probe, "part int, lists array<int>, id long, v array<double>")
    wanted = wanted.unionByName(mine.where(other).select((-F.col("length")).alias("part"), F.array(F.lit(0)).alias("lists"), "id", "v"))

    sizes = scratch.keep(held.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "sizes")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = held.join(sizes, "part").select("part", "list", "ids", "v", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("block"))
    keys = ("part", "block", "of")

    def searched(some: DataFrame) -> DataFrame:
        """(query_id, vec_id, score, rank) of queries (part, lists, id, v). A part's vectors go to as many tasks as its own queries
        need, ASKED to each; parts that no query reads aren't moved."""
        asked_of = some.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("groups"))
        split = scratch.keep(sizes.join(asked_of, "part"), "split")
        some = some.join(split, "part").select("part", "lists", "id", "v", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int").alias("of"), every(F.col("blocks")).alias("block"))
        read = held.join(split.select("part", "groups"), "part").select("part", "list", "ids", "v", "block", every(F.col("groups")).alias("of"))
        found = some.groupBy(*keys).cogroup(read.groupBy(*keys)).applyInArrow(_compare(k), "query_id long, vec_id long, score double")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = result.keep(searched(scratch.keep(wanted, "wanted")), "found")
    full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    short = scratch.keep(mine.where(usual).join(full, F.col("id") == F.col("query_id"), "left_anti").select("id", "v"), "short")
    if exact or not short.head(1):
        scratch.drop()
        return found
    # the lists of these hold fewer than k others: they read all

    def probe_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, part_of = shared.value
        for batch in batches:
            for part in np.unique(part_of):
                lists = np.flatnonzero(part_of == part).astype(np.int32)
                times = np.arange(batch.num_rows + 1, dtype=np.int32) * len(lists)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int32)), pa.ListArray.from_arrays(pa.array(times), pa.array(np.tile(lists, batch.num_rows))), batch.column(0), batch.column(1)], ["part", "lists", "id", "v"])

    again = searched(scratch.keep(short.mapInArrow(probe_all, "part int, lists array<int>, id long, v array<double>"), "all"))
    out = result.keep(found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(again), "whole")
    scratch.drop()
    return out
