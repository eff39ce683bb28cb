"""Retrieval: BM25, dense vectors, rank fusion, calibration to scores, constraint ordering, the abstention gate, peers."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import voltage_band
from ..session import Scratch, spread
from .postings import TERMS, Segment, counted, frequencies, segments, tallies

#: Patterns of a term, and queries that are sent to the tasks at once.
LATIN, INDIC, QUERIES = "[a-z0-9]+", "[ऀ-ॿ]+|[a-z0-9]+", 1024
#: Postings of a segment, and documents of a block.
POSTINGS, BLOCK = 2_000_000, 32
#: The characters beyond ASCII whose lower case holds an ASCII letter.
_TO_ASCII = ("İ".encode(), "\u212a".encode())
K1, B, EPSILON = 1.5, 0.75, 0.25
FUSE, DEPTH, SHORTLIST = 60, 20, 10
ACCEPT, MARGIN, CLEAR = 0.45, 0.10, 0.80
PEER_DOCUMENTS, PEER_SHARE, PEER_LEAST = 30, 0.35, 3


def terms_of(pattern: str) -> Callable[[bytes], list[str]]:
    """The matches of a pattern in a text's lower-case form. For LATIN, ASCII letters and digits, plain bytes suffice: all else separates."""
    find = re.compile(pattern).findall
    if pattern != LATIN:
        return lambda text: find(text.decode("utf-8", "replace").lower())
    table = bytes(b if b < 128 and chr(b).isalnum() else 32 for b in range(256)).lower()

    def words(text: bytes) -> list[str]:
        if not text.isascii() and any(x in text for x in _TO_ASCII):
            return find(text.decode("utf-8", "replace").lower())
        return text.translate(table).decode("ascii").split()

    return words


def bm25(docs: DataFrame, queries: DataFrame, k: int = DEPTH, text: str = "text", doc_id: str = "doc_id", query: str = "text", query_id: str = "item_id", pattern: str = LATIN) -> DataFrame:
    """(query_id, doc, score, rank): the k best documents of each query that share a term with it, ties by doc; scores to 6 places.

    Okapi weights with a floor: a term in more than half of the documents counts EPSILON of the mean weight of all terms. A repeated
    query term counts as often. Terms are the matches of `pattern` in the lower-cased text (LATIN or INDIC).

    Queries with the same terms, each as often, are one search; its result goes to all of them. So the work grows with the different
    queries and the documents, whatever the number of queries.

    Texts are read once: the counts of the queries' terms are written as postings. Queries then come to the tasks in blocks of
    QUERIES, with terms in rounds of TERMS, and every task searches its own postings in segments: documents stand in blocks
    of BLOCK by length, each term has a bound for each of its blocks, and blocks are scored from the highest sum of bounds down, until
    none can reach the k-th score (see `Postings.best`). Only a segment's k best of each query are shuffled, so no term is a join
    key, however frequent. The result has k rows of a query at most; it is written, and the postings are dropped.
    """
    spark, words = docs.sparkSession, terms_of(pattern)
    keep = Scratch(spark, "bm25")
    kind_q, kind_d = queries.schema[query_id].dataType.simpleString(), docs.schema[doc_id].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [words(t.as_py() or b"") for t in batch.column(1)]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([x for f in found for x in f], pa.string())], ["q", "term"])

    asked = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).alias("q"), F.col(query).cast("binary")).mapInArrow(split, f"q {kind_q}, term string")
    asked = keep.keep(asked.groupBy("q", "term").agg(F.count(F.lit(1)).alias("qf")), "asked")
    bags = keep.keep(asked.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("term", "qf"))).alias("bag")), "bags")  # a query's own terms
    first = keep.keep(bags.groupBy("bag").agg(F.min("q").alias("first")), "first")
    same = bags.join(first, "bag").select(F.col("q").alias("of"), F.col("first").alias("query_id"))
    asked = keep.keep(asked.join(first.select(F.col("first").alias("q")), "q", "left_semi"), "searched")
    rounds = 1 + asked.count() // TERMS
    out = None
    for r in range(rounds):
        own = asked.where(F.pmod(F.xxhash64("q"), F.lit(rounds)) == r).toArrow().sort_by("q").combine_chunks()  # some TERMS rows
        vocabulary = pc.unique(own.column("term")).sort().to_pylist()
        steps = Scratch(spark, "bm25-postings")
        counts = steps.keep(counted(spread(docs.select(doc_id, text), doc_id, text), vocabulary, words, doc_id, text, tallied=True), "counts")
        rows = counts.where("terms IS NOT NULL")
        total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("n").alias("avgdl")).first()
        n, avgdl = total["n"], total["avgdl"] or 1.0
        df = frequencies(rows, len(vocabulary))
        with np.errstate(divide="ignore"):
            raw = np.log(n - df + 0.5) - np.log(df + 0.5)
        if (raw < 0).any():  # only then does the mean matter
            each = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
            raw = np.where(raw < 0, EPSILON * tallies(counts).agg(F.avg(each)).first()[0], raw)
        names = pc.unique(own.column("q"))
        place = pc.index_in(own.column("term"), pa.array(vocabulary, pa.string())).to_numpy()
        weight = own.column("qf").to_numpy() * raw[place]
        starts = np.searchsorted(pc.index_in(own.column("q"), names).to_numpy(), np.arange(len(names) + 1))
        # few postings are searched by several tasks, each for some of the queries
        idle = spark.sparkContext.defaultParallelism // max(1, rows.rdd.getNumPartitions())
        size = max(1, min(QUERIES, max(16, -(-len(names) // max(1, idle)))))
        found = None
        for at in range(0, max(1, len(names)), size):
            asks = [list(zip(place[a:b].tolist(), weight[a:b].tolist())) for a, b in zip(starts[at : at + size], starts[at + 1 : at + size + 1])]
            part = rows.where(F.size("terms") > 0).mapInArrow(_searched(names[at : at + size], asks, float(avgdl), k), f"query_id {kind_q}, doc {kind_d}, score double")
            found = part if found is None else found.unionByName(part)
        part = keep.keep(top(found.withColumn("score", F.round("score", 6)), k).select("query_id", "doc", "score", "rank"), "best")
        steps.drop()
        out = part if out is None else out.unionByName(part)
    return same.join(out, "query_id").select(F.col("of").alias("query_id"), "doc", "score", "rank")


class Postings:
    """A segment's postings as BM25 shares of a score, in blocks of BLOCK documents by length, with each term's largest share in each."""

    def __init__(self, segment: Segment, avgdl: float):
        self.ids, self.size = segment.ids, len(segment.n)
        tf, dl = segment.tf.astype(np.float64), segment.n[segment.doc]
        self.doc, self.share = segment.doc, tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
        block = segment.doc // BLOCK
        new = np.flatnonzero((np.diff(segment.term, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        self.start, self.block, self.length = new, block[new], np.diff(new, append=len(block))
        self.most = np.maximum.reduceat(self.share, new) if len(new) else self.share
        at = segment.starts  # a term's runs, one of each of its blocks
        self.runs = {t: slice(*np.searchsorted(new, at[i : i + 2])) for t, i in segment.place.items()}
        self.order = pc.rank(self.ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)

    def best(self, asked: list[tuple[int, float]], k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and scores, to 6 places, of the k best documents with `floor` or more, and how many documents were scored.

        asked: (term, weight). A block's bound is the sum of its terms' largest shares by weight, negative weights left out. Blocks are
        taken from the highest bound down, ever more at once; when the next one's bound is below the k-th score so far, all that
        is left is too, and is not looked at. In the blocks that are, a document is scored if it holds an essential term: the terms with the
        least bounds whose sum is below the k-th score can't bring a document there by themselves.
        """
        mine = [(self.runs[t], w, max(0.0, w * self.most[self.runs[t]].max())) for t, w in asked if t in self.runs]
        if not mine:
            return np.zeros(0, np.int64), np.zeros(0), 0
        mine.sort(key=lambda x: -x[2])
        left = np.cumsum([x[2] for x in mine][::-1])[::-1]  # what the terms from i on can add
        many = [s.stop - s.start for s, _, _ in mine]
        runs = np.concatenate([np.arange(s.start, s.stop) for s, _, _ in mine])
        weight, of = np.repeat([w for _, w, _ in mine], many), np.repeat(np.arange(len(mine)), many)
        bound = np.bincount(self.block[runs], np.maximum(0, weight * self.most[runs]))
        held = np.unique(self.block[runs])
        held = held[np.argsort(-bound[held], kind="stable")]
        rows, scores, seen, at, step = np.zeros(0, np.int64), np.zeros(0), 0, 0, max(1, 2 * k // BLOCK)
        slot = np.full(len(bound), -1)

        def cells(pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Each posting of some runs in the chosen blocks: the document's cell, and what it adds."""
            r, w, n = runs[pick], weight[pick], self.length[runs[pick]]
            place = np.repeat(self.start[r] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(r) else np.zeros(0, np.int64)
            doc = self.doc[place]
            return slot[doc // BLOCK] * BLOCK + doc % BLOCK, np.repeat(w, n) * self.share[place]

        while at < len(held) and bound[held[at]] >= floor - 2e-6:
            chosen = held[at : at + step]
            chosen = chosen[bound[chosen] >= floor - 2e-6]
            slot[:] = -1
            slot[chosen] = np.arange(len(chosen))
            here, essential = slot[self.block[runs]] >= 0, left[of] >= floor - 2e-6
            cell, adds = cells(here & essential)
            total = np.bincount(cell, adds, len(chosen) * BLOCK)
            able = np.zeros(len(total), bool)
            able[cell] = True
            cell, adds = cells(here & ~essential)
            cell, adds = cell[able[cell]], adds[able[cell]]
            total += np.bincount(cell, adds, len(total))
            hit = np.flatnonzero(able)
            seen += len(hit)
            rows = np.concatenate((rows, chosen[hit // BLOCK] * BLOCK + hit % BLOCK))
            scores = np.concatenate((scores, np.round(total[hit], 6)))
            if len(rows) > k:
                by = np.lexsort((self.order[rows], -scores))[:k]
                rows, scores = rows[by], scores[by]
            if len(rows) == k:
                floor = max(floor, scores.min())
            at, step = at + step, 4 * step
        able = scores >= floor
        return rows[able], scores[able], seen


def _searched(names: pa.Array, asked: list[list[tuple[int, float]]], avgdl: float, k: int):
    """A function over a task's rows of `counted` that yields its k best documents of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[float]] = [[] for _ in asked]  # the k best scores of each query over the task's segments
        for segment in segments(batches, POSTINGS, ("n", "doc")):
            own = Postings(segment, avgdl)
            whose, rows, scores = [], [], []
            for j, terms in enumerate(asked):
                r, s, _ = own.best(terms, k, best[j][-1] if len(best[j]) == k else -np.inf)
                best[j] = heapq.nlargest(k, [*best[j], *s.tolist()])
                whose.append(np.full(len(r), j))
                rows.append(r)
                scores.append(s)
            if whose:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(whose))), own.ids.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(scores))], ["query_id", "doc", "score"])

    return run


def best_of(names: pa.Array, docs: pa.Array, score: np.ndarray, real: np.ndarray, k: int) -> pa.RecordBatch:
    """(query_id, doc, score) of the k best real columns of each row of scores; ties, to 6 places, by doc."""
    order = pc.rank(docs, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    rounded = np.where(real, np.round(score, 6), -np.inf)
    if rounded.shape[1] > k:
        floor = np.partition(rounded, -k, axis=1)[:, -k][:, None]
        row, col = np.nonzero(real & (rounded >= floor))
    else:
        row, col = np.nonzero(real)
    by = np.lexsort((order[col], -rounded[row, col], row))
    row, col = row[by], col[by]
    keep = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
    row, col = row[keep], col[keep]
    return pa.RecordBatch.from_arrays([names.take(pa.array(row)), docs.take(pa.array(col)), pa.array(score[row, col], pa.float64())], ["query_id", "doc", "score"])


def top(scored: DataFrame, k: int, by: str = "query_id", item: str = "doc", score: str = "score") -> DataFrame:
    """The k best of each query with rank, from 1; ties by item."""
    w = Window.partitionBy(by).orderBy(F.desc(score), item)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, doc, score, rank): exact nearest vectors by dot product in double precision, the query's own row left out;
    scores to 6 places, ties by doc.

    queries (query_id, query) come to the tasks in blocks of QUERIES; the vectors are read in place, once for each block,
    and only a batch's k best of each query are shuffled. Null vectors and those of another length have no score.
    """
    usable = queries.where("query_id IS NOT NULL AND query IS NOT NULL")
    kind = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc {vectors.schema[vec_id].dataType.simpleString()}, score double"
    rows = vectors.select(F.col(vec_id).alias("doc"), F.col(embedding).cast("array<double>").alias("v")).where("v IS NOT NULL")
    blocks = max(1, -(-usable.count() // QUERIES))
    out = None
    for b in range(blocks):
        block = usable.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", F.col("query").cast("array<double>").alias("query")).toArrow()
        part = rows.mapInArrow(_products(block, k), kind)
        out = part if out is None else out.unionByName(part)
    return top(out.withColumn("score", F.round("score", 6)), k)


def _products(asked: pa.Table, k: int):
    by_length: dict[int, list[int]] = {}
    for i, v in enumerate(asked.column("query").to_pylist()):
        by_length.setdefault(len(v), []).append(i)
    names = asked.column("query_id").combine_chunks()
    sides = {n: (names.take(pa.array(at)), np.array([asked.column("query")[i].as_py() for i in at], np.float64)) for n, at in by_length.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(1).value_lengths().to_numpy()
            for n, (own, q) in sides.items():
                part = batch.filter(pa.array(length == n))
                for at in range(0, part.num_rows, 1024):
                    rows = part.slice(at, 1024)
                    v = rows.column(1).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, n)
                    docs = rows.column(0)
                    code = pa.concat_arrays([own.cast(docs.type), docs]).dictionary_encode().indices.fill_null(-1).to_numpy()
                    score = q @ v.T
                    real = (code[: len(own), None] != code[None, len(own) :]) & ~np.isnan(score)
                    yield best_of(own, docs, score, real, k)

    return run


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.65, "High").when(score >= 0.40, "Medium").otherwise("Low")


def fuse(rankings: list[DataFrame], k: int = SHORTLIST) -> DataFrame:
    """(query_id, doc, rrf, rank): reciprocal rank fusion of rankings (query_id, doc, rank)."""
    every = None
    for r in rankings:
        part = r.select("query_id", "doc", (F.lit(1.0).cast("double") / (F.lit(FUSE) + F.col("rank"))).alias("r"))
        every = part if every is None else every.unionByName(part)
    return top(every.groupBy("query_id", "doc").agg(F.round(F.sum("r"), 9).alias("rrf")), k, score="rrf")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def calibrated(kind: str, value: Column, rankings: int = 2) -> Column:
    """A score from 0 to 1 without a cross-encoder: kind fused (of so many rankings), lexical or dense."""
    if kind == "fused":
        return sigmoid(12.0 * (F.least(value / F.lit(rankings / (FUSE + 1.0)), F.lit(1.0)) - 0.55))
    return sigmoid(4.0 * (value / 14.0 - 1.0)) if kind == "lexical" else sigmoid(12.0 * (value - 0.81))


def order_candidates(c: DataFrame, by: str = "query_id") -> DataFrame:
    """Adds place: order by voltage, material, role and status verdicts together, then by score."""
    rank = lambda col, names, default: F.coalesce(*[F.when(F.col(col) == n, F.lit(i)) for i, n in enumerate(names)], F.lit(default))
    keys = [rank("voltage", ["in_band", "not_declared", "out_of_band"], 1), rank("material", ["match", "not_declared", "different_material"], 1), rank("role", ["match", "wrong_kind"], 0), rank("status", ["Current", "Superseded", "Withdrawn"], 0)]
    return c.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*keys, F.desc("score"), "doc")))


def gate(candidates: DataFrame, score: str = "score", place: str = "rank", queries: DataFrame | None = None) -> DataFrame:
    """(query_id, doc, score, gap, decision, reason) from each query's first two candidates.

    Reasons to abstain: no_close_match (the best score is low), ambiguous (the second is close behind), voltage_unspecified
    (the first two are parts of one standard for different voltages, nearly equal, and the query states none), and
    no_candidates (a row of `queries` without any). The voltage is judged where candidates have is_base, title and
    stated (the query's voltage); a query without candidates is reported where `queries` (query_id) is given.
    """
    w = Window.partitionBy("query_id").orderBy(place)
    second = lambda c: F.lead(c).over(w)
    c = candidates.withColumn("gap", F.round(F.col(score) - F.coalesce(second(score), F.lit(0.0)), 6))
    split = F.lit(False)
    if {"is_base", "title", "stated"} <= set(candidates.columns):
        c = c.withColumns({"_next": second("is_base"), "_band": voltage_band(F.col("title"))})
        c = c.withColumn("_other", second("_band"))
        split = F.col("stated").isNull() & (F.col("_next") == F.col("is_base")) & (F.abs("gap") < MARGIN) & F.col("_band").isNotNull() & (F.col("_band") != F.col("_other"))
    low, near = F.col(score) < ACCEPT, (F.col(score) < CLEAR) & (F.col("gap") < MARGIN)
    reason = F.when(low, "no_close_match").when(near, "ambiguous").when(F.coalesce(split, F.lit(False)), "voltage_unspecified").otherwise("clear_match")
    c = c.withColumn("reason", reason).where(F.col(place) == 1).select("query_id", "doc", score, "gap", "reason")
    if queries is not None:
        c = queries.select("query_id").distinct().join(c, "query_id", "left").fillna("no_candidates", ["reason"])
    return c.select("query_id", "doc", score, "gap", F.when(F.col("reason") == "clear_match", "recommend").otherwise("abstain").alias("decision"), "reason")


def expand_by_graph(shortlist: DataFrame, edges: DataFrame, hits: int = 3, neighbours: int = 5) -> DataFrame:
    """(query_id, doc, via, n_co): the strongest neighbours of the first hits that the shortlist doesn't hold, each once."""
    start = shortlist.where(F.col("rank") <= hits)
    w = Window.partitionBy("query_id", "src").orderBy(F.desc("n_co"), "dst")
    near = start.join(edges, start.doc == edges.src).withColumn("n", F.row_number().over(w)).where(F.col("n") <= neighbours)
    near = near.select("query_id", F.col("dst").alias("doc"), F.col("src").alias("via"), "n_co", "rank")
    near = near.join(shortlist.select("query_id", "doc"), ["query_id", "doc"], "left_anti")
    first = Window.partitionBy("query_id", "doc").orderBy("rank", "via")
    return near.withColumn("n", F.row_number().over(first)).where("n = 1").select("query_id", "doc", "via", "n_co")


def peer_group(scored: DataFrame) -> DataFrame:
    """(query_id, doc, rank, peers): the documents most like a query, from a BM25 result of PEER_DOCUMENTS or more.

    Those with at least PEER_SHARE of the best score; queries with fewer than PEER_LEAST have no group."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    group = top(scored.where("score > 0"), PEER_DOCUMENTS).withColumn("best", best).where(F.col("score") >= PEER_SHARE * F.col("best"))
    group = group.withColumn("peers", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).where(F.col("peers") >= PEER_LEAST)
    return group.select("query_id", "doc", "rank", "peers")


def peers(scored: DataFrame, citations: DataFrame, limit: int = 12, dead: DataFrame | None = None) -> DataFrame:
    """(query_id, item, documents, share): what the documents most like a query cite (see peer_group), most cited first.

    citations has doc and item; items should be resolved, so that spellings of one are tallied together. With dead (item)
    dead items come first in the choice, and the result has dead.
    """
    tally = peer_group(scored).join(citations.select("doc", "item").distinct(), "doc").groupBy("query_id", "peers", "item").agg(F.count(F.lit(1)).alias("documents"))
    first: list[Column] = []
    if dead is not None:
        tally = tally.join(dead.select("item").distinct().withColumn("dead", F.lit(True)), "item", "left").fillna(False, ["dead"])
        first = [F.desc("dead")]
    w = Window.partitionBy("query_id").orderBy(*first, F.desc("documents"), "item")
    tally = tally.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    return tally.select("query_id", "item", "documents", F.round(F.col("documents") / F.col("peers"), 6).alias("share"), *(["dead"] if dead is not None else []))


def peer_report(scored: DataFrame, dead: DataFrame, docs: DataFrame, repeats: int = 8, buyers: int = 6, examples: int = 4) -> DataFrame:
    """(query_id, peers, repeating, repeats, buyers, examples) of each query with a peer group.

    repeats are the peers that cite most dead items, each with up to six of them; repeating is the number of all that cite
    any; buyers are the first by name; examples are the best matches' categories, of 110 characters at most.
    dead: doc, item (dead ones only); docs: doc, buyer, category.
    """
    g = peer_group(scored).join(docs.select("doc", "buyer", "category"), "doc", "left")
    bad = dead.select("doc", "item").distinct().groupBy("doc").agg(F.array_sort(F.collect_set("item")).alias("items"))
    g = g.join(bad, "doc", "left")
    row = F.struct((-F.size("items")).alias("order"), "rank", "doc", F.slice("items", 1, 6).alias("dead"))
    named = F.struct("rank", F.substring("category", 1, 110).alias("category"))
    out = g.groupBy("query_id", "peers").agg(  # PEER_DOCUMENTS rows of each query at most
        F.count("items").alias("repeating"),
        F.slice(F.array_sort(F.collect_list(F.when(F.col("items").isNotNull(), row))), 1, repeats).alias("r"),
        F.slice(F.array_sort(F.collect_set("buyer")), 1, buyers).alias("buyers"),
        F.slice(F.array_sort(F.collect_list(named)), 1, examples).alias("e"),
    )
    return out.select("query_id", "peers", "repeating", F.transform("r", lambda x: F.struct(x["doc"].alias("doc"), x["dead"].alias("dead"))).alias("repeats"), "buyers", F.transform("e", lambda x: x["category"]).alias("examples"))


#: Strategy name -> the rankings it fuses, whether graph neighbours are added, whether it is gated, and whether it needs a model
#: that is absent here. `run_strategy` runs the available ones.
STRATEGIES = {
    "bm25": {"rankings": ("bm25",), "graph": False, "gate": False, "available": True},
    "dense": {"rankings": ("dense",), "graph": False, "gate": False, "available": True},
    "hybrid_rrf": {"rankings": ("bm25", "dense"), "graph": False, "gate": True, "available": True},
    "graph_expand": {"rankings": ("bm25", "dense"), "graph": True, "gate": True, "available": True},
    "hybrid_ce": {"rankings": ("bm25", "dense"), "graph": False, "gate": True, "available": False},
    "llm_only": {"rankings": (), "graph": False, "gate": False, "available": False},
}


def run_strategy(name: str, rankings: dict[str, DataFrame], edges: DataFrame | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, doc, score, rank): the candidates of a registered strategy, with scores from 0 to 1.

    rankings: name -> (query_id, doc, score, rank) to DEPTH. Two rankings are fused to a shortlist; one is cut to it. With
    graph, neighbours of the first hits follow the shortlist with score 0. edges: src, dst, n_co. A reranker maps
    (query_id, doc, score) to itself with new scores; a strategy that needs one that isn't given is refused, not guessed.
    """
    s = STRATEGIES[name]
    if not s["available"] and rerank is None:
        raise ValueError(f"{name} needs a model that isn't here")
    used = [rankings[r] for r in s["rankings"]]
    if len(used) > 1:
        c = fuse([r.select("query_id", "doc", "rank") for r in used]).select("query_id", "doc", calibrated("fused", F.col("rrf"), len(used)).alias("score"), "rank")
    else:
        kind = "lexical" if s["rankings"] == ("bm25",) else "dense"
        c = used[0].where(F.col("rank") <= SHORTLIST).select("query_id", "doc", calibrated(kind, F.col("score")).alias("score"), "rank")
    if s["graph"] and edges is not None:
        near = expand_by_graph(c, edges).withColumn("score", F.lit(0.0))
        at = Window.partitionBy("query_id").orderBy(F.desc("n_co"), "doc")
        c = c.unionByName(near.select("query_id", "doc", "score", (F.lit(SHORTLIST) + F.row_number().over(at)).alias("rank")))
    if rerank is not None:
        c = top(rerank(c.select("query_id", "doc", "score")), SHORTLIST)
    return c.select("query_id", "doc", F.round("score", 6).alias("score"), "rank")
