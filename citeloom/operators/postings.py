"""Term counts of documents, restricted to the terms that queries ask for: what ranked search reads instead of the texts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct terms that travel to the tasks at once, some 100 bytes each; a caller with more counts in rounds.
TERMS = 2_000_000
#: Words that a task tallies before it hands the tally on, and texts whose counts it holds at once.
TALLY, STEP = 200_000, 256


def counted(docs: DataFrame, vocabulary: list, words: Callable[[bytes], list], doc_id: str = "doc_id", text: str = "text", tallied: bool = False) -> DataFrame:
    """(doc, n, terms, tfs): a row of each row of docs; n counts all its words, terms are the places in `vocabulary` of those it
    asks for, ascending, tfs how often each occurs.

    words turns UTF-8 bytes into words; a null text has none. The texts are read once, in place, and nothing is shuffled. The
    vocabulary must be bounded by the caller (see TERMS). With `tallied` there are also word and held: rows whose terms are null
    hold up to TALLY of all words of a task's documents and how many of them hold each, to be summed by `tallies`.
    """
    known = {t: i for i, t in enumerate(vocabulary)}
    names = ["doc", "n", "terms", "tfs", *(["word", "held"] if tallied else [])]
    doc_kind = docs.schema[doc_id].dataType.simpleString()

    def tally(seen: Counter, kind: pa.DataType) -> pa.RecordBatch:
        words_of = [w.decode("utf-8", "replace") if isinstance(w, bytes) else w for w in seen]
        lists = lambda x, t: pa.array([x], pa.list_(t))
        row = [pa.nulls(1, kind), pa.array([0], pa.int64()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())), lists(words_of, pa.string()), lists(list(seen.values()), pa.int64())]
        seen.clear()
        return pa.RecordBatch.from_arrays(row, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, seen, kind = known.get, Counter(), None
        for batch in (b.slice(at, STEP) for b in batches for at in range(0, b.num_rows, STEP)):
            kind = batch.schema.field(0).type
            n, ids, tfs = np.zeros(batch.num_rows, np.int64), [], []
            for i, value in enumerate(batch.column(1)):
                found = words(value.as_py() or b"")
                n[i] = len(found)
                if tallied:
                    seen.update(set(found))
                one, tf = np.unique(np.array([x for x in map(get, found) if x is not None], np.int32), return_counts=True)
                ids.append(one)
                tfs.append(tf)
            at = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in ids]))), pa.int32())
            joined = [pa.array(np.concatenate(x) if x else np.zeros(0), pa.int32()) for x in (ids, tfs)]
            rows = [batch.column(0), pa.array(n), *[pa.ListArray.from_arrays(at, x) for x in joined]]
            if tallied:
                rows += [pa.nulls(batch.num_rows, pa.list_(pa.string())), pa.nulls(batch.num_rows, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(rows, names)
            if len(seen) > TALLY:
                yield tally(seen, kind)
        if seen:
            yield tally(seen, kind)

    schema = f"doc {doc_kind}, n bigint, terms array<int>, tfs array<int>" + (", word array<string>, held array<bigint>" if tallied else "")
    return docs.select(F.col(doc_id).alias("doc"), F.col(text).cast("binary")).mapInArrow(run, schema)


def tallies(counts: DataFrame) -> DataFrame:
    """(word, df): in how many documents each word of `counted(tallied=True)` occurs."""
    each = counts.where("terms IS NULL").select(F.explode(F.arrays_zip("word", "held")).alias("w"))
    return each.groupBy(F.col("w.word").alias("word")).agg(F.sum("w.held").alias("df"))


def frequencies(counts: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term of a vocabulary of `size` terms: partial counts in the tasks, one row of a term to the driver."""
    found = counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[found.column("t").to_numpy()] = found.column("df").to_numpy()
    return df


class Segment:
    """Documents of one task in the order of `by`, their ids unless told otherwise, and their postings by term.

    doc and tf are the postings of all terms one after another, a term's in the order of the documents; of(t) is a term's part.
    """

    def __init__(self, batches: list[pa.RecordBatch], by: tuple[str, ...] = ("doc",)):
        rows = pa.Table.from_batches(batches).combine_chunks()
        order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in by], null_placement="at_end")
        rows = rows.take(order)
        self.ids, self.n = rows.column("doc").combine_chunks(), rows.column("n").to_numpy()
        terms, tfs = (rows.column(c).combine_chunks() for c in ("terms", "tfs"))
        doc = np.repeat(np.arange(rows.num_rows, dtype=np.int32), terms.value_lengths().to_numpy())
        term = terms.flatten().to_numpy()
        by = np.argsort(term, kind="stable")
        self.term, self.doc, self.tf = term[by], doc[by], tfs.flatten().to_numpy()[by]
        self.starts = np.append(np.flatnonzero(np.diff(self.term, prepend=-1)), len(self.term))
        self.place = {int(t): i for i, t in enumerate(self.term[self.starts[:-1]])}

    def of(self, term: int) -> slice:
        """Where a term's postings stand; the term must be in `place`."""
        i = self.place[term]
        return slice(self.starts[i], self.starts[i + 1])


def segments(batches: Iterator[pa.RecordBatch], most: int, by: tuple[str, ...] = ("doc",)) -> Iterator[Segment]:
    """A task's rows of `counted` in segments of about `most` postings, so that memory doesn't grow with its share of the table."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            held.append(part)
            size += len(part.column(2).flatten())
            if size >= most:
                yield Segment(held, by)
                held, size = [], 0
    if held:
        yield Segment(held, by)
