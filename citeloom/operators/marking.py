"""Marks around every registered designation in texts: an automaton of their forms finds candidates, a join keeps the registered ones."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Patterns that one automaton takes; they are sent to all tasks, some 100 bytes each.
PATTERNS = 1_000_000
_FORM = str.maketrans("123456789", "000000000")
_built: dict[int, tuple[list[str], object]] = {}


def automaton(patterns: list[str]):
    """An Aho-Corasick automaton over the patterns, built once in a worker."""
    import ahocorasick

    key = hash(tuple(patterns))
    if key not in _built or _built[key][0] != patterns:
        _built.clear()
        made = ahocorasick.Automaton()
        for p in patterns:
            made.add_word(p, len(p))
        made.make_automaton()
        _built[key] = (patterns, made)
    return _built[key][1]


def places(made, text: str) -> list[tuple[int, int]]:
    """(start, end) of the designations in a text: from the left, the longest that begins at a place, none inside another.

    The automaton gives all matches by their ends in one pass over the text; of each beginning only the longest is held.
    """
    return chosen((last + 1 - n, last + 1) for last, n in made.iter(text))


def chosen(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of (start, end) in any order, the longest of each start, from the left, none inside another."""
    longest: dict[int, int] = {}
    for start, end in spans:
        if end > longest.get(start, -1):
            longest[start] = end
    out, free = [], 0
    for start in sorted(longest):
        if start >= free:
            free = longest[start]
            out.append((start, free))
    return out


def _candidates(forms: list[str]):
    """A function over a task's rows (row, text) that yields the places whose form is one of the forms, with what stands there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = automaton(forms)
        for batch in batches:
            rows, starts, names = [], [], []
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for last, n in made.iter(value.translate(_FORM)):
                    rows.append(row)
                    starts.append(last + 1 - n)
                    names.append(value[last + 1 - n : last + 1])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(starts, pa.int32()), pa.array(names, pa.string())], ["row", "start", "name"])

    return run


def marked(docs: DataFrame, designations: DataFrame, text: str = "text", designation: str = "designation", before: str = "[", after: str = "]") -> DataFrame:
    """docs with marked, the text with every designation between marks, and found, how many are.

    Where one designation is the beginning of another, the longer one is marked. A null text stays null, empty designations are ignored.

    A register may be of any size: only the forms of its designations, their digits made zeros, go to the tasks, PATTERNS at once. One pass
    over a text finds the places of all forms; what stands there is joined with the designations, and each text gets its own places back.
    docs are written once, so that a row keeps its number.
    """
    steps = Scratch(docs.sparkSession, "marks")
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    kept = [c for c in docs.columns if c.lower() not in ("marked", "found")]
    known = designations.select(F.col(designation).alias("name")).where("name <> ''").distinct()
    forms = steps.keep(known.select(F.regexp_replace("name", "[1-9]", "0").alias("form")).distinct(), "forms")
    texts = steps.keep(docs.select(*[quoted(c) for c in kept], F.monotonically_increasing_id().alias("_row")), "texts")
    parts, near = max(1, -(-forms.count() // PATTERNS)), None
    for i in range(parts):
        own = [r["form"] for r in forms.where(F.pmod(F.xxhash64("form"), F.lit(parts)) == i).toLocalIterator()]
        if own:
            part = texts.where(F.col(text) != "").select("_row", quoted(text)).mapInArrow(_candidates(own), "row bigint, start int, name string")
            near = part if near is None else near.unionByName(part)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in texts.drop("_row").schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(kept)
            out, counts = [], []
            for value, spans in zip(own.column(kept.index(text)).to_pylist(), batch.column(len(kept)).to_pylist()):
                spans, pieces, at = chosen((s["start"], s["end"]) for s in spans or ()), [], 0
                for a, b in spans:
                    pieces += [value[at:a], before, value[a:b], after]
                    at = b
                out.append(None if value is None else "".join(pieces) + value[at:])
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(out, pa.string()), pa.array(counts, pa.int64())], [*kept, "marked", "found"])

    if near is None:
        return texts.select(*[quoted(c) for c in kept], quoted(text).alias("marked"), F.lit(0).cast("bigint").alias("found"))
    # a text's own places
    spans = near.join(known, "name", "left_semi").groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("start", (F.col("start") + F.length("name")).alias("end"))).alias("_spans"))
    return texts.join(spans, "_row", "left").select(*[quoted(c) for c in kept], "_spans").mapInArrow(run, f"{fields}, marked string, found bigint")
