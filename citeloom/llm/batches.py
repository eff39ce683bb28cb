"""Small helpers for functions that run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most text bytes that one step of a vectorised function takes in; one longer text is taken alone.
STEP_BYTES = 8 << 20


def quoted(name: str) -> str:
    """A column name as SQL takes it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def columns(names: list[str]) -> list[Column]:
    return [F.col(quoted(c)) for c in names]


def add_columns(df: DataFrame, keep: list[str], used: list[str | Column], function: Callable[..., list[pa.Array]], added: str) -> DataFrame:
    """The columns `keep` of df, and `added` (name type, ...), which function makes of a batch's `used` columns, row by row.

    `used` names kept columns, or gives others as Columns. Columns travel under names of their own, so df's may be any.
    """
    names, new = [f"c{i}" for i in range(len(keep))], [x.split()[0] for x in added.split(", ")]
    extra = [u for u in used if isinstance(u, Column)]
    rows = df.select(*[c.alias(x) for c, x in zip(columns(keep), names)], *[u.alias(f"u{i}") for i, u in enumerate(extra)])
    places, at = [], len(keep)
    for u in used:
        places.append(keep.index(u) if isinstance(u, str) else at)
        at += not isinstance(u, str)
    kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = function(*[batch.column(i) for i in places])
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *made], [*names, *new])

    schema = ", ".join([f"{x} {df.schema[c].dataType.simpleString()}" for x, c in zip(names, keep)] + [added])
    return rows.mapInArrow(run, schema).select(*[F.col(x).alias(c) for x, c in zip(names, keep)], *new)


def as_bytes(column: pa.Array) -> list[bytes]:
    """Values of a binary column; null becomes empty."""
    return [x or b"" for x in column.to_pylist()]


def steps(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose binary column holds about STEP_BYTES each."""
    if not batch.num_rows:
        return
    values = batch.column(column)
    sizes = np.diff(np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1]) if pa.types.is_binary(values.type) else np.array([len(x or b"") for x in values.to_pylist()])
    group = np.cumsum(sizes.astype(np.int64)) // STEP_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole runs of equal keys, many runs to a table, from batches that come sorted by those keys.

    A table ends where a run ends; only a run that spans batches is held back, so memory is a batch plus the longest run.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        last = batch.num_rows - 1
        same = np.ones(batch.num_rows, bool)
        for c in columns:
            same &= c == c[last]
        cut = last + 1 - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            head = pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
            yield head
        elif held and any(held[-1].column(k)[held[-1].num_rows - 1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which the runs of equal keys in a sorted table begin, and its length."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)
