"""Keyed state of streams: the newest row of each key and how many it had, changed in place, with keys that fall idle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS, CHANGE = "n_rows", "change"


class Newest(StatefulProcessor):
    """State of a key: its newest row and the number of its rows; with an idle time, a timer that ends the key."""

    def __init__(self, key: str, names: list[str], schema: StructType, order: list[str], idle: int | None, ts: str | None):
        self.key, self.names, self.schema, self.order, self.idle, self.ts = key, names, schema, order, idle, ts

    def init(self, handle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", self.schema)

    def _rank(self, row) -> tuple:
        """Rows in the stated order; a null is before everything else."""
        return tuple((row[c] is not None, row[c]) if row[c] is not None else (False,) for c in self.order)

    def _ends(self, row) -> int:
        return row[self.ts] // 1000 + self.idle

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        from pyspark.sql import Row

        names, held = self.names, self.held.get() if self.held.exists() else None
        best, n, new = (dict(zip(names, held[:-1])), held[-1], False) if held else (None, 0, False)
        was = self._ends(best) if self.idle is not None and best is not None else None
        for r in rows:
            row = {c: r[c] for c in names}
            n += r["_n"]
            if best is None or self._rank(row) > self._rank(best):
                best, new = row, True
        self.held.update((*[best[c] for c in names], n))
        if self.idle is not None and new:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(self._ends(best))
        change = "insert" if held is None else "update" if new else "repeat"
        yield Row(**best, **{ROWS: n, CHANGE: change})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        from pyspark.sql import Row

        held = self.held.get()
        self.held.clear()
        yield Row(**dict(zip(self.names, held[:-1])), **{ROWS: held[-1], CHANGE: "idle"})

    def close(self) -> None:
        pass


def _combined(key: int, order: list[int]):
    """A function over batches that leaves each key's newest row in a batch, with the number of its rows as a last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = [(batch.schema.names[i], "ascending") for i in order]
            rows = pa.Table.from_batches([batch])
            rows = rows.take(pc.sort_indices(rows, sort_keys=by, null_placement="at_start")).combine_chunks()
            code = rows.column(key).combine_chunks().dictionary_encode().indices.to_numpy()
            last = np.zeros(code.max(initial=-1) + 1, np.int64)
            last[code] = np.arange(len(code))
            kept = rows.take(pa.array(last))
            yield from kept.append_column("_n", pa.array(np.bincount(code, minlength=len(last)), pa.int64())).to_batches()

    return run


def newest(stream: DataFrame, key: str, order: list[str], idle: str | None = None, ts: str | None = None) -> DataFrame:
    """The changes of the newest row of each key: stream's columns, n_rows (the key's rows so far) and change.

    A micro-batch gives one row of each key in it: change is insert for a key without state, update where its newest row changed, else
    repeat. The newest is the last in the order of the `order` columns, nulls first; of equal rows the one seen first. Only the keys
    of a batch are read and written: the rest of the state stays where it is, in a RocksDB store on the executors that the
    checkpoint keeps, and a restart goes on from it. With `idle` ("30 minutes") and an event time column `ts` that has a
    watermark, a key whose newest row is older than the watermark by that much gives a last row with change idle, and its state goes; it
    begins anew if rows come later. Rows without key are left out.

    Before the shuffle each Arrow batch is reduced to one row of a key, so a frequent key sends few rows to its task; there they are folded
    one after another, never held together.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    if (idle is None) != (ts is None):
        raise ValueError("idle and ts go together")
    # time stamps are microseconds in the state, which every part of Spark and Python reads alike
    fields, times = stream.schema.fields, {f.name for f in stream.schema.fields if isinstance(f.dataType, TimestampType)}
    plain = [StructField(f.name, LongType() if f.name in times else f.dataType) for f in fields]
    state, names = StructType([*plain, StructField(ROWS, LongType())]), [f.name for f in fields]
    out = StructType([*state.fields, StructField(CHANGE, StringType())])
    length = int(spark.sql(f"SELECT unix_millis(timestamp '1970-01-01 00:00:00Z' + INTERVAL {idle}) AS n").first()["n"]) if idle else None
    rows = stream.where(F.col(key).isNotNull())
    if ts is not None:
        rows = rows.where(F.col(ts).isNotNull())
    rows = rows.select(*[F.unix_micros(c).alias(c) if c in times else c for c in names])
    rows = rows.mapInArrow(_combined(names.index(key), [names.index(c) for c in order]), StructType([*plain, StructField("_n", LongType())]))
    changes = rows.groupBy(key).transformWithState(Newest(key, names, state, order, length, ts), out, "Update", "EventTime" if idle else "None")
    return changes.select(*[F.timestamp_micros(c).alias(c) if c in times else c for c in names], ROWS, CHANGE)


def current(changes: DataFrame, key: str) -> DataFrame:
    """What a table of changes (see `newest`, with `batch`) comes to: each key's row of the last batch that has it, idle keys left out."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*changes.columns), F.struct("batch", F.col(CHANGE) != "idle")).alias("r"))
    return last.select("r.*").where(F.col(CHANGE) != "idle")
