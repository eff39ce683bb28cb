"""Incremental runs: file streams, windowed counts, keyed upserts, change detection, running decision counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import amendments
from ..sources.logs import valid_decision
from .sinks import BatchTable


def read_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", files: int = 16) -> DataFrame:
    """New files of a folder, a bounded number for each micro-batch."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files).load(folder)


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 day", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """(start, by, n, total) in windows of event time; rows later than the watermark are dropped. Works on batch and stream."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    g = e.groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), by, "n", "total")


def run_available(df: DataFrame, checkpoint: str, each, mode: str = "update") -> StreamingQuery:
    """Process what is there and stop: the periodic run. each(batch, batch_id) is called for every micro-batch."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def run_periodic(df: DataFrame, checkpoint: str, each, every: str = "6 hours", mode: str = "update") -> StreamingQuery:
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=every).foreachBatch(each).start()


def upsert_into(path: str, key: str):
    """A foreachBatch sink that keeps the newest row of each key in versions <path>/v=<batch>; a replay rewrites its version.
    A batch holds a key once. Batch 0 starts the state; a later batch fails if the version before it is gone, as going on
    without it would lose rows. Versions that no replay can need are deleted. Every batch writes the whole state, so this is for small
    ones; `state.newest` keeps large ones in place."""

    def each(batch: DataFrame, batch_id: int) -> None:
        new = batch
        if batch_id > 0:
            old = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/v={batch_id - 1}")
            new = old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)
        new.write.mode("overwrite").parquet(f"{path}/v={batch_id}")
        if batch_id > 1:
            old_path = batch.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v={batch_id - 2}")
            old_path.getFileSystem(batch.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(old_path, True)

    return each


def detect_amendments(register: DataFrame, diffs: str | BatchTable, apply=None):
    """A foreachBatch sink for portal records: differences are always reported; apply(diffs) runs only if given.

    They go to a BatchTable, or to JSON partitions <diffs>/batch=<n>. In both a replayed batch replaces its own rows; a table's readers
    see whole batches only, those of a folder may meet one that is being replaced.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        found = amendments(register, batch)
        if isinstance(diffs, str):
            found.write.mode("overwrite").json(f"{diffs}/batch={batch_id}")
            found = found.sparkSession.read.schema(found.schema).json(f"{diffs}/batch={batch_id}")
        else:
            diffs.write(found, batch_id)
        if apply is not None:
            apply(found.withColumn("batch", F.lit(batch_id)))

    return each


def running_decisions(log: DataFrame) -> DataFrame:
    """(decision, n) over the valid decisions so far."""
    return valid_decision(log).where("problem IS NULL").groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
