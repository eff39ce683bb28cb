"""A sink for micro-batches that may be replayed: every batch is a folder of its own, and a commit names the one that counts."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class BatchTable:
    """A table of micro-batches under a folder: data/batch=<n>/<attempt>, and commits/<n>.json that name a batch's live attempt.

    A batch is written to a folder that no other attempt uses and committed by renaming its note over the one of an earlier attempt, so a
    replayed batch replaces its rows, a failed attempt leaves nothing that is read, and readers see whole batches. Rows get `batch`.
    The folder's file system must replace a file by rename at once, as HDFS and local ones do.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        for folder in ("data", "commits"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))

    def _path(self, x: str):
        return self._jvm.org.apache.hadoop.fs.Path(x)

    def _read(self, path) -> dict:
        stream = self._fs.open(path)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def live(self) -> dict[int, str]:
        """The folder of each committed batch."""
        notes = [s.getPath() for s in self._fs.listStatus(self._path(f"{self.root}/commits"))]
        return {int(p.getName()[:-5]): self._read(p)["folder"] for p in notes if p.getName().endswith(".json")}

    def write(self, rows: DataFrame, batch: int) -> None:
        """Replace a batch by these rows."""
        before = self._path(f"{self.root}/commits/{batch}.json")
        old = self._read(before)["folder"] if self._fs.exists(before) else None
        folder = f"data/batch={batch}/{uuid.uuid4().hex}"
        rows.drop("batch").write.parquet(f"{self.root}/{folder}")
        draft = self._path(f"{self.root}/commits/{batch}.{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps({"folder": folder}).encode()))
        out.close()
        options = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(options, 1)
        how[0] = options.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf).rename(self._fs.makeQualified(draft), self._fs.makeQualified(before), how)
        if old:
            self._fs.delete(self._path(f"{self.root}/{old}"), True)

    def read(self, schema: StructType | str) -> DataFrame:
        """The rows of all committed batches with `batch`; schema is theirs, without it."""
        live = self.live()
        if not live:
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(0).cast("long"))
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*[f"{self.root}/{f}" for _, f in sorted(live.items())])
        if "batch" not in rows.columns:
            rows = rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), "/batch=([0-9]+)/", 1))
        return rows.withColumn("batch", F.col("batch").cast("long"))

    def each(self):
        """The table as a foreachBatch function."""
        return self.write
