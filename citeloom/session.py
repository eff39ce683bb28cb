"""Session helpers: the shared folder for lineage cuts, and table readers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or the checkpoint folder that was set on the context.

    Without either a temporary folder is used where the driver is the only executor (local mode, as in tests); on a cluster it
    is an error, as other machines don't see this one's folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        defined = spark.sparkContext._jsc.sc().getCheckpointDir()
        if defined.isDefined():
            folder = defined.get()
        elif spark.sparkContext._jsc.sc().isLocal():
            folder = "file://" + tempfile.mkdtemp(prefix="citeloom-")
            spark.sparkContext.setCheckpointDir(folder)
        else:
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    return folder.rstrip("/")


class Scratch:
    """Written tables in the shared folder: they cut lineage, survive lost executors, and can be dropped when superseded."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        self.n = 0
        _roots[self.root] = self

    def write(self, df: DataFrame, name: str = "t") -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        return self.write(df, name)[0]

    def drop(self, path: str | None = None) -> None:
        """Delete a written table, or all of them."""
        path = path or self.root
        _roots.pop(path, None)
        jvm = self.spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


_roots: dict[str, Scratch] = {}


def drop_scratch() -> None:
    """Delete all scratch tables of this process; results that were not written elsewhere can't be read afterwards."""
    for root, scratch in list(_roots.items()):
        try:
            scratch.drop(root)
        except Exception:  # the session is gone: its folder is left to whoever owns the shared one
            _roots.pop(root, None)


atexit.register(drop_scratch)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt to as many tasks as there are cores if it comes from fewer files, else df as it is. For work that is heavy by the row: a small
    table in one file would be one task. A table of many files, which is any large one, isn't shuffled."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *by) if 0 < len(df._jdf.inputFiles()) < n else df


def dealt_to(df: DataFrame, each: int) -> int:
    """How many tasks df's rows make, counted, at `each` rows a task, as many as there are cores at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
