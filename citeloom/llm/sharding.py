"""Sharding by size-tiered compaction under a versioned manifest."""

from __future__ import annotations

import json
import math
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Files of one tier that start a merge, size of the smallest tier, size a merged file aims at, merges in one job.
FAN_IN, SMALLEST, TARGET, AT_ONCE = 4, 1 << 20, 64 << 20, 64
#: Seconds after which a writer that hasn't committed counts as dead.
ABANDONED = 24 * 3600
#: Stores whose rename copies and can replace, so two writers could both commit one version.
UNSAFE = frozenset("s3 s3a s3n gs oss cos cosn obs swift wasb wasbs".split())


@dataclass(frozen=True)
class Shard:
    path: str
    size: int


def united(a: StructType | None, b: StructType) -> StructType:
    """The columns of a and then those of b that a lacks, all nullable. Columns of one name must have one type and be spelled alike."""
    fields = {f.name.lower(): f for f in (a.fields if a else [])}
    for f in b.fields:
        held = fields.setdefault(f.name.lower(), f)
        if held.name != f.name or held.dataType.simpleString() != f.dataType.simpleString():
            raise ValueError(f"the store has {held.name} {held.dataType.simpleString()}, the rows have {f.name} {f.dataType.simpleString()}")
    return StructType([StructField(f.name, f.dataType, True) for f in fields.values()])


class ShardStore:
    """Immutable Parquet shards under a folder, and manifests v00000001.json, v00000002.json ... that list the live ones.

    A version is committed by renaming a complete temporary file to the next number, which fails if that number exists;
    the loser reads the newer version and tries again. Readers see whole versions only. A writer marks its folder as
    pending before it writes, renews the mark while it does and drops it after its commit, so `vacuum` leaves the files of one at work
    alone; those of a job that died go once its mark wasn't renewed for ABANDONED seconds. A writer whose mark is gone (it was cut
    off for so long) can't commit. Manifests hold the union of the columns of all that was appended; rows from before a column
    came have nulls there, and rows whose columns clash with the store's are refused. The folder must be one that all executors share, on a
    file system whose rename is atomic; stores known for another are refused.
    """

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fan_in: int = FAN_IN, smallest: int = SMALLEST):
        self.spark, self.root, self.target, self.fan_in, self.smallest = spark, root.rstrip("/"), target, fan_in, smallest
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if self._fs.getScheme() in UNSAFE:
            raise ValueError(f"{self._fs.getScheme()} has no atomic rename, which commits need")
        for folder in ("manifests", "pending", "shards"):
            self._fs.mkdirs(self._path(f"{self.root}/{folder}"))

    def _path(self, x: str):
        return self._jvm.org.apache.hadoop.fs.Path(x)

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max([int(n[1:-5]) for n in names if n.startswith("v")], default=0)

    def shards(self, version: int | None = None) -> list[Shard]:
        return [Shard(**s) for s in self._manifest(self.version() if version is None else version)["shards"]]

    def schema(self, version: int | None = None) -> StructType | None:
        """The union of the columns of all appended rows; None before the first."""
        manifest = self._manifest(self.version() if version is None else version)
        if "schema" in manifest:
            return StructType.fromJson(manifest["schema"]) if manifest["schema"] else None
        paths = [s["path"] for s in manifest["shards"]]  # a manifest from before schemas were kept
        return self.spark.read.option("mergeSchema", True).parquet(*paths).schema if paths else None

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"shards": [], "schema": None}
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:08d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def commit(self, added: list[Shard], removed: list[Shard] = (), schema: StructType | None = None) -> int:
        """The number of a new version: the newest with `removed` replaced by `added`, its columns with those of schema. Fails if one of
        the removed is gone, if vacuum has taken the added for abandoned, or if the columns clash."""
        while True:
            version = self.version()
            live, columns = self.shards(version), self.schema(version)
            if schema is not None:
                columns = united(columns, schema)
            for folder in {s.path.rsplit("/", 2)[-2] for s in added if "/" in s.path}:
                if not self._fs.exists(self._path(f"{self.root}/pending/{folder}")):
                    raise RuntimeError(f"the files of {folder} were taken for abandoned")
            if missing := set(removed) - set(live):
                raise RuntimeError(f"another commit has removed {len(missing)} of the merged shards")
            live = [s for s in live if s not in set(removed)] + list(added)
            draft = self._path(f"{self.root}/manifests/draft-{uuid.uuid4().hex}")
            out = self._fs.create(draft)
            out.write(bytearray(json.dumps({"version": version + 1, "schema": columns and columns.jsonValue(), "shards": [asdict(s) for s in live]}).encode()))
            out.close()
            final = self._path(f"{self.root}/manifests/v{version + 1:08d}.json")
            if not self._fs.exists(final) and self._fs.rename(draft, final):
                for folder in {s.path.rsplit("/", 2)[-2] for s in added if "/" in s.path}:
                    self._fs.delete(self._path(f"{self.root}/pending/{folder}"), False)
                return version + 1
            self._fs.delete(draft, False)

    def _written(self, df: DataFrame, rows: int | None = None, name: str | None = None) -> list[Shard]:
        """The files of df, one for each of its partitions and `rows` rows, in a folder of its own."""
        folder = f"{self.root}/shards/{name or uuid.uuid4().hex}"
        writer = df.write.option("compression", "zstd")
        (writer.option("maxRecordsPerFile", rows) if rows else writer).parquet(folder)
        files = [s for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("part-")]
        return sorted((Shard(s.getPath().toString(), int(s.getLen())) for s in files), key=lambda s: s.path)

    def _marked(self, df: DataFrame, rows: int | None = None) -> list[Shard]:
        """The same in a folder that is marked as pending before anything is written; the commit drops the mark."""
        name = uuid.uuid4().hex
        with self._renewed(name):
            return self._written(df, rows, name)

    @contextmanager
    def _renewed(self, name: str) -> Iterator[None]:
        """A pending mark whose time is renewed as long as the block runs; it stays afterwards."""
        mark, done = self._path(f"{self.root}/pending/{name}"), threading.Event()
        self._fs.create(mark).close()

        def renew() -> None:
            while not done.wait(max(0.05, ABANDONED / 10)):
                if self._fs.exists(mark):  # never made anew: without it the files may be gone
                    self._fs.setTimes(mark, int(self._jvm.java.lang.System.currentTimeMillis()), -1)

        thread = threading.Thread(target=renew, daemon=True)
        thread.start()
        try:
            yield
        finally:
            done.set()
            thread.join()

    def append(self, docs: DataFrame) -> int:
        """Write an arrival as small shards, one for each of its partitions, without a shuffle, and commit them. Rows whose columns clash with
        the store's are refused before anything is written."""
        united(self.schema(), docs.schema)
        return self.commit(self._marked(docs), schema=docs.schema)

    def tier(self, size: int) -> int:
        """Shards of a tier differ in size by less than the fan-in."""
        return 0 if size <= self.smallest else 1 + int(math.log(size / self.smallest, self.fan_in))

    def plan(self) -> list[list[Shard]]:
        """Runs of shards of one tier to merge: tiers with fan-in or more shards under the target size, packed in order up to it."""
        tiers: dict[int, list[Shard]] = {}
        for s in self.shards():
            if s.size < self.target / 2:
                tiers.setdefault(self.tier(s.size), []).append(s)
        runs = []
        for _, members in sorted(tiers.items()):
            if len(members) < self.fan_in:
                continue
            run, size = [], 0
            for s in members:
                if run and size + s.size > self.target:
                    runs.append(run)
                    run, size = [], 0
                run.append(s)
                size += s.size
            runs.append(run)
        return [r for r in runs if len(r) > 1]

    def split(self) -> int:
        """Cut shards of more than twice the target into files of about the target, in place and without a shuffle: rows of one
        are dealt by its average row. Repeats until none is left but single rows of that size. Returns the version."""
        done: set[Shard] = set()
        while large := [s for s in self.shards() if s.size > 2 * self.target and s not in done]:
            for s in large:
                df = self.spark.read.parquet(s.path)
                rows = df.count()  # from the file's footer
                if rows > 1:
                    self.commit(self._marked(df, max(1, rows * self.target // s.size)), [s])
                else:
                    done.add(s)
        return self.version()

    def compact(self) -> int:
        """Cut what is too large, and merge until no tier holds a run; each round of merges is one commit. Returns the version.

        A merge is one task that reads its shards and writes one file, so rows are moved once and never shuffled, and a
        lost executor repeats only its own merges. The merges of a round run beside each other.
        """
        self.split()
        while runs := self.plan():
            schema = self.schema()
            for k in range(0, len(runs), AT_ONCE):
                part = runs[k : k + AT_ONCE]
                merged = None
                for run in part:
                    one = self.spark.read.schema(schema).parquet(*[s.path for s in run]).coalesce(1)
                    merged = one if merged is None else merged.union(one)
                self.commit(self._marked(merged), [s for run in part for s in run])
        return self.version()

    def read(self, version: int | None = None, schema=None) -> DataFrame | None:
        """The rows of a version, with the columns of all that was appended unless told otherwise, shard (file name) and shard_row (place in the
        file); None if it has no shards."""
        version = self.version() if version is None else version
        live = self.shards(version)
        if not live:
            return None
        return self.spark.read.schema(schema if schema is not None else self.schema(version)).parquet(*[s.path for s in live]).select("*", F.col("_metadata.file_name").alias("shard"), F.col("_metadata.row_index").alias("shard_row"))

    def vacuum(self, keep: int = 1) -> int:
        """Delete files that none of the newest `keep` versions lists and that no writer owns. Older versions can't be read
        afterwards. Returns the number of files.

        Pending marks and files are listed before the manifests are read: a writer whose mark is gone by then has committed,
        so its files are in the manifest that is read.
        """
        now = int(self._jvm.java.lang.System.currentTimeMillis())
        at_work = set()
        for s in self._fs.listStatus(self._path(f"{self.root}/pending")):
            if now - s.getModificationTime() < 1000 * ABANDONED:
                at_work.add(s.getPath().getName())
            else:
                self._fs.delete(s.getPath(), False)  # before its files, so that its writer can't commit them
        files = [f.getPath() for folder in self._fs.listStatus(self._path(f"{self.root}/shards")) if folder.getPath().getName() not in at_work for f in self._fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-")]
        newest = self.version()
        live = {s.path for v in range(max(1, newest - keep + 1), newest + 1) for s in self.shards(v)}
        return sum(bool(self._fs.delete(f, False)) for f in files if f.toString() not in live)


def shard(docs: DataFrame, root: str, target: int = TARGET, keep: int | None = None) -> DataFrame:
    """Append docs to the store at root, compact it, and return the live rows with shard and shard_row.

    Every row of docs is in exactly one shard: nulls, empty and very long texts, repeated rows and columns of any name are
    stored as they are (columns named shard or shard_row are left out, as the result has its own). An empty table gives
    a version without rows. With keep, files of versions before the newest `keep` are dropped; else all stay readable.
    """
    docs = docs.drop("shard", "shard_row")
    store = ShardStore(docs.sparkSession, root, target)
    store.append(docs)
    store.compact()
    if keep is not None:
        store.vacuum(keep)
    rows = store.read(schema=docs.schema)
    if rows is None:
        rows = docs.sparkSession.createDataFrame([], docs.schema).withColumns({"shard": F.lit("").cast("string"), "shard_row": F.lit(0).cast("long")})
    return rows
