"""Places for models that are not here: encoders and recognisers are given as functions and run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def embedded(texts: DataFrame, encode: Callable[[list[str]], np.ndarray], key: str = "doc", text: str = "text", batch: int = 256) -> DataFrame:
    """(key, embedding): unit vectors that `encode` makes of lists of texts; null for an empty text or a zero vector.

    The function goes to the tasks; what it loads it should load there once. Vectors are single precision.
    """
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                said = [t or "" for t in part.column(1).to_pylist()]
                full = [i for i, t in enumerate(said) if t.strip()]
                out: list = [None] * len(said)
                if full:
                    x = np.asarray(encode([said[i] for i in full]), np.float64)
                    norm = np.linalg.norm(x, axis=1)
                    for i, v, n in zip(full, x, norm):
                        out[i] = (v / n).astype(np.float32).tolist() if n > 0 else None
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.float32()))], [key, "embedding"])

    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, embedding array<float>")


def recognised(files: DataFrame, read: Callable[[bytes], str] | None, pages: int = 12) -> DataFrame:
    """(path, text, error) of page images (path, content, page) that `read` recognises, the first `pages` of a file in order.

    Without a recogniser every file is reported as such and no text is made up; a page that fails is reported and the others stay.
    """
    f = files.where(F.col("page") <= pages).select("path", "page", "content")
    if read is None:
        return f.select("path").distinct().select("path", F.lit(None).cast("string").alias("text"), F.lit("no recogniser").alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said, wrong = [], []
            for raw in b.column(2):
                try:
                    said.append(read(raw.as_py() or b""))
                    wrong.append(None)
                except Exception as x:  # a broken page is a result, not a failure of the job
                    said.append(None)
                    wrong.append(f"{type(x).__name__}: {x}"[:200])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), pa.array(said, pa.string()), pa.array(wrong, pa.string())], ["path", "page", "text", "error"])

    made = f.mapInArrow(run, "path string, page int, text string, error string")
    pages_of = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("page", c)))), lambda x: x[c])
    g = made.groupBy("path").agg(pages_of("text").alias("t"), pages_of("error").alias("e"))  # `pages` rows a file
    return g.select("path", F.when(F.size("t") > 0, F.array_join("t", "\n")).alias("text"), F.try_element_at("e", F.lit(1)).alias("error"))
