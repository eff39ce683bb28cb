"""Language identification by nearest centroid over TF-IDF character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import add_columns

DIM = 1 << 13
#: Rows of each language that fitting takes at most, of all languages about, and of each language in any case; centroids of each.
SAMPLE, ROWS, LEAST, CENTROIDS = 400, 80_000, 20, 3
#: Characters of all languages' rows about, dealt to them equally; the longest piece of a text counted at once, in bytes.
CHARACTERS, PIECE = 64 << 20, 1 << 20
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter; numerals such as ½ or Ⅷ are none."""
    return any(map(str.isalpha, text or ""))


def counts(text: str) -> np.ndarray:
    """Hashed counts of byte n-grams of lengths 1 to 4, lower-cased, everything but letters folded to blanks."""
    out = np.zeros(DIM)
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    for k in range(0, max(len(raw) - 3, 1), PIECE):
        b = _FOLD[raw[k : k + PIECE + 3]]
        b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))]
        h = b
        for n in range(1, 5):
            if n > 1:
                h = h[:-1] * np.uint32(0x01000193) + b[n - 1 :] if len(h) else h
            mixed = (h + np.uint32(n)) * np.uint32(0x9E3779B1)
            out += np.bincount(mixed >> np.uint32(19), minlength=DIM)
    return out


@dataclass
class Model:
    """Unit centroids, their languages' numbers, and the least cosine at which a text isn't rejected."""

    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    names: list[str]
    least: float

    def vectors(self, raw: np.ndarray) -> np.ndarray:
        x = np.log1p(raw) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def predict(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language of the nearest centroid (on ties the first by name), and the cosine."""
        s = self.vectors(raw) @ self.centroids.T
        best = np.stack([s[:, self.owner == k].max(axis=1) for k in range(len(self.names))], axis=1)
        return best.argmax(axis=1), np.clip(best.max(axis=1), 0, 1)


def _cluster(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Spherical k-means; empty clusters are left out."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(10):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == j].sum(axis=0) for j in range(len(c)) if (near == j).any()])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(rows: list[tuple[str, str]], centroids: int = CENTROIDS, reject: float = 0.005, seed: int = 42) -> Model:
    """rows: (text, language). The rejection bound is the `reject` quantile of the sample's own cosines.

    Vectors are made language by language, so those of one are held at a time.
    """
    texts: dict[str, list[str]] = {}
    for text, lang in rows:
        if has_letter(text):
            texts.setdefault(lang, []).append(text)
    names = sorted(texts)
    if not names:
        return Model(np.ones(DIM), np.zeros((0, DIM)), np.zeros(0, np.int64), [], 0.0)
    raw = lambda name: np.stack([counts(t) for t in texts[name]]).astype(np.float32)
    idf = np.log((1 + sum(map(len, texts.values()))) / (1 + sum((raw(k) > 0).sum(axis=0) for k in names))) + 1
    model = Model(idf, np.zeros((0, DIM)), np.zeros(0, np.int64), names, 0.0)
    rng = np.random.default_rng(seed)
    made = [_cluster(model.vectors(raw(k)), centroids, rng) for k in names]
    model.centroids, model.owner = np.concatenate(made).astype(np.float32), np.repeat(np.arange(len(names)), [len(m) for m in made])
    model.least = float(np.quantile(np.concatenate([model.predict(raw(k))[1] for k in names]), reject))
    return model


def train(docs: DataFrame, learn: Column | None = None, lang: str = "lang", text: str = "text", bound: int = SAMPLE) -> Model:
    """Fit on at most `bound` rows of every language, in the order of a hash of their id.

    All languages take part. With more than ROWS / `bound` of them each gives fewer rows, but LEAST in any case, and a
    language's rows end once they have its share of CHARACTERS; texts are taken whole, whatever their length. So the driver
    gets a bounded sample. A model holds CENTROIDS * DIM numbers (0.1 MB) a language.

    Rows whose hash is beyond four times the wanted share of their language are dropped before anything is shuffled.
    """
    known = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0))
    known = known.where(learn) if learn is not None else known
    known = known.select(F.col(lang).alias("lang"), F.col("doc_id").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("digest"))
    sizes = known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("id", "digest")).alias("n"))
    languages = sizes.count()
    per = max(LEAST, min(bound, ROWS // max(languages, 1)))
    share = CHARACTERS // max(languages, 1)
    drawn = known.select("lang", "id", "digest", F.length("text").alias("size"), F.xxhash64(F.lit("sample"), "id", "digest").alias("h"))
    drawn = drawn.join(F.broadcast(sizes), "lang")  # a row a language
    drawn = drawn.where(F.col("h").cast("double") <= F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(4.0 * per / F.col("n"), F.lit(1.0))).distinct()
    by = Window.partitionBy("lang").orderBy("h", "id", "digest")
    first = drawn.withColumn("at", F.row_number().over(by)).where(F.col("at") <= per)
    first = first.withColumn("before", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).where(F.col("before") < share)
    rows = known.join(F.broadcast(first.select("lang", F.col("id").alias("i"), "digest", "h")), ["lang", "digest"])  # a few numbers a row of the sample
    rows = rows.where(F.col("id").eqNullSafe(F.col("i"))).groupBy("lang", "h", "digest").agg(F.min("text").alias("text"))
    return fit([(r["text"], r["lang"]) for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["h"], r["digest"]))])


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred (string), score (the cosine, 0 to 1) and rejected (boolean) added in place of columns so named.

    A null text, or one without a letter, is `und` with score 0, and so is every text if the model knows no language. A text
    farther from all centroids than the fitted bound keeps its nearest language and is marked rejected. Whole texts are
    read, long ones in pieces. Repeated rows and other columns are kept; an empty table stays empty.
    """
    new = ["lang_pred", "score", "rejected"]
    rest = [c for c in docs.columns if c.lower() not in new]

    def run(column: pa.Array) -> list[pa.Array]:
        texts = column.to_pylist()
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        able = [i for i, t in enumerate(texts) if has_letter(t)] if model.names else []
        for k in range(0, len(able), 256):
            part = able[k : k + 256]
            who, cosine = model.predict(np.stack([counts(texts[i]) for i in part]))
            for i, w, c in zip(part, who, cosine):
                names[i], scores[i] = model.names[w], c
        return [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(scores < model.least)]

    return add_columns(docs, rest, [text], run, "lang_pred string, score double, rejected boolean")
