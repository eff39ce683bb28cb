"""Quality: Bradley-Terry ranking of preference pairs, thresholded at a score quantile."""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import add_columns
from .labelled import sample

#: Labelled rows and preference pairs that fitting takes at most.
SAMPLE, PAIRS = 6000, 60_000
FEATURES = ("log_words", "upper_words", "plain_words", "letterless_words", "repeated_next", "distinct_words", "repeated_lines", "word_length", "upper_bytes", "digit_bytes", "mark_bytes", "symbol_bytes", "most_frequent_word")
_UPPER = np.arange(65, 91)
_DIGIT = np.arange(48, 58)
_MARK = np.array([ord(c) for c in ".,;:?'\"()-"])
_SYMBOL = np.array([b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:?'\"()-"])


def features(text: str | None) -> np.ndarray:
    """Shares that describe how a whole text is written; independent of language, source and ids."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(len(FEATURES))
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    size = raw.sum()
    kinds: dict[str, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    plain = sum(map(str.isalpha, words))
    letterless = sum(k for w, k in kinds.items() if not any(map(str.isalpha, w)))
    return np.array([
        np.log1p(n), sum(map(str.isupper, words)) / n, plain / n, letterless / n, sum(map(eq, words, words[1:])) / n,
        np.log(len(kinds) + 1) / np.log(n + 1), 1 - len(set(lines)) / max(len(lines), 1), min(size / n, 40) / 10,
        raw[_UPPER].sum() / size, raw[_DIGIT].sum() / size, raw[_MARK].sum() / size, raw[_SYMBOL].sum() / size, max(kinds.values()) / n,
    ])


@dataclass
class Model:
    """A text's strength is weights . (features - mean) / scale; strength `cut` is shown as score `at`."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    at: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.strength(x) - self.cut + np.log(self.at / (1 - self.at)), -30, 30)))


def fit(rows: list[tuple[str, int]], threshold: float = 0.7, pairs: int = PAIRS, seed: int = 42) -> Model:
    """Learn strengths so that P(better wins) = sigmoid(strength difference), over pairs of a good and a poor text.

    The cut is the quantile of the sample's strengths at its share of poor texts, in the middle of the gap there.
    """
    x = np.array([features(t) for t, _ in rows]).reshape(-1, len(FEATURES))
    y = np.array([v for _, v in rows], dtype=np.int64)
    mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    scale = np.where(scale < 1e-6, 1.0, scale)
    model = Model(mean, scale, np.zeros(len(FEATURES)), 0.0, threshold)
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(poor):
        model.cut = -5.0 if len(good) else 5.0
        return model
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(poor, pairs)]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        g = -(d * p[:, None]).mean(axis=0) + 1e-3 * w
        h = (d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    model.weights = w
    s = np.sort(z @ w)
    k = min(max(len(poor), 1), len(s) - 1)
    model.cut = float((s[k - 1] + s[k]) / 2)
    return model


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "quality", threshold: float = 0.7, bound: int = SAMPLE) -> Model:
    """Fit on at most `bound` labelled rows that satisfy `learn`."""
    return fit(sample(docs, labels.where(learn) if learn is not None else labels, label, bound, balanced=False), threshold)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (double, 0 to 1) and predicted (int) added in place of columns of these names.

    Every whole text is scored. Null, empty and wordless texts have all features zero and score by that. Equal texts
    score alike; repeated rows and other columns are kept; an empty table stays empty. A model fitted without both
    labels gives every text the same score, on the side of the label it saw.
    """
    rest = [c for c in docs.columns if c.lower() not in ("score", "predicted")]

    def run(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(model.score(np.array([features(t.as_py()) for t in texts]).reshape(-1, len(FEATURES))), pa.float64())]

    out = add_columns(docs, rest, [text], run, "score double")
    return out.withColumn("predicted", (F.col("score") >= model.at).cast("int"))
