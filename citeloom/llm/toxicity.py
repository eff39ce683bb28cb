"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import add_columns
from .labelled import sample

BUCKETS, DIM, SHORTEST, LONGEST = 1 << 16, 4, 3, 5
#: Words averaged into one bag; a text scores as its most toxic bag.
WINDOW = 6
#: Labelled rows that training takes at most.
SAMPLE = 3000
#: Weight of the embeddings' squares in the loss.
DECAY = 1e-5
#: Bytes of a text that are hashed at once.
PIECE = 1 << 20
#: Blank for all ASCII bytes but letters and digits.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 32


def grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of folded bytes that begin and end with a blank: places and buckets of the n-grams, and each word's first place.

    An n-gram may hold a blank only as its first or last byte, where it marks the word's beginning or end. It belongs to
    the word that holds its second byte.
    """
    blank = raw == 32
    before = np.concatenate(([0], np.cumsum(blank)))
    places, buckets = [], []
    h = raw.astype(np.uint32)
    for n in range(2, LONGEST + 1):
        if len(h) < 2:
            break
        h = h[:-1] * np.uint32(0x01000193) + raw[n - 1 :]
        if n >= SHORTEST:
            at = np.flatnonzero(before[n - 1 : n - 1 + len(h)] == before[1 : 1 + len(h)])
            places.append(at)
            buckets.append(((h[at] + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(16))
    first = np.flatnonzero(blank[:-1] & ~blank[1:])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), first
    return np.concatenate(places), np.concatenate(buckets), first


def fold(text: str) -> np.ndarray:
    return _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)]


def words_of(raw: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's mean margin over its n-grams, and a number that equal words share."""
    at, bucket, first = grams(raw)
    if not len(first):
        return np.zeros(0), np.zeros(0)
    word = np.searchsorted(first, at, side="right") - 1 if len(at) < 64 else (np.cumsum(np.bincount(first, minlength=len(raw))) - 1)[at]
    n = len(first)
    return np.bincount(word, margin[bucket], n) / np.maximum(np.bincount(word, minlength=n), 1), np.bincount(word, np.sqrt(bucket + 1.0), n)


def word_margins(raw: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Each word's mean margin over its n-grams."""
    return words_of(raw, margin)[0]


@dataclass
class Model:
    """margin: each bucket's embedding under the difference of the two softmax rows; the rest calibrates the best bag."""

    margin: np.ndarray
    slope: float
    offset: float

    def score(self, text: str | None) -> float:
        raw = fold(text or "")
        parts, k = [], 0
        while k < len(raw) - 1:  # long texts in pieces that end at a blank
            end = min(len(raw), k + PIECE)
            if end < len(raw):
                blanks = np.flatnonzero(raw[k + 1 : end] == 32)
                end = k + 2 + int(blanks[-1]) if len(blanks) else end
            parts.append(words_of(raw[k:end], self.margin))
            k = end - 1
        best = best_bag(calm(*map(np.concatenate, zip(*parts))) if parts else np.zeros(0))[0]
        return float(1 / (1 + np.exp(-np.clip(self.slope * best + self.offset, -30, 30))))


def best_bag(words: np.ndarray) -> tuple[float, int]:
    """The largest mean of WINDOW neighbouring words' margins, and where it begins; zero without words.

    Words are given without immediate repeats (see `calm`), so one dull word said many times isn't a bag of evidence.
    """
    if len(words) <= WINDOW:
        return (float(words.mean()) if len(words) else 0.0), 0
    total = np.concatenate(([0.0], np.cumsum(words)))
    means = (total[WINDOW:] - total[:-WINDOW]) / WINDOW
    at = int(np.argmax(means))
    return float(means[at]), at


def calm(words: np.ndarray, same: np.ndarray | None = None) -> np.ndarray:
    """What is said of words, without those that equal the word before. `same` tells words apart (default: the values do)."""
    same = words if same is None else same
    return words[np.append(True, same[1:] != same[:-1])] if len(words) else words


def _sums(values: np.ndarray, of: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the rows values[of] from each start to the next, a column at a time, which keeps copies small; starts has the end too, and may repeat."""
    out = np.zeros((len(starts) - 1, values.shape[1]))
    full = np.flatnonzero(np.diff(starts))
    for k in range(values.shape[1] if len(full) else 0):
        out[full, k] = np.add.reduceat(values[:, k][of], starts[full])
    return out


class _Trainer:
    def __init__(self, vocabulary: list[bytes], seed: int):
        rng = np.random.default_rng(seed)
        at, bucket, first = grams(_FOLD[np.frombuffer(b" " + b" ".join(vocabulary) + b" ", np.uint8)])
        word = np.searchsorted(first, at, side="right") - 1
        order = np.argsort(word, kind="stable")
        self.row = word[order].astype(np.int32)
        self.used, gram = np.unique(bucket[order], return_inverse=True)
        self.gram = gram.astype(np.int32)
        self.start = np.searchsorted(self.row, np.arange(len(vocabulary) + 1))
        self.size = np.maximum(np.diff(self.start), 1)[:, None]
        self.values = [rng.normal(0, 0.1, (len(self.used), DIM)), rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)]
        self.first, self.second, self.t = [np.zeros_like(v) for v in self.values], [np.zeros_like(v) for v in self.values], 0

    def words(self) -> np.ndarray:
        return _sums(self.values[0], self.gram, self.start) / self.size

    def margins(self) -> np.ndarray:
        return self.words() @ (self.values[1][:, 1] - self.values[1][:, 0])

    def train(self, bags: list[np.ndarray], y: np.ndarray, rounds: int, rate: float = 0.1, decay: float = DECAY) -> None:
        """Adam on all bags at once. A bag is an array of word numbers, below zero for words without embedding."""
        known = [b[b >= 0] for b in bags]
        start = np.concatenate(([0], np.cumsum([len(b) for b in known]))).astype(np.int64)
        word = np.concatenate(known) if known else np.zeros(0, np.int64)
        bag = np.repeat(np.arange(len(bags)), np.diff(start))
        size = np.maximum([len(b) for b in bags], 1)[:, None]
        weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))[:, None]
        truth = np.stack([1 - y, y], axis=1)
        for _ in range(rounds):
            e, w, b = self.values
            vec = self.words()
            mean = _sums(vec, word, start) / size
            z = mean @ w + b
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            dz = (p - truth) * weight
            d_mean = dz @ w.T / size
            d_vec = np.stack([np.bincount(word, d_mean[:, k][bag], len(vec)) for k in range(DIM)], axis=1) / self.size
            d_e = np.stack([np.bincount(self.gram, d_vec[:, k][self.row], len(e)) for k in range(DIM)], axis=1)
            self.t += 1
            for k, g in enumerate((d_e + decay * e, mean.T @ dz + 1e-4 * w, dz.sum(axis=0))):
                self.first[k] = 0.9 * self.first[k] + 0.1 * g
                self.second[k] = 0.999 * self.second[k] + 0.001 * g * g
                self.values[k] = self.values[k] - rate * (self.first[k] / (1 - 0.9**self.t)) / (np.sqrt(self.second[k] / (1 - 0.999**self.t)) + 1e-9)


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the best bags, with Platt's softened targets."""
    pos, neg = max((y == 1).sum(), 1), max((y == 0).sum(), 1)
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y == 1, 0.5 / pos, 0.5 / neg)
    mid, scale = x.mean(), x.std() or 1.0
    z, beta = np.stack([(x - mid) / scale, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        g = z.T @ (weight * (p - target)) + 1e-4 * beta
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-4 * np.eye(2)
        beta -= np.clip(np.linalg.solve(h, g), -3, 3)
    return float(beta[0] / scale), float(beta[1] - beta[0] * mid / scale)


def fit(rows: list[tuple[str, int]], seed: int = 42) -> Model:
    """Train on whole texts first, then twice on each text's most toxic bag, which lets one sentence mark a long text."""
    folded = [fold(t) for t, _ in rows]
    texts = [f.tobytes().split() for f in folded]
    y = np.array([v for _, v in rows], dtype=np.int64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(BUCKETS), 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    seen = Counter(w for t in texts for w in set(t))
    vocabulary = sorted(w for w, n in seen.items() if n > 1) or sorted(seen)
    number = {w: i for i, w in enumerate(vocabulary)}
    for w in sorted(seen):
        number.setdefault(w, -len(number))  # words without embedding have numbers of their own, below zero
    bags = [calm(np.fromiter((number[w] for w in t), np.int64, len(t))) for t in texts]
    trainer = _Trainer(vocabulary, seed)
    trainer.train(bags, y, 30)
    clean = np.flatnonzero(y == 0)
    hard: list[np.ndarray] = []
    for _ in range(3):
        m = trainer.margins()
        windows = [b[k : k + WINDOW] for b, k in ((b, best_bag(np.where(b < 0, 0.0, m[np.maximum(b, 0)]))[1]) for b in bags)]
        hard += [windows[i] for i in clean]
        positive = [windows[i] for i in np.flatnonzero(y)]
        trainer.train(positive + hard, np.repeat([1, 0], [len(positive), len(hard)]), 25)
    margin = np.zeros(BUCKETS)
    margin[trainer.used] = trainer.values[0] @ (trainer.values[1][:, 1] - trainer.values[1][:, 0])
    return Model(margin, *_calibrate(np.array([best_bag(calm(*words_of(f, margin)))[0] for f in folded]), y))


def train(docs: DataFrame, labels: DataFrame, learn: Column | None = None, label: str = "toxic", bound: int = SAMPLE) -> Model:
    """Fit on at most `bound` labelled rows that satisfy `learn`, half of them toxic where there are so many."""
    return fit(sample(docs, labels.where(learn) if learn is not None else labels, label, bound, balanced=True))


def score(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """docs with score (double, 0 to 1) and predicted (int) added in place of columns of these names.

    Every whole text is scored: the largest bag of WINDOW neighbouring words decides. A null or empty text scores as a
    bag without words. Equal texts score alike, repeated rows and other columns are kept, an empty table stays empty.
    A model fitted without both labels gives every text the labels' share.
    """
    rest = [c for c in docs.columns if c.lower() not in ("score", "predicted")]

    def run(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([model.score(t.as_py()) for t in texts], pa.float64())]

    out = add_columns(docs, rest, [text], run, "score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
