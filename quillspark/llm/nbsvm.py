"""Quality classifier: naive Bayes scaled features under a linear hinge loss.

A text's features are the indicators of its hashed character n-grams (one to
three characters) and of the shares of words that equal the one one, two or
three words before. The log-count ratios of the two classes scale them, and
dual coordinate descent fits the separating weights; a sigmoid fitted on rows
that the weights have not seen turns margins into scores.

The fit takes at most ``sample`` labelled rows (those of least hash of their
id), each as a bit field of fixed size, so what reaches the driver is bounded
by sample * 2**bits / 8 bytes. Scoring covers every row and whole texts.
"""

from __future__ import annotations

from bisect import bisect_left
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import odd_multipliers, slices, texts

BITS, GRAMS, SEED = 16, 3, 20_240_311
#: Upper ends of the classes of a share of equal words; they take the last buckets.
SHARES, LAGS = (0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 1.0), 3


def indicators(text: str, bits: int = BITS) -> np.ndarray:
    """Which of the 2**bits n-gram buckets the text touches."""
    out = np.zeros(1 << bits, bool)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    mult, places = odd_multipliers(GRAMS, SEED), np.uint64((1 << bits) - len(SHARES) * LAGS)
    h = np.zeros(len(c), np.uint64)
    for k in range(GRAMS):
        if len(c) <= k:
            break
        h = h[: len(c) - k] + c[k:] * mult[k]
        out[((h * mult[0] >> np.uint64(40)) % places).astype(np.int64)] = True
    words = text.split()
    for k in range(1, LAGS + 1):
        if len(words) > k:
            share = sum(map(eq, words, words[k:])) / (len(words) - k)
            out[int(places) + (k - 1) * len(SHARES) + bisect_left(SHARES, share)] = True
    return out


def _packed(batches):
    for b in batches:
        raw = b.column(1)
        for x, y in slices(pa.compute.binary_length(raw).to_pylist(), 4_000_000):
            bits = [np.packbits(indicators(t)).tobytes() for t in raw.slice(x, y - x).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(x, y - x), pa.array(bits, pa.binary())], ["y", "bits"])


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, size: int, alpha: float = 1.0) -> np.ndarray:
    p, q = np.full(size, alpha), np.full(size, alpha)
    for idx, label in zip(rows, y):
        (p if label > 0 else q)[idx] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = 15) -> np.ndarray:
    """Weights over the scaled indicators: the hinge loss's dual, one coordinate at a time."""
    w, alpha = np.zeros(len(scale)), np.zeros(len(rows))
    norm = np.array([float((scale[i] ** 2).sum()) for i in rows])
    rng = np.random.default_rng(SEED)
    for _ in range(epochs):
        moved = 0.0
        for k in rng.permutation(len(rows)):
            i = rows[k]
            x = scale[i]
            if norm[k] <= 0:
                continue
            g = y[k] * float(w[i] @ x) - 1
            new = min(max(alpha[k] - g / norm[k], 0.0), cost[k])
            if new != alpha[k]:
                w[i] += (new - alpha[k]) * y[k] * x
                moved += abs(new - alpha[k])
                alpha[k] = new
        if moved < 1e-4:
            break
    return w


def sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a m + b))) by Newton's rounds on smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    spread = margin.std() or 1.0
    m = margin / spread
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        d, v = p - target, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, [(d * m).sum() + 1e-3 * a, d.sum() + 1e-3 * b])
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return a / spread, b


class Model:
    """Weights by bucket, and the sigmoid; ``None`` weights give a constant score."""

    def __init__(self, weights: np.ndarray | None, a: float, b: float):
        self.weights, self.a, self.b = weights, a, b

    def score(self, text: str) -> float:
        m = float(self.weights[indicators(text)].sum()) if self.weights is not None else 0.0
        return float(1 / (1 + np.exp(-np.clip(self.a * m + self.b, -30, 30))))


def train(rows: list[np.ndarray], y: np.ndarray, size: int = 1 << BITS, cost: float = 1.0) -> Model:
    """``rows`` hold each text's buckets, ``y`` is 1 or -1. Every fifth row fits the sigmoid."""
    if not len(rows) or abs(y.sum()) == len(y):
        rate = (1 + (y > 0).sum()) / (2 + len(y))
        return Model(None, 0.0, float(np.log(rate / (1 - rate))))
    fold = np.arange(len(rows)) % 5 == 4
    if len(rows) < 25 or len(set(y[~fold])) < 2 or len(set(y[fold])) < 2:
        fold[:] = False
    at = np.flatnonzero(~fold)
    fit, label = [rows[i] for i in at], y[at]
    r = log_count_ratios(fit, label, size)
    each = np.where(label > 0, (label < 0).mean(), (label > 0).mean()) * 2 * cost
    w = dual_descent(fit, label, r, each / np.median([float((r[i] ** 2).sum()) or 1.0 for i in fit])) * r
    held = np.flatnonzero(fold) if fold.any() else at
    a, b = sigmoid_fit(np.array([w[rows[i]].sum() for i in held]), y[held])
    return Model(w, a, b)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 4000) -> Model:
    """Fits on labelled rows whose crc32(doc_id as text) mod 5 is not 0; null labels and ids are left out.

    At most ``sample`` ids, those of least hash, take part, with one row each: of
    several labels the least counts, of several texts that of the least md5.
    """
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("y")).where(
        F.col("y").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    )
    usable = usable.groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # its size bounds the broadcast
    own = docs.select("doc_id", texts().alias("text")).join(F.broadcast(chosen), "doc_id").withColumn("sum", F.md5(F.col("text").cast("binary")))
    # combined map-side, so what is gathered is one text an id
    own = own.groupBy("doc_id").agg(F.min("y").alias("y"), F.min_by("text", "sum").alias("text"))
    got = own.select("y", "text").mapInArrow(_packed, "y int, bits binary").collect()
    got.sort(key=lambda r: (r.bits, r.y))
    order = np.random.default_rng(SEED).permutation(len(got))
    rows = [np.flatnonzero(np.unpackbits(np.frombuffer(got[i].bits, np.uint8))) for i in order]
    return train(rows, np.array([1 if got[i].y > 0 else -1 for i in order]))


def _scored(model: Model, cutoff: float):
    def run(batches):
        for b in batches:
            raw = b.column(2)
            for x, y in slices(pa.compute.binary_length(raw).to_pylist(), 8_000_000):
                s = [model.score(t) for t in raw.slice(x, y - x).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(x, y - x), b.column(1).slice(x, y - x), pa.array(s, pa.float64()), pa.array([int(v >= cutoff) for v in s], pa.int32())],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return run


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = 4000, cutoff: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs``.

    Only the text enters a score. Null and empty texts get the score of a text
    without n-grams. A null doc_id is not held out. Without labels of both
    classes the score is constant. Rows stay as they are, repeated or not; an empty
    table gives none; extra columns are not read, whatever their names.
    """
    model = fit_quality(docs, labels, sample)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), texts().alias("text")).mapInArrow(_scored(model, cutoff), "doc_id long, held_out boolean, score double, predicted int")
