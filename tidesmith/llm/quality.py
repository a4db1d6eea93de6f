"""Quality by naive Bayes support vectors: n-gram indicators scaled by log-count ratios, a linear hinge-loss model on top."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesmith.llm.common import slices, table
from tidesmith.llm.sample import labelled_ids, remainder, sample_texts

#: Bound of the training sample: documents of each class.
PER_CLASS = 4000
BITS, LEAST_DOCS = 18, 3
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def _shape(token: str) -> int:
    """A class of few values: case, digits, or the first marks of a run of punctuation."""
    if token[0].isalnum() or token[0] == "_":
        if token.isdigit():
            return 1
        if token.isupper():
            return 2 if len(token) > 1 else 3
        return 4 if token.islower() else 5 if token[0].isupper() and token[1:].islower() else 6
    return 8 + xxhash.xxh32_intdigest(token[:2]) % 4088


class _Tokens(dict):
    """(hash of the lower-cased token) << 12 | shape, for tokens seen lately."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        out = self[token] = xxhash.xxh32_intdigest(token.lower()) << 12 | _shape(token)
        return out


def _hash(*columns: np.ndarray) -> np.ndarray:
    x = np.full(len(columns[0]), len(columns) * 0x51ED270B, np.uint64)
    for c in columns:
        x = (x ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)


def indicators(text: str | None, of: _Tokens) -> np.ndarray:
    """The distinct n-grams of a whole text, hashed: words (1, 2) and shapes (1 to 3), a word that repeats the one before it as a shape of its own."""
    tokens = _TOKEN.findall(text or "")
    if not tokens:
        return np.empty(0, np.int64)
    packed = np.fromiter(map(of.__getitem__, tokens), np.int64, len(tokens))
    word, shape = packed >> 12, packed & 4095
    shape[1:][word[1:] == word[:-1]] = 7
    grams = [_hash(word), _hash(word[:-1], word[1:])] + [_hash(np.full(len(shape) - n, 97 + n), *(shape[i : len(shape) - n + i] for i in range(n + 1))) for n in range(3) if len(shape) > n]
    return np.unique(np.concatenate(grams))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = _Tokens()
    for part in slices(batches):
        ids = [indicators(t, of).astype(np.int32).tobytes() for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(ids, pa.binary())], ["y", "ids"])


def _dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, c: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised, L1-loss linear support vector machine, by dual coordinate descent; c bounds each dual variable."""
    w, b, alpha, rng = np.zeros(1 << BITS), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    square = np.array([v @ v + 1 for v in values])  # the bias is a feature of value 1
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            g = y[i] * (w[rows[i]] @ values[i] + b) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), c[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                b += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, b


def _platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))), by Newton steps on smoothed targets."""
    pos, neg = (weight * y).sum(), (weight * (1 - y)).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([(weight * (t - p) * margin).sum() - 1e-3 * a, (weight * (t - p)).sum()])
        h = weight * p * (1 - p)
        m = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        d = np.clip(np.linalg.solve(m, g), -2, 2)
        a, b = max(1e-3, a + d[0]), b + d[1]
    return float(a), float(b)


def fit(docs: DataFrame, ids: DataFrame, cost: float = 1.0, epochs: int = 20, seed: int = 7) -> tuple[np.ndarray, float, float, float]:
    """(weights already scaled by the ratios, bias, a, b): the model and its Platt scale, fitted on a fifth of the sample.

    With one class only, or none, every text gets that class's smoothed share.
    """
    sample = sample_texts(docs, ids).mapInArrow(_rows, "y int, ids binary").collect()
    y = np.array([r["y"] for r in sample], float)
    rows = [np.frombuffer(r["ids"], np.int32).astype(np.int64) for r in sample]
    ones, zeros = int(y.sum()), int(len(y) - y.sum())
    if not ones or not zeros:
        return np.zeros(1 << BITS), 0.0, 1.0, float(np.log((ones + 1) / (zeros + 1)))
    with_, without = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for label, r in zip(y, rows):
        (with_ if label else without)[r] += 1
    p, q = (with_ + 1) / (ones + 2), (without + 1) / (zeros + 2)
    ratio = np.where(with_ + without >= LEAST_DOCS, np.log(p / q), 0.0)
    values = [ratio[r] for r in rows]
    values = [v / max(1e-9, np.sqrt(v @ v)) for v in values]
    fold = np.random.default_rng(seed).permutation(len(y)) % 5
    c = np.where(y > 0, cost * len(y) / (2 * ones), cost * len(y) / (2 * zeros))
    sign = 2 * y - 1
    on = np.flatnonzero(fold > 0)
    w, b = _dual_descent([rows[i] for i in on], [values[i] for i in on], sign[on], c[on], epochs, seed)
    off = np.flatnonzero(fold == 0)
    margins = np.array([w[rows[i]] @ values[i] + b for i in off])
    # both classes weigh alike, as the sample's shares are those of its bounds, not of the corpus
    share = np.where(y[off] > 0, 1 / max(1, y[off].sum()), 1 / max(1, (1 - y[off]).sum())) * len(off) / 2
    scale, shift = _platt(margins, y[off], share) if 0 < y[off].sum() < len(off) else (2.0, 0.0)
    return np.stack([w, ratio]), b, scale, shift


def _score(model: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (weights, bias, scale, shift), of = model, _Tokens()
        w, ratio = weights if weights.ndim == 2 else (weights, weights)
        scaled, square = w * ratio, ratio * ratio
        for part in slices(batches):
            scores = []
            for text in part.column("text").to_pylist():
                ids = indicators(text, of)
                margin = scaled[ids].sum() / max(1e-9, np.sqrt(square[ids].sum())) + bias
                scores.append(float(1 / (1 + np.exp(-np.clip(scale * margin + shift, -30, 30)))))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, model: tuple) -> DataFrame:
    """(doc_id, score): the likelihood that each whole text is labelled 1.

    A text without known n-grams (null and empty too) gets the score of the bias. Each row is scored by itself, so ties,
    repeated rows, null ids and further columns change nothing; an empty table gives an empty result. The model is two
    arrays of 2 ** BITS doubles, whatever the size of the corpus.
    """
    return docs.select("doc_id", "text").mapInArrow(_score(model), "doc_id long, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, labelled_ids(table(spark, sf_dir, "labels"), "quality", 5, 0, PER_CLASS))
    return quality(docs, model).select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )
