"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learned from labels of documents."""

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
BITS, PREFIXES, MOST_WORDS, LEAST_DOCS = 18, (4, 5, 6), 48, 5
_SENTENCE, _WORD = re.compile(r"[^.!?\n]+[.!?]*"), re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, distinct words) of each sentence, in code points of the text; a longer one is cut every MOST_WORDS words."""
    for s in _SENTENCE.finditer(text or ""):
        found = list(_WORD.finditer(s[0]))
        for i in range(0, len(found), MOST_WORDS):
            part = found[i : i + MOST_WORDS]
            a = s.start() + (part[0].start() if i else 0)
            b = s.end() if i + MOST_WORDS >= len(found) else s.start() + part[-1].end()
            yield a, b, list({w[0].lower(): None for w in part})


def features(word: str) -> list[int]:
    """The hashed features of a word: the word itself and its beginnings, so that inflected forms share what they share."""
    raw = [f"w{word}", *(f"{n}{word[:n]}" for n in PREFIXES if len(word) > n)]
    return [xxhash.xxh32_intdigest(x) >> (32 - BITS) for x in raw]


class _Features(dict):
    """features() of words seen lately."""

    def __missing__(self, word: str) -> list[int]:
        if len(self) > 200_000:
            self.clear()
        out = self[word] = features(word)
        return out


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, ids, lengths): the features of a document's sentences one after another, and how many each sentence has."""
    of = _Features()
    for part in slices(batches):
        ids, lengths = [], []
        for text in part.column("text").to_pylist():
            bags = [[f for w in words for f in of[w]] for _, _, words in sentences(text)]
            ids.append(np.array([f for b in bags for f in b], np.int32).tobytes())
            lengths.append(np.array([len(b) for b in bags], np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(ids, pa.binary()), pa.array(lengths, pa.binary())], ["y", "ids", "lengths"])


def fit(docs: DataFrame, ids: DataFrame, epochs: int = 30, l2: float = 2e-5, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the sentence score, by Adagrad on the documents' noisy-or likelihood.

    P(document) = 1 - prod(1 - p(sentence)); so a positive document moves the sentences that explain it, a negative one all of its own.
    Without positive labels every sentence gets the bias. The sample is bounded by PER_CLASS documents of each class.
    """
    rows = sample_texts(docs, ids).mapInArrow(_bags, "y int, ids binary, lengths binary").collect()
    weights, bias = np.zeros(1 << BITS), -6.0
    bags = [(r["y"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["lengths"], np.int32)) for r in rows]
    bags = [b for b in bags if len(b[1])]
    if not any(y for y, _, _ in bags):
        return weights, bias
    seen, counts = np.zeros((2, 1 << BITS)), np.zeros(2)
    for y, f, _ in bags:
        seen[y][np.unique(f)] += 1
        counts[y] += 1
    # each feature is scaled by the log-ratio of its shares among the classes, so that words of both count for little
    scale = np.where(seen.sum(0) >= LEAST_DOCS, np.log((seen[1] + 1) / (counts[1] + 2)) - np.log((seen[0] + 1) / (counts[0] + 2)), 0.0)
    weights = 0.3 * np.sign(scale) * (np.abs(scale) > 1)
    g2, gb, rng = np.full(1 << BITS, 1e-2), 1e-2, np.random.default_rng(seed)
    for _ in range(epochs):
        for chunk in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // 200)):
            own = [bags[i] for i in chunk]
            f = np.concatenate([x for _, x, _ in own])
            sentence_of = np.repeat(np.arange(sum(len(x) for _, _, x in own)), np.concatenate([x for _, _, x in own]))
            doc_of = np.repeat(np.arange(len(own)), [len(x) for _, _, x in own])
            y = np.array([y for y, _, _ in own], float)
            z = bias + np.bincount(sentence_of, (weights * scale)[f], minlength=len(doc_of))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            none = np.bincount(doc_of, np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(own))
            whole = np.maximum(-np.expm1(none), 1e-9)
            up = np.where(y > 0, (1 - whole) / whole, -1.0)[doc_of] * p / len(own)
            grad = np.bincount(f, up[sentence_of], minlength=1 << BITS) * scale
            on = np.flatnonzero(grad)
            step = grad[on] - l2 * weights[on]
            g2[on] += (step * 30) ** 2
            weights[on] += 0.2 * step * 30 / np.sqrt(g2[on])
            gb += (up.sum() * 30) ** 2
            bias = min(-3.0, bias + 0.1 * up.sum() * 30 / np.sqrt(gb))
    return weights * scale, float(bias)


class _WordScores(dict):
    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        out = self[word] = float(sum(self.weights[f] for f in features(word)))
        return out


def _score(weights: np.ndarray, bias: float, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _WordScores(weights)
        score = of.__getitem__
        for part in slices(batches):
            scores, found = [], []
            for text in part.column("text").to_pylist():
                spans, z = [], []
                for a, b, own in sentences(text):
                    z.append(bias + sum(map(score, own)))
                    spans.append((a, b))
                p = 1 / (1 + np.exp(-np.clip(np.array(z), -30, 30)))
                scores.append(float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if z else 0.0)
                found.append([{"start": spans[i][0], "end": spans[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= least)])
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores, pa.float64()), pa.array(found, _SPANS)], [*part.schema.names[:-1], "score", "offending"])

    return run


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def toxicity(docs: DataFrame, model: tuple[np.ndarray, float], least: float = 0.5) -> DataFrame:
    """(doc_id, score, offending): the noisy-or score of each whole text, and its sentences of a score of `least` or more.

    Null and empty texts, and texts without letters, hold no sentence: score 0. Each row is scored by itself, so ties,
    repeated rows, null ids and further columns change nothing; an empty table gives an empty result. The weights are
    2 ** BITS doubles, whatever the size of the corpus.
    """
    out = "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>"
    return docs.select("doc_id", "text").mapInArrow(_score(*model, least), out)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, labelled_ids(table(spark, sf_dir, "labels"), "toxic", 3, 1, PER_CLASS))
    scored = toxicity(docs, model)
    return scored.select(
        "doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "offending"
    )
