"""Packing of token sequences: repeat counts of length patterns by non-negative least squares, residuals by best fit."""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidesmith.llm.common import keep, n_partitions, slices, table, worker_cache

CONTEXT, END = 4096, 1
#: Documents of an enumerated pattern, starts tried for each length, sweeps of the least-squares fit.
MOST_DOCS, STARTS, SWEEPS = 12, 4, 60

# --- tokens -----------------------------------------------------------------------------------------------------------

#: Texts of these characters alone are tokenised word by word: white space always parts words there, and lower-casing goes character by character.
_PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ‐-‧‰-⁞]*")
#: Marks that end words; a word of letters and then marks is two tokens' worth of text: the letters, and the marks.
_MARKS = ".,;:!?$#%&*+=~^|/)]}>-"
#: Words encoded by one call, words kept.
_CALL, _KEPT = 1000, 1_200_000


class Tokenizer:
    """ids of whole texts, as little-endian 32-bit bytes.

    Words are encoded one by one by the tokenizer anyway, so ids of words seen lately are kept. Words that are new to a
    slice of documents are encoded together, joined by blanks, without their closing marks: in the result each word ends
    with the one id whose token carries the mark of a word's end. Only a tokenizer of that form gets words; to all others, and of all other
    texts (see _PLAIN), the whole text is given.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Files

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.encoder, self.seen = Files.from_file(path), {}
        form = json.loads(self.encoder.to_str())
        split = (form.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0]
        steps = [x["type"] for x in (form.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = form["model"].get("end_of_word_suffix") == "</w>" and steps == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed"
        vocab = self.encoder.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _raw(self, text: str) -> bytes:
        return np.array(self.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: set[str]) -> None:
        """Keeps the ids of new words."""
        seen, parts, letters, others = self.seen, [], set(), set()
        for word in new:
            base = word.rstrip(_MARKS)
            if base.isalpha():
                letters.add(base)
                if base != word:
                    others.add(word[len(base) :])
                    parts.append((word, base, word[len(base) :]))
            else:
                others.add(word)
        todo = list(letters.difference(seen))
        for i in range(0, len(todo), _CALL):
            words = todo[i : i + _CALL]
            ids = np.array(self.encoder.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stops) != len(words):
                others.update(words)
                continue
            raw, at = ids.tobytes(), 0
            for word, stop in zip(words, stops.tolist()):
                seen[word] = raw[at:stop]
                at = stop
        todo = list(others.difference(seen))
        for word, e in zip(todo, self.encoder.encode_batch_fast(todo, add_special_tokens=False)):
            seen[word] = np.array(e.ids, "<u4").tobytes()
        for word, base, marks in parts:
            seen[word] = seen[base] + seen[marks]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        plain = [bool(t and self.by_word and "<|" not in t and _PLAIN.fullmatch(t) and unicodedata.is_normalized("NFC", t)) for t in texts]
        words = [t.lower().split() if on else None for t, on in zip(texts, plain)]
        distinct = set().union(*(w for w in words if w))
        new = distinct.difference(self.seen)
        if len(self.seen) + len(new) > _KEPT:
            self.seen.clear()
            new = distinct
        if new:
            self._learn(new)
        of = self.seen.__getitem__
        return [b"".join(map(of, w)) if w is not None else self._raw(t) if t else b"" for t, w in zip(texts, words)]


def _pieces(path: str, context: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = worker_cache("tokenizers")
        if path not in tokenizers:
            tokenizers[path] = Tokenizer(path)
        tokenize = tokenizers[path]
        tail = np.array([end], "<u4").tobytes()
        for part in slices(batches):
            out: list[list] = [[] for _ in range(6)]
            for doc, ids in zip(part.column("doc_id").to_pylist(), tokenize(part.column("text").to_pylist())):
                raw = ids + tail
                for piece, at in enumerate(range(0, len(raw), 4 * context)):
                    ids = raw[at : at + 4 * context]
                    for column, x in zip(out, (doc, piece, at // 4, len(ids) // 4, zlib.crc32(ids), ids)):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(x, kind) for x, kind in zip(out, kinds)]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays(arrays[:n], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:n])

    return run


# --- the plan: from a histogram of lengths alone ------------------------------------------------------------------------


def patterns(lengths: np.ndarray, context: int) -> list[tuple[int, ...]]:
    """Multisets of few lengths that fill the context well: each length, each of a few companions, then always the longest that still fits."""
    have, out = sorted(lengths.tolist()), {}
    for a in reversed(have):
        most = bisect_left(have, context - a + 1)
        for i in sorted({most - 1 - (most * s) // STARTS for s in range(STARTS)}):
            if i < 0:
                continue
            bag, left = [a, have[i]], context - a - have[i]
            while left >= have[0] and len(bag) < MOST_DOCS:
                bag.append(have[bisect_left(have, left + 1) - 1])
                left -= bag[-1]
            out[tuple(sorted(bag, reverse=True))] = None
        if most == 0:
            out[(a,)] = None
    return list(out)


def nnls(bags: list[tuple[int, ...]], histogram: dict[int, int], sweeps: int = SWEEPS) -> np.ndarray:
    """x >= 0 that brings sum(x[j] * bag j) closest to the histogram, by coordinate descent over the sparse columns."""
    columns = []
    for bag in bags:
        lengths, times = np.unique(bag, return_counts=True)
        columns.append((lengths.tolist(), times.tolist(), float((times**2).sum())))
    left, x = {k: float(v) for k, v in histogram.items()}, np.zeros(len(bags))
    for _ in range(sweeps):
        moved = 0.0
        for j, (lengths, times, square) in enumerate(columns):
            step = max(-x[j], sum(t * left[k] for k, t in zip(lengths, times)) / square)
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for k, t in zip(lengths, times):
                    left[k] -= t * step
        if moved < 0.01:
            break
    return x


def plan(histogram: dict[int, int], context: int = CONTEXT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times): bags that use up the histogram exactly. Its work depends on the number of distinct lengths alone.

    Repeat counts of the enumerated patterns come from least squares, rounded and bounded by what is there. Residual
    pieces go, longest first, to the fullest bags that still take them (those of the patterns too), else to new ones;
    bags of one pattern move together.
    """
    left = dict(histogram)
    bags = patterns(np.array(sorted(left)), context) if left else []
    x = nnls(bags, left)
    room: dict[int, list] = {}  # what is left of a bag -> [lengths, times]
    caps: list[int] = []

    def put(bag: tuple[int, ...], times: int) -> None:
        free = context - sum(bag)
        if free not in room:
            room[free] = []
            insort(caps, free)
        room[free].append([bag, times])

    for j in np.argsort(-x, kind="stable"):
        lengths, each = np.unique(bags[j], return_counts=True)
        times = min([round(x[j]), *(left[int(k)] // int(t) for k, t in zip(lengths, each))])
        if times > 0:
            put(bags[j], times)
            for k, t in zip(lengths, each):
                left[int(k)] -= times * int(t)
    for k in sorted(left, reverse=True):
        while left[k]:
            i = bisect_left(caps, k)
            if i == len(caps):
                per = min(context // k, left[k])
                times = left[k] // per
                put((k,) * per, times)
                left[k] -= times * per
                continue
            free = caps[i]
            bag, have = room[free].pop()
            if not room[free]:
                del room[free], caps[i]
            times = min(have, left[k])
            if times < have:
                put(bag, have - times)
            put((*bag, k), times)
            left[k] -= times
    return [(bag, times) for free in caps for bag, times in room[free]]


def _place(slots: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sequence, offset = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            rank = pdf["rank"].to_numpy(np.int64)
            for k, at in pdf.groupby("length").indices.items():
                lo, first, off = slots[int(k)]
                i = np.searchsorted(lo, rank[at], side="right") - 1
                sequence[at], offset[at] = first[i] + rank[at] - lo[i], off[i]
            yield pdf.drop(columns=["rank"]).assign(sequence_id=sequence, offset=offset)

    return run


def pack(docs: DataFrame, tokenizer: str, context: int = CONTEXT, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): every piece of every document, packed.

    docs: (doc_id, text, ...). A document is its ids and then `end`; null or empty text is `end` alone. Documents longer
    than the context are cut into pieces of it. Pieces of a sequence follow one another from offset 0. Rows of null doc_id
    and repeated rows are packed like any other; an empty table gives an empty result.

    Only the histogram of lengths (at most `context` rows) reaches the driver, and only bags of the plan (bounded by the number of
    distinct lengths) reach the tasks. A piece's rank among those of its length comes from counts of salted groups, so no
    group holds all pieces of a frequent length.
    """
    spark = docs.sparkSession
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    pieces = keep(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, context, end, with_ids), schema))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_partitions(spark))).alias("salt")
    salted = pieces.select("*", salt)
    counts = salted.groupBy("length", "salt").count()
    before = counts.select("length", "salt", (F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    taken: dict[int, list] = {k: [] for k in histogram}
    used, base = dict.fromkeys(histogram, 0), 0
    for bag, times in plan(histogram, context):
        at = 0
        for k in bag:
            taken[k].append((used[k], base, at))
            used[k] += times
            at += k
        base += times
    slots = {k: tuple(np.array(x, np.int64).T) for k, x in taken.items()}
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(order) - 1).join(before, ["length", "salt"])
    cols = [*pieces.columns]
    rows = ranked.select(*cols, (F.col("own") + F.col("before")).cast("long").alias("rank"))
    return rows.mapInPandas(_place(slots), schema + ", sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
