"""Benchmark decontamination: a distributed positional inverted index of the training tokens, searched from the rarest term."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesmith.llm.common import keep, slices, table, words

WINDOW, DISTANCE = 10, 20
#: Tokens of an index shard, bytes of test items that one pass sends to the tasks.
SHARD_TOKENS, BLOCK_BYTES = 1_500_000, 16_000_000
#: A null doc_id among the bytes of a shard.
NO_ID = -(2**63)


class TestWindows:
    """The windows of a block of test items over a vocabulary of its own: ids[w, i], and how many terms a window has."""

    def __init__(self, items: list[tuple], size: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        seen: dict[tuple, set] = {}
        for item, text in items:
            w = words(text)
            for at in range(max(1, len(w) - size + 1) if w else 0):
                seen.setdefault(tuple(w[at : at + size]), set()).update([] if item is None else [str(item)])
        for window in seen:
            for term in window:
                self.vocab.setdefault(term, len(self.vocab))
        self.lengths = np.array([len(w) for w in seen], np.int64)
        self.ids = np.full((len(seen), size), -1, np.int64)
        for row, window in enumerate(seen):
            self.ids[row, : len(window)] = [self.vocab[t] for t in window]
        self.items = [sorted(x) for x in seen.values()]


#: A shard: doc_ids, first tokens and numbers of tokens of its documents; terms (by blanks), list lengths and position lists (one after another, as differences).
INDEX = "doc_ids binary, firsts binary, lengths binary, terms binary, counts binary, positions binary"


class _Numbers(dict):
    """A number for each term of a shard, in the order in which they are met."""

    def __missing__(self, term: bytes) -> int:
        out = self[term] = len(self)
        return out


def _index(gap: int):
    """Task: documents to index shards. Positions run on through a shard, with a gap between documents that no window spans."""

    def shard(docs: list[tuple[int, int, np.ndarray]], terms: _Numbers) -> tuple:
        firsts, at = [], 0
        for _, n, _ in docs:
            firsts.append(at)
            at += n + gap
        term = np.concatenate([x for _, _, x in docs])
        where = np.concatenate([np.arange(first, first + n, dtype=np.int64) for first, (_, n, _) in zip(firsts, docs)])
        where = where[np.argsort(term, kind="stable")]  # positions of a term stay in order
        counts = np.bincount(term, minlength=len(terms))
        starts = np.cumsum(counts) - counts
        step = np.diff(where, prepend=0)
        step[starts] = where[starts]
        return (
            np.array([d for d, _, _ in docs], np.int64).tobytes(), np.array(firsts, np.int64).tobytes(), np.array([n for _, n, _ in docs], np.int64).tobytes(),
            b" ".join(terms), counts.astype(np.int32).tobytes(), step.astype(np.int32).tobytes(),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, tokens, terms = [], 0, _Numbers()
        names = [c.split()[0] for c in INDEX.split(", ")]
        out = lambda: pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in shard(docs, terms)], names)
        for part in slices(batches):
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                w = words(text)
                docs.append((NO_ID if doc is None else doc, len(w), np.fromiter(map(terms.__getitem__, w), np.int32, len(w))))
                tokens += len(w) + gap
                if tokens >= SHARD_TOKENS:
                    yield out()
                    docs, tokens, terms = [], 0, _Numbers()
        if docs:
            yield out()

    return run


class _Shard:
    """A shard as the terms of a block of tests see it: n[t] places of term t."""

    def __init__(self, row: dict, vocab: dict[bytes, int]):
        self.doc_ids, self.firsts, self.lengths = (np.frombuffer(row[c], np.int64) for c in ("doc_ids", "firsts", "lengths"))
        counts, terms = np.frombuffer(row["counts"], np.int32), row["terms"].split(b" ") if row["terms"] else []
        on = [(i, vocab[t]) for i, t in enumerate(terms) if t in vocab]
        own, test = np.array(on, np.int64).reshape(-1, 2).T
        self.steps = np.frombuffer(row["positions"], np.int32)
        self.n, self.start = np.zeros(len(vocab), np.int64), np.zeros(len(vocab), np.int64)
        self.n[test] = counts[own]
        self.start[test] = (np.cumsum(counts, dtype=np.int64) - counts)[own]
        self._lists: dict[int, np.ndarray] = {}

    def positions(self, term: int) -> np.ndarray:
        got = self._lists.get(term)
        if got is None:
            got = self._lists[term] = np.cumsum(self.steps[self.start[term] : self.start[term] + self.n[term]], dtype=np.int64)
        return got

    def phrase(self, ids: np.ndarray) -> np.ndarray:
        """Places where the terms stand one after another: lists, each moved by its offset, met from the rarest term on."""
        order = np.argsort(self.n[ids], kind="stable")
        at = self.positions(int(ids[order[0]])) - order[0]
        for i in order[1:]:
            if not len(at):
                break
            p = self.positions(int(ids[i]))
            found = np.searchsorted(p, at + i)
            at = at[(found < len(p)) & (p[np.minimum(found, len(p) - 1)] == at + i)]
        return at

    def near(self, ids: np.ndarray, distance: int) -> np.ndarray:
        """Places of the window's first term with every other term of it within so many words on either side, the rarest looked for first."""
        at, rest = self.positions(int(ids[0])), np.unique(ids)
        rest = rest[rest != ids[0]]
        for t in rest[np.argsort(self.n[rest], kind="stable")]:
            if not len(at):
                break
            p = self.positions(int(t))
            i = np.searchsorted(p, at - distance)
            at = at[(i < len(p)) & (p[np.minimum(i, len(p) - 1)] <= at + distance)]
        return at


def _search(tests: TestWindows, distance: int | None):
    """Task: one row for each document of each shard: n_words, spans of hit words (starts, ends), items that occur, items near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths = tests.ids, tests.lengths
        for batch in batches:
            for row in batch.to_pylist():
                s = _Shard(row, tests.vocab)
                n = len(s.doc_ids)
                spans: list[list] = [[] for _ in range(n)]
                items: list[set] = [set() for _ in range(n)]
                close: list[set] = [set() for _ in range(n)]
                present = (np.where(ids >= 0, s.n[ids], 1) > 0).all(1) if len(ids) else np.zeros(0, bool)
                for w in np.flatnonzero(present):
                    own = ids[w, : lengths[w]]
                    at = s.phrase(own)
                    docs = np.searchsorted(s.firsts, at, side="right") - 1
                    for d, start in zip(docs.tolist(), (at - s.firsts[docs]).tolist()):
                        spans[d].append((start, start + int(lengths[w])))
                        items[d].update(tests.items[w])
                    if distance is not None:
                        for d in np.unique(np.searchsorted(s.firsts, s.near(own, distance), side="right") - 1).tolist():
                            close[d].update(tests.items[w])
                merged = [_union(x) for x in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if d == NO_ID else d for d in s.doc_ids.tolist()], pa.int64()), pa.array(s.lengths),
                        pa.array([[a for a, _ in m] for m in merged], pa.list_(pa.int64())), pa.array([[b for _, b in m] for m in merged], pa.list_(pa.int64())),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array([sorted(x) for x in close], pa.list_(pa.string())),
                    ],
                    ["doc_id", "n_words", "starts", "ends", "items", "near_items"],
                )

    return run


def _union(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


FOUND = "doc_id long, n_words long, starts array<long>, ends array<long>, items array<string>, near_items array<string>"


def _blocks(tests: DataFrame) -> int:
    size = tests.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    return max(1, -(-size // BLOCK_BYTES))


def contamination(docs: DataFrame, tests: DataFrame, size: int = WINDOW, distance: int | None = None) -> DataFrame:
    """For each document (doc_id, n_words, starts, ends, items, near_items): the word spans that windows of test items cover.

    docs: (doc_id long, text); tests: (item_id, text). Words are those of common.words. A window is `size` words of an
    item one after another; an item of fewer words, but not none, is one window. starts/ends: the hit words, as spans
    that neither touch nor overlap. items: those with a window in the document. near_items (if distance is given): those
    with a window whose terms all stand within `distance` words of its first one. Null or empty text has no words and no
    hits; an empty test table leaves every document with none; each repeated row, and each row of null doc_id, gets its own
    answer. Words of a test of null item_id are hit, but no item is named for it. Further columns are not looked at.

    The index holds the postings of all terms of the documents, sharded by document, so a
    frequent term's list is cut with the documents and no list outgrows its shard. It is written once; each block of tests
    (BLOCK_BYTES of items, the bound of what tasks are sent) is then looked up in it.
    """
    tests = tests.select(F.col("item_id").cast("string").alias("item_id"), "text")
    blocks = _blocks(tests)
    docs = docs.select("doc_id", "text")
    if blocks > 1:  # answers of blocks are put together by row
        docs = keep(docs.withColumn("row", F.monotonically_increasing_id()))
        rows, docs = docs.select("row", F.col("doc_id").alias("own")), docs.select(F.col("row").alias("doc_id"), "text")
    index, out = keep(docs.mapInArrow(_index(size + 2 * (distance or 0)), INDEX)), None
    for block in range(blocks):
        own = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        found = index.mapInArrow(_search(TestWindows([tuple(r) for r in own], size), distance), FOUND)
        out = found if out is None else out.union(found)
    if blocks == 1:
        return out
    spans = F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))
    sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")]
    cols = [F.max("n_words").alias("n_words"), F.array_sort(spans).alias("s"), *sets]
    step = lambda a, x: F.when(
        (F.size(a) > 0) & (F.element_at(a, -1)["ends"] >= x["starts"]),
        F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["starts"].alias("starts"), F.greatest(F.element_at(a, -1)["ends"], x["ends"]).alias("ends")))),
    ).otherwise(F.concat(a, F.array(x)))
    one = out.groupBy("doc_id").agg(*cols).withColumn("s", F.aggregate("s", F.expr("cast(array() as array<struct<starts:bigint,ends:bigint>>)"), step))
    one = one.join(rows, one["doc_id"] == rows["row"])
    return one.select(F.col("own").alias("doc_id"), "n_words", F.col("s.starts").alias("starts"), F.col("s.ends").alias("ends"), "items", "near_items")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), distance=DISTANCE)
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
    )


_DOC_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_DOC_WORDS}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, coalesce({_DOC_WORDS}, []) AS w FROM benchmark),
bw AS (
  SELECT item_id, array_to_string(w[i : i + 9], ' ') AS k, len(w[i : i + 9]) AS n, w[i] AS one, list_distinct(w[i : i + 9]) AS terms
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
), ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)
), m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
wk AS (SELECT DISTINCT k, one, terms FROM bw),
held AS (
  SELECT doc_id, k, one, terms
  FROM (SELECT DISTINCT doc_id, unnest(w) AS t FROM d) JOIN (SELECT k, one, terms, unnest(terms) AS t FROM wk) USING (t)
  GROUP BY ALL HAVING count(*) = len(terms)
), near AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_near
  FROM (SELECT doc_id, k, one, terms, w, unnest(range(1, len(w) + 1)) AS i FROM held JOIN d USING (doc_id)) p JOIN bw USING (k)
  WHERE w[i] = p.one AND list_has_all(w[greatest(1, i - {DISTANCE}) : i + {DISTANCE}], p.terms) GROUP BY doc_id
), it AS (SELECT doc_id, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN near USING (doc_id)
"""
