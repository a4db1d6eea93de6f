"""Line dedup: sharded minimal perfect hashes over repeated line hashes, probed by documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesmith.llm.common import keep, slices, table

MIN_CHARS = 10
#: Lines of a shard of the index (at about 30 bytes each), and the most lines of the index that goes to every task.
SHARD_KEYS, HOT_KEYS = 500_000, 100_000
#: Lines that probe one shard.
SHARD_PROBES = 2_000_000
_STRIP, _LEVELS = b" \t\n\x0b\x0c\r", 40


def line_keys(text: str | None) -> tuple[list[bytes], list[tuple[int, int] | None]]:
    """The lines of a text as UTF-8, and for each the 128-bit hash of its key as two longs; None for keys under MIN_CHARS code points.

    bytes.strip and bytes.lower touch ASCII alone: exactly the key's rule.
    """
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    keys: list[tuple[int, int] | None] = []
    for line in lines:
        key = line.strip(_STRIP)
        if len(key) < MIN_CHARS or (len(key) < 4 * MIN_CHARS and len(key.decode("utf-8", "surrogatepass")) < MIN_CHARS):
            keys.append(None)
            continue
        d = xxhash.xxh3_128_digest(key.lower())
        keys.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
    return lines, keys


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, doc_id): one row for each line key of each document."""
    for part in slices(batches, 1024):
        h1, h2, docs = [], [], []
        for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
            if doc is None:
                continue
            for a, b in {k for k in line_keys(text)[1] if k}:
                h1.append(a), h2.append(b), docs.append(doc)
        yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(docs, pa.int64())], ["h1", "h2", "doc_id"])


# --- minimal perfect hash -------------------------------------------------------------------------------------------


def _slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    x = h1.view(np.uint64) + h2.view(np.uint64) * np.uint64(2 * level + 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


def mph_build(h1: np.ndarray, h2: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bit arrays of a minimal perfect hash of distinct (h1, h2), the place of each key, and the keys that no level took.

    A key that is alone in its slot of a level takes it; the others go on to the next level. A key's place is the
    number of taken slots before its own. Two keys share every slot of all levels only if they are equal.
    """
    levels, place, left, base = [], np.empty(len(h1), np.int64), np.arange(len(h1)), 0
    for level in range(_LEVELS):
        if not len(left):
            break
        size = max(64, 2 * len(left))
        at = _slot(h1[left], h2[left], level, size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        won = alone[at]
        before = np.cumsum(alone) - alone
        place[left[won]] = base + before[at[won]]
        base += int(alone.sum())
        levels.append(alone)
        left = left[~won]
    place[left] = base + np.arange(len(left))
    return levels, place, left


class Index:
    """A shard: the levels of the hash as bits, and by place a fingerprint (the second hash), a count and the owner."""

    def __init__(self, bits: bytes, sizes: bytes, rest: bytes, prints: bytes, counts: bytes, owners: bytes):
        sizes_ = np.frombuffer(sizes, np.int64)
        self.levels, self.before, at, base = [], [], 0, 0
        packed = np.frombuffer(bits, np.uint8)
        for size in sizes_:
            n = (int(size) + 7) // 8
            taken = np.unpackbits(packed[at : at + n], count=int(size)).astype(bool)
            self.levels.append(taken)
            self.before.append(base + np.cumsum(taken, dtype=np.int32) - taken)
            at, base = at + n, base + int(taken.sum())
        self.rest = {tuple(k): base + i for i, k in enumerate(np.frombuffer(rest, np.int64).reshape(-1, 2).tolist())}
        self.prints, self.counts, self.owners = np.frombuffer(prints, np.int64), np.frombuffer(counts, np.int32), np.frombuffer(owners, np.int64)

    @staticmethod
    def make(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> tuple:
        levels, place, left = mph_build(h1, h2)
        back = np.empty_like(place)
        back[place] = np.arange(len(place))
        bits = b"".join(np.packbits(x).tobytes() for x in levels)
        rest = np.stack([h1[left], h2[left]], axis=1).astype(np.int64).tobytes()
        sizes = np.array([len(x) for x in levels], np.int64).tobytes()
        few = np.minimum(counts[back], 2**31 - 1).astype(np.int32)
        return bits, sizes, rest, h2[back].tobytes(), few.tobytes(), owners[back].astype(np.int64).tobytes()

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, owner) of each key; count 0 where the fingerprint says the key is not in the index."""
        place, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, (taken, before) in enumerate(zip(self.levels, self.before)):
            if not len(left):
                break
            at = _slot(h1[left], h2[left], level, len(taken)).astype(np.int64)
            hit = taken[at]
            place[left[hit]] = before[at[hit]]
            left = left[~hit]
        for i in left if self.rest else ():
            place[i] = self.rest.get((int(h1[i]), int(h2[i])), -1)
        if not len(self.prints):
            return np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        known = (place >= 0) & (self.prints[place] == h2)
        return np.where(known, self.counts[place], 0), np.where(known, self.owners[place], 0)


SHARD = "shard long, bits binary, sizes binary, rest binary, prints binary, counts binary, owners binary"


def _build_shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    parts = Index.make(*(pdf[c].to_numpy(np.int64) for c in ("h1", "h2", "n", "owner")))
    return pd.DataFrame([(int(key[0]), *parts)], columns=[c.split()[0] for c in SHARD.split(", ")])


def _index_of(pdf: pd.DataFrame) -> Index:
    return Index(*(pdf[c].iloc[0] for c in ("bits", "sizes", "rest", "prints", "counts", "owners")))


def _probes(hot: tuple | None):
    """Task: lines that the hot index decides come out decided (shard -1), all others as a probe of their shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*hot) if hot else None
        for rows in _holders(batches):
            h1, h2, docs = (rows.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            decided = np.zeros(len(h1), bool)
            if index and len(h1):
                n, owner = index.probe(h1, h2)
                decided = n > 0
                keep_ = ~decided | (owner != docs)
                h1, h2, docs, decided = h1[keep_], h2[keep_], docs[keep_], decided[keep_]
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(docs), pa.array(decided)], ["h1", "h2", "doc_id", "decided"])

    return run


def _probe_shard(key: tuple, lines: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    out = lines[["doc_id", "h1"]]
    if not len(shard) or not len(lines):
        return out.iloc[:0]
    h1, h2, docs = (lines[c].to_numpy(np.int64) for c in ("h1", "h2", "doc_id"))
    n, owner = _index_of(shard).probe(h1, h2)
    return out[(n >= 2) & (owner != docs)]


# --- the operator ---------------------------------------------------------------------------------------------------


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(h1, h2, owner, n): line keys of two documents or more, with the smallest doc_id and the number of documents."""
    return (
        docs.select("doc_id", "text").mapInArrow(_holders, "h1 long, h2 long, doc_id long")
        .groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
        .where("owner < last").drop("last")
    )


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, drop): for each document that loses lines, the first hashes of the keys that it loses.

    Keys found in two documents or more are indexed: the many keys of one document can lose no line, and the 64-bit
    fingerprint turns their probes away. Keys by far more frequent than the rest (at most HOT_KEYS, however large the
    input: the least count that counts as hot is the number of holders / HOT_KEYS) are held by an index of a few MB that goes
    to every task, so no shard meets more than that many probes of one key. All other probes go to their shard; there are as many shards
    as keep both its keys and its probes bounded.
    """
    spark = docs.sparkSession
    known = keep(repeated_lines(docs))
    size = known.agg(F.count("*").alias("keys"), F.sum("n").alias("holders")).head()
    if not size["keys"]:
        return spark.createDataFrame([], "doc_id long, drop array<bigint>")
    least = max(100, -(-size["holders"] // HOT_KEYS))
    top = known.where(F.col("n") > least).toPandas()
    hot = Index.make(*(top[c].to_numpy(np.int64) for c in ("h1", "h2", "n", "owner"))) if len(top) else None
    probes = keep(docs.select("doc_id", "text").mapInArrow(_probes(hot), "h1 long, h2 long, doc_id long, decided boolean"))
    cold = probes.where("not decided")
    shards = max(-(-size["keys"] // SHARD_KEYS) * 8, -(-cold.count() // SHARD_PROBES))
    shard = F.pmod(F.col("h1"), F.lit(shards)).alias("shard")
    index = keep(known.where(F.col("n") <= least).withColumn("shard", shard).groupBy("shard").applyInPandas(_build_shard, SHARD))
    cold = cold.select(shard, "h1", "h2", "doc_id")
    found = cold.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_probe_shard, "doc_id long, h1 long")
    found = found.union(probes.where("decided").select("doc_id", "h1"))
    return found.groupBy("doc_id").agg(F.collect_set("h1").alias("drop"))


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kept_text, n_lines and n_dropped beside all columns of the batch but drop."""
    for part in slices(batches, 1024):
        kept, total, gone = [], [], []
        for text, drop in zip(part.column("text").to_pylist(), part.column("drop").to_pylist()):
            lines, keys = line_keys(text)
            if drop:
                lost = set(drop)
                left = [line for line, k in zip(lines, keys) if not (k and k[0] in lost)]
            else:
                left = lines
            kept.append(b"\n".join(left).decode("utf-8", "surrogatepass"))
            total.append(len(lines)), gone.append(len(lines) - len(left))
        rest = [i for i, name in enumerate(part.schema.names) if name != "drop"]
        yield pa.RecordBatch.from_arrays(
            [*(part.column(i) for i in rest), pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
            [*(part.schema.names[i] for i in rest), "kept_text", "n_lines", "n_dropped"],
        )


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with kept_text, n_lines and n_dropped; columns of those names are replaced.

    Lines whose key (ASCII white space stripped, A-Z lower-cased) has 10 code points or more and is found in two documents
    or more stay only in the smallest doc_id that holds it. Null or empty text: one empty line. Rows of null doc_id come
    back whole and hold no line; rows that share a doc_id count as one document. An empty table gives an empty table.
    """
    cols = [c for c in docs.columns if c not in ("drop", "kept_text", "n_lines", "n_dropped")]
    joined = docs.select(*cols).join(dropped_lines(docs), "doc_id", "left").select(*cols, "drop")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", kept_text string, n_lines long, n_dropped long"
    return joined.mapInArrow(_rewrite, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), r AS (
  SELECT k, min(doc_id) AS owner FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), d AS (
  SELECT l.*, r.owner IS NOT NULL AND r.owner <> l.doc_id AS gone FROM l LEFT JOIN r ON l.k = r.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
