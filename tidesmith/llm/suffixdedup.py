"""Suffix-array dedup of byte strings: sampled suffixes, range-partitioned, sorted locally, compared across boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesmith.llm.common import keep, n_partitions, slices, table

LEAST = 100
#: Bytes of the token at which a sampled suffix starts, and of them the leading ones that order suffixes; suffixes of one token (or of several) that a task sorts at once.
TOKEN, LEAD, BUCKET_SUFFIXES = 32, 8, 500_000
#: Windows of a text that are sampled at once; a place among them has so many bits.
_STRIDE, _PLACE_BITS = 1 << 22, 23
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lead, token, lo, hi) of a text of any length: those of stretches of _STRIDE windows, none of which is left out or split."""
    parts = [(f, t, lo + i, hi + i) for i in range(0, max(1, len(raw) - LEAST + 1), _STRIDE) for f, t, lo, hi in [_anchors(raw[i : i + _STRIDE + LEAST - 1])]]
    return tuple(np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]


def _anchors(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lead, token, lo, hi): the sampled suffixes of a text and the windows of LEAST bytes that each stands for.

    A window's sample is the TOKEN bytes in it whose hash is least (the leftmost of equals), so equal windows have their
    sample at the same place, and windows lo..hi have the same one. lead is the first LEAD bytes of the sample as a number
    of the same order, token the hash of all TOKEN bytes.
    """
    n = len(raw)
    if n < LEAST:
        none = np.empty(0, np.int64)
        return none, none, none, none
    h, size = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1), 1
    while size < TOKEN:
        h = (h[:-size] * _A) ^ (h[size:] * _B) ^ (h[:-size] >> np.uint64(31))
        size *= 2
    h = (h ^ (h >> np.uint64(33))) * _A
    m = (h & ~np.uint64((1 << _PLACE_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
    width, size = LEAST - TOKEN + 1, 1
    while 2 * size <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if width > size:
        m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
    at = (m & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    lo = np.flatnonzero(np.diff(at, prepend=-1))
    hi = np.append(lo[1:] - 1, len(at) - 1)
    at = at[lo]
    first = np.frombuffer(raw, np.uint8)[at[:, None] + np.arange(LEAD)]
    lead = np.ascontiguousarray(first).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)  # signed longs sort as the bytes do
    return lead.view(np.int64), h[at].view(np.int64), lo, hi


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lead, token, context, doc_id, lo, hi): context is the hash of the bytes of all windows lo..hi."""
    for part in slices(batches, 512):
        rows: list[list] = [[] for _ in range(6)]
        for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
            if doc is None or not text:
                continue
            raw = text.encode("utf-8", "surrogatepass")
            lead, token, lo, hi = anchors(raw)
            context = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(lo.tolist(), (hi + LEAST).tolist())), np.uint64, len(lo))
            for column, x in zip(rows, (lead, token, context.view(np.int64), np.full(len(lo), doc, np.int64), lo, hi)):
                column.append(x)
        arrays = [np.concatenate(x) if x else np.empty(0, np.int64) for x in rows]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["lead", "token", "context", "doc_id", "lo", "hi"])


def _compare_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted bucket of (lead, token, context, doc_id, lo, hi): rows that repeat (again), and first ones whose token has other contexts (not again).

    What stands at either end of a bucket may go on in the next one: its first and its last context are passed on as ones
    to compare, so that nothing is decided across a boundary here.
    """

    def out(rows: np.ndarray, again: bool) -> pa.RecordBatch:
        lead, token, _, doc, lo, hi = rows
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (lead, token, doc, lo, hi)] + [pa.array(np.full(len(token), again))], ["lead", "token", "doc_id", "lo", "hi", "again"])

    held, held_other = None, False  # the first row of the last context so far; whether its token has another context
    for batch in batches:
        x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)])
        if not x.shape[1]:
            continue
        start = held is None
        if not start:
            x = np.concatenate([held[:, None], x], axis=1)
        new = np.append(True, (x[1, 1:] != x[1, :-1]) | (x[2, 1:] != x[2, :-1]))
        at = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        first = x[:, at]
        yield out(x[:, ~new & ((x[3] != first[3][run]) | (x[4] != first[4][run]))], True)
        same = first[1, 1:] == first[1, :-1]
        other = np.append(start or held_other, same) | np.append(same, False)
        yield out(first[:, :-1][:, other[:-1]], False)
        held, held_other = first[:, -1], bool(other[-1])
    if held is not None:
        yield out(held[:, None], False)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lead, token, doc_id, lo, hi, raw): the bytes of the windows of each suffix that is left to compare."""
    for part in slices(batches):
        rows: list[list] = [[] for _ in range(6)]
        for doc, text, own in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "own"))):
            raw = text.encode("utf-8", "surrogatepass")
            for s in own:
                for column, x in zip(rows, (s["lead"], s["token"], doc, s["lo"], s["hi"], raw[s["lo"] : s["hi"] + LEAST])):
                    column.append(x)
        kinds = (*[pa.int64()] * 5, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], ["lead", "token", "doc_id", "lo", "hi", "raw"])


def repeated_suffixes(token: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of windows whose LEAST bytes also start earlier in these contexts.

    A multikey quicksort by eight bytes at a time, all groups together: a round sorts the suffixes that are still equal by
    their next eight bytes, and those that stand alone leave. What is left in a group after LEAST bytes is equal.
    """
    text = np.frombuffer(b"".join(raw) + bytes(8), np.uint8).astype(np.uint64)
    word = np.zeros(len(text) - 7, np.uint64)
    for i in range(8):
        word = (word << np.uint64(8)) | text[i : len(text) - 7 + i]
    count = hi - lo + 1
    of = np.repeat(np.arange(len(lo)), count)
    step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    base = np.cumsum([0, *(len(r) for r in raw[:-1])])[of] + step
    group, alive = np.unique(token, return_inverse=True)[1][of], np.arange(len(of))
    for at in [*range(0, LEAST - 8, 8), LEAST - 8]:
        key = word[base[alive] + at]
        order = np.lexsort((key, group))
        alive, key, group = alive[order], key[order], group[order]
        new = np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))[: len(alive)]
        number = np.cumsum(new) - 1
        many = np.bincount(number, minlength=1)[number] > 1 if len(alive) else new
        alive, group = alive[many], number[many]
    docs, starts = doc[of[alive]], (lo[of] + step)[alive]
    order = np.lexsort((starts, docs, group))
    docs, starts, group = docs[order], starts[order], group[order]
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
    size = np.diff(np.append(head, len(group)))
    later = (docs != np.repeat(docs[head], size)) | (starts != np.repeat(starts[head], size))
    return docs[later], starts[later]


def _spans(docs: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
    """Windows that start one after another as one span."""
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    new = np.append(True, (docs[1:] != docs[:-1]) | (starts[1:] > starts[:-1] + LEAST))[: len(docs)]
    at = np.flatnonzero(new)
    last = np.append(at[1:] - 1, len(docs) - 1)[: len(at)]
    return pa.RecordBatch.from_arrays([pa.array(docs[at]), pa.array(starts[at]), pa.array(starts[last] + LEAST)], ["doc_id", "lo", "hi"])


def _sort_buckets(limit: int):
    """Task: a bucket sorted by token; whole tokens are taken up to `limit` suffixes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(rows: list[tuple]) -> pa.RecordBatch:
            token, doc, lo, hi = (np.array([r[i] for r in rows], np.int64) for i in range(4))
            return _spans(*repeated_suffixes(token, doc, lo, hi, [r[4] for r in rows]))

        windows = 0
        for part in slices(batches, 4096):
            for row in zip(*(part.column(c).to_pylist() for c in ("token", "doc_id", "lo", "hi", "raw"))):
                if windows >= limit and row[0] != held[-1][0]:
                    yield done(held)
                    held, windows = [], 0
                held.append(row)
                windows += row[3] - row[2] + 1
        if held:
            yield done(held)

    return run


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(prefix, doc_id, lo): each window of each context as a suffix of its own."""
    for part in slices(batches, 512):
        doc, lo, hi, raw = (part.column(c).to_pylist() for c in ("doc_id", "lo", "hi", "raw"))
        rows = [(r[i : i + LEAST], d, a + i) for d, a, b, r in zip(doc, lo, hi, raw) for i in range(b - a + 1)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["prefix", "doc_id", "lo"])


def _compare_dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket sorted by (prefix, doc_id, lo): suffixes that come after the first of their prefix here (prefix null), and two that face the buckets beside it.

    Those two are the first suffix of the bucket and the first of its last prefix, with their prefixes: what a prefix over
    several buckets has in all of them is settled by comparing these.
    """

    def out(prefix: list, doc: list, lo: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(prefix, pa.binary()), pa.array(doc, pa.int64()), pa.array(lo, pa.int64())], ["prefix", "doc_id", "lo"])

    edge = first = None
    for part in slices(batches, 8192):
        docs, los = [], []
        for row in zip(*(part.column(c).to_pylist() for c in ("prefix", "doc_id", "lo"))):
            edge = edge or row
            if first is None or row[0] != first[0]:
                first = row
            elif row != first:
                docs.append(row[1]), los.append(row[2])
        yield out([None] * len(docs), docs, los)
    if edge:
        yield out(*zip(*({edge, first})))


def _repeated_dense(dense: DataFrame) -> DataFrame:
    """(doc_id, lo) of suffixes (prefix, doc_id, lo) whose prefix also starts earlier.

    Sampled splitters cut them by all three columns, so a prefix of many suffixes lies in several buckets; of each bucket
    two suffixes at most are compared with those of others.
    """
    order = ["prefix", "doc_id", "lo"]
    cut = dense.repartitionByRange(n_partitions(dense.sparkSession), *order).sortWithinPartitions(*order)
    judged = keep(cut.mapInArrow(_compare_dense, "prefix binary, doc_id long, lo long"))
    edges = judged.where("prefix is not null")
    first = edges.groupBy("prefix").agg(F.min(F.struct("doc_id", "lo")).alias("first"))
    late = edges.join(first, "prefix").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("lo") != F.col("first.lo")))
    return judged.where("prefix is null").select("doc_id", "lo").union(late.select("doc_id", "lo"))


def repeated_spans(docs: DataFrame, bucket: int = BUCKET_SUFFIXES) -> DataFrame:
    """(doc_id, lo, hi): byte spans made of windows of LEAST bytes that also start earlier.

    Suffixes are sampled by content (see anchors): each stands for the windows around it, so one of about 33 is moved.
    Sampled splitters (repartitionByRange) cut the suffixes, ordered by their leading bytes (hashes of the whole token and of
    what surrounds it settle ties), into buckets; a token that a third of all texts hold is spread over many. A sorted bucket
    settles whole contexts that repeat. Where a token has several contexts, their first ones are left: their bytes are fetched,
    cut in the same order, and every suffix in them is sorted by multikey quicksort. Tokens with more than `bucket` suffixes are
    cut suffix by suffix by all their LEAST bytes instead, with no limit on how many buckets one prefix takes.
    """
    spark, n = docs.sparkSession, n_partitions(docs.sparkSession)
    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    sampled = rows.mapInArrow(_samples, "lead long, token long, context long, doc_id long, lo long, hi long")
    order = ["lead", "token", "context", "doc_id", "lo"]
    cut = sampled.repartitionByRange(n, *order).sortWithinPartitions(*order)
    judged = keep(cut.mapInArrow(_compare_neighbours, "lead long, token long, doc_id long, lo long, hi long, again boolean"))
    settled = judged.where("again").select("doc_id", "lo", (F.col("hi") + LEAST).alias("hi"))
    left = judged.where("not again").drop("again")
    hot = left.groupBy("token").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("n")).where(F.col("n") > bucket).select("token")
    hot = F.broadcast(keep(hot))  # at most (all suffixes that are left) / bucket rows
    own = left.groupBy("doc_id").agg(F.collect_list(F.struct("lead", "token", "lo", "hi")).alias("own"))
    contexts = keep(rows.join(own, "doc_id").select("doc_id", "text", "own").mapInArrow(_contexts, "lead long, token long, doc_id long, lo long, hi long, raw binary"))
    cold = contexts.join(hot, "token", "left_anti").repartitionByRange(n, "lead", "token").sortWithinPartitions("lead", "token")
    found = cold.select("token", "doc_id", "lo", "hi", "raw").mapInArrow(_sort_buckets(bucket), "doc_id long, lo long, hi long")
    dense = contexts.join(hot, "token", "left_semi").select("token", "doc_id", "lo", "hi", "raw").mapInArrow(_dense, "prefix binary, doc_id long, lo long")
    return settled.union(found).union(_repeated_dense(dense).select("doc_id", "lo", (F.col("lo") + LEAST).alias("hi")))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        rows: list[list] = [[] for _ in range(6)]
        for doc, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
            raw = (text or "").encode("utf-8", "surrogatepass")
            merged: list[list[int]] = []
            for a, b in sorted((s["lo"], s["hi"]) for s in spans or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            ends = [0, *(b for _, b in merged)]
            left = b"".join(raw[x:y] for x, y in zip(ends, [*(a for a, _ in merged), len(raw)]))
            for column, x in zip(rows, (doc, len(raw), len(raw) - len(left), len(merged), left, [{"lo": a, "hi": b} for a, b in merged])):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "removed"])


def drop_repeated_bytes(docs: DataFrame, bucket: int = BUCKET_SUFFIXES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, removed): each whole text as UTF-8 without the bytes that repeat earlier ones.

    A byte goes if a string of LEAST bytes that covers it also starts earlier: in a smaller doc_id, or earlier in the same
    document. Strings never cross documents and are judged on the input. kept: the bytes left, one after another;
    removed: the maximal removed runs. Null text: empty. Rows of null doc_id are neither matched nor cut. doc_id must
    identify a text: equal rows count as one document. An empty table gives an empty result.
    """
    spans = repeated_spans(docs, bucket).groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = docs.select("doc_id", "text").join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<lo:long,hi:long>>")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
