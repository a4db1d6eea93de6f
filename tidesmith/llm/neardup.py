"""Near duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidesmith.llm.common import components, keep, n_partitions, slices, table, words

SHINGLE, SIMILAR = 5, 0.8
#: Bands and samples of a band: two texts of similarity s share a band with probability 1 - (1 - s**ROWS)**BANDS, 0.998 at 0.8.
BANDS, ROWS = 12, 4
#: Buckets of the word frequencies; entries of the pool of random numbers.
IDF_BITS, POOL_BITS = 16, 16
#: Samples of BANDS * ROWS that must agree in a byte before texts are compared: at similarity 0.8 fewer agree with probability 0.0005.
AGREE = 29
#: Partners of a document in the first round; the second one does not depend on them.
NEAREST = 2
#: Members of a bucket, and members outside its largest component, that one cell compares.
BLOCK = 256
_MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def _word_hashes(text: str | None, of: _Hashes) -> np.ndarray:
    w = words(text)
    return np.fromiter(map(of.__getitem__, w), np.uint64, len(w))


# --- document frequencies ---------------------------------------------------------------------------------------------


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of, counts, n = _Hashes(), np.zeros(1 << IDF_BITS, np.int64), 0
    for part in slices(batches):
        for text in part.column("text").to_pylist():
            counts[np.unique(_word_hashes(text, of) >> np.uint64(64 - IDF_BITS))] += 1
            n += 1
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], n))], ["bucket", "n"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """idf of each of the 2 ** IDF_BITS buckets that words are hashed to, from all documents.

    Every task sums up before it sends, so the size of what is moved depends on the buckets alone. Rare words share the
    share of their bucket; frequent words dominate theirs.
    """
    rows = docs.select("text").mapInArrow(_frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    count = {r["bucket"]: r["n"] for r in rows}
    df = np.zeros(1 << IDF_BITS)
    total = count.pop(-1, 0)
    df[list(count)] = list(count.values())
    return (np.log((1 + total) / (1 + df)) + 0.1).astype(np.float32)


def weighted_shingles(text: str | None, idf: np.ndarray, of: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, weights) of a whole text's distinct shingles, sorted: times a shingle stands there, by the mean idf of its words.

    A text of fewer than SHINGLE words, but not none, is one shingle.
    """
    h = _word_hashes(text, of)
    if not len(h):
        return h, np.empty(0, np.float32)
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    weight = idf[(h >> np.uint64(64 - IDF_BITS)).astype(np.int64)]
    code, mean = np.zeros(n, np.uint64), np.zeros(n, np.float32)
    for i in range(size):
        code = (code ^ h[i : i + n]) * _MULTIPLIERS[i]
        code ^= code >> np.uint64(29)
        mean += weight[i : i + n]
    code, first, times = np.unique(code, return_index=True, return_counts=True)
    return code, times * mean[first] / np.float32(size)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    wa, wb = a[1].astype(np.float64), b[1].astype(np.float64)
    low = np.minimum(wa[i], wb[j]).sum()
    whole = wa.sum() + wb.sum() - low
    return float(low / whole) if whole > 0 else 0.0


# --- signatures -------------------------------------------------------------------------------------------------------


class Sampler:
    """BANDS * ROWS consistent weighted samples: of each, the shingle of the least a and the t at which its weight stands.

    The numbers r, c ~ Gamma(2, 1) and beta ~ U(0, 1) of a shingle and a sample come from a pool by a hash of both.
    """

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        size = 1 << POOL_BITS
        self.r = rng.gamma(2, 1, size).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, size)).astype(np.float32)
        self.beta = rng.random(size).astype(np.float32)
        self.odd = rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def bands(self, shingles: tuple[np.ndarray, np.ndarray]) -> tuple[list[int], list[int]]:
        """BANDS hashes of a text that has shingles, and its sketch: a byte of each sample, eight to an integer."""
        code, weight = shingles
        k = BANDS * ROWS
        best, at, t_at = np.full(k, np.inf, np.float32), np.zeros(k, np.uint64), np.zeros(k, np.int64)
        for i in range(0, len(code), 1024):
            c, log_w = code[i : i + 1024], np.log(weight[i : i + 1024])
            pick = ((c[:, None] * self.odd[None, :]) >> np.uint64(64 - POOL_BITS)).astype(np.int32)
            r, beta = self.r[pick], self.beta[pick]
            t = np.floor(log_w[:, None] / r + beta)
            log_a = self.log_c[pick] - r * (t - beta + 1)
            low = log_a.argmin(0)
            own = log_a[low, np.arange(k)]
            won = own < best
            best[won], at[won], t_at[won] = own[won], c[low[won]], t[low[won], np.flatnonzero(won)].astype(np.int64)
        sample = ((at + t_at.astype(np.uint64) * _MULTIPLIERS[0]) * _MULTIPLIERS[1]).reshape(BANDS, ROWS)
        out = np.arange(BANDS, dtype=np.uint64) * _MULTIPLIERS[2]
        for j in range(ROWS):
            out = (out ^ sample[:, j]) * _MULTIPLIERS[j]
            out ^= out >> np.uint64(31)
        sketch = (sample >> np.uint64(56)).astype(np.uint8).reshape(-1).view("<i8")
        return out.view(np.int64).tolist(), sketch.tolist()


def _signatures(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sampler = _Hashes(), Sampler()
        last: dict[tuple, tuple] = {}
        for part in slices(batches):
            ids, g1, g2, bands, sketches = [], [], [], [], []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                w = words(text)
                if doc is None or not w:
                    continue
                d = _digest(w)
                if d not in last:
                    if len(last) > 5000:
                        last.clear()
                    last[d] = sampler.bands(weighted_shingles(text, idf, of))
                ids.append(doc), bands.append(last[d][0]), sketches.append(last[d][1])
                g1.append(d[0]), g2.append(d[1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(g1, pa.int64()), pa.array(g2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], ["doc_id", "g1", "g2", "bands", "sketch"])

    return run


def _digest(w: list[bytes]) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(b" ".join(w))
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _own_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) of rows whose words are those of (g1, g2)."""
    for part in slices(batches):
        text = part.column("text")
        on = [_digest(words(t)) == (g1, g2) for t, g1, g2 in zip(text.to_pylist(), part.column("g1").to_pylist(), part.column("g2").to_pylist())]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), text], ["doc_id", "text"]).filter(pa.array(on, pa.bool_()))


def _similarities(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, kept = _Hashes(), {}

        def shingles(doc: int, text: str) -> tuple:
            if doc not in kept:
                if len(kept) >= 64:
                    kept.pop(next(iter(kept)))
                kept[doc] = weighted_shingles(text, idf, of)
            return kept[doc]

        for part in slices(batches):
            a, b, ta, tb = (part.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            s = [weighted_jaccard(shingles(x, u), shingles(y, v)) for x, y, u, v in zip(a, b, ta, tb)]
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(s, pa.float64())], ["a", "b", "s"])

    return run


# --- links ------------------------------------------------------------------------------------------------------------


def _verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(a, b, s) of pairs (a, b): their weighted Jaccard similarity."""
    text = lambda c: texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}"))
    sided = pairs.join(text("b"), "b").join(text("a"), "a")
    return keep(sided.select("a", "b", "text_a", "text_b").mapInArrow(_similarities(idf), "a long, b long, s double"))


def _sketches(column: pa.Array) -> np.ndarray:
    """Rows of BANDS * ROWS bytes of an array<long> column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("<i8")
    return flat.view(np.uint8).reshape(len(column), BANDS * ROWS)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task over (bucket, doc_id, sketch) in order: (doc_id, a, b, n) of each row with the row before it and the first of its bucket here."""
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        sketch = _sketches(batch.column(2))
        if last is not None:  # the row before and the first of its bucket come again at the head of this batch
            bucket, doc, sketch = (np.concatenate([x, y]) for x, y in zip(last, (bucket, doc, sketch)))
        at = np.arange(len(bucket))
        start = np.maximum.accumulate(np.where(np.append(True, bucket[1:] != bucket[:-1]), at, 0))
        own = at[(0 if last is None else 2) :]
        i, j = np.concatenate([own, own]), np.concatenate([np.maximum(own - 1, 0), start[own]])
        on = (bucket[i] == bucket[j]) & (doc[i] != doc[j])
        i, j = i[on], j[on]
        n = (sketch[i] == sketch[j]).sum(1)
        on = n >= AGREE
        i, j, n = i[on], j[on], n[on]
        yield pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(np.minimum(doc[i], doc[j])), pa.array(np.maximum(doc[i], doc[j])), pa.array(n.astype(np.int32))], ["doc_id", "a", "b", "n"])
        ends = [start[-1], len(at) - 1]
        last = bucket[ends], doc[ends], sketch[ends]


def _first_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b): of each document the NEAREST that agree with its sketch in most samples, among those before it and the first of its buckets.

    A bucket is sorted by its sketches, begun at another integer in different buckets: neighbours agree in a long run of samples,
    so each of thousands of near copies soon meets some of those most like it, at the cost of sorting. Sampled splitters cut
    wide buckets too; what would meet across a cut is left to the second round.
    """
    n = BANDS * ROWS // 8
    turn = F.pmod("bucket", F.lit(n)).cast("int")
    turned = F.concat(F.slice("sketch", turn + 1, F.lit(n)), F.slice("sketch", F.lit(1), turn)).alias("turned")
    order = ["bucket", "turned", "doc_id"]
    cut = buckets.select("bucket", "doc_id", "sketch", turned).repartitionByRange(n_partitions(buckets.sparkSession), *order).sortWithinPartitions(*order)
    close = cut.select("bucket", "doc_id", "sketch").mapInArrow(_neighbours, "doc_id long, a long, b long, n int")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "a", "b"))
    best = close.dropDuplicates(["doc_id", "a", "b"]).withColumn("place", place).where(F.col("place") <= NEAREST)
    return best.select("a", "b").distinct()


def _cells(members: DataFrame) -> DataFrame:
    """(bucket, i, j, doc_id, root, member, head, bands, sketch): the cells of all buckets of members with a root other than big.

    Heads are the members outside the largest component of their bucket. Both are dealt by a hash, BLOCK to a block, and every block of
    members meets every block of heads: no pair of two components is left out, and no task ever holds more than a cell of
    a wide bucket. A bucket of up to BLOCK members is one cell, in which each member stands once.
    """
    head = (F.col("root") != F.col("big")).alias("head")
    rows = members.select("bucket", "doc_id", "root", "bands", "sketch", head)
    size = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.count_if("head").alias("h")).where(F.col("n") > BLOCK)
    wide = keep(size.select("bucket", F.ceil(F.col("n") / BLOCK).alias("across"), F.ceil(F.col("h") / BLOCK).alias("down")))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), k - 1))
    of, cols = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), ["bucket", "i", "j", "doc_id", "root", "member", "head", "bands", "sketch"]
    zero, yes, no = F.lit(0).cast("long"), F.lit(True), F.lit(False)
    narrow = rows.join(wide, "bucket", "left_anti").withColumns({"i": zero, "j": zero, "member": yes}).select(cols)
    broad = rows.join(wide, "bucket")
    across = broad.withColumns({"i": of % F.col("across"), "member": yes}).withColumn("head", no).withColumn("j", every(F.col("down"))).select(cols)
    down = broad.where("head").withColumns({"j": of % F.col("down"), "member": no}).withColumn("i", every(F.col("across"))).select(cols)
    return narrow.unionByName(across).unionByName(down)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of equal first `keys` columns of a sorted stream, one table for each; only one is held."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            now = tuple(key[:, a])
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def _to_meet(bucket: int, root: np.ndarray, member: np.ndarray, head: np.ndarray, bands: np.ndarray, sketch: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(head, members) of a cell that are to be compared: of two components, their sketches agree, and this bucket is the first that they share."""
    band = int(np.flatnonzero((bands == bucket).all(0))[0])
    on, out = np.flatnonzero(member), []
    for h in np.flatnonzero(head):
        m = on[root[on] != root[h]]
        m = m[(sketch[m] == sketch[h]).sum(1) >= AGREE]
        m = m[(bands[m, :band] != bands[h, :band]).all(1)]
        if len(m):
            out.append((int(h), m))
    return out


def _cell(table_: pa.Table) -> tuple:
    bucket, _, _, _, root, member, head = (table_.column(i).to_numpy() for i in range(7))
    bands = table_.column(7).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)
    return int(bucket[0]), root, member, head, bands, _sketches(table_.column(8).combine_chunks())


def _open_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of cells in order that have someone to meet."""
    for t in _groups(batches, 3):
        on = np.zeros(t.num_rows, bool)
        for h, m in _to_meet(*_cell(t)):
            on[h] = True
            on[m] = True
        if on.any():
            yield from t.filter(pa.array(on)).combine_chunks().to_batches()


def _joined(idf: np.ndarray, least: float):
    """Task over cells with texts: links (a, b) that join the components of a cell, at most one for each component less one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _Hashes()
        for t in _groups(batches, 3):
            bucket, root, member, head, bands, sketch = _cell(t)
            doc, texts = t.column(3).to_numpy(), t.column(9)
            shingles: dict[int, tuple] = {}
            up: dict[int, int] = {}

            def top(x: int) -> int:
                while up.get(x, x) != x:
                    up[x] = up.get(up[x], up[x])
                    x = up[x]
                return x

            def weights(i: int) -> tuple:
                if i not in shingles:
                    code, w = weighted_shingles(texts[i].as_py(), idf, of)
                    shingles[i] = code, w.astype(np.float64), float(w.sum(dtype=np.float64))
                return shingles[i]

            links = []
            for h, m in _to_meet(bucket, root, member, head, bands, sketch):
                own = weights(h)
                m = [i for i in m.tolist() if top(int(root[i])) != top(int(root[h]))]
                parts = [weights(i) for i in m]
                if not m:
                    continue
                ends = np.cumsum([len(p[0]) for p in parts])
                code = np.concatenate([p[0] for p in parts])
                at = np.minimum(np.searchsorted(own[0], code), len(own[0]) - 1)
                low = np.where(own[0][at] == code, np.minimum(own[1][at], np.concatenate([p[1] for p in parts])), 0.0)
                low = np.add.reduceat(low, np.append(0, ends[:-1]))
                s = low / np.maximum(own[2] + np.array([p[2] for p in parts]) - low, 1e-300)
                for k in np.flatnonzero(s >= least):
                    x, y = top(int(root[m[k]])), top(int(root[h]))
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        links.append((int(doc[h]), int(doc[m[k]])))
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots after links (a, b) have joined components."""
    at = lambda c: roots.select(F.col("doc_id").alias(c), F.col("root").alias(f"root_{c}"))
    joined = keep(links.join(at("a"), "a").join(at("b"), "b").select("root_a", "root_b"))
    if not joined.head(1):
        return roots
    moved = components(joined, "root_a", "root_b").select(F.col("id").alias("root"), F.col("root").alias("to"))
    return keep(roots.join(moved, "root", "left").select("doc_id", F.coalesce("to", "root").alias("root")))


def classes(buckets: DataFrame, texts: DataFrame, idf: np.ndarray, least: float = SIMILAR) -> DataFrame:
    """(doc_id, root): of each document in a bucket, the smallest doc_id of the component that verified links give.

    buckets: (bucket, doc_id, bands, sketch), texts: (doc_id, text). Texts are compared where sketches agree in AGREE samples.
    The first round compares each document with a few neighbours, which joins most of a group of near copies at the cost of sorting.
    The second one is exhaustive: in each bucket that lies in several components, the members outside the largest one
    meet all members of other components, in cells of bounded size (see _cells), each pair in the first bucket that it shares. Cells send
    links that join components, never pairs, and only texts with someone to meet are moved.
    """
    spark = buckets.sparkSession
    roots = buckets.select("doc_id").distinct().withColumn("root", F.col("doc_id"))
    first = _verified(_first_pairs(buckets), texts, idf)
    roots = _merged(keep(roots), first.where(F.col("s") >= least).select("a", "b"))
    n, key = n_partitions(spark), ["bucket", "i", "j"]
    cells = _cells(_open(buckets.join(roots, "doc_id"))).repartition(n, *key).sortWithinPartitions(*key)
    kinds = "bucket long, i long, j long, doc_id long, root long, member boolean, head boolean, bands array<long>, sketch array<long>"
    left = keep(cells.mapInArrow(_open_rows, kinds))
    full = left.join(texts, "doc_id").select(*left.columns, "text").repartition(n, *key).sortWithinPartitions(*key)
    return _merged(roots, full.mapInArrow(_joined(idf, least), "a long, b long"))


def _open(members: DataFrame) -> DataFrame:
    """members of buckets that lie in several components, with the root of the largest as big."""
    parts = members.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    big = parts.groupBy("bucket").agg(F.max(F.struct("n", (-F.col("root")).alias("neg"))).alias("big"), F.count("*").alias("parts")).where("parts > 1")
    return keep(members.join(big.select("bucket", (-F.col("big.neg")).alias("big")), "bucket"))


def near_duplicates(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id): one row per row of docs; class_id is the smallest doc_id of its class.

    Classes are the connected components of pairs with weighted Jaccard similarity >= least over TF-IDF weighted shingles
    of five words (see inverse_frequencies). Texts of the same words are one class from the start and enter the search
    once, so thousands of copies cost no more than one text. Texts without words (null and empty too) are alone, as are rows
    of null doc_id, whose class_id is null. Rows that share a doc_id get the smallest of their texts' classes; where they have
    different texts, one text (the least digest) is searched under that doc_id beside those that other documents hold too.
    """
    rows = docs.select("doc_id", "text")
    idf = inverse_frequencies(rows)
    signed = keep(rows.mapInArrow(_signatures(idf), "doc_id long, g1 long, g2 long, bands array<long>, sketch array<long>"))
    same = keep(signed.groupBy("g1", "g2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    one = same.groupBy("rep").agg(F.min_by(F.struct("g1", "g2", "bands", "sketch"), F.struct("g1", "g2")).alias("s")).select(F.col("rep").alias("doc_id"), "s.*")
    every = one.select(F.explode(F.array_distinct("bands")).alias("bucket"), "doc_id")
    shared = every.join(every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"), "bucket")
    buckets = keep(shared.join(one.select("doc_id", "bands", "sketch"), "doc_id").select("bucket", "doc_id", "bands", "sketch"))
    nodes = buckets.select("doc_id").distinct().join(one.select("doc_id", "g1", "g2"), "doc_id")
    texts = keep(rows.join(nodes, "doc_id").mapInArrow(_own_texts, "doc_id long, text string").dropDuplicates(["doc_id"]))
    roots = classes(buckets, texts, idf, least)
    rep = same.join(roots, same["rep"] == roots["doc_id"], "left").select("g1", "g2", F.coalesce("root", "rep").alias("class_id"))
    member = signed.select("doc_id", "g1", "g2").join(rep, ["g1", "g2"]).groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    return rows.select("doc_id").join(member, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
