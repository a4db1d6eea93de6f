"""Importance resampling towards a target: weights from hashed n-grams, a cutoff found by counting, ranks by range partitions."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidesmith.llm.common import keep, n_partitions, portions, table, words
from tidesmith.llm.fim import drawn

#: Buckets of features, words of the longest feature, percent of the eligible documents that are drawn, words of an eligible one, seed.
BUCKETS, GRAMS, SHARE, LEAST_WORDS, SEED = 10_000, 2, 25, 20, 7
#: Thresholds that one counting job tests: each job halves the range four times.
PROBES = 15
_LAST_ID = (1 << 63) - 1


def _features(text: str | None, buckets: int, grams: int) -> tuple[np.ndarray, int]:
    """(bucket of each run of 1 to `grams` words, number of words). A run's crc32 goes on from that of the run without its last word."""
    own = words(text)
    crcs = list(map(zlib.crc32, own))
    out, tails = [np.array(crcs, np.int64)], [b" " + w for w in own]
    for k in range(1, min(grams, len(own))):
        crcs = list(map(zlib.crc32, tails[k:], crcs))
        out.append(np.array(crcs, np.int64))
    return np.concatenate(out) % buckets, len(own)


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket. A task sends its sums, at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in portions(batches, "text"):
            every = [_features(text, buckets, grams)[0] for text in part.column("text").to_pylist()]
            total += np.bincount(np.concatenate(every), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS, grams: int = GRAMS) -> np.ndarray:
    """A thousandth-log gain for each bucket: how much likelier the target is to have its features, both counts raised by one.

    What reaches the driver is one number a bucket, whatever the size of the texts.
    """
    count = []
    for texts in (raw, target):
        n = np.zeros(buckets, np.int64)
        for r in bucket_counts(texts, buckets, grams).collect():
            n[r["bucket"]] = r["n"]
        count.append(n)
    s, t = count
    whole_s, whole_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * whole_s / ((float(a) + 1) * whole_t))) for a, b in zip(s, t)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, grams: int = GRAMS) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of a text's features; 0 without any."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            rows = []
            for text in part.column("text").to_pylist():
                at, n = _features(text, buckets, grams)
                rows.append((n, len(at), int(gain[at].sum()) // len(at) if len(at) else 0))
            own = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(x) for x in own.T.copy())], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """A draw of the Gumbel distribution in thousandths, floored, from the hash of the id."""
    u = (drawn(doc_id, seed, 1)[0].cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u))).cast("long")


def bisect(count: Callable[[list[int]], list[int]], low: int, high: int, wanted: int, probes: int = PROBES) -> int:
    """The least x in [low, high] with count(x) >= wanted, of counts that never fall as x rises; high's is known to reach it.

    count takes several thresholds, so that one job over the data does for several halvings.
    """
    while low < high:
        step = max(1, -(-(high - low) // (probes + 1)))
        at = list(range(low + step - 1, high, step))[:probes]
        for x, n in zip(at, count(at)):
            if n >= wanted:
                high = x
                break
            low = x + 1
    return low


def draw(scored: DataFrame, k: int) -> DataFrame:
    """scored (doc_id, eligible, score, ...) and rank: 1 to k by falling score and rising doc_id among the eligible, null for all others.

    scored is a kept table, read once for each counting job. The k-th score is found by bisection over scores, and among the rows that tie there
    the last doc_id by bisection over ids; no more than what is drawn then moves, in range partitions. Null ids come last. Of rows of one
    doc_id and score, those of the lesser other columns come first, and a last id that stands more often than there is room is cut there.
    """
    spark = scored.sparkSession
    rows = scored.withColumn("_id", F.coalesce("doc_id", F.lit(_LAST_ID)))
    on = rows.where("eligible")
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    if k <= 0:
        return none

    def counts(df: DataFrame, ok: Callable[[int], Column]) -> Callable[[list[int]], list[int]]:
        return lambda at: list(df.agg(*(F.count_if(ok(x)) for x in at)).head())

    ends = on.agg(F.min("score"), F.max("score")).head()
    cut = -bisect(counts(on, lambda x: F.col("score") >= -x), -ends[1], -ends[0], k)
    above = on.where(F.col("score") > cut).count()
    tied = on.where(F.col("score") == cut)
    first, last = tied.agg(F.min("_id"), F.max("_id")).head()
    until = bisect(counts(tied, lambda x: F.col("_id") <= x), first, last, k - above)
    taken = F.col("eligible") & ((F.col("score") > cut) | ((F.col("score") == cut) & (F.col("_id") <= until)))

    rest = [c for c in scored.columns if c not in ("doc_id", "score", "eligible")]
    order = [F.desc("score"), F.asc("_id"), *rest]
    placed = rows.where(taken).repartitionByRange(n_partitions(spark), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    # the number of a partition and the place in it; written once, as range bounds are drawn anew whenever they are computed
    placed = keep(placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # one row a partition
    rank = F.col("_at") + F.col("_before") + 1
    ranked = placed.join(F.broadcast(before), "_part").withColumn("rank", F.when(rank <= k, rank).cast("long"))
    others = rows.where(~F.coalesce(taken, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*scored.columns, "rank").unionByName(others.select(*scored.columns, "rank"))


def resample(
    docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, grams: int = GRAMS, seed: int = SEED
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs (doc_id, text, ...): share percent of those with least_words words, drawn towards target (text, ...).

    score is the weight and a Gumbel draw from doc_id, so the highest scores are a draw without replacement in proportion to exp(weight / 1000).
    Null text has no words. Rows of one doc_id are scored each by its own text. An empty docs gives an empty result, an empty target
    flat gains of the raw texts.
    """
    gain = gains(docs, target, buckets, grams)
    scored = weights(docs, gain, grams).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = keep(scored.withColumn("eligible", F.col("n_words") >= least_words))
    return draw(scored, share * scored.where("eligible").count() // 100).drop("eligible")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
