"""Exact maximum-inner-product top-k: ball trees per shard, branch and bound, a shared kth score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesmith.llm.common import keep, table

#: Vectors of a leaf, rows of a shard (one tree each), queries of a block, shards that are searched first.
LEAF, SHARD_ROWS, BLOCK_ROWS, PILOT = 128, 8192, 4096, 4
#: The score of no candidate.
NONE = -(2**62)


def _tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of rows, (lo, hi, left, right) of each node, centres and radii of a ball tree; a node is a range of rows in that order.

    Each ball is cut at the median of the direction between two far points; node 0 is the root, left is -1 at a leaf.
    """
    order, nodes, centres, radii = np.arange(len(x)), [[0, len(x), -1, -1]], [], []
    at = 0
    while at < len(nodes):
        lo, hi, _, _ = nodes[at]
        v = x[order[lo:hi]]
        c = v.mean(0)
        away = ((v - c) ** 2).sum(1)
        centres.append(c)
        radii.append(float(np.sqrt(away.max())) * (1 + 1e-9) + 1e-6)  # a hair wider, so that rounding never makes a bound too low
        if hi - lo > LEAF:
            far = v[np.argmax(away)]
            other = v[np.argmax(((v - far) ** 2).sum(1))]
            order[lo:hi] = order[lo:hi][np.argsort(v @ (other - far), kind="stable")]
            half = (lo + hi) // 2
            nodes[at][2:] = len(nodes), len(nodes) + 1
            nodes += [[lo, half, -1, -1], [half, hi, -1, -1]]
        at += 1
    return order, np.array(nodes, np.int64), np.array(centres), np.array(radii)


def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shards of (id, dim, v): one row for each tree of up to SHARD_ROWS vectors."""
    for pdf in batches:
        for dim, group in pdf.groupby("dim"):
            for cut in range(0, len(group), SHARD_ROWS):
                part = group.iloc[cut : cut + SHARD_ROWS]
                x, ids = np.stack(part["v"].to_numpy()).astype(np.int64).reshape(len(part), -1), part["id"].to_numpy(np.int64)
                order, nodes, centres, radii = _tree(x.astype(np.float64))
                row = (int(dim), len(part), ids[order].tobytes(), x[order].tobytes(), nodes.tobytes(), centres.astype(np.float64).tobytes(), radii.tobytes())
                yield pd.DataFrame([row], columns=[c.split()[0] for c in TREES.split(", ")])


#: Size that components stay below: products of two vectors of up to 2,000 of them fit a 64-bit number.
LARGEST = 1 << 26

TREES = "dim int, n int, ids binary, vecs binary, nodes binary, centres binary, radii binary"
HITS = "query_id long, vec_id long, score long"


class _Best:
    """The k best of each query so far, ties to the smaller id; low is the kth score, shared by all nodes that follow."""

    def __init__(self, n: int, k: int, low: np.ndarray):
        self.score, self.id, self.low, self.k = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max), low.copy(), k

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        s = np.concatenate([self.score[q], score], axis=1)
        i = np.concatenate([self.id[q], np.broadcast_to(ids, score.shape)], axis=1)
        i = np.where(s == NONE, np.iinfo(np.int64).max, i)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[q], self.id[q] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.low[q] = np.maximum(self.low[q], self.score[q, -1])


def _leaf_bounds(nodes: np.ndarray, centres: np.ndarray, radii: np.ndarray, qf: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaves, bound of each query in each leaf): from the root down, level by level; a query leaves a subtree that cannot reach its kth score, its bound there is -inf."""
    norm = np.sqrt((qf**2).sum(1))
    level, on, leaves, bounds = np.array([0]), np.ones((len(qf), 1), bool), [], []
    while len(level):
        bound = qf @ centres[level].T + norm[:, None] * radii[level][None, :] + 1e-6
        bound[~on | (bound < low[:, None])] = -np.inf
        used = (bound > -np.inf).any(0)
        level, bound = level[used], bound[:, used]
        leaf = nodes[level, 2] < 0
        leaves.append(level[leaf])
        bounds.append(bound[:, leaf])
        inner = level[~leaf]
        level, on = nodes[inner, 2:4].ravel(), np.repeat(bound[:, ~leaf] > -np.inf, 2, axis=1)
    return np.concatenate(leaves), np.concatenate(bounds, axis=1)


def _walk(tree: pd.Series, qid: np.ndarray, qv: np.ndarray, best: _Best) -> int:
    """Branch and bound of all queries through one tree; the number of scores that were computed.

    Each query meets its leaves in the order of its own bounds, the highest first, and ends at the first that cannot reach its kth score so far.
    Queries whose next leaf is the same one are scored there together.
    """
    ids, nodes = np.frombuffer(tree["ids"], np.int64), np.frombuffer(tree["nodes"], np.int64).reshape(-1, 4)
    vecs, radii = np.frombuffer(tree["vecs"], np.int64).reshape(len(ids), -1), np.frombuffer(tree["radii"], np.float64)
    centres = np.frombuffer(tree["centres"], np.float64).reshape(len(radii), -1)
    qf = qv.astype(np.float64)
    # floats are exact where all sums are below 2^53
    exact = vecs.size and qv.size and float(np.abs(vecs).max()) * float(np.abs(qv).max()) * vecs.shape[1] < 2.0**52
    leaves, bounds = _leaf_bounds(nodes, centres, radii, qf, best.low)
    order = np.argsort(-bounds, axis=1, kind="stable")
    live, scored = np.arange(len(qid)), 0
    for step in range(len(leaves)):
        next_ = order[live, step]
        bound = bounds[live, next_]
        on = (bound > -np.inf) & (bound >= best.low[live])
        live, next_ = live[on], next_[on]
        if not len(live):
            break
        by = np.argsort(next_, kind="stable")
        for q in np.split(live[by], np.flatnonzero(np.diff(next_[by])) + 1):
            lo, hi = nodes[leaves[order[q[0], step]], :2]
            v = vecs[lo:hi]
            s = (qf[q] @ v.T.astype(np.float64)).astype(np.int64) if exact else qv[q] @ v.T
            best.add(q, np.where(ids[lo:hi][None, :] == qid[q][:, None], NONE, s), ids[lo:hi][None, :])
            scored += s.size
    return scored


def _search(queries: dict, k: int):
    """Task: every query through every tree of its length; sends hits that reach the kth scores known before."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = {d: _Best(len(ids), k, low) for d, (ids, _, low) in queries.items()}
        for pdf in batches:
            for _, tree in pdf.iterrows():
                if tree["dim"] in queries:
                    _walk(tree, *queries[tree["dim"]][:2], best[tree["dim"]])
        for dim, b in best.items():
            ids, _, low = queries[dim]
            q, c = np.nonzero((b.id != np.iinfo(np.int64).max) & (b.score >= low[:, None]))
            if len(q):
                yield pd.DataFrame({"query_id": ids[q], "vec_id": b.id[q, c], "score": b.score[q, c]})

    return run


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query; a task has sent at most k, and of those only what reaches the shared kth score."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), F.col("vec_id"))))
    top = hits.groupBy("query_id").agg(F.slice(pairs, 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.neg")).alias("score")
    )


def integers(rows: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, dim, v): components as floor(scale * x). Rows with null id or vector, or a null or non-finite component, take no part.

    A component of LARGEST or more in size is an error: products of such could not be told from others.
    """
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    good = rows.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(~bad)
    whole = lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")
    large = lambda x: F.abs(F.lit(float(scale)) * x.cast("double")) >= float(LARGEST)
    v = F.transform(vec_col, lambda x: F.when(large(x), F.raise_error(F.lit(f"a component is not below {LARGEST} in size"))).otherwise(whole(x)))
    return good.select(F.col(id_col).cast("long").alias("id"), F.size(vec_col).alias("dim"), v.alias("v"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Exact top k by inner product of integer vectors: (query_id, rank, vec_id, score).

    rows, queries: (id long, dim int, v array<long>). Rows of the query's id are no candidates; ties go to the smaller
    vec_id; fewer than k candidates: all. Vectors of other lengths than the query's do not meet it. Empty inputs give an
    empty result. A repeated id is a candidate each time, but one query: the least of its vectors.

    Trees are built per shard and written once. Queries come in blocks of BLOCK_ROWS, whose size is the proven bound of
    what is sent to tasks. For each block PILOT trees are searched first; the kth scores found there are
    shared with every shard as lower bounds, below which nodes are passed over and hits are not sent.
    """
    spark = rows.sparkSession
    trees = keep(rows.mapInPandas(build, TREES))
    one = keep(queries.groupBy("id").agg(F.min(F.struct("dim", "v")).alias("q")).select("id", "q.dim", "q.v"))
    blocks, out = max(1, -(-one.count() // BLOCK_ROWS)), None
    for block in range(blocks):
        own = one.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toPandas()
        held = {}
        for dim, g in own.groupby("dim"):
            ids = g["id"].to_numpy(np.int64)
            held[int(dim)] = (ids, np.stack(g["v"].to_numpy()).astype(np.int64).reshape(len(ids), -1), np.full(len(ids), NONE))
        if not held:
            continue
        first = trees.limit(PILOT).mapInPandas(_search(held, k), HITS)
        kth = {r["query_id"]: r["score"] for r in ranked(first, k).where(F.col("rank") == k).collect()}
        for ids, _, low in held.values():
            low[:] = [kth.get(int(i), NONE) for i in ids]
        found = trees.mapInPandas(_search(held, k), HITS)
        found = found if blocks == 1 else keep(found)
        out = found if out is None else out.union(found)
    return ranked(spark.createDataFrame([], HITS) if out is None else out, k)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_k(rows, rows.where("id % 50 = 0"), 5)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
