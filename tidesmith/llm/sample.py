"""Bounded, repeatable training samples: the rows of the smallest hashes of doc_id, per class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, m: int) -> Column:
    """crc32 of the id's decimal text, modulo m."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % m


def labelled_ids(labels: DataFrame, label: str, m: int, held: int, per_class: int) -> DataFrame:
    """(doc_id, y) of at most per_class documents of each class, none of them held out.

    Rows of null doc_id or label take no part; a document labelled both ways counts as 1.
    The size is bounded by 2 * per_class rows, whatever the size of labels.
    """
    own = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (remainder("doc_id", m) != held))
    one = own.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    first = lambda y: one.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    return first(0).union(first(1))


def sample_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, y, text) of the chosen documents, one row each, in order of doc_id: of rows that share one the text of the least hash.

    ids has a bounded number of rows, so it goes to every task, and so has the result, however often a document stands in docs.
    """
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min_by(F.struct("text"), F.xxhash64("text")).alias("t")).select("doc_id", "y", "t.text").orderBy("doc_id")
