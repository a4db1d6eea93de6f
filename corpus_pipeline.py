"""From documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesmith.llm import decontaminate, langid, linededup, neardup, packing
from tidesmith.llm.common import keep, table


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and lang of docs, and all its other columns in one struct, so that no name of theirs meets one of an operator."""
    return docs.select("doc_id", "text", "lang", F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "lang"))).alias("row"))


def _back(found: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs, with some of them changed."""
    own = {c: F.col(c) if c in ("doc_id", "text", "lang") else F.col(f"row.`{c}`") for c in docs.columns}
    own |= {c: x for c, x in changed.items() if c in own}
    return found.select(*(x.alias(c) for c, x in own.items()))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a wide enough margin, with that language in lang. The dictionaries come from docs itself.

    Null, empty and letterless texts go. Rows are judged one by one: repeated rows, null ids and further columns stay as they are.
    """
    found = langid.identify(_carried(docs), langid.dictionaries(docs.select("doc_id", "text", "lang")))
    return _back(found.where("not rejected"), docs, lang=F.col("lang_pred"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a smaller doc_id holds too; those that lose all their text so go.

    Rows that share a doc_id count as one document; rows of null doc_id stay whole; null text becomes empty.
    """
    left = linededup.drop_repeated_lines(_carried(docs))
    some = (F.col("n_dropped") == 0) | F.regexp_like("kept_text", F.lit(r"\S"))
    return _back(left.where(some), docs, text=F.col("kept_text"), n_chars=F.length("kept_text").cast("long"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each class of near duplicates, once: of rows that share that doc_id, the text of the least hash.

    Rows of null doc_id stay. Texts without words are no one's duplicates.
    """
    others = neardup.near_duplicates(docs).where("class_id <> doc_id").select("doc_id").distinct()
    kept = docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    own = [c for c in docs.columns if c != "doc_id"]
    # rows of null doc_id are told apart by a number; grouping keeps to the partitions of the join
    each = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    one = kept.groupBy("doc_id", each.alias("each")).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in own)), F.xxhash64("text")).alias("row"))
    return one.select(*(F.col("doc_id") if c == "doc_id" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Rows of null doc_id stay; rows that share a doc_id go if one of them holds one."""
    hit = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark")).where("size(starts) > 0").select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, repeated rows and null ids included, and their places in training sequences."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("decontamination", decontaminated),
    ("packing", packed),
]
#: Compression, sampled signatures and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
