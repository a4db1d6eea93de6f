"""What the operators of this folder share: tables, the shared work folder, words, edges."""

from __future__ import annotations

import re
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII separators of words become spaces and A-Z becomes a-z; bytes of other characters stay.
_WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the one that the cluster names in spark.checkpoint.dir.

    Where the setting is missing in local mode (tests: one machine) a folder of this machine is taken; a cluster must name one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"


def discard(spark: SparkSession) -> None:
    """Deletes all that this application has kept, once its results are written: they read those files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{spark.sparkContext.applicationId}-*")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in files.globStatus(path) or ():
            files.delete(found.getPath(), True)


def keep(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and lost executors cost no more than a reread."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: str | None) -> list[bytes]:
    """Words of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z is lower-cased, as UTF-8. Null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_TABLE).split() if text else []


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, so that Python holds few whole texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most so many bytes of a column of strings or lists of 32-bit numbers, or of one longer row."""
    for batch in batches:
        kind = batch.schema.field(column).type
        size = pc.list_value_length(batch.column(column)) if pa.types.is_list(kind) else pc.binary_length(batch.column(column))
        total = np.cumsum(pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype(np.int64) * (4 if pa.types.is_list(kind) else 1) + 64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def worker_cache(name: str) -> dict:
    """A dict of this Python worker, which serves many tasks."""
    home = sys.modules.setdefault("tidesmith_worker_cache", types.ModuleType("tidesmith_worker_cache"))
    return home.__dict__.setdefault(name, {})


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges: (id, root), root the smallest id of the component.

    Labels fall to the least label among the neighbours and then jump to the label of the label, so the
    number of rounds grows with the logarithm of a component's length; each round is written to the shared folder.
    Only ids with an edge are returned. A hot id is met by partial aggregation.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    links = keep(both.union(both.select("v", "u")).distinct())
    labels = keep(links.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.min("u")).alias("root")))
    while True:
        near = links.join(labels, links.v == labels.id).groupBy("u").agg(F.min("root").alias("seen"))
        low = labels.join(near, labels.id == near.u).select("id", F.least("root", "seen").alias("root"), F.col("root").alias("was"))
        low = keep(low)
        # every member of a tree also lowers the label of its old root, so whole trees hook at once
        hook = low.groupBy(F.col("was").alias("at")).agg(F.min("root").alias("hook"))
        hooked = low.join(hook, low.id == hook["at"], "left").select("id", F.least("root", "hook").alias("root"), "was")
        to = hooked.select(F.col("id").alias("at"), F.col("root").alias("far"))
        new = keep(hooked.join(to, hooked.root == to["at"], "left").select("id", F.least("root", "far").alias("root"), "was"))
        labels = new.select("id", "root")
        if not new.where("root <> was").head(1):
            return labels
