"""Tables laid out in partitions by a rule over their keys, so that a write touches the partitions of its own rows alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidesmith.operators.graph import first_of, upsert
from tidesmith.sources.kept import keep

PART = "part"


def by_hash(*key: str, parts: int = 64) -> Column:
    """A rule: the hash of the key, for tables of no natural order."""
    return F.pmod(F.xxhash64(*key), F.lit(parts))


def by_month(column: str) -> Column:
    """A rule: the month of a time in the key, for facts that arrive day by day."""
    return F.date_format(column, "yyyy-MM")


def _placed(df: DataFrame, rule: Column) -> DataFrame:
    return df.withColumn(PART, F.coalesce(rule.cast("string"), F.lit("none")))


def create(df: DataFrame, path: str, rule: Column) -> None:
    """Writes df as a new table, one file for each partition; fails where there is a table already."""
    _placed(df, rule).repartition(PART).write.partitionBy(PART).parquet(path)


def read(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table; its columns are those of schema, without the partition."""
    every = StructType(schema.fields).add(PART, "string")
    return spark.read.schema(every).parquet(path)


def rewrite(path: str, new: DataFrame, schema: StructType, rule: Column, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> list[str]:
    """Merges new rows into the table by merge(old, new) and returns the partitions that were written.

    Only partitions that rows of new fall into are read and replaced; rule must depend on columns that merge never changes. The merged rows
    are written aside first, so a merge that fails leaves the table as it was; then Spark replaces the touched partitions in one commit.
    The list of partitions, which the rule bounds, is all that reaches the driver.
    """
    spark = new.sparkSession
    touched = sorted(r[0] for r in _placed(new, rule).select(PART).distinct().collect())
    if not touched:
        return []
    old = read(spark, path, schema).where(F.col(PART).isin(touched)).drop(PART)
    merged = keep(_placed(merge(old, new).select(*schema.names), rule))
    merged.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    return touched


def upsert_rows(path: str, new: DataFrame, schema: StructType, rule: Column, key: list[str], changed: list[str], order: list[Column | str] | None = None) -> list[str]:
    """Upserts new rows by key: of those that are there only `changed` is replaced. With order, the first of several new rows of a key counts.

    Without order a key may stand once among the new rows. The same rows again change nothing, so a run can be repeated.
    """
    return rewrite(path, new if order is None else first_of(new, key, order), schema, rule, lambda old, rows: upsert(old, rows, key, changed))
