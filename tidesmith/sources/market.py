"""Long observations (key, date, value) from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesmith.operators.series import given


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents(price: str) -> Column:
    """A price in whole cents, null where it is null, NaN or infinite."""
    return given(F.col(price)).try_cast("decimal(18,2)")


def market_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset:N<nation>, asset:R<region> and asset:MKT from prices, indicator:<priority> from orders, one value a day; prices that are missing take no part."""
    t = lambda n: table(spark, sf_dir, n)
    nations = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_regionkey")
    # sums and counts by nation and day; each then counts for its nation, its region and the market
    base = (
        t("lineitem").join(nations, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", "n_regionkey", F.to_date("l_shipdate").alias("date")).agg(F.sum(_cents("l_extendedprice")).alias("s"), F.count(_cents("l_extendedprice")).alias("c"))
    )
    levels = F.array(F.concat(F.lit("asset:N"), "s_nationkey"), F.concat(F.lit("asset:R"), "n_regionkey"), F.lit("asset:MKT"))
    mean = F.try_divide(F.sum("s").cast("double"), F.sum("c")).alias("value")  # cents add up exactly, whatever the order
    assets = base.select(F.explode(levels).alias("key"), "date", "s", "c").groupBy("key", "date").agg(mean)
    macro = t("orders").groupBy(F.concat(F.lit("indicator:"), F.col("o_orderpriority")).alias("key"), F.to_date("o_orderdate").alias("date")).agg(F.try_divide(F.sum(_cents("o_totalprice")).cast("double"), F.count(_cents("o_totalprice"))).alias("value"))
    return assets.unionByName(macro)


def event_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short, dense series: the daily mean of each event type. NaN counts as missing."""
    e = table(spark, sf_dir, "events").withColumn("value", given(F.col("value")))
    return e.groupBy(F.concat(F.lit("asset:"), F.col("event_type")).alias("key"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("value"))


def between(df: DataFrame, column: str, start: Column, end: Column) -> DataFrame:
    """Range scan, inclusive at both ends; the predicate reaches the file scan."""
    return df.where(F.col(column).between(start, end))
