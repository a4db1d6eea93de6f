"""Wide tables of prices, a column for each metric and ticker, as points in long form; one ticker's trouble is its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesmith.sources.kept import keep

# Metrics of a wide table, the names and units that their points have.
METRICS = {"Close": ("close_price", "USD"), "Volume": ("volume", "shares")}
SOURCE = "yfinance"


def decimal_places(value: Column, places: int = 4) -> Column:
    """A number as a decimal of so many places, by its shortest text, halves to the even digit; null where it is no finite number."""
    return F.bround(value.cast("string").try_cast("decimal(38,18)"), places)


def to_long(wide: DataFrame, by: str = "date", mark: str = ":") -> DataFrame:
    """(by, metric, ticker, value string) of a wide table whose other columns are named metric:ticker; a ticker may hold the mark too.

    One unpivot: a row for each cell, made where the row lies. Null cells stay.
    """
    cells = [c for c in wide.columns if c != by]
    texts = wide.select(by, *(F.col(f"`{c}`").cast("string").alias(c) for c in cells))
    part = F.split("cell", f"\\Q{mark}\\E", 2)
    return texts.unpivot([by], [F.col(f"`{c}`") for c in cells], "cell", "value").select(by, part[0].alias("metric"), F.get(part, F.lit(1)).alias("ticker"), "value")


def to_wide(points: DataFrame, tickers: list[str], by: str = "date", mark: str = ":") -> DataFrame:
    """The wide table of points (by, metric, ticker, value): the first value of each cell, in columns of named tickers alone."""
    cells = [f"{m}{mark}{t}" for m in METRICS for t in tickers]
    return points.withColumn("cell", F.concat("metric", F.lit(mark), "ticker")).groupBy(by).pivot("cell", cells).agg(F.first("value"))


def price_points(wide: DataFrame, tickers: DataFrame, latest_only: bool = False, by: str = "date") -> tuple[DataFrame, DataFrame]:
    """(points, counts by ticker) of a wide table of Close:ticker and Volume:ticker for the tickers (ticker) that are tracked.

    Points: closing prices to four places, whole volumes; empty and NaN cells are no points and no failures, other cells that are no finite number are failures.
    A ticker without a column, or without any closing price, has failed and has no points. With latest_only the last date of the table counts, not of
    each ticker. counts: (ticker, ok, stored, failed).
    """
    rows = wide.where(F.col(by) == wide.agg(F.max(by)).scalar()) if latest_only else wide
    own = tickers.select("ticker").distinct()
    cells = to_long(rows, by).where(F.col("metric").isin(*METRICS)).join(own, "ticker", "left_semi").where(F.col("value").isNotNull() & (F.lower("value") != "nan"))
    whole = lambda v: F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v))
    number = F.col("value").try_cast("decimal(38,18)")
    value = F.when(F.col("metric") == "Close", F.bround(number, 4)).otherwise(whole(number).cast("decimal(38,4)"))
    cells = keep(cells.withColumn("number", value.cast("decimal(38,4)")))
    seen = cells.groupBy("ticker").agg(F.count_if(F.col("metric") == "Close").alias("closes"), F.count("number").alias("stored"), F.count_if(F.col("number").isNull()).alias("failed"))
    ok = F.coalesce(F.col("closes"), F.lit(0)) > 0
    n = lambda c: F.when(ok, F.col(c)).otherwise(0).cast("long").alias(c)
    counts = own.join(seen, "ticker", "left").select("ticker", ok.alias("ok"), n("stored"), n("failed"))
    names = F.create_map(*(F.lit(x) for m, (name, _) in METRICS.items() for x in (m, name)))
    units = F.create_map(*(F.lit(x) for m, (_, unit) in METRICS.items() for x in (m, unit)))
    good = cells.where("number is not null").join(counts.where("ok").select("ticker"), "ticker", "left_semi")
    points = good.select(F.lit("asset").alias("entity_type"), F.col("ticker").alias("entity_id"), names[F.col("metric")].alias("metric"), F.col("number").alias("value"), units[F.col("metric")].alias("unit"), F.col(by).alias("timestamp"), F.lit(SOURCE).alias("source"))
    return points, counts
