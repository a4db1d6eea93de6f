"""Operators on long series (key, date, value): spine, fill, transforms, scaling. NaN is null from ingestion on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidesmith.sources.kept import keep


def missing(value: Column) -> Column:
    """Whether a number is missing: null or NaN."""
    return value.isNull() | F.coalesce(F.isnan(value), F.lit(False))


def given(value: Column) -> Column:
    """The number, or null where it is missing."""
    return F.when(~missing(value), value)


def by_date() -> WindowSpec:
    return Window.partitionBy("key").orderBy("date")


def by_key() -> WindowSpec:
    return Window.partitionBy("key")


def spine(df: DataFrame) -> DataFrame:
    """Every key on every date that any key has. The dates, a few thousand, are one array, which each key unfolds."""
    dates = df.select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("dates"))
    return df.select("key").distinct().select("key", F.explode(dates.scalar()).alias("date")).join(df, ["key", "date"], "left")


def forward_fill(df: DataFrame) -> DataFrame:
    last = F.last("value", ignorenulls=True).over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    return spine(df).withColumn("value", last)


def min_observations(df: DataFrame, share: float = 0.75, least: int = 15) -> DataFrame:
    """Series with values on at least max(least, int(dates * share)) dates of the filled spine."""
    n, dates = F.count("value").over(by_key()), F.count("*").over(by_key())
    return df.withColumn("n", n).withColumn("dates", dates).where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("dates") * share))).drop("n", "dates")


def previous() -> Column:
    return F.lag("value").over(by_date())


def log_return() -> Column:
    ratio = F.try_divide("value", F.nullif(previous(), F.lit(0.0)))
    return F.when(ratio > 0, F.log(ratio))


def difference() -> Column:
    return F.col("value") - previous()


def percent_change() -> Column:
    return F.try_divide(F.col("value") - previous(), F.nullif(previous(), F.lit(0.0)))


def transform(df: DataFrame, volatile: tuple[str, ...] = ()) -> DataFrame:
    """Log returns of assets (percent changes of volatile ones), differences of indicators; the first row of a series goes."""
    usual = F.when(F.col("key").startswith("asset:"), log_return()).otherwise(difference())
    change = F.when(F.col("key").isin(*volatile), percent_change()).otherwise(usual) if volatile else usual
    return df.select("key", "date", change.alias("value"), F.row_number().over(by_date()).alias("row")).where("row > 1").drop("row")


def zscore(df: DataFrame) -> DataFrame:
    """Null where the sample deviation is below 1e-10."""
    sd = F.stddev_samp("value").over(by_key())
    return df.withColumn("value", F.when(sd >= 1e-10, (F.col("value") - F.avg("value").over(by_key())) / sd))


def winsorize(df: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values clipped to the nearest-rank quantiles of their series: those at places round((n - 1) * q) in order, without interpolation.

    A series, a few thousand dates, is one row while its quantiles are taken; longer ones are for winsorize_long.
    """
    whole = df.groupBy("key").agg(F.collect_list(F.struct("date", "value")).alias("rows"))
    placed = whole.withColumn("v", F.sort_array(F.filter(F.transform("rows", lambda r: r["value"]), lambda v: v.isNotNull())))
    at = lambda q: F.get("v", F.round((F.size("v") - 1) * F.lit(q)).cast("int"))
    each = placed.select("key", at(low).alias("lo"), at(high).alias("hi"), F.inline("rows"))
    return each.select("key", "date", F.when(F.col("value").isNotNull(), F.greatest("lo", F.least("hi", "value"))).alias("value"))


#: Values of a series that may meet in one array, once a quantile has been narrowed down to them.
FEW = 10_000


def exact_quantiles(df: DataFrame, qs: list[float], few: int = FEW) -> DataFrame:
    """(key, q, value): the value at place round((n - 1) * q) of each series' values in order, for series of any length.

    No series is sorted or met whole by a task. Each round takes approximate quantiles on either side of the wanted place (mergeable sketches), counts exactly
    how many values lie below and between them, and goes on between them, until at most `few` values are left or all that are left are equal. Nulls take
    no part; a series of nulls has no quantile. Rounds grow with the logarithm of the longest series.
    """
    values = df.where("value is not null").select("key", "value")
    sizes = values.groupBy("key").agg(F.count("*").alias("left"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    state = sizes.select("key", F.explode(F.array(*map(F.lit, qs))).alias("q"), "left", "lo", "hi").withColumn("place", F.round((F.col("left") - 1) * F.col("q")).cast("long"))
    state = keep(state)
    inside = F.col("value").between(F.col("lo"), F.col("hi"))
    wide = (F.col("left") > few) & (F.col("lo") < F.col("hi"))
    while state.where(wide).head(1):
        open_ = state.where(wide)
        share = F.col("place") / (F.col("left") - 1)
        around = values.join(open_, "key").where(inside).groupBy("key", "q").agg(F.percentile_approx("value", F.array(*(F.lit(i / 256) for i in range(257))), 2000).alias("cuts"))
        near = open_.join(around, ["key", "q"]).select(
            *state.columns, F.get("cuts", F.greatest(F.floor(share * 256) - 2, F.lit(0)).cast("int")).alias("low"), F.get("cuts", F.least(F.ceil(share * 256) + 2, F.lit(256)).cast("int")).alias("high")
        )
        v = F.col("value")
        parts = F.when(v < F.col("low"), 0).when(v <= F.col("high"), 1).otherwise(2)
        counts = values.join(near, "key").where(inside).groupBy("key", "q", "place", parts.alias("part")).agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        before = F.sum("n").over(Window.partitionBy("key", "q").orderBy("part")) - F.col("n")
        on = counts.withColumn("before", before).where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("n")))
        narrowed = on.select("key", "q", F.col("n").alias("left"), "lo", "hi", (F.col("place") - F.col("before")).alias("place"))
        state = keep(state.where(~wide).unionByName(narrowed.select(*state.columns)))
    some = values.join(state.where("lo < hi"), "key").where(inside).groupBy("key", "q", "place").agg(F.sort_array(F.collect_list("value")).alias("v"))
    found = some.select("key", "q", F.get("v", F.col("place").cast("int")).alias("value"))
    return state.where("lo = hi").select("key", "q", F.col("lo").alias("value")).unionByName(found)


def winsorize_long(df: DataFrame, low: float = 0.01, high: float = 0.99, few: int = FEW) -> DataFrame:
    """winsorize() for series too long to be sorted by one task: the bounds come from exact_quantiles."""
    bounds = exact_quantiles(df, [low, high], few).groupBy("key").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return df.join(bounds, "key", "left").select("key", "date", F.when(F.col("value").isNotNull(), F.greatest("lo", F.least("hi", "value"))).alias("value"))


def window_of(df: DataFrame, days: int) -> DataFrame:
    """The last so many calendar days up to the last date of all."""
    last = df.agg(F.max("date").alias("last")).scalar()
    return df.where(F.col("date") > F.date_sub(last, days))


def without(df: DataFrame, names: DataFrame) -> DataFrame:
    """Series whose id, the part of the key after its first colon, is not among the names (id): non-daily ones, or a pass's exclusions."""
    return df.join(names.select(F.col("id").alias("_id")).distinct(), key_id(F.col("key")) == F.col("_id"), "left_anti")


def entity_key(kind: Column, name: Column) -> Column:
    return F.concat_ws(":", kind, name)


def key_kind(key: Column) -> Column:
    return F.substring_index(key, ":", 1)


def key_id(key: Column) -> Column:
    """What follows the first colon; later colons belong to the id."""
    return F.element_at(F.split(key, ":", 2), 2)


def monthly_changes(df: DataFrame) -> DataFrame:
    """Log returns of assets and differences of indicators from one row of the shared monthly spine to the next.

    Assets share one spine of months and indicators another; a month that a series skips leaves it without a value there
    and in the next month. The first month of each spine goes.
    """
    last = monthly_last(df)
    asset = F.col("key").startswith("asset:")
    return transform(spine(last.where(asset))).unionByName(transform(spine(last.where(~asset))))


def latest_only(df: DataFrame) -> DataFrame:
    """Rows of the last date of all, not of each key."""
    return df.where(F.col("date") == df.agg(F.max("date")).scalar())


def monthly_last(df: DataFrame) -> DataFrame:
    return df.groupBy("key", F.trunc("date", "MM").alias("date")).agg(F.max_by("value", "date").alias("value"))


def beta_residual(df: DataFrame, market: str, sector: DataFrame, least: int = 30) -> DataFrame:
    """Series with a sector minus their fit on market and sector; others as they are. sector: (key, sector_key), one row a key.

    Where there is no series of the sector, and for a null sector_key, the fit is on the market alone, as it is for collinear regressors. Normal equations from
    moments; under `least` joint rows, or without a series of the market, nothing changes; a residual is null where a regressor is.
    """
    m = df.where(F.col("key") == market).select("date", F.col("value").alias("m"))
    s = df.join(sector.select(F.col("sector_key").alias("key"), F.col("key").alias("own")), "key").select(F.col("own").alias("key"), "date", F.col("value").alias("s"))
    there = df.select(F.col("key").alias("sector_key")).distinct().withColumn("has", F.lit(True))
    known = sector.join(there, "sector_key", "left").select("key", F.coalesce("has", F.lit(False)).alias("has"))
    wide = df.join(known, "key").join(m, "date", "left").join(s, ["key", "date"], "left").withColumn("s", F.when(F.col("has"), F.col("s")).otherwise(0.0)).drop("has")
    full = F.col("value").isNotNull() & F.col("m").isNotNull() & F.col("s").isNotNull()
    cov = lambda a, b: F.covar_pop(F.when(full, F.col(a)), F.when(full, F.col(b)))
    fit = wide.groupBy("key").agg(
        F.count_if(full).alias("n"), cov("m", "m").alias("mm"), cov("s", "s").alias("ss"), cov("m", "s").alias("ms"), cov("m", "value").alias("my"), cov("s", "value").alias("sy"),
        *(F.avg(F.when(full, F.col(c))).alias(f"a{c}") for c in ("m", "s", "value")),
    )
    det = F.col("mm") * F.col("ss") - F.col("ms") * F.col("ms")
    two = det > 1e-12
    b1 = F.when(two, F.try_divide(F.col("ss") * F.col("my") - F.col("ms") * F.col("sy"), det)).otherwise(F.try_divide("my", "mm"))
    b2 = F.when(two, F.try_divide(F.col("mm") * F.col("sy") - F.col("ms") * F.col("my"), det)).otherwise(0.0)
    fit = fit.select("key", "n", b1.alias("b1"), b2.alias("b2"), "am", "as", "avalue")
    rest = F.col("value") - F.col("avalue") - F.col("b1") * (F.col("m") - F.col("am")) - F.col("b2") * (F.col("s") - F.col("as"))
    done = wide.join(fit, "key").select("key", "date", F.when(F.col("n") < least, F.col("value")).otherwise(rest).alias("value"))
    return done.unionByName(df.join(sector.select("key"), "key", "left_anti"))
