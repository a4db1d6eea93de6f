"""Gates on rows of pairs (a, b, ...): redundant and implausible pairs, tiers, merging of passes. Names meet small tables by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _of(pairs: DataFrame, names: DataFrame, value: str) -> DataFrame:
    """pairs with _a and _b: the value of names (key, value) at either end, null where there is none."""
    at = lambda c: names.select(F.col("key").alias(c), F.col(value).alias(f"_{c}"))
    return pairs.join(at("a"), "a", "left").join(at("b"), "b", "left")


# Categories of what the map does not know.
OTHER = {"indicator": "fred_other", "asset": "equity"}


def classify(keys: DataFrame, known: DataFrame) -> DataFrame:
    """(key, category) of keys by a map (kind, id, category), met by kind and id; what the map does not know gets the category that is usual for its kind."""
    kind = F.substring_index("key", ":", 1)
    of = known.select(F.concat_ws(":", "kind", "id").alias("key"), "category").dropDuplicates(["key"])
    other = F.when(kind == "indicator", OTHER["indicator"]).otherwise(OTHER["asset"])
    return keys.select("key").join(of, "key", "left").select("key", F.coalesce("category", other).alias("category"))


def not_redundant(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose ends are not of one group; an end without a group is redundant with none. groups: (key, grp)."""
    return _of(pairs, groups, "grp").where("_a is null or _b is null or _a <> _b").select(*pairs.columns)


def plausible(pairs: DataFrame, categories: DataFrame, blocked: DataFrame) -> DataFrame:
    """Pairs whose categories, in either order, are not blocked. categories: (key, category), blocked: (lo, hi) with lo <= hi."""
    both = _of(pairs, categories, "category").withColumns({"lo": F.least("_a", "_b"), "hi": F.greatest("_a", "_b")})
    return both.join(F.broadcast(blocked), ["lo", "hi"], "left_anti").select(*pairs.columns)


def strong(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs of a strength of at least so much; null and NaN go."""
    return pairs.where(~F.isnan("r") & (F.abs("r") >= least))


def tier_status(r: Column, active: float = 0.15) -> Column:
    """Partial correlations of at least `active` are candidates, weaker ones wait for verification."""
    return F.when(F.abs(r) >= active, "candidate").otherwise("pending_verification")


def strongest(first: DataFrame, second: DataFrame) -> DataFrame:
    """Each unordered pair once, from the pass that gives it the larger |r|, the first pass on ties."""
    every = first.withColumn("_pass", F.lit(1)).unionByName(second.withColumn("_pass", F.lit(2)))
    best = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy(F.desc(F.abs("r")), "_pass", "a", "b")
    return every.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_pass")


def unverified_last(pairs: DataFrame, most: int = 200) -> DataFrame:
    """The strongest so many pairs, by |r|; a report of the top, ties by names."""
    return pairs.orderBy(F.desc(F.abs("r")), "a", "b").limit(most)
