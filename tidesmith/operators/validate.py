"""Checks of facts, entities, candidates and extracted values: each gives (valid, rejected), and no row is in both or neither."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of entities and methods of candidates; edges of strength tiers.
KINDS, METHODS = ["asset", "indicator"], ["pearson", "spearman", "partial"]
STRONG, MODERATE = 0.7, 0.5
#: Columns of an entity that its metadata cannot replace.
RESERVED = ["id", "name", "description"]


def _parted(df: DataFrame, ok: Column) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(ok, F.lit(False))
    return df.where(ok), df.where(~ok)


def filled(*columns: str) -> Column:
    """None of the columns is null or empty."""
    out = F.lit(True)
    for c in columns:
        out = out & (F.length(F.col(c)) > 0)
    return out


def facts(df: DataFrame, sources: list[str]) -> tuple[DataFrame, DataFrame]:
    """Facts (entity_type, entity_id, metric, value, timestamp, source): known kind and source, nothing empty; ids in upper case."""
    ok = F.col("entity_type").isin(KINDS) & F.col("source").isin(sources) & filled("entity_id", "metric") & F.col("value").isNotNull() & F.col("timestamp").isNotNull()
    valid, rejected = _parted(df, ok)
    return valid.withColumn("entity_id", F.upper("entity_id")), rejected


def entities(df: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """Entities (label, id, name, description, metadata map<string,string>): known label, nothing empty; valid ones get props.

    props: the metadata without reserved names and nulls, and then id, name and description.
    """
    valid, rejected = _parted(df, F.col("label").isin(labels) & filled("id", "name"))
    own = F.create_map(*(x for c in RESERVED for x in (F.lit(c), F.col(c).cast("string"))))
    meta = F.map_filter(F.coalesce("metadata", F.expr("cast(map() as map<string,string>)")), lambda k, v: ~k.isin(RESERVED) & v.isNotNull())
    return valid.select("label", "id", "name", F.map_concat(meta, own).alias("props")), rejected


def candidates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (a, b, lag, r, p, n, method, window_days), a and b as kind:id: ranges, kinds and method, two different ids.

    Valid ones get upper-case ids, r and p to six places, strength, direction and tier.
    """
    kind, name = (lambda c: F.substring_index(c, ":", 1)), (lambda c: F.element_at(F.split(c, ":", 2), 2))
    ok = F.col("r").between(-1, 1) & F.col("p").between(0, 1) & (F.col("lag") >= 0) & (F.col("n") > 0) & (F.col("window_days") > 0) & F.col("method").isin(METHODS)
    ok = ok & kind("a").isin(KINDS) & kind("b").isin(KINDS) & (F.length(name("a")) > 0) & (F.length(name("b")) > 0) & (F.upper(name("a")) != F.upper(name("b")))
    valid, rejected = _parted(df, ok)
    s = F.abs("r")
    derived = {
        "a": F.concat_ws(":", kind("a"), F.upper(name("a"))), "b": F.concat_ws(":", kind("b"), F.upper(name("b"))), "r": F.round("r", 6), "p": F.round("p", 6), "strength": F.round(s, 6),
        "direction": F.when(F.col("r") >= 0, "positive").otherwise("negative"), "tier": F.when(s >= STRONG, "strong").when(s >= MODERATE, "moderate").otherwise("store"),
    }
    return valid.withColumns(derived), rejected


def edge_properties(df: DataFrame, end: Column, now: Column) -> DataFrame:
    """(a, b, props): what an edge of a valid candidate holds; a new one is half sure, never tested, and valid from now on without an end."""
    own = ["strength", "direction", F.col("r").alias("correlation"), F.col("p").alias("p_value"), "method", "tier", F.col("lag").alias("lag_days"), F.col("n").alias("observation_count"), "window_days"]
    fixed = {"window_end": end, "confidence": F.lit(0.5), "source": F.lit("statistical"), "status": F.col("status"), "times_tested": F.lit(0), "times_confirmed": F.lit(0), "valid_from": now, "valid_until": F.lit(None).cast("timestamp")}
    return df.select("a", "b", F.struct(*own, *(c.alias(k) for k, c in fixed.items())).alias("props"))


def label_of(raw: Column, labels: list[str]) -> Column:
    """The label that a raw name means, whatever its case and blanks; null if none."""
    known = F.create_map(*(F.lit(x) for label in labels for x in (label.lower(), label)))
    return known[F.lower(F.replace(F.trim(raw), F.lit(" "), F.lit("")))]


def relation_of(raw: Column) -> Column:
    return F.replace(F.upper(F.trim(raw)), F.lit(" "), F.lit("_"))


def clamp(x: Column) -> Column:
    """Between 0 and 1; null and NaN are 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))


def safe_relation(kind: Column) -> Column:
    """Whether a name of a relationship may stand in a statement: capitals and underscores, two at least, a capital first."""
    return F.coalesce(F.regexp_like(kind, F.lit("^[A-Z][A-Z_]{1,}$")), F.lit(False))


def long_enough(text: Column, least: int = 50) -> Column:
    """Whether a text has so many words parted by white space; null and blank texts have none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")) >= least


def known_ids(ids: Column, valid: Column) -> Column:
    """The ids that are among the valid ones, in their order, repeats included."""
    return F.filter(ids, lambda x: F.array_contains(valid, x))
