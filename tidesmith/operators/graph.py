"""Upserts and status changes as joins: facts, nodes, edges, candidates, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], changed: list[str]) -> DataFrame:
    """old with new's rows: where the key meets, only `changed` columns are replaced; other new rows are added whole."""
    n = new.select(*key, *(F.col(c).alias(f"_{c}") for c in old.columns if c not in key), F.lit(True).alias("_new"))
    o = old.withColumn("_old", F.lit(True))
    value = lambda c: F.when(F.col("_old").isNull() | (F.col("_new") & F.lit(c in changed)), F.col(f"_{c}")).otherwise(F.col(c))
    return o.join(n, key, "full").select(*(F.col(c) if c in key else value(c).alias(c) for c in old.columns))


def overlay(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Node upsert: maps of properties overlaid one by one; a null value removes its property. Both have a map column props."""
    n = new.select(*key, F.col("props").alias("_props"))
    kept = F.map_filter(F.coalesce("props", F.expr("map()")), lambda k, v: ~F.coalesce(F.map_contains_key("_props", k), F.lit(False)))
    added = F.map_filter(F.coalesce("_props", F.expr("map()")), lambda k, v: v.isNotNull())
    return old.join(n, key, "full").select(*key, F.map_concat(kept, added).alias("props"))


def edges_between(rels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relationships both of whose ends exist, once for each (from_id, rel_type, to_id)."""
    ids = nodes.select("id").distinct()
    both = rels.join(ids, F.col("from_id") == F.col("id"), "left_semi").join(ids, F.col("to_id") == F.col("id"), "left_semi")
    return both.dropDuplicates(["from_id", "rel_type", "to_id"])


def adjacency(edges: DataFrame) -> DataFrame:
    """Neighbours in both directions, each once: (id, other, rel_type)."""
    out = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other"), "rel_type")
    return out.union(edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("other"), "rel_type")).distinct()


def node(nodes: DataFrame, label: str, name: str) -> DataFrame:
    """The node of a label and an id; the predicate reaches the scan."""
    return nodes.where((F.col("label") == label) & (F.col("id") == name))


def entity_list(nodes: DataFrame, labels: list[str]) -> DataFrame:
    """All nodes of the labels with an id and a name, in order of names."""
    return nodes.where(F.col("label").isin(labels) & F.col("id").isNotNull() & F.col("name").isNotNull()).orderBy("name", "label", "id")


def insert_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and new; fails when it is run if a key of new repeats, there or in old."""
    every = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    whole = Window.partitionBy(*key)
    twice = (F.count("*").over(whole) > 1) & (F.max("_new").over(whole) == 1)
    checked = every.withColumn("_bad", F.when(twice, F.raise_error(F.concat_ws(" ", F.lit("duplicate key"), *(F.col(k).cast("string") for k in key)))))
    return checked.where(F.col("_bad").isNull()).select(*old.columns)


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (from_id, rel_type, to_id, props map) after new ones with both ends among nodes are merged in, property by property."""
    return overlay(old, edges_between(new, nodes), ["from_id", "rel_type", "to_id"])


def upsert_mentions(old: DataFrame, found: DataFrame, nodes: DataFrame, at: Column) -> DataFrame:
    """MENTIONS edges (url, id, matched_at) after articles' ids (url, ids) are merged in: known ids only, once each, matched now."""
    new = found.select("url", F.explode("ids").alias("id")).distinct().join(nodes.select("id").distinct(), "id", "left_semi").withColumn("matched_at", at)
    return upsert(old, new.select(*old.columns), ["url", "id"], ["matched_at"])


def article_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Articles by url: a known url gets the new values of all columns but its status, a new one comes whole; of repeated new urls the first by position."""
    first = first_of(new, ["url"], ["pos"]).select(*old.columns)
    return upsert(old, first, ["url"], [c for c in old.columns if c not in ("url", "status")])


def raw_articles(articles: DataFrame, since: Column | None = None) -> DataFrame:
    """Articles that wait, with a summary, newest first; with `since`, only those collected from then on."""
    some = articles.where("status = 'raw' and trim(summary) <> ''")
    return (some if since is None else some.where(F.col("collected_at") >= since)).orderBy(F.desc("collected_at"), "url")


def article_status(articles: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Articles after a run. outcomes: (url, ok). raw ones become mentions_done or mentions_failed; raw ones without a summary are skipped; all others stay."""
    new = F.when(F.col("status") != "raw", F.col("status")).when(F.coalesce(F.trim("summary"), F.lit("")) == "", "skipped_no_summary").when(F.col("_ok"), "mentions_done").when(~F.col("_ok"), "mentions_failed").otherwise(F.col("status"))
    by_url = outcomes.groupBy("url").agg(F.bool_or("ok").alias("_ok"))
    return articles.join(by_url, "url", "left").withColumn("status", new).select(*articles.columns)


def pending(edges: DataFrame, nodes: DataFrame, most: int = 200) -> DataFrame:
    """The strongest edges that wait for a verdict, with names and kinds of both ends: a report of at most so many."""
    at = lambda c: nodes.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name"), F.when(F.col("label") == "Indicator", "indicator").otherwise("asset").alias(f"{c}_type"))
    on = edges.where("status = 'pending_verification'").join(at("a"), "a").join(at("b"), "b")
    return on.orderBy(F.desc(F.abs("r")), "a", "b").limit(most)


CANDIDATE = ["a", "b", "lag", "method", "window_days"]


def replace_candidates(old: DataFrame, new: DataFrame, key: list[str], window: int) -> DataFrame:
    """The edge set (key, window_days, r, status, verdict) after a run: candidates of this window without a verdict go, new ones come; a verdict keeps its status.

    The result has the columns of old, so it can be old for the next window. Edges of other windows are others, even of the same key.
    """
    stays = old.where(~((F.col("status") == "candidate") & (F.col("window_days") == window) & F.col("verdict").isNull()))
    every = [*key, "window_days"]
    n = new.select(*key, F.lit(window).alias("window_days"), F.col("r").alias("_r"), F.lit(True).alias("_new"))
    status = F.when(F.col("verdict").isNotNull(), F.col("status")).when(F.col("_new"), F.lit("candidate")).otherwise(F.col("status"))
    return stays.join(n, every, "full").select(*every, F.coalesce("_r", "r").alias("r"), status.alias("status"), "verdict")


def replace_partial(old: DataFrame, new: DataFrame, window: int) -> DataFrame:
    """Edges (CANDIDATE, r, status, verdict) after a partial run: those of its method and window that are candidates or wait, without a verdict, go.

    New ones are merged in by five columns; an edge with a verdict gets the new r but keeps its status.
    """
    mine = (F.col("method") == "partial") & (F.col("window_days") == window) & F.col("status").isin("candidate", "pending_verification") & F.col("verdict").isNull()
    came = new.select(*CANDIDATE, F.struct("r", "status").alias("_new"))
    both = old.where(~F.coalesce(mine, F.lit(False))).join(came, CANDIDATE, "full")
    fresh = F.col("_new").isNotNull()
    value = {"r": F.when(fresh, F.col("_new.r")).otherwise(F.col("r")), "status": F.when(fresh & F.col("verdict").isNull(), F.col("_new.status")).otherwise(F.col("status"))}
    return both.select(*(value.get(c, F.col(c)).alias(c) for c in old.columns))


def write_verdicts(edges: DataFrame, results: DataFrame) -> DataFrame:
    """Edges after a verification: the ones with a result get the status that follows from its verdict, and its other values where edges have such columns.

    results: (a, b, method, window_days, verdict, ...). Edges are met by the first four; of several results of an edge the least verdict counts.
    """
    key = ["a", "b", "method", "window_days"]
    values = [c for c in edges.columns if c in results.columns and c not in (*key, "status")]
    new = results.groupBy(*key).agg(F.min_by(F.struct(*values), F.struct(*values)).alias("_new"))
    both = edges.join(new, key, "left")
    found = F.col("_new").isNotNull()
    changed = {c: F.when(found, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in values}
    changed["status"] = F.when(found, verdict_status(F.col("_new.verdict"))).otherwise(F.col("status"))
    return both.select(*(changed.get(c, F.col(c)).alias(c) for c in edges.columns))


def run_record(results: DataFrame, run: str, started: Column, finished: Column) -> tuple[DataFrame, DataFrame]:
    """(one audit row of a verification run, its result rows): counts by verdict, and each result under the run's id; a missing method is partial."""
    v = F.col("verdict")
    counts = results.agg(F.count("*").alias("total_pairs"), F.count_if(v.isin(PLAUSIBLE)).alias("promoted"), F.count_if(v.isin(SPURIOUS)).alias("rejected"), F.count_if(v == UNCERTAIN).alias("uncertain"))
    took = (F.unix_seconds(finished.cast("timestamp")) - F.unix_seconds(started.cast("timestamp"))).alias("duration_seconds")
    own = results.withColumn("method", F.coalesce("method", F.lit("partial")))
    return counts.select(F.lit(run).alias("run_id"), started.alias("started_at"), finished.alias("finished_at"), took, "*"), own.select(F.lit(run).alias("run_id"), *own.columns)


def verdict_counts(results: DataFrame) -> DataFrame:
    """(verdict, n, percent) of results, a row for each of the five verdicts in their order, also those that no result has; percent of nothing is 0."""
    n = results.groupBy("verdict").agg(F.count("*").alias("n"))
    total = results.agg(F.count("*")).scalar()
    every = results.sparkSession.createDataFrame(list(enumerate(VERDICTS)), "place int, verdict string")
    share = F.coalesce(F.try_divide(F.coalesce("n", F.lit(0)) * 100.0, total), F.lit(0.0))
    return every.join(n, "verdict", "left").select("place", "verdict", F.coalesce("n", F.lit(0)).alias("n"), share.alias("percent"))


def mention_totals(results: DataFrame) -> DataFrame:
    """Of a run's articles (ok, ids): how many, how many failed, mentions in all and on average of those that went well."""
    n = F.size(F.coalesce("ids", F.array().cast("array<string>")))
    return results.agg(F.count("*").alias("articles"), F.count_if(~F.col("ok")).alias("failed"), F.sum(F.when(F.col("ok"), n).otherwise(0)).alias("mentions"), F.avg(F.when(F.col("ok"), n)).alias("average"))


# The verdicts on an edge, in the order of reports.
VERDICTS = ["confirmed_plausible", "likely_plausible", "uncertain", "likely_spurious", "confirmed_spurious"]
PLAUSIBLE, UNCERTAIN, SPURIOUS = VERDICTS[:2], VERDICTS[2], VERDICTS[3:]


def verdict_status(verdict: Column) -> Column:
    """Plausible edges are candidates, spurious ones rejected; all others, null and unknown verdicts too, go on waiting."""
    return F.when(verdict.isin(SPURIOUS), "rejected").when(verdict.isin(PLAUSIBLE), "candidate").otherwise("pending_verification")


def needs_review(verdict: Column, confidence: Column, least: float = 0.65) -> Column:
    """A second look: always at uncertain, at likely_* below the confidence; never at anything else."""
    likely = verdict.isin("likely_plausible", "likely_spurious")
    return F.coalesce((verdict == UNCERTAIN) | (likely & (confidence < least)), F.lit(False))


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in the order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
