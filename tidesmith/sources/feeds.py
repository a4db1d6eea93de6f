"""Feeds as they were fetched, RSS or Atom in one column of XML: items, failures by feed, and a run that admits new articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesmith.operators.text import published, strip_html
from tidesmith.sources.kept import keep

# The name space of Atom, and the tiers that a feed may have.
ATOM, TIERS = "http://www.w3.org/2005/Atom", ["1", "2", "3"]
#: Items of a feed that count, from its start, and days after which an article is too old.
PER_FEED, MOST_DAYS = 20, 7

#: An element that may be missing (null), empty, or hold text in pieces between other elements; the text before the first of them counts.
_TEXT = "struct<_VALUE:array<string>>"
_RSS_ITEM = f"array<struct<title:{_TEXT},link:{_TEXT},description:{_TEXT},pubDate:{_TEXT}>>"
_RSS = f"channel array<struct<item:{_RSS_ITEM}>>, item {_RSS_ITEM}, _corrupt_record string"
_ATOM = f"entry array<struct<title:{_TEXT},link:array<struct<_href:string,_rel:string>>,summary:{_TEXT},content:{_TEXT},published:{_TEXT},updated:{_TEXT}>>, _corrupt_record string"
_ITEM = "array<struct<title:string,link:string,summary:string,published:string>>"
_ROOT = r"(?s)^\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|<![A-Za-z][^>\[]*(?:\[.*?\]\s*)?>\s*)*<(?:([^\s<>:/]+):)?[^\s<>:/]+([^<>]*)"


def _text(element: Column) -> Column:
    """The text of an element; empty if it has none, null if there is no such element."""
    return F.when(element.isNotNull(), F.coalesce(F.get(element["_VALUE"], F.lit(0)), F.lit("")))


def _is_atom(xml: Column) -> Column:
    """Whether the root is of Atom's name space: the default one, or that of the root's own prefix."""
    prefix = F.regexp_extract(xml, _ROOT, 1)
    name = F.when(prefix == "", "xmlns").otherwise(F.concat(F.lit("xmlns:"), prefix))
    spaces = F.regexp_extract_all(F.regexp_extract(xml, _ROOT, 2), F.lit(r"""([^\s=]+)\s*=\s*["']([^"']*)["']"""), F.lit(0))
    bare = F.transform(spaces, lambda s: F.regexp_replace(s, r"""\s*=\s*["']([^"']*)["']$""", "=$1"))
    return F.array_contains(bare, F.concat(name, F.lit(f"={ATOM}")))


def _unprefixed(xml: Column) -> Column:
    """Atom under a prefix as Atom without one."""
    prefix = F.regexp_extract(xml, _ROOT, 1)
    return F.when(prefix == "", xml).otherwise(F.regexp_replace(xml, F.concat(F.lit("(</?)"), prefix, F.lit(":")), F.lit("$1")))


def _link(links: Column) -> Column:
    """The first alternate link (one without rel is alternate); without its address the first link's."""
    alternate = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return F.coalesce(F.nullif(F.get(alternate, F.lit(0))["_href"], F.lit("")), F.get(links, F.lit(0))["_href"])


def parse(feeds: DataFrame) -> DataFrame:
    """feeds (xml, ...) with items, array<struct<title, link, summary, published>>, and error.

    The root's name space decides between Atom and RSS. RSS: title, link, description and pubDate of each item. Atom: title, an alternate link's
    address, summary or else content, published or else updated. Items without a link are left out; titles and summaries lose their
    mark-up. error: fetch_failed for null, parse_failed for what is no well-formed XML (no items then), null otherwise.
    """
    options = {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"}
    atom = _is_atom(F.col("xml"))
    read = feeds.select("*", F.from_xml(F.when(~atom, F.col("xml")), _RSS, options).alias("_rss"), F.from_xml(F.when(atom, _unprefixed(F.col("xml"))), _ATOM, options).alias("_atom"))

    def item(title: Column, link: Column, summary: Column, date: Column) -> Column:
        return F.struct(strip_html(_text(title)).alias("title"), F.btrim(link).alias("link"), strip_html(_text(summary)).alias("summary"), _text(date).alias("published"))

    none = F.expr(f"cast(array() as {_RSS_ITEM})")
    channels = F.flatten(F.transform(F.col("_rss.channel"), lambda c: F.coalesce(c["item"], none)))
    rss = F.transform(F.concat(F.coalesce(channels, none), F.coalesce("_rss.item", none)), lambda x: item(x["title"], _text(x["link"]), x["description"], x["pubDate"]))
    entries = F.transform(F.col("_atom.entry"), lambda x: item(x["title"], _link(x["link"]), F.when(x["summary"].isNotNull(), x["summary"]).otherwise(x["content"]), F.when(x["published"].isNotNull(), x["published"]).otherwise(x["updated"])))
    broken = F.col("_rss._corrupt_record").isNotNull() | F.col("_atom._corrupt_record").isNotNull()
    error = F.when(F.col("xml").isNull(), "fetch_failed").when(broken, "parse_failed")
    found = F.filter(F.coalesce(F.when(F.col("_atom").isNotNull(), entries), rss).cast(_ITEM), lambda x: F.coalesce(x["link"], F.lit("")) != "")
    items = F.when(error.isNull(), found).otherwise(F.expr(f"cast(array() as {_ITEM})"))
    return read.select(*feeds.columns, items.alias("items"), error.alias("error"))


def items(parsed: DataFrame, most: int | None = None) -> DataFrame:
    """One row for each item of parsed feeds, with its place in the feed from 0; with `most`, the first so many of each feed."""
    cut = F.col("items") if most is None else F.slice("items", 1, most)
    rest = [c for c in parsed.columns if c not in ("xml", "items", "error")]
    return parsed.where("error is null").select(*rest, F.posexplode(cut).alias("pos", "item")).select(*rest, "pos", "item.*")


def run(feeds: DataFrame, known: DataFrame, now: Column, per_feed: int = PER_FEED, most_days: int = MOST_DAYS) -> tuple[DataFrame, DataFrame]:
    """(new articles, counts by feed) of feeds (feed, place, category, tier, content_type, xml), taken in the order of place. known: (url).

    Of each feed the first items count. An item is a duplicate if its url is known or a feed before has stored it, old if it was published
    over most_days before now (what has no readable date is new), else stored; a url that a feed repeats is one article, with what comes last.
    Counts: stored, failed, duplicates, old, and error; a feed that cannot be read, or has no valid tier, fails alone.
    """
    parsed = keep(parse(feeds.withColumn("xml", F.when(F.col("tier").isin(TIERS), F.col("xml")))).drop("xml"))
    rows = items(parsed, per_feed)
    seen = known.select(F.col("url").alias("link"), F.lit(True).alias("_known")).distinct()
    rows = rows.join(seen, "link", "left").withColumn("_old", published(F.col("published"), now) < now - F.make_dt_interval(F.lit(most_days)))
    rows = keep(rows.withColumn("_known", F.coalesce("_known", F.lit(False))))
    first = rows.where("not _known and not _old").groupBy("link").agg(F.min("place").alias("_first"))
    judged = rows.join(first, "link", "left").withColumn("_twice", F.col("_known") | F.coalesce(F.col("_first") < F.col("place"), F.lit(False)))
    judged = judged.withColumn("_new", ~F.col("_twice") & ~F.col("_old"))
    count = lambda c: F.count_if(c)
    by_feed = judged.groupBy("feed", "place").agg(count(F.col("_new")).alias("stored"), count(F.col("_twice")).alias("duplicates"), count(~F.col("_twice") & F.col("_old")).alias("old"))
    error = F.when(~F.col("tier").isin(TIERS) | F.col("tier").isNull(), "unexpected_error").otherwise(F.col("error"))
    whole = parsed.select("feed", "place", error.alias("error")).join(by_feed, ["feed", "place"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    counts = whole.select("feed", "place", zero("stored"), F.col("error").isNotNull().cast("long").alias("failed"), zero("duplicates"), zero("old"), "error")
    text = lambda c, otherwise: F.coalesce(F.nullif(c, F.lit("")), F.lit(otherwise)).alias(c)
    article = F.struct(
        text("title", "Untitled"), text("summary", ""), F.col("feed").alias("source"), F.col("category").alias("source_category"), published(F.col("published"), now).alias("published_date"),
        now.alias("collected_at"), "content_type", "tier", F.lit("raw").alias("status"),
    )
    new = judged.where("_new").groupBy(F.col("link").alias("url")).agg(F.max_by(article, "pos").alias("a"))
    return new.select("url", "a.*"), counts


def summary(counts: DataFrame) -> DataFrame:
    """One row of a whole run: sums over its feeds, how many there were and how many failed."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("stored", "failed", "duplicates", "old")]
    return counts.agg(*sums, F.count("*").alias("feeds"))
