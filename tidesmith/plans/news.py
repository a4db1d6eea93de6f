"""Queries over feeds, made from documents (RSS) and pages (Atom), each feed of at most 25 items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesmith.plans.catalogue import ORACLE_SQL, query
from tidesmith.sources import feeds
from tidesmith.sources.market import table

NOW = "2026-03-21 00:00:00"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def landed_feeds(spark: SparkSession, d: str) -> DataFrame:
    """(feed, place, category, tier, content_type, xml): some feeds were not fetched, some are cut off, some have no valid tier."""
    day = lambda n: F.timestamp_seconds(F.lit(1772323200) + n % 20 * 86400)  # noqa: E731  from 1 March 2026 on
    n, text = F.col("doc_id"), F.regexp_replace(F.coalesce("text", F.lit("")), r"[&<>\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", " ")
    item = F.concat(
        F.lit("<item><title>Doc &lt;i&gt;"), n, F.lit("&lt;/i&gt; &amp;amp; more</title><link> http://news/doc/"), n, F.lit("</link><description><![CDATA[<p>"), text,
        F.lit("</p>]]></description><pubDate>"), F.date_format(day(n), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>"),
    )
    m = F.col("page_id")
    entry = F.concat(
        F.lit("<entry><title>Page "), m, F.lit('</title><link rel="self" href="http://self/'), m, F.lit('"/><link href="'), _escaped(F.col("url")), F.lit('"/><content type="html">'), _escaped(F.col("html")),
        F.lit("</content><updated>"), F.date_format(day(m), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</updated></entry>"),
    )
    kinds = [("documents", "doc", n, item, "<rss version='2.0'><channel>", "</channel></rss>", 0), ("pages", "page", m, entry, f"<feed xmlns='{feeds.ATOM}'>", "</feed>", 1)]
    out = []
    for name, kind, key, one, head, tail, odd in kinds:
        rows = table(spark, d, name).where(key.isNotNull()).select(F.floor(key / 25).alias("k"), key.alias("i"), one.alias("one"))
        k = F.col("k")
        body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "one"))), lambda x: x["one"]), "")
        xml = F.concat(F.lit(head), F.col("body"), F.when(k % 7 == 3, tail[:5]).otherwise(tail))
        tier = F.when(k % 13 == 6, "9").otherwise((k % 3 + 1).cast("string"))
        out.append(
            rows.groupBy("k").agg(body.alias("body")).select(
                F.concat_ws("-", F.lit(kind), k).alias("feed"), (k * 2 + odd).alias("place"), F.lit(kind).alias("category"), tier.alias("tier"), F.lit("full_text").alias("content_type"),
                F.when(k % 11 != 5, xml).alias("xml"),
            )
        )
    return out[0].unionByName(out[1])


_WHITE = r"[\s\x1c-\x1f\x{85}\p{Z}]+"
ITEMS = f"""
texts AS (SELECT doc_id AS i, 'doc' AS kind, 'Doc ' || doc_id || ' & more' AS title, 'http://news/doc/' || doc_id AS link,
  trim(regexp_replace(regexp_replace(coalesce(text, ''), '[&<>\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{{FFFE}}\\x{{FFFF}}]', ' ', 'g'), '{_WHITE}', ' ', 'g')) AS summary FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT page_id, 'page', 'Page ' || page_id, url, h.text FROM pages JOIN ({ORACLE_SQL["html_strip"]}) h USING (page_id)),
every AS (SELECT *, CAST(floor(i / 25) AS BIGINT) AS k, row_number() OVER (PARTITION BY kind, floor(i / 25) ORDER BY i) - 1 AS pos, 1772323200 + i % 20 * 86400 AS second FROM texts),
feeds AS (SELECT DISTINCT kind || '-' || k AS feed, k * 2 + CASE kind WHEN 'doc' THEN 0 ELSE 1 END AS place, CASE WHEN k % 13 = 6 THEN 'unexpected_error' WHEN k % 11 = 5 THEN 'fetch_failed' WHEN k % 7 = 3 THEN 'parse_failed' END AS error, k % 11 = 5 OR k % 7 = 3 AS broken FROM every)"""


@query(f"WITH {ITEMS} SELECT kind || '-' || k AS feed, pos, link, title, md5(summary) AS summary_md5, second FROM every JOIN feeds ON feed = kind || '-' || k WHERE NOT broken")
def feed_items(spark, d):
    """Every item of every feed that can be read, RSS and Atom."""
    rows = feeds.items(feeds.parse(landed_feeds(spark, d)))
    when = F.unix_seconds(feeds.published(F.col("published"), F.lit(NOW).cast("timestamp")))
    return rows.select("feed", "pos", "link", "title", F.md5(F.col("summary").cast("binary")).alias("summary_md5"), when.alias("second"))


RUN = f"""
rows AS (SELECT feed, place, link, second < epoch(TIMESTAMP '{NOW}') - 7 * 86400 AS old, link IN (SELECT 'http://news/doc/' || doc_id FROM labels) AS known FROM every JOIN feeds ON feed = kind || '-' || k WHERE error IS NULL AND pos < 20),
first AS (SELECT link, min(place) AS p FROM rows WHERE NOT known AND NOT old GROUP BY link),
judged AS (SELECT feed, known OR coalesce(p < place, false) AS twice, old FROM rows LEFT JOIN first USING (link)),
counted AS (SELECT feed, count(*) FILTER (NOT twice AND NOT old) AS stored, count(*) FILTER (twice) AS duplicates, count(*) FILTER (NOT twice AND old) AS old FROM judged GROUP BY feed),
counts AS (SELECT feed, coalesce(stored, 0) AS stored, CASE WHEN error IS NULL THEN 0 ELSE 1 END AS failed, coalesce(duplicates, 0) AS duplicates, coalesce(old, 0) AS old, error FROM feeds LEFT JOIN counted USING (feed))"""


def run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    known = table(spark, d, "labels").select(F.concat(F.lit("http://news/doc/"), "doc_id").alias("url"))
    return feeds.run(landed_feeds(spark, d), known, F.lit(NOW).cast("timestamp"))


@query(f"WITH {ITEMS}, {RUN} SELECT * FROM counts")
def feed_run(spark, d):
    """What a run over all feeds stores, feed by feed."""
    return run(spark, d)[1].drop("place")


@query(f"WITH {ITEMS}, {RUN} SELECT CAST(sum(stored) AS BIGINT) AS stored, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(duplicates) AS BIGINT) AS duplicates, CAST(sum(old) AS BIGINT) AS old, count(*) AS feeds FROM counts")
def feed_totals(spark, d):
    return feeds.summary(run(spark, d)[1])
