"""Feeds: both formats, their fallbacks, CDATA, name spaces, broken rows; runs over several feeds."""

from pyspark.sql import functions as F

from tidesmith.sources import feeds as S

RSS = """<?xml version="1.0"?><!-- c --><!DOCTYPE rss [<!ENTITY x "y">]><rss version="2.0" xmlns:media="u" xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>of the channel</title><atom:link href="q"/>
<item><title>A &amp; &lt;b&gt;B&lt;/b&gt;</title><link> http://x/1 </link><description><![CDATA[<p>Hi &amp; bye</p>]]></description><pubDate>Mon, 23 Mar 2026 14:30:00 GMT</pubDate><media:title>no</media:title></item>
<item><title>no link</title><description>x</description><link/></item>
<item><link>http://x/2</link><description>first <b>bold</b> rest</description></item><item><title/><link>http://x/3</link></item></channel></rss>"""
ATOM = """<feed xmlns='http://www.w3.org/2005/Atom'><title>f</title><entry><title type="html">T &lt;i&gt;1</title><link rel="self" href="s"/><link href="http://a/1"/><content>c</content><updated>2026-03-23T14:30:00Z</updated></entry>
<entry><link rel="self" href="http://a/2"/><summary/><content>not this</content><published>p</published><updated>u</updated></entry><entry><title>no link</title></entry>
<entry><link rel="alternate"/><link href="http://a/3"/></entry></feed>"""
PREFIXED = '<a:feed xmlns:a="http://www.w3.org/2005/Atom" xmlns:m="n"><a:entry><a:title>P</a:title><m:title>other</m:title><a:link href="http://p/1"/><a:summary>s</a:summary></a:entry></a:feed>'


def test_both_formats_and_what_is_broken(spark):
    xml = [RSS, ATOM, PREFIXED, None, "", "plain", "<rss><channel><item><title>x</title>", "<rss><channel/></rss>", "<html><p>x</p></html>", "<rss><item><link>l</link></item></rss>"]
    parsed = S.parse(spark.createDataFrame(list(enumerate(xml)), "feed int, xml string"))
    got = {r["feed"]: ([tuple(x) for x in r["items"]], r["error"]) for r in parsed.collect()}
    assert got[0] == ([("A & B", "http://x/1", "Hi & bye", "Mon, 23 Mar 2026 14:30:00 GMT"), (None, "http://x/2", "first", None), ("", "http://x/3", None, None)], None)
    assert got[1] == ([("T 1", "http://a/1", "c", "2026-03-23T14:30:00Z"), (None, "http://a/2", "", "p")], None)  # an alternate link without an address, first of all, is none
    assert got[2] == ([("P", "http://p/1", "s", None)], None)
    assert {k: got[k] for k in range(3, 9)} == {3: ([], "fetch_failed"), 4: ([], "parse_failed"), 5: ([], "parse_failed"), 6: ([], "parse_failed"), 7: ([], None), 8: ([], None)}
    assert got[9] == ([(None, "l", None, None)], None)
    assert S.items(parsed.limit(0)).count() == 0


def rss(*items):
    return "<rss><channel>" + "".join(f"<item><link>{u}</link><title>{t}</title><pubDate>{d}</pubDate></item>" for u, t, d in items) + "</channel></rss>"


def test_a_run_over_feeds(spark):
    """The order of feeds decides who stores a url that several have; old ones store nothing, so a later feed may."""
    new, old = "2026-03-22T00:00:00Z", "2026-03-01T00:00:00Z"
    rows = [
        ("one", 1, "1", rss(("u1", "a", new), ("u2", "b", old), ("known", "c", new), ("u1", "a2", new), ("u5", "", "nobody knows"))),
        ("two", 2, "2", rss(("u1", "late", new), ("u2", "b2", new), ("known", "c", old))),
        ("three", 3, "3", rss(*((f"m{i}", "t", new) for i in range(25)), ("u9", "t", new))),
        ("four", 4, "1", None), ("five", 5, "1", "<rss><"), ("six", 6, "9", rss(("u7", "t", new))), ("seven", 7, "3", "<rss/>"), ("eight", 8, "1", rss(("u2", "again", old))),
    ]
    feeds = spark.createDataFrame(rows, "feed string, place int, tier string, xml string").withColumns({"category": F.lit("c"), "content_type": F.lit("summary")})
    known = spark.createDataFrame([("known",), ("known",)], "url string")
    articles, counts = S.run(feeds, known, F.lit("2026-03-23 00:00:00").cast("timestamp"))
    got = {r["feed"]: tuple(r)[2:] for r in counts.collect()}
    assert got == {
        "one": (3, 0, 1, 1, None), "two": (1, 0, 2, 0, None), "three": (20, 0, 0, 0, None), "four": (0, 1, 0, 0, "fetch_failed"), "five": (0, 1, 0, 0, "parse_failed"),
        "six": (0, 1, 0, 0, "unexpected_error"), "seven": (0, 0, 0, 0, None), "eight": (0, 0, 1, 0, None),
    }
    by_url = {r["url"]: r for r in articles.collect()}
    assert set(by_url) == {"u1", "u2", "u5", *(f"m{i}" for i in range(20))}
    assert (by_url["u1"]["title"], by_url["u1"]["source"], by_url["u2"]["source"], by_url["u5"]["title"]) == ("a2", "one", "two", "Untitled")
    assert tuple(S.summary(counts).first()) == (24, 3, 4, 1, 8)
    assert tuple(S.summary(counts.limit(0)).first()) == (0, 0, 0, 0, 0)
