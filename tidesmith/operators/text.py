"""Text operators: HTML cleaning, admission of articles, mentions, checks of extracted entities."""

from __future__ import annotations

from collections.abc import Iterator
from html.entities import html5

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidesmith.operators.validate import clamp, label_of, long_enough, relation_of

# Named character references of HTML 5 by name, as the standard library lists them; the old ones also stand without a semicolon.
# Short names come first, as they are the frequent ones and a map is searched from its start.
_NAMED = "\u0001".join(f"{name}\u0002{char}" for name, char in sorted(html5.items(), key=lambda x: (len(x[0]), x[0])))
_OLD = "|".join(sorted((x for x in html5 if not x.endswith(";")), key=len, reverse=True))
REFERENCE = r"&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[A-Za-z][A-Za-z0-9]*;?)"
#: What the numbers 128 to 159 stand for: the characters of that Windows code page, where it has one.
_WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160))


def _numbered(n: Column) -> Column:
    """The character of a number: U+FFFD for those that are none, nothing for control characters and non-characters."""
    none = n.isNull() | (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    mute = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(none, "\ufffd").when(n.between(128, 159), F.lit(_WINDOWS).substr((n - 127).cast("int"), F.lit(1))).when(mute, "").otherwise(char)


def decode_references(text: Column) -> Column:
    """text with each character reference, named or numbered, replaced once (so `&amp;lt;` becomes `&lt;`); unknown names stay."""
    named = F.str_to_map(F.lit(_NAMED), F.lit("\u0001"), F.lit("\u0002"))

    def one(hit: Column) -> Column:
        digits = F.regexp_replace(hit, "^&#[xX]?0*|;$", "")
        name = hit.substr(F.lit(2), F.length(hit))
        old = F.regexp_extract(name, f"^({_OLD})", 1)
        known = F.coalesce(F.try_element_at(named, name), F.concat(F.try_element_at(named, old), name.substr(F.length(old) + 1, F.length(name))), hit)
        number = F.when(digits == "", 0).when(F.length(digits) <= 8, F.when(hit.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long"))
        return F.when(hit.startswith("&#"), _numbered(number)).otherwise(known)

    hits = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)))
    whole = F.array_join(F.zip_with(hits, F.split(text, REFERENCE, -1), lambda hit, after: F.concat(one(hit), after)), "")
    return F.when(text.contains("&"), whole).otherwise(text)


def strip_html(html: Column) -> Column:
    """CDATA unwrapped, tags out, character references decoded (escaped tags stay as text), white space collapsed."""
    x = F.regexp_replace(html, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    x = F.transform(F.array(F.regexp_replace(x, "<[^>]+>", "")), decode_references)[0]  # bound once, not cut anew for each use
    return F.btrim(F.regexp_replace(x, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


# The forms of dates in feeds, without the day of the week, each with the shape that any text in it has; they come after what Spark itself reads (ISO 8601).
DATES = {
    f"{day} HH:mm{seconds}{zone}": f"^[^ ]+ [^ ]+ {year} [0-9]{{2}}:[0-9]{{2}}{':[0-9]{2}' if seconds else ''}{end}$"
    for day, year in (("d MMM yyyy", "[+-]?[0-9]{4,}"), ("d MMM yy", "[0-9]{2}"))
    for seconds in (":ss", "")
    for zone, end in ((" Z", " [+-][0-9]{4}"), (" z", " .+"), ("", ""))
} | {"d MMM yyyy": "^[^ ]+ [^ ]+ [+-]?[0-9]{4,}$", "yyyy/M/d": "^[^/]+/[^/]+/[^/]+$"}


def published(text: Column, otherwise: Column) -> Column:
    """The time that a feed's date stands for (without a zone: the session's); `otherwise` where it is null, empty or in no known form."""
    bare = F.regexp_replace(F.btrim(text), r"^[A-Za-z]{3,9},?\s+(?=[0-9])", "")

    def read(t: Column) -> Column:
        # a form that fails costs an error of the parser, so only those of the text's own shape are tried
        return F.coalesce(F.try_to_timestamp(t), *(F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(form))) for form, shape in DATES.items()))

    return F.coalesce(F.transform(F.array(bare), read)[0], otherwise)  # bound once, not cut anew for each form


def admit(articles: DataFrame, known: DataFrame, per_feed: int = 20, since: Column | None = None) -> DataFrame:
    """The first per_feed articles of each feed by position, then those with a url that is not known. Articles: (feed, pos, url[, published]).

    With `since`, articles published before it go; those whose date cannot be read stay. Of repeated urls the first by feed and position stays.
    """
    head = articles.withColumn("n", F.row_number().over(Window.partitionBy("feed").orderBy("pos"))).where(F.col("n") <= per_feed).drop("n")
    fresh = head if since is None else head.where(published(F.col("published"), since) >= since)
    once = fresh.where("url is not null and url <> ''").withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("feed", "pos"))).where("n = 1").drop("n")
    return once.join(known.select("url"), "url", "left_anti")


#: Bytes of names that one automaton holds; more names are dealt to several, each of which reads the texts once.
NAMES_BYTES = 32 << 20
_APART = regex.compile(r"[^\p{L}0-9]+")
_WORD = regex.compile(r"[\p{L}0-9]+")


def _normal(text: str) -> str:
    """The words of a text in lower case, a blank before each."""
    words = _APART.sub(" ", text.lower()).strip()
    return " " + words if words else ""


def _places(text: str) -> list[tuple[int, int]]:
    """Start and end, in code points of the text itself, of each of its words as _normal has them."""
    low = text.lower()
    spans = [m.span() for m in _WORD.finditer(low)]
    if len(low) == len(text):
        return spans
    ends = np.cumsum([len(c.lower()) for c in text])  # some characters have two in lower case
    at = lambda i: int(np.searchsorted(ends, i, side="right"))
    return [(at(a), at(b - 1) + 1) for a, b in spans]


def _automaton(names: list[str]):
    """All names at once, as their words; a name without a word is never found. Names of the same words are found together."""
    import ahocorasick

    of: dict[str, list[str]] = {}
    for name in sorted(set(names)):
        if words := _normal(name):
            of.setdefault(words, []).append(name)
    found = ahocorasick.Automaton()
    for words, own in of.items():
        found.add_word(words, (len(words), words.count(" "), own))
    if of:
        found.make_automaton()
    return found if of else None


def _hits(automaton, words: str):
    """(word, words, names) of every match that ends where a word ends, in the order of ends."""
    for end, (length, k, own) in automaton.iter(words):
        if end + 1 == len(words) or words[end + 1] == " ":
            yield words.count(" ", 0, end - length + 2) - 1, k, own


def _longest(hits: list[tuple]) -> list[tuple]:
    """Of matches (word, words, ...) that overlap, the leftmost, and of those the longest."""
    out, free = [], 0
    for hit in sorted(hits, key=lambda h: (h[0], -h[1])):
        if hit[0] >= free:
            out.append(hit)
            free = hit[0] + hit[1]
    return out


_SPANS = "doc_id {}, name string, word int, words int, start int, end int"
_KINDS = {"name": pa.string(), "word": pa.int32(), "words": pa.int32(), "start": pa.int32(), "end": pa.int32()}
#: Matches that a task gathers before it hands them on (and all those of the text that it is in).
GATHERED = 20_000


def _search(names: list[str], longest: bool, spans: bool):
    kinds = list(_KINDS.items())[: 5 if spans else 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(names)
        for batch in batches:
            docs, texts = batch.column("doc_id"), batch.column("text")
            at: list[int] = []
            out: list[tuple] = []

            def made() -> pa.RecordBatch:
                columns = zip(*out) if out else [()] * len(kinds)
                return pa.RecordBatch.from_arrays([docs.take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(columns, kinds))], ["doc_id", *(n for n, _ in kinds)])

            for i in range(batch.num_rows):
                text = texts[i].as_py()
                hits = list(_hits(automaton, _normal(text))) if automaton is not None and text else []
                before = len(out)
                if not spans:
                    out.extend((name,) for name in {name for _, _, own in hits for name in own})
                elif hits:
                    places = _places(text)
                    for word, k, own in _longest(hits) if longest else hits:
                        out.extend((name, word, k, places[word][0], places[word + k - 1][1]) for name in own)
                at.extend([i] * (len(out) - before))
                if len(out) >= GATHERED:
                    yield made()
                    at.clear()
                    out.clear()
            yield made()

    return run


def _blocks(names: DataFrame, most: int) -> list[list[str]]:
    """The names in blocks of at most so many bytes of names each (by hash; a name of more bytes alone is a block)."""
    named = names.where(F.col("name").isNotNull()).select("name").distinct()
    size = named.agg(F.coalesce(F.sum(F.octet_length("name")), F.lit(0))).head()[0]
    n = -(-size // most)
    block = F.pmod(F.xxhash64("name"), F.lit(max(n, 1)))
    return [[r["name"] for r in named.where(block == i).collect()] for i in range(n)]


def mention_spans(texts: DataFrame, names: DataFrame, longest: bool = True, most: int = NAMES_BYTES) -> DataFrame:
    """(doc_id, name, word, words, start, end) where a text (doc_id, text) holds the words of a name (name) one after another.

    Case and the marks between words do not matter; names may have any number of words. word: which word of the text, from 0; start and end in code
    points. With `longest`, of matches that overlap the leftmost counts, and of those the longest; names of the same words are found together.
    One automaton over all names reads each text once. It goes to every task, so its names are measured first: beyond `most` bytes they are dealt
    to several automata, whose matches meet by text; the driver holds all names while the plan is made. Null texts and names, and names without a word, are never found.
    """
    blocks = _blocks(names, most)
    kinds = _SPANS.format(texts.schema["doc_id"].dataType.simpleString())
    if len(blocks) <= 1:
        return texts.select("doc_id", "text").mapInArrow(_search((blocks or [[]])[0], longest, True), kinds)
    # matches of one text meet again; its own hash tells it from others of the same doc_id
    rows = texts.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("doc_id"), "text")
    found = None
    for block in blocks:
        part = rows.mapInArrow(_search(block, False, True), _SPANS.format(rows.schema["doc_id"].dataType.simpleString()))
        found = part if found is None else found.unionByName(part)
    found = found.select("doc_id.*", *found.columns[1:])
    if not longest:
        return found.drop("hash")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = set(_longest(list(zip(pdf["word"], pdf["words"]))))
        return pdf[[x in kept for x in zip(pdf["word"], pdf["words"])]].drop(columns="hash").drop_duplicates()

    return found.groupBy("doc_id", "hash").applyInPandas(settle, kinds)


def mentions(texts: DataFrame, names: DataFrame, most: int = NAMES_BYTES) -> DataFrame:
    """(doc_id, name), once each, where a text holds the name's words one after another, whatever their case and the marks between them."""
    kinds = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, name string"
    found = None
    for block in _blocks(names, most) or [[]]:
        part = texts.select("doc_id", "text").mapInArrow(_search(block, False, False), kinds)
        found = part if found is None else found.unionByName(part)
    return found.distinct()


# Words of names that prove nothing.
STOP = ["inc", "ltd", "corp", "bank", "the", "group", "fund", "trust", "capital", "global", "energy", "financial", "national", "international"]


def grounded(text: Column, name: Column, span: Column | None = None, stop: list[str] = STOP) -> Column:
    """Whether a span or a name, or a word of the name of over four letters that is no stop word, stands in the text, whatever the case."""
    low = F.lower(text)
    word = F.exists(F.split(F.lower(F.trim(name)), r"\s+"), lambda w: (F.length(w) > 4) & ~w.isin(*stop) & low.contains(w))
    whole = low.contains(F.lower(F.trim(name)))
    return whole | word if span is None else F.coalesce(low.contains(F.lower(F.trim(span))), F.lit(False)) | whole | word


def relationships(rels: DataFrame, entities: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Relationships whose ends are both extracted entities, without SUPPLIES_TO a Commodity. Names meet trimmed and lower-cased, within an article where `by` names its columns."""
    by = list(by)
    e = entities.select(*by, F.lower(F.trim("name")).alias("_k"), "entity_type")
    ends = rels.withColumns({"_s": F.lower(F.trim("subject")), "_o": F.lower(F.trim("object"))})
    names = lambda c: e.select(*by, F.col("_k").alias(c)).distinct()
    known = ends.join(names("_s"), [*by, "_s"], "left_semi").join(names("_o"), [*by, "_o"], "left_semi")
    goods = e.where("entity_type = 'Commodity'").select(*by, F.col("_k").alias("_o"), F.lit("SUPPLIES_TO").alias("relationship_type"))
    return known.join(goods, [*by, "_o", "relationship_type"], "left_anti").select(*rels.columns)


#: Confidence that a relationship needs.
LEAST_CONFIDENCE = 0.70


def extraction(articles: DataFrame, entities: DataFrame, rels: DataFrame, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) that stand, of what was extracted from articles (doc_id, text), once for each doc_id.

    entities: (doc_id, pos, span, entity_type, name), rels: (doc_id, pos, subject, object, relationship_type, confidence). In this order: types are brought to the
    labels, and rows of none go; entities that the text does not hold go; of one name in an article the first stays; kinds and confidence of
    relationships are brought to their forms, and unsure ones go; articles of fewer than 50 words, or without entities, have no relationships; of one
    (subject, object, kind) the first stays; then the rules on ends (see relationships).
    """
    typed = entities.withColumn("entity_type", label_of(F.col("entity_type"), labels)).where("entity_type is not null and name is not null")
    texts = articles.select("doc_id", "text", long_enough(F.col("text")).alias("_long"))
    held = typed.join(texts, "doc_id").where(grounded(F.coalesce("text", F.lit("")), F.col("name"), F.col("span")))
    one = lambda df, *key: df.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", *key).orderBy("pos"))).where("_n = 1")
    kept = one(held, F.lower(F.trim("name"))).select(*entities.columns)
    formed = rels.withColumns({"relationship_type": relation_of(F.col("relationship_type")), "confidence": clamp(F.col("confidence"))}).where(F.col("confidence") >= LEAST_CONFIDENCE)
    judged = formed.join(texts.where("_long").select("doc_id"), "doc_id", "left_semi")
    first = one(judged, F.lower(F.trim("subject")), F.lower(F.trim("object")), "relationship_type").select(*rels.columns)
    return kept, relationships(first, kept, ("doc_id",))
