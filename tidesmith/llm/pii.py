"""Personal data, native: base patterns, and bootstrapped contextual extraction of further identifiers. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidesmith.llm.common import keep, table

# The forms of the base kinds. Written so that the regex engine neither backtracks nor recurses:
# possessive loops, and starts only where the first character class begins (or the match before ended).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
#: An ip's part of at most 255, leading zeros allowed.
PART = r"(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)|0++)"

#: Seeds beside the base kinds: access keys of a fixed form, and hexadecimal strings of 16 or more with both digits and letters.
SECRET = r"(?:AKIA[0-9A-Z]{16}|(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{16,})"
#: Candidates for further identifiers: runs of at least LEAST_LENGTH of these characters, however long, with a digit, less what marks end them.
# A pattern is the label before one: a word, a mark of = : #, and at most an opening quote or bracket.
CANDIDATE = r"(?<![A-Za-z0-9._@/#:-])(?=[A-Za-z._@/#:-]*+[0-9])[A-Za-z0-9@#][A-Za-z0-9._@/#:-]*[A-Za-z0-9]"
LEAST_LENGTH = 6
ROUNDS, LEAST_SEEDS, LEAST_PATTERN, LEAST_INSTANCE = 3, 5, 0.8, 0.9
#: Belief that an identifier needs whose shape no seed has.
LEAST_STRANGE = 0.95


#: Matches whose places are summed up together, and the characters before a match that come with it.
BLOCK, BEFORE = 256, 40


def _matches(text: Column, regex: str) -> Column:
    """array<struct<start, end, text, before>> of a regex's matches in code points, by the lengths of matches and of what lies between them.

    Places are sums of those lengths, taken by blocks: sums of whole blocks first, then inside each block from where it begins, so the work grows
    with the matches and not with their square. before: at least the BEFORE characters before a match, as far as the match before it reaches.
    """
    kind = "struct<start:int,end:int,text:string,before:string>"
    none = F.expr(f"cast(array() as array<{kind}>)")
    cut = F.struct(F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("hits"), F.split(text, regex, -1).alias("gaps"))

    def places(cut: Column) -> Column:
        def one(hit: Column, i: Column) -> Column:
            gap, last = F.get(cut["gaps"], i), F.coalesce(F.get(cut["hits"], i - 1), F.lit(""))
            return F.struct(F.length(gap).alias("gap"), hit.alias("hit"), F.concat(F.right(last, F.lit(BEFORE)), F.right(gap, F.lit(BEFORE))).alias("before"))

        return F.transform(cut["hits"], one)

    def blocks(steps: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(steps), F.lit(BLOCK))
        return F.transform(firsts, lambda i: F.slice(steps, i, BLOCK))

    def starts(of: Column) -> Column:
        """Where each block begins: a running sum over the blocks alone."""
        lengths = F.transform(of, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x["gap"] + F.length(x["hit"])))
        return F.aggregate(lengths, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))

    def inside(block: Column, at: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            end = begin + F.length(x["hit"])
            hit = F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("text"), x["before"].alias("before"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(hit)).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def once(value: Column, then) -> Column:
        """then(value), with value computed a single time."""
        return F.get(F.transform(F.array(value), then), F.lit(0))

    found = once(cut, lambda c: once(once(places(c), blocks), lambda of: F.flatten(F.transform(F.arrays_zip(of.alias("b"), F.slice(starts(of), 1, F.size(of)).alias("s")), lambda x: inside(x["b"], x["s"])))))
    return F.when(F.regexp_like(text, F.lit(regex)), found).otherwise(none)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, every second from the right doubled (less 9 where that is over 9), sum up to a multiple of 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, text: Column) -> Column:
    n = F.length(_digits(text))
    return {
        "email": F.lit(True),
        "ip": F.regexp_like(text, F.lit(rf"^{PART}\.{PART}\.{PART}\.{PART}$")),
        "card": n.between(13, 19) & F.when(n.between(13, 19), _luhn(_digits(text))).otherwise(False),
        "phone": n.between(9, 15),
    }[kind]


def base_spans(docs: DataFrame) -> DataFrame:
    """docs with one array<struct<start, end, text, before>> for each of email, ip, card and phone."""
    t = F.coalesce("text", F.lit(""))

    def of(kind: str, regex: str) -> Column:
        return F.filter(_matches(t, regex), lambda m: _valid(kind, m["text"])).alias(kind)

    return docs.select("*", *(of(*x) for x in KINDS.items()))


def _context(before: Column) -> Column:
    """The label that the characters before a place end with, lower-cased, its white space as one blank; empty if there is none.

    A label is one run of letters, so it reaches into the match before at most: that holds a digit or an @.
    """
    return F.regexp_replace(F.lower(F.regexp_extract(before, r"([\p{L}_]{2,30}\s{0,2}[=:#]\s{0,2}[\"'(<\[]?)$", 1)), r"\s+", " ")


def _shape(text: Column) -> Column:
    """What an identifier looks like: runs of digits as 0, of letters as a, mixed ones as x."""
    runs = F.regexp_replace(text, r"\b(?=[0-9]*[A-Za-z])(?=[A-Za-z]*[0-9])[A-Za-z0-9]+\b", "\u0001")
    return F.translate(F.regexp_replace(F.regexp_replace(runs, "[A-Za-z]+", "a"), "[0-9]+", "0"), "\u0001", "x")


def candidates(spans: DataFrame) -> DataFrame:
    """(doc, doc_id, start, end, text, seed, base, pattern): base matches and other candidates, each with the pattern of its place.

    Candidates that overlap a base match go. A document's matches are met in the order of their starts: the furthest end of a base match so far
    and the next start of one tell.
    """
    t = F.coalesce("text", F.lit(""))
    own = lambda m, seed, base: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), seed.alias("seed"), F.lit(base).alias("base"), _context(m["before"]).alias("pattern"))
    base = F.flatten(F.array(*(F.transform(k, lambda m: own(m, F.lit(True), True)) for k in KINDS)))
    free = F.filter(_matches(t, CANDIDATE), lambda m: F.length(m["text"]) >= LEAST_LENGTH)
    free = F.transform(free, lambda m: own(m, F.regexp_like(m["text"], F.lit(f"^{SECRET}$")), False))
    rows = spans.select("doc", "doc_id", F.explode(F.concat(base, free)).alias("m")).select("doc", "doc_id", "m.*")
    by = Window.partitionBy("doc", "doc_id")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(by.orderBy("start", F.desc("base")).rowsBetween(Window.unboundedPreceding, 0))
    # in falling order, as a frame that reaches to the end is summed up anew for each row
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(by.orderBy(F.desc("start"), "base").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumns({"reach": F.coalesce(reach, F.lit(0)), "ahead": ahead})
    return placed.where("base or (reach <= start and (ahead is null or ahead >= end))").drop("reach", "ahead")


def bootstrap(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Candidates that are seeds, or that the patterns find: (doc, doc_id, start, end), by rounds over the graph of patterns and instances.

    An instance is an identifier's text; it starts believed (1) if it is a seed. A pattern's confidence is the share of
    belief among its distinct instances, once LEAST_SEEDS believed ones support it. An instance's belief is the noisy-or of the
    confidences of its patterns of LEAST_PATTERN or more. An identifier is found at a belief of LEAST_INSTANCE where it looks like some seed
    (digits, letters, marks), and of LEAST_STRANGE where it does not. Patterns are judged by the instances that look like a seed. Each round is one
    pass of partially aggregated sums over the graph, which holds a row for each pair of pattern and instance.
    """
    edges = keep(found.where("pattern <> ''").groupBy("pattern", "text").agg(F.max("seed").alias("seed")).withColumn("shape", _shape(F.col("text"))))
    shapes = edges.where("seed").select("shape", F.lit(True).alias("like")).distinct()
    edges = keep(edges.join(shapes, "shape", "left").withColumn("like", F.coalesce("like", F.lit(False))))
    belief = edges.groupBy("text").agg(F.max(F.col("seed").cast("double")).alias("belief"))
    for _ in range(rounds):
        scored = edges.join(belief.select("text", "belief"), "text")
        patterns = scored.where("like").groupBy("pattern").agg(F.sum("belief").alias("for"), F.count("*").alias("n")).where(
            (F.col("for") >= LEAST_SEEDS) & (F.col("for") >= LEAST_PATTERN * F.col("n"))
        )
        conf = patterns.select("pattern", F.least(F.col("for") / (F.col("n") + 1), F.lit(0.999)).alias("conf"))
        doubt = edges.join(conf, "pattern", "left").groupBy("text").agg(
            F.max("seed").alias("seed"), F.max("like").alias("like"), F.sum(F.log1p(-F.coalesce("conf", F.lit(0.0)))).alias("doubt")
        )
        belief = keep(doubt.select("text", "like", F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("doubt")).alias("belief")))
    good = belief.where(F.col("belief") >= F.when(F.col("like"), LEAST_INSTANCE).otherwise(LEAST_STRANGE)).select("text")
    free = found.where("not base")
    places = free.where("not seed and pattern <> ''").join(edges.where("not seed").select("pattern", "text"), ["pattern", "text"], "left_semi")
    return places.join(good, "text", "left_semi").union(free.where("seed").select(places.columns)).select("doc", "doc_id", "start", "end")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, email, ip, card, phone, learned): for each row of docs (doc_id, text, ...) its spans, in code points.

    Base kinds are found leftmost and without overlaps; matches that fail their check (parts of an ip, digits of a card or
    phone) are dropped. learned: identifiers that bootstrapped patterns find, none overlapping a base span. Null or empty
    text has none. A repeated row has the same spans as its copy; rows of null doc_id are searched too.
    """
    rows = docs.select("doc_id", "text").withColumn("doc", F.xxhash64("doc_id", "text"))
    spans = base_spans(rows)
    found = keep(candidates(spans))
    learned = bootstrap(found).distinct().groupBy("doc", F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("learned"))
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return spans.join(learned, (spans["doc"] == learned["doc"]) & spans["doc_id"].eqNullSafe(learned["id"]), "left").select("doc_id", *KINDS, F.coalesce("learned", none).alias("learned"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    text = lambda kind: F.transform(kind, lambda m: F.concat(F.lit(f"{kind}:"), m["start"].cast("string"), F.lit(":"), m["end"].cast("string")))
    base, every = F.concat(*map(text, KINDS)), F.concat(*map(text, [*KINDS, "learned"]))
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"),
    )
