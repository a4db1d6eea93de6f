"""Queries over what lands and is stored: answers of a judge, wide prices, seeds, facts, edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidesmith.operators import gates, landed, pipelines, seeding, text
from tidesmith.operators import graph as G
from tidesmith.operators import pairs as P
from tidesmith.operators import series as S
from tidesmith.plans.catalogue import CHANGED, CLIPPED, FILLED, MARKET, ORACLE_SQL, SCALED, STATUS, VERDICT, chain, filled, monthly_pairs, monthly_set, passes, query, returns, rounded
from tidesmith.sources import layout, wide
from tidesmith.sources.kept import keep, shared_dir
from tidesmith.sources.market import market_long, table

# --- answers ----------------------------------------------------------------------------------------------------------------

#: Each order is an edge with two answers; some are missing, cut off, or of no known verdict.
ANSWERS = f"""
o AS (SELECT o_orderkey, {VERDICT} AS v1, (o_orderkey % 100) / 100.0 AS c1, {G.VERDICTS}[o_orderkey % 5 + 1] AS v2, (o_orderkey % 50) / 50.0 AS c2,
  CASE WHEN o_orderkey % 10 = 9 THEN 'missing' WHEN o_orderkey % 10 = 3 THEN 'broken' WHEN o_orderkey % 6 = 5 THEN 'verdict' END AS e1 FROM orders),
r AS (SELECT *, e1 IS NULL AND (v1 = 'uncertain' OR v1 LIKE 'likely%' AND c1 < 0.65) AS review, o_orderkey % 4 = 1 AS cut FROM o),
j AS (SELECT o_orderkey, e1, review AND cut AS e2, CASE WHEN e1 IS NOT NULL THEN NULL WHEN review AND NOT cut THEN v2 ELSE v1 END AS verdict, CASE WHEN e1 IS NOT NULL THEN NULL WHEN review AND NOT cut THEN c2 ELSE c1 END AS confidence FROM r)"""


def answers(spark, d):
    """(edges, first answers, second answers)."""
    o = table(spark, d, "orders").withColumn("k", F.col("o_orderkey"))
    key = [F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"), F.lit("partial").alias("method"), F.lit(63).alias("window_days")]

    def said(verdict, confidence):
        return F.to_json(F.struct(F.lit("because").alias("mechanism"), F.lit("chance").alias("alternative_explanations"), F.upper(verdict).alias("verdict"), confidence.alias("confidence"), F.lit("so it is").alias("reasoning"), F.lit("Macro_Sensitivity").alias("relationship_category")))

    one = said(F.expr(VERDICT), F.col("k") % 100 / 100.0)
    two = said(F.element_at(F.array(*map(F.lit, G.VERDICTS)), (F.col("k") % 5 + 1).cast("int")), F.col("k") % 50 / 50.0)
    cut = lambda text: F.substring(text, 1, 40)
    edges = o.select(*key, F.lit("pending_verification").alias("status"), *(F.lit(None).cast(t).alias(c) for c, t in (("verdict", "string"), ("confidence", "double"), ("reasoning", "string"))))
    first = o.select(*key, F.when(F.col("k") % 10 == 9, None).when(F.col("k") % 10 == 3, cut(one)).otherwise(one).alias("response"))
    return edges, first, o.select(*key, F.when(F.col("k") % 4 == 1, cut(two)).otherwise(two).alias("response"))


@query(f"WITH {ANSWERS} SELECT o_orderkey, {STATUS.format('coalesce(verdict, chr(0))')} AS status, verdict, confidence, CASE WHEN verdict IS NOT NULL THEN 'so it is' END AS reasoning FROM j")
def verification_batch(spark, d):
    """Edges after both passes are read and written back; an edge without a good answer goes on waiting."""
    edges, first, second = answers(spark, d)
    results, _ = landed.verify(edges.select("a", "b", "method", "window_days"), first, second)
    return G.write_verdicts(edges, results).select(F.col("a").alias("o_orderkey"), "status", "verdict", "confidence", "reasoning")


@query(f"WITH {ANSWERS} SELECT o_orderkey, 1 AS pass, e1 AS error FROM j WHERE e1 IS NOT NULL UNION ALL SELECT o_orderkey, 2, 'broken' FROM j WHERE e2")
def verification_errors(spark, d):
    """Answers that could not be read, by pass and reason."""
    edges, first, second = answers(spark, d)
    return landed.verify(edges.select("a", "b", "method", "window_days"), first, second)[1].select(F.col("a").alias("o_orderkey"), "pass", "error")


@query(f"WITH {ANSWERS} SELECT CAST(o_orderkey AS VARCHAR) AS entity_a_id, '63' AS window_days, verdict, NULL AS direction FROM (SELECT * FROM j WHERE verdict IS NOT NULL ORDER BY o_orderkey LIMIT 200)")
def csv_audit(spark, d):
    """The audit file of a batch of 200 results, read back."""
    edges, first, second = answers(spark, d)
    results, _ = landed.verify(edges.select("a", "b", "method", "window_days"), first, second)
    path = shared_dir(spark)
    landed.write_audit(results.orderBy("a").limit(200).withColumnsRenamed({"a": "entity_a_id", "b": "entity_b_id"}), path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return back.select("entity_a_id", "window_days", "verdict", "direction")


#: The two hundred strongest edges alone.
ROUND = f"""WITH {ANSWERS},
top AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice / 1e6 DESC, o_orderkey, o_custkey LIMIT 200)"""


def verification(spark, d):
    """A round over all orders as edges that wait, between orders and customers as nodes."""
    edges, first, second = answers(spark, d)
    edges = edges.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("a"), (F.col("o_totalprice") / 1e6).alias("r")), "a")
    node = lambda rows, c, label: rows.select(F.col(c).alias("id"), F.concat(F.lit(label), F.col(c)).alias("name"), F.lit(label).alias("label"))
    # orders and customers are nodes of one table, so the ids of the latter are below zero
    low = lambda rows: rows.withColumn("b", -1 - F.col("b"))
    nodes = node(table(spark, d, "orders"), "o_orderkey", "Asset").union(node(table(spark, d, "customer").withColumn("c_custkey", -1 - F.col("c_custkey")), "c_custkey", "Indicator"))
    times = (F.lit(f"2026-03-23 14:0{m}:00").cast("timestamp") for m in (0, 4))
    return landed.round_of(low(edges), nodes, low(first), low(second), "run", *times)


@query(f"{ROUND} SELECT o_orderkey, CASE WHEN t.k IS NULL THEN 'pending_verification' ELSE {STATUS.format('coalesce(verdict, chr(0))')} END AS status, CASE WHEN t.k IS NOT NULL THEN verdict END AS verdict FROM j LEFT JOIN (SELECT o_orderkey AS k FROM top) t ON k = o_orderkey")
def verification_round(spark, d):
    """All edges after a round: those of the batch with a good answer have a verdict, all others wait as before."""
    return verification(spark, d)[0].select(F.col("a").alias("o_orderkey"), "status", "verdict")


@query(f"{ROUND} SELECT 'run' AS run_id, count(*) AS total_pairs, count(*) FILTER (verdict LIKE '%plausible') AS promoted, count(*) FILTER (verdict LIKE '%spurious') AS rejected, count(*) FILTER (verdict = 'uncertain') AS uncertain FROM j JOIN top USING (o_orderkey) WHERE verdict IS NOT NULL")
def verification_audit(spark, d):
    return verification(spark, d)[2].select("run_id", "total_pairs", "promoted", "rejected", "uncertain")


# --- wide prices --------------------------------------------------------------------------------------------------------------

DAYS = "SELECT CAST(l_shipdate AS DATE) AS date, 'N' || s_nationkey AS ticker, max(l_extendedprice) AS close, sum(l_quantity) AS volume FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL"


def wide_table(spark, d):
    """The highest price and the quantity of each nation and day, landed as a table of a column for each; one of the tickers never traded."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    days = rows.groupBy(F.to_date("l_shipdate").alias("date"), F.concat(F.lit("N"), "s_nationkey").alias("ticker")).agg(F.max("l_extendedprice").alias("Close"), F.sum("l_quantity").alias("Volume"))
    cells = days.unpivot(["date", "ticker"], ["Close", "Volume"], "metric", "value")
    tickers = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("ticker")).union(spark.createDataFrame([("NONE",)], "ticker string"))
    names = [r[0] for r in tickers.collect()]  # the columns of the table, as many as there are tickers
    return keep(wide.to_wide(cells, names)), tickers


@query(f"WITH d AS ({DAYS}) SELECT ticker AS entity_id, 'close_price' AS metric, CAST(date AS VARCHAR) AS date, round(close, 2) AS value, 'USD' AS unit FROM d UNION ALL SELECT ticker, 'volume', CAST(date AS VARCHAR), round(volume, 2), 'shares' FROM d")
def price_points(spark, d):
    points, _ = wide.price_points(*wide_table(spark, d))
    return points.select("entity_id", "metric", F.col("timestamp").cast("string").alias("date"), F.round(F.col("value").cast("double"), 2).alias("value"), "unit")


@query(f"WITH d AS ({DAYS}), t AS (SELECT 'N' || n_nationkey AS ticker FROM nation UNION SELECT 'NONE') SELECT t.ticker, count(d.ticker) > 0 AS ok, 2 * count(d.ticker) AS stored, 0 AS failed FROM t LEFT JOIN (SELECT * FROM d WHERE date = (SELECT max(date) FROM d)) d USING (ticker) GROUP BY ALL")
def price_counts(spark, d):
    """What the last day alone stores, ticker by ticker: those that did not trade then have failed."""
    return wide.price_points(*wide_table(spark, d), latest_only=True)[1]


@query("SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice / 7, 4) AS DOUBLE) AS value FROM lineitem")
def half_even_values(spark, d):
    """Values at four places, halves to the even digit."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", wide.decimal_places(F.col("l_extendedprice") / 7).cast("double").alias("value"))


@query(chain(MARKET, FILLED, CHANGED, SCALED, CLIPPED) + " SELECT key, date, round(value, 5) AS value FROM w")
def winsorize_selected(spark, d):
    """winsorize_nearest by counting: no series is sorted."""
    return rounded(S.winsorize_long(keep(S.zscore(returns(spark, d))), few=500), 5)


# --- graph and facts ----------------------------------------------------------------------------------------------------------

SEED = """
n AS (SELECT 'Country' AS label, 'N' || n_nationkey AS id, n_name AS name FROM nation UNION ALL SELECT 'Company', 'C' || c_custkey, 'Customer ' || c_custkey FROM customer),
e AS (SELECT 'C' || c_custkey AS from_id, CASE WHEN c_custkey % 2 = 0 THEN 'LOCATED_IN' ELSE 'SELLS_TO' END AS rel_type, 'N' || (c_custkey % 30) AS to_id FROM customer)"""


@query(f"WITH {SEED} SELECT from_id, rel_type, to_id, name AS to_name FROM e JOIN n ON id = to_id")
def seed_graph(spark, d):
    """Nations and customers as a graph in two tables; relationships to nations that are not there are left out."""
    mark = lambda c, t: F.concat(F.lit(t), c)
    entity = lambda rows, label, i, name: rows.select(F.lit(label).alias("label"), i.alias("id"), name.alias("name"), F.lit("").alias("description"), F.create_map(F.lit("from"), F.lit("seed")).alias("metadata"))
    nations = entity(table(spark, d, "nation"), "Country", mark("n_nationkey", "N"), F.col("n_name"))
    people = entity(table(spark, d, "customer"), "Company", mark("c_custkey", "C"), mark("c_custkey", "Customer "))
    rels = table(spark, d, "customer").select(mark("c_custkey", "C").alias("from_id"), F.when(F.col("c_custkey") % 2 == 0, "LOCATED_IN").otherwise("SELLS_TO").alias("rel_type"), mark(F.col("c_custkey") % 30, "N").alias("to_id"), F.create_map(F.lit("w"), F.lit("1")).alias("props"))
    paths, rules = [shared_dir(spark), shared_dir(spark)], [layout.by_hash("label", "id", parts=8), layout.by_hash("from_id", "rel_type", "to_id", parts=8)]
    nodes = spark.createDataFrame([], "label string, id string, props map<string,string>")
    layout.create(nodes, paths[0], rules[0])
    layout.create(rels.limit(0), paths[1], rules[1])
    seeding.seed(nations.unionByName(people), rels, ["Country", "Company"], *paths, *rules)
    names = layout.read(spark, paths[0], nodes.schema).select(F.col("id").alias("to_id"), F.col("props")["name"].alias("to_name"))
    return layout.read(spark, paths[1], rels.schema).join(names, "to_id").select("from_id", "rel_type", "to_id", "to_name")


@query("SELECT n_name AS name, n_regionkey AS region FROM nation WHERE n_nationkey = 7")
def entity_lookup(spark, d):
    """One node by label and id; the id reaches the scan."""
    nodes = table(spark, d, "nation").select(F.lit("Nation").alias("label"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return G.node(nodes, "Nation", 7).select("name", "region")


@query("SELECT o_orderkey, o_totalprice AS value FROM orders")
def insert_facts(spark, d):
    """Orders that are there and orders that come, none twice: an insert that fails on a key that repeats."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("value"))
    late = F.col("o_orderkey") % 10 == 0
    return G.insert_new(rows.where(~late), rows.where(late), ["o_orderkey"])


@query("""WITH o AS (SELECT o_orderkey AS a, o_custkey AS b, 0 AS lag, CASE WHEN o_orderkey % 3 = 0 THEN 'pearson' ELSE 'partial' END AS method, CASE WHEN o_orderkey % 5 = 0 THEN 252 ELSE 63 END AS window_days, o_totalprice / 1e6 AS r,
  CASE WHEN o_orderkey % 2 = 0 THEN 'candidate' ELSE 'pending_verification' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'uncertain' END AS verdict FROM orders),
  stay AS (SELECT * FROM o WHERE NOT (method = 'partial' AND window_days = 63 AND verdict IS NULL)), new AS (SELECT o_orderkey AS a, o_custkey AS b, o_totalprice / 2e6 AS r FROM orders WHERE o_orderkey % 4 = 1)
  SELECT coalesce(s.a, n.a) AS a, coalesce(s.method, 'partial') AS method, coalesce(s.window_days, 63) AS window_days, coalesce(n.r, s.r) AS r, CASE WHEN n.a IS NOT NULL AND verdict IS NULL THEN 'candidate' ELSE status END AS status, verdict
  FROM stay s FULL JOIN new n ON s.a = n.a AND s.b = n.b AND s.method = 'partial' AND s.window_days = 63""")  # fmt: skip
def replace_partial(spark, d):
    """Orders as edges of two methods and windows; every fourth comes anew from a partial run of one window."""
    k, o = F.col("o_orderkey"), table(spark, d, "orders")
    key = [k.alias("a"), F.col("o_custkey").alias("b"), F.lit(0).alias("lag")]
    old = o.select(*key, F.when(k % 3 == 0, "pearson").otherwise("partial").alias("method"), F.when(k % 5 == 0, 252).otherwise(63).alias("window_days"), (F.col("o_totalprice") / 1e6).alias("r"), F.when(k % 2 == 0, "candidate").otherwise("pending_verification").alias("status"), F.when(k % 7 == 0, "uncertain").alias("verdict"))
    new = o.where("o_orderkey % 4 = 1").select(*key, F.lit("partial").alias("method"), F.lit(63).alias("window_days"), (F.col("o_totalprice") / 2e6).alias("r"), F.lit("candidate").alias("status"))
    return G.replace_partial(old, new, 63).select("a", "method", "window_days", "r", "status", "verdict")


@query(chain(MARKET, "k AS (SELECT DISTINCT key FROM market)") + " SELECT key, key NOT LIKE 'asset:R%' AND key <> 'asset:MKT' AS micro, key NOT LIKE 'asset:N%' AS macro FROM k")
def series_of_passes(spark, d):
    """Which series the two passes of a partial run take in: all but what they leave out."""
    long = keep(market_long(spark, d))
    keys, (micro, macro) = long.select("key").distinct(), passes(long)
    has = lambda names, c: S.without(keys, names).select("key", F.lit(True).alias(c))
    both = keys.join(has(micro, "micro"), "key", "left").join(has(macro, "macro"), "key", "left")
    return both.select("key", F.coalesce("micro", F.lit(False)).alias("micro"), F.coalesce("macro", F.lit(False)).alias("macro"))


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'indicator:' || o_custkey ELSE 'asset:' || o_custkey END AS key, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN c_custkey IS NOT NULL THEN lower(c_mktsegment) ELSE 'fred_other' END WHEN c_custkey IS NOT NULL THEN upper(c_mktsegment) ELSE 'equity' END AS category FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 5000")
def classify_by_map(spark, d):
    """Orders as keys of both kinds; the map knows customers of some wealth, by segments."""
    o = table(spark, d, "orders").select(F.concat(F.when(F.col("o_orderkey") % 2 == 0, "indicator:").otherwise("asset:"), "o_custkey").alias("key"))
    c = table(spark, d, "customer").where("c_acctbal > 5000")
    side = lambda kind, name: c.select(F.lit(kind).alias("kind"), F.col("c_custkey").cast("string").alias("id"), name.alias("category"))
    return gates.classify(o, side("indicator", F.lower("c_mktsegment")).union(side("asset", F.upper("c_mktsegment"))))


# --- extraction ---------------------------------------------------------------------------------------------------------------

LABELS = ["Company", "Commodity", "Country", "Sector"]
#: What was extracted from each document: its first words, the same again, a name that it does not hold, and one that it holds in part.
EXTRACTED = """
w AS (SELECT doc_id, lower(text) AS t, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, t, len(w) AS n, w[1] || ' ' || w[2] AS one, w[4] || ' Holdings Group' AS two FROM w WHERE len(w) >= 4),
raw AS (SELECT doc_id, t, n, 1 AS pos, one AS span, one AS name, ['Company', 'Commodity', 'Country'][doc_id % 3 + 1] AS kind FROM d UNION ALL SELECT doc_id, t, n, 2, ' ' || one || ' ', ' ' || one || ' ', 'Sector' FROM d
  UNION ALL SELECT doc_id, t, n, 3, 'zz qq', 'Zzqx Corp', 'Company' FROM d UNION ALL SELECT doc_id, t, n, 4, 'nowhere zz', two, 'Company' FROM d WHERE doc_id % 5 <> 0),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(trim(name)) ORDER BY pos) AS i FROM raw WHERE contains(t, lower(trim(span))) OR contains(t, lower(trim(name)))
  OR len(list_filter(string_split_regex(lower(trim(name)), '\\s+'), lambda x: len(x) > 4 AND x <> 'group' AND contains(t, x))) > 0),
e AS (SELECT * FROM g WHERE i = 1)"""


def extracted(spark, d):
    """(articles, entities, relationships)."""
    docs = table(spark, d, "documents").where("text is not null").withColumn("w", F.filter(F.split("text", r"\s+"), lambda w: w != "")).where("size(w) >= 4")
    one, two = F.concat_ws(" ", F.col("w")[0], F.col("w")[1]), F.concat(F.col("w")[3], F.lit(" Holdings Group"))
    wide_one = F.concat(F.lit(" "), one, F.lit(" "))
    kind = F.element_at(F.array(F.lit("company"), F.lit("COMMODITY "), F.lit(" Country")), (F.col("doc_id") % 3 + 1).cast("int"))
    rows = lambda **c: F.struct(*(v.alias(k) for k, v in c.items()))
    ent = [(1, one, one, kind), (2, wide_one, wide_one, F.lit("sector")), (3, F.lit("zz qq"), F.lit("Zzqx Corp"), F.lit("Company")), (4, F.lit("nowhere zz"), two, F.when(F.col("doc_id") % 5 == 0, "planet").otherwise("Company"))]
    entities = docs.select("doc_id", F.explode(F.array(*(rows(pos=F.lit(p), span=s, entity_type=t, name=n) for p, s, n, t in ent))).alias("x")).select("doc_id", "x.*")
    rel = [(1, one, two, "supplies to", 0.9), (2, two, one, " Supplies_To ", 0.8), (3, wide_one, two, "SUPPLIES_TO", 0.95), (4, one, F.lit("Zzqx Corp"), "COMPETES_WITH", 0.9), (5, one, two, "OWNS", 0.5), (6, two, one, "OWNS", 1.7)]
    rels = docs.select("doc_id", F.explode(F.array(*(rows(pos=F.lit(p), subject=s, object=o, relationship_type=F.lit(k), confidence=F.lit(c)) for p, s, o, k, c in rel))).alias("x")).select("doc_id", "x.*")
    return table(spark, d, "documents").select("doc_id", "text"), entities, rels


@query(f"WITH {EXTRACTED} SELECT doc_id, pos, name, kind AS entity_type FROM e")
def extracted_entities(spark, d):
    """Entities that stand after grounding and the first of each name."""
    return text.extraction(*extracted(spark, d), LABELS)[0].select("doc_id", "pos", "name", "entity_type")


@query(f"""WITH {EXTRACTED},
  r AS (SELECT doc_id, n, 1 AS pos, one AS s, two AS o, 'SUPPLIES_TO' AS k, 0.9 AS confidence FROM d UNION ALL SELECT doc_id, n, 2, two, one, 'SUPPLIES_TO', 0.8 FROM d UNION ALL SELECT doc_id, n, 3, ' ' || one || ' ', two, 'SUPPLIES_TO', 0.95 FROM d
    UNION ALL SELECT doc_id, n, 4, one, 'Zzqx Corp', 'COMPETES_WITH', 0.9 FROM d UNION ALL SELECT doc_id, n, 6, two, one, 'OWNS', 1.0 FROM d),
  f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(trim(s)), lower(trim(o)), k ORDER BY pos) AS i FROM r WHERE n >= 50)
  SELECT f.doc_id, f.pos, k AS relationship_type, CAST(confidence AS DOUBLE) AS confidence FROM f JOIN e a ON a.doc_id = f.doc_id AND lower(trim(a.name)) = lower(trim(s)) JOIN e b ON b.doc_id = f.doc_id AND lower(trim(b.name)) = lower(trim(o)) WHERE f.i = 1 AND NOT (k = 'SUPPLIES_TO' AND b.kind = 'Commodity')""")  # fmt: skip
def extracted_relationships(spark, d):
    """Relationships that stand after the whole chain of rules."""
    return text.extraction(*extracted(spark, d), LABELS)[1].select("doc_id", "pos", "relationship_type", "confidence")


# --- series --------------------------------------------------------------------------------------------------------------------

@query(chain(MARKET, FILLED, CHANGED, SCALED, """
j AS (SELECT z.key, z.date, z.value AS y, m.value AS m FROM z LEFT JOIN z m ON m.key = 'asset:MKT' AND m.date = z.date WHERE z.key LIKE 'asset:N%'),
f AS (SELECT key, count(*) AS n, covar_pop(m, y) / nullif(var_pop(m), 0) AS b, avg(m) AS am, avg(y) AS ay FROM j WHERE y IS NOT NULL AND m IS NOT NULL GROUP BY key)""")
    + " SELECT key, j.date, round(CASE WHEN n < 30 THEN y ELSE y - ay - b * (m - am) END, 4) AS value FROM j JOIN f USING (key)")
def beta_market(spark, d):
    """Nations without the market: their sectors have no series of their own."""
    scaled = keep(S.zscore(returns(spark, d)))
    lone = scaled.where("key like 'asset:N%'").select("key").distinct().withColumn("sector_key", F.lit("asset:NONE"))
    return rounded(S.beta_residual(scaled, "asset:MKT", lone).where("key like 'asset:N%'"), 4)


@query(chain(MARKET, FILLED, CHANGED.replace("CASE WHEN key LIKE 'asset:%'", "CASE WHEN key IN ('asset:N3', 'asset:N8') THEN (value - p) / nullif(p, 0) WHEN key LIKE 'asset:%'")) + " SELECT key, date, round(value, 5) AS value FROM ret")
def volatile_transform(spark, d):
    """Changes by kind of series; two of them count as volatility and change by percent."""
    return rounded(S.transform(filled(spark, d), ("asset:N3", "asset:N8")), 5)


@query(chain(MARKET) + """, last AS (SELECT max(date) AS d FROM market)
  SELECT key, count(*) AS n, CAST(min(date) AS VARCHAR) AS first FROM market, last WHERE date >= d - INTERVAL 5 YEAR AND (key LIKE 'asset:%' OR key NOT IN ('indicator:3-MEDIUM')) GROUP BY key""")  # fmt: skip
def monthly_series(spark, d):
    """What a monthly run of five years takes in: all assets, and indicators of the monthly set."""
    rows = pipelines.monthly_input(keep(market_long(spark, d)), monthly_set(spark, d), 5)
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("date").cast("string").alias("first"))


@query("SELECT event_type, count(*) FILTER (event_id % 3 < 2) AS missing, round(avg(value) FILTER (event_id % 3 = 2), 6) AS mean FROM events GROUP BY ALL")
def missing_values(spark, d):
    """Of events, every third value is null and every third NaN: both are missing."""
    v = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(F.col("event_id") % 3 == 2, F.col("value"))
    rows = table(spark, d, "events").select("event_type", v.alias("v"))
    return rounded(rows.groupBy("event_type").agg(F.count_if(S.missing(F.col("v"))).alias("missing"), F.avg(S.given(F.col("v"))).alias("mean")))


def stability(spark, d):
    return P.monthly_stability(monthly_pairs(spark, d))


@query()
def tercile_consistent(spark, d):
    return stability(spark, d).select("a", "b", "tercile_ok")


@query()
def magnitude_stable(spark, d):
    return stability(spark, d).select("a", "b", "magnitude_ok")


for _name, _column in (("tercile_consistent", "tercile_ok"), ("magnitude_stable", "magnitude_ok")):
    ORACLE_SQL[_name] = f"SELECT a, b, {_column} FROM ({ORACLE_SQL['monthly_stability']})"
