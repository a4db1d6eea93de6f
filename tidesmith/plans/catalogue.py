"""The registered queries and the SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesmith.operators import gates, pipelines, validate
from tidesmith.operators import graph as G
from tidesmith.operators import pairs as P
from tidesmith.operators import series as S
from tidesmith.operators import text as X
from tidesmith.streaming import news as N
from tidesmith.sources import layout
from tidesmith.sources.kept import keep, shared_dir
from tidesmith.sources.market import between, event_long, market_long, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def alike(sql: str) -> str:
    """Dates as text, and no negative zero, as rounded() gives them."""
    last = sql[sql.rfind(" SELECT ") if " SELECT " in sql else 0 :]
    fixes = ["CAST(date AS VARCHAR) AS date"] if re.search(r"\bdate, |AS date", last) else []
    fixes += [f"{c} + 0.0 AS {c}" for c in ("r", "rho", "value", "cov", "r1", "r2", "t") if re.search(rf"round\(.*\) AS {c}\b", last)]
    return f"SELECT * REPLACE ({', '.join(fixes)}) FROM ({sql})" if fixes else sql


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = alike(sql)
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros; dates as text."""
    own = {"double": lambda c: F.round(c, digits) + F.lit(0.0), "date": lambda c: F.col(c).cast("string")}
    return df.select(*(own.get(t, F.col)(c).alias(c) for c, t in df.dtypes))


# --- SQL building blocks -------------------------------------------------------------------------------------------

MARKET = """
base AS (SELECT s_nationkey, n_regionkey, CAST(l_shipdate AS DATE) AS date, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s, count(*) AS c
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
market AS (
  SELECT 'asset:N' || s_nationkey AS key, date, CAST(sum(s) AS DOUBLE) / sum(c) AS value FROM base GROUP BY ALL
  UNION ALL SELECT 'asset:R' || n_regionkey, date, CAST(sum(s) AS DOUBLE) / sum(c) FROM base GROUP BY ALL
  UNION ALL SELECT 'asset:MKT', date, CAST(sum(s) AS DOUBLE) / sum(c) FROM base GROUP BY ALL
  UNION ALL SELECT 'indicator:' || o_orderpriority, CAST(o_orderdate AS DATE), CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(o_totalprice) FROM orders GROUP BY ALL)"""
EVENTS = """
market AS (SELECT 'asset:' || event_type AS key, CAST(ts AS DATE) AS date, avg(value) AS value FROM events GROUP BY ALL)"""
FILLED = """
spine AS (SELECT key, date FROM (SELECT DISTINCT key FROM market) CROSS JOIN (SELECT DISTINCT date FROM market)),
filled AS (SELECT s.key, s.date, last_value(m.value IGNORE NULLS) OVER (PARTITION BY s.key ORDER BY s.date ROWS UNBOUNDED PRECEDING) AS value
  FROM spine s LEFT JOIN market m ON s.key = m.key AND s.date = m.date)"""
CHANGED = """
prev AS (SELECT *, lag(value) OVER w AS p, row_number() OVER w AS rn FROM filled WINDOW w AS (PARTITION BY key ORDER BY date)),
ret AS (SELECT key, date, CASE WHEN key LIKE 'asset:%' THEN CASE WHEN value / nullif(p, 0) > 0 THEN ln(value / nullif(p, 0)) END ELSE value - p END AS value
  FROM prev WHERE rn > 1)"""
SCALED = """
z AS (SELECT key, date, CASE WHEN stddev_samp(value) OVER w >= 1e-10 THEN (value - avg(value) OVER w) / stddev_samp(value) OVER w END AS value
  FROM ret WINDOW w AS (PARTITION BY key))"""
CLIPPED = """
bounds AS (SELECT key, v[CAST(round((len(v) - 1) * 0.01) AS INT) + 1] AS lo, v[CAST(round((len(v) - 1) * 0.99) AS INT) + 1] AS hi
  FROM (SELECT key, list(value ORDER BY value) FILTER (value IS NOT NULL) AS v FROM z GROUP BY key)),
w AS (SELECT z.key, date, CASE WHEN value IS NOT NULL THEN greatest(lo, least(hi, value)) END AS value FROM z JOIN bounds ON z.key = bounds.key)"""
MONTHLY = """
monthly AS (SELECT key, CAST(date_trunc('month', date) AS DATE) AS date, arg_max(value, date) AS value FROM market GROUP BY ALL)"""
LAGGED = """
dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM {src})),
onidx AS (SELECT key, idx, value FROM {src} JOIN dates USING (date) WHERE value IS NOT NULL),
pairs AS (SELECT a.key AS a, b.key AS b, lag, a.idx, a.value AS x, b.value AS y
  FROM (SELECT *, idx - lag AS at FROM onidx CROSS JOIN (SELECT unnest({lags}) AS lag)) a JOIN onidx b ON a.at = b.idx
  WHERE (lag = 0 AND a.key < b.key) OR (lag > 0 AND a.key <> b.key))"""
R = "covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)"


def chain(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


def pairs_sql(src: str, lags: list[int]) -> str:
    return LAGGED.format(src=src, lags=lags)


def filled(spark: SparkSession, d: str) -> DataFrame:
    return S.forward_fill(keep(market_long(spark, d)))


def returns(spark: SparkSession, d: str) -> DataFrame:
    return S.transform(filled(spark, d))


def scaled(spark: SparkSession, d: str) -> DataFrame:
    return S.winsorize(S.zscore(returns(spark, d)))


def event_pairs(spark: SparkSession, d: str, lags: list[int]) -> DataFrame:
    return P.lagged(S.transform(S.forward_fill(event_long(spark, d))), lags)


EVENT_RETURNS = (EVENTS, FILLED, CHANGED)


def market_pairs(spark: SparkSession, d: str, lags: list[int] = P.LAGS, macro: list[int] = P.MACRO_LAGS, **more) -> DataFrame:
    return P.pair_statistics(keep(S.zscore(returns(spark, d))), lags, macro, **more)


MARKET_PAIRS = (MARKET, FILLED, CHANGED, SCALED, """
dates AS (SELECT DISTINCT date FROM z),
every AS (SELECT * FROM (""" + chain(pairs_sql("z", P.MACRO_LAGS)) + """ SELECT * FROM pairs)),
pairs AS (SELECT * FROM every WHERE lag NOT IN (21, 63) OR a LIKE 'indicator:%' OR b LIKE 'indicator:%')""")

# --- scans ---------------------------------------------------------------------------------------------------------


@query("SELECT event_id, user_id, event_type, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND event_type <> 'view'")
def scan_bulk_range(spark, d):
    rows = between(table(spark, d, "events"), "ts", F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))
    return rows.where("event_type <> 'view'").select("event_id", "user_id", "event_type", "value")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_suppkey = 7 AND l_returnflag = 'R' AND l_shipdate BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1996-12-31'")
def scan_entity_range(spark, d):
    rows = between(table(spark, d, "lineitem"), "l_shipdate", F.lit("1994-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz"))
    return rows.where("l_suppkey = 7 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30")
def latest_n(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(30).select("o_orderkey", "o_totalprice")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n FROM lineitem WHERE l_discount >= 0.05 GROUP BY ALL")
def parametrised_sql(spark, d):
    return spark.sql(
        "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n FROM {rows} WHERE l_discount >= :least GROUP BY ALL",
        args={"least": 0.05}, rows=table(spark, d, "lineitem"),
    )


@query("SELECT event_type, CAST(ts AS DATE) AS date, round(arg_max(value, (ts, event_id)), 9) AS value FROM events GROUP BY ALL")
def last_per_day(spark, d):
    e = table(spark, d, "events")
    return rounded(e.groupBy("event_type", F.to_date("ts").alias("date")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value")), 9)


@query(chain(MARKET, MONTHLY) + " SELECT key, date, round(value, 6) AS value FROM monthly")
def last_per_month(spark, d):
    return rounded(S.monthly_last(market_long(spark, d)))


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT CAST(ts AS DATE) AS date, " + ", ".join(f"round(avg(value) FILTER (event_type = '{t}'), 6) AS {t}" for t in TYPES) + " FROM events GROUP BY ALL")
def pivot_wide(spark, d):
    e = table(spark, d, "events")
    return rounded(e.groupBy(F.to_date("ts").alias("date")).pivot("event_type", TYPES).agg(F.avg("value")))


# --- series --------------------------------------------------------------------------------------------------------


@query(chain(MARKET, FILLED) + " SELECT key, date, round(value, 6) AS value FROM filled")
def forward_fill(spark, d):
    return rounded(filled(spark, d))


@query(chain(MARKET, FILLED) + " SELECT key, count(value) AS n FROM filled GROUP BY key HAVING count(value) >= greatest(15, CAST(floor(count(*) * 0.75) AS BIGINT))")
def min_obs_filter(spark, d):
    return S.min_observations(filled(spark, d)).groupBy("key").agg(F.count("value").alias("n"))


@query(chain(MARKET, FILLED) + " SELECT key, date, round(CASE WHEN value / nullif(lag(value) OVER w, 0) > 0 THEN ln(value / nullif(lag(value) OVER w, 0)) END, 6) AS value FROM filled WINDOW w AS (PARTITION BY key ORDER BY date)")
def log_returns(spark, d):
    return rounded(filled(spark, d).withColumn("value", S.log_return()))


@query(chain(MARKET, FILLED) + " SELECT key, date, round(value - lag(value) OVER w, 8) AS value FROM filled WINDOW w AS (PARTITION BY key ORDER BY date)")
def first_diff(spark, d):
    return rounded(filled(spark, d).withColumn("value", S.difference()), 8)


@query(chain(MARKET, FILLED) + " SELECT key, date, round((value - lag(value) OVER w) / nullif(lag(value) OVER w, 0), 6) AS value FROM filled WINDOW w AS (PARTITION BY key ORDER BY date)")
def pct_change(spark, d):
    return rounded(filled(spark, d).withColumn("value", S.percent_change()))


@query(chain(MARKET, FILLED, CHANGED) + " SELECT key, date, round(value, 5) AS value FROM ret")
def typed_transform(spark, d):
    return rounded(returns(spark, d), 5)


@query(chain(MARKET, FILLED, CHANGED, SCALED) + " SELECT key, date, round(value, 5) AS value FROM z")
def zscore(spark, d):
    return rounded(S.zscore(returns(spark, d)), 5)


@query(chain(MARKET, FILLED, CHANGED, SCALED, CLIPPED) + " SELECT key, date, round(value, 5) AS value FROM w")
def winsorize_nearest(spark, d):
    return rounded(scaled(spark, d), 5)


@query(chain(MARKET, FILLED, CHANGED) + " SELECT key, round(stddev_pop(value), 6) AS sd FROM ret GROUP BY key HAVING stddev_pop(value) >= 1e-10")
def low_variance_filter(spark, d):
    return rounded(P.low_variance(returns(spark, d)).groupBy("key").agg(F.stddev_pop("value").alias("sd")))


def sectors(spark, d):
    pairs = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return pairs.select(F.concat(F.lit("asset:N"), F.col("s_nationkey")).alias("key"), F.concat(F.lit("asset:R"), F.col("n_regionkey")).alias("sector_key")).distinct()


@query(
    chain(MARKET, FILLED, CHANGED, SCALED, """
j AS (SELECT z.key, z.date, z.value AS y, m.value AS m, s.value AS s FROM z
  JOIN (SELECT DISTINCT 'asset:N' || s_nationkey AS key, 'asset:R' || n_regionkey AS sk FROM supplier JOIN nation ON s_nationkey = n_nationkey) k ON z.key = k.key
  LEFT JOIN z m ON m.key = 'asset:MKT' AND m.date = z.date LEFT JOIN z s ON s.key = sk AND s.date = z.date),
f AS (SELECT key, count(*) AS n, var_pop(m) AS mm, var_pop(s) AS ss, covar_pop(m, s) AS ms, covar_pop(m, y) AS my, covar_pop(s, y) AS sy, avg(m) AS am, avg(s) AS asx, avg(y) AS ay
  FROM j WHERE y IS NOT NULL AND m IS NOT NULL AND s IS NOT NULL GROUP BY key),
g AS (SELECT key, n, am, asx, ay, mm * ss - ms * ms AS det,
  CASE WHEN mm * ss - ms * ms > 1e-12 THEN (ss * my - ms * sy) / nullif(mm * ss - ms * ms, 0) ELSE my / nullif(mm, 0) END AS b1,
  CASE WHEN mm * ss - ms * ms > 1e-12 THEN (mm * sy - ms * my) / nullif(mm * ss - ms * ms, 0) ELSE 0 END AS b2 FROM f)""")
    + " SELECT j.key, j.date, round(CASE WHEN n < 30 THEN y ELSE y - ay - b1 * (m - am) - b2 * (s - asx) END, 4) AS value FROM j JOIN g USING (key)"
)
def beta_market_sector_residual(spark, d):
    rest = S.beta_residual(keep(S.zscore(returns(spark, d))), "asset:MKT", sectors(spark, d))
    return rounded(rest.where("key like 'asset:N%'"), 4)


# --- pairs -----------------------------------------------------------------------------------------------------------


@query(chain(MARKET, FILLED, CHANGED, SCALED, pairs_sql("z", [0])) + f" SELECT a, b, lag, round({R}, 5) AS r, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) >= 30 AND {R} IS NOT NULL")
def pearson_pairs_lag0(spark, d):
    return rounded(market_pairs(spark, d, [0], [0]), 5)


@query(chain(*EVENT_RETURNS, pairs_sql("ret", [0, 1, 2, 3])) + f" SELECT a, b, lag, round({R}, 5) AS r, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) >= 10 AND {R} IS NOT NULL")
def lagged_pairs_both_directions(spark, d):
    return rounded(P.correlations(event_pairs(spark, d, [0, 1, 2, 3]), 10), 5)


@query(chain(*MARKET_PAIRS) + f" SELECT a, b, lag, round({R}, 5) AS r, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) >= 30 AND {R} IS NOT NULL")
def market_lagged_pairs(spark, d):
    return rounded(market_pairs(spark, d), 5)


@query(chain(MARKET, FILLED) + " , n AS (SELECT count(DISTINCT key) AS k FROM filled), full_dates AS (SELECT date FROM filled GROUP BY date HAVING count(value) = (SELECT k FROM n)) SELECT key, date, round(value, 6) AS value FROM filled SEMI JOIN full_dates USING (date)")
def listwise_complete_dates(spark, d):
    return rounded(P.listwise(filled(spark, d)))


GROUPS = "(SELECT DISTINCT 'asset:N' || s_nationkey AS key, 'asset:R' || n_regionkey AS grp FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def groups(spark, d):
    return sectors(spark, d).withColumnRenamed("sector_key", "grp")


@query(chain(MARKET, f"g AS {GROUPS}", "k AS (SELECT DISTINCT market.key, grp FROM market LEFT JOIN g ON market.key = g.key)") + " SELECT a.key AS a, b.key AS b FROM k a JOIN k b ON a.key < b.key WHERE a.grp IS NULL OR b.grp IS NULL OR a.grp <> b.grp")
def redundancy_filter(spark, d):
    return gates.not_redundant(market_pairs(spark, d, [0], [0], least_n=2).select("a", "b"), groups(spark, d))


CATEGORY = "CASE WHEN key LIKE 'indicator:%' THEN CASE WHEN key LIKE 'indicator:1%' OR key LIKE 'indicator:2%' THEN 'rates' ELSE 'fred_other' END WHEN key LIKE 'asset:R%' OR key = 'asset:MKT' THEN 'index' ELSE 'equity' END"


@query(chain(MARKET) + f" SELECT key, {CATEGORY} AS category FROM market GROUP BY key")
def classify_entity(spark, d):
    return categories(market_long(spark, d))


def categories(long):
    spark = long.sparkSession
    known = [("indicator", "1-URGENT", "rates"), ("indicator", "2-HIGH", "rates"), ("asset", "MKT", "index"), *(("asset", f"R{i}", "index") for i in range(5))]
    return gates.classify(long.select("key").distinct(), spark.createDataFrame(known, "kind string, id string, category string"))


BLOCKED = [("fred_other", "index"), ("rates", "rates")]


@query(
    chain(MARKET, f"k AS (SELECT key, {CATEGORY} AS c FROM market GROUP BY key)")
    + " SELECT a.key AS a, b.key AS b FROM k a JOIN k b ON a.key < b.key WHERE (least(a.c, b.c), greatest(a.c, b.c)) NOT IN (('fred_other', 'index'), ('rates', 'rates'))"
)
def plausibility_gate(spark, d):
    long = keep(market_long(spark, d))
    pairs = P.pair_statistics(keep(S.zscore(S.transform(S.forward_fill(long)))), [0], [0], least_n=2).select("a", "b")
    return gates.plausible(pairs, categories(long), blocked(spark))


SPEARMAN = """
ranks AS (SELECT a, b, lag, rank() OVER (PARTITION BY a, b, lag ORDER BY x) + (count(*) OVER (PARTITION BY a, b, lag, x) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY a, b, lag ORDER BY y) + (count(*) OVER (PARTITION BY a, b, lag, y) - 1) / 2.0 AS y FROM pairs)"""


@query(chain(*EVENT_RETURNS, pairs_sql("ret", [0, 1]), SPEARMAN) + f" SELECT a, b, lag, round({R}, 5) AS rho, count(*) AS n FROM ranks GROUP BY ALL")
def spearman_pairs(spark, d):
    return rounded(P.spearman(event_pairs(spark, d, [0, 1]), ["a", "b", "lag"]), 5)


@query(chain(*MARKET_PAIRS, SPEARMAN) + f" SELECT a, b, lag, round({R}, 5) AS rho, count(*) AS n FROM ranks GROUP BY ALL")
def market_spearman_pairs(spark, d):
    return rounded(market_pairs(spark, d, least_n=1, tests=True).select("a", "b", "lag", "rho", F.col("rho_n").alias("n")), 5)


T = "greatest(-0.99999, least(0.99999, r)) * sqrt((n - 2) / (1 - power(greatest(-0.99999, least(0.99999, r)), 2)))"


def tested(spark, d):
    c = P.correlations(event_pairs(spark, d, [0, 1, 2, 3]), 10)
    return c.withColumn("t", P.t_statistic(F.col("r"), F.col("n")))


@query(chain(*EVENT_RETURNS, pairs_sql("ret", [0, 1, 2, 3]), f"c AS (SELECT a, b, lag, {R} AS r, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) >= 10)") + f" SELECT a, b, lag, n, round({T}, 4) AS t FROM c WHERE r IS NOT NULL")
def t_statistic(spark, d):
    return rounded(tested(spark, d).select("a", "b", "lag", "n", "t"), 4)


def market_tested(spark, d):
    return market_pairs(spark, d).withColumn("t", P.t_statistic(F.col("r"), F.col("n")))


@query(chain(*MARKET_PAIRS, f"c AS (SELECT a, b, lag, {R} AS r, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) >= 30)") + f" SELECT a, b, lag, n, round({T}, 4) AS t FROM c WHERE r IS NOT NULL")
def market_t_statistic(spark, d):
    return rounded(market_tested(spark, d).select("a", "b", "lag", "n", "t"), 4)


#: Both tails of Student's distribution beyond t, at n - 2 degrees of freedom: its finite series in the angle atan(t / sqrt(n - 2)), for odd and for even degrees.
TAILS = """
angle AS (SELECT *, n - 2 AS df, atan(abs(t) / sqrt(n - 2)) AS o FROM tv),
tails AS (SELECT * EXCLUDE (df, o), greatest(0.0, 1 - CASE WHEN df % 2 = 0 THEN sin(o) * list_sum([exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1.0) + 2 * j * ln(cos(o))) for j in range(0, df // 2)])
  ELSE 2 / pi() * (o + sin(o) * coalesce(list_sum([exp(lgamma(j + 1.0) + lgamma(1.5) - lgamma(j + 1.5) + (2 * j + 1) * ln(cos(o))) for j in range(0, (df - 1) // 2)]), 0)) END) AS p FROM angle)"""
#: And what the false discovery rate makes of them, all rows being one family.
ADJUSTED = """
places AS (SELECT *, row_number() OVER (ORDER BY p) AS place, count(*) OVER () AS family FROM tails),
found AS (SELECT *, least(1.0, min(p * family / place) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM places)"""


@query(chain(*MARKET_PAIRS, f"c AS (SELECT a, b, lag, {R} AS r, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) >= 30)", f"tv AS (SELECT a, b, lag, r, n, {T} AS t FROM c WHERE r IS NOT NULL)", TAILS) + " SELECT a, b, lag, n, round(r, 6) AS r, round(t, 6) AS t, round(p, 6) + 0.0 AS p FROM tails")
def p_value_two_sided(spark, d):
    return rounded(P.p_values(market_tested(spark, d)))


@query(
    "WITH p AS (SELECT o_orderkey AS k, (o_orderkey * 7919 % 10007) / 10007.0 * ((o_custkey % 13 + 1) / 13.0) AS p FROM orders), "
    "r AS (SELECT *, row_number() OVER (ORDER BY p, k) AS rk, count(*) OVER () AS m FROM p), "
    "a AS (SELECT k, least(1.0, min(p * m / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS adjusted_p FROM r) SELECT k, round(adjusted_p, 6) AS adjusted_p FROM a WHERE adjusted_p <= 0.6"
)
def bh_fdr(spark, d):
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.expr("(o_orderkey * 7919 % 10007) / 10007.0D * ((o_custkey % 13 + 1) / 13.0D)").alias("p"))
    return rounded(P.false_discovery(p, 0.6).select("k", "adjusted_p"))


HALVES = """
h AS (SELECT a, b, lag, CASE WHEN idx < (SELECT count(*) // 2 FROM dates) THEN 1 WHEN idx - lag >= (SELECT count(*) // 2 FROM dates) THEN 2 END AS part, x, y FROM pairs),
q AS (SELECT a, b, lag, part, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS r FROM h GROUP BY ALL HAVING count(*) >= 10),
twice AS (SELECT a, b, lag, max(r) FILTER (part = 1) AS r1, max(r) FILTER (part = 2) AS r2 FROM q GROUP BY ALL)"""


def event_halves(spark, d, least_r):
    r = S.transform(S.forward_fill(event_long(spark, d)))
    return P.split_half(P.lagged(r, [0, 1]), r, least_r, 10)


@query(chain(*EVENT_RETURNS, pairs_sql("ret", [0, 1]), HALVES) + " SELECT a, b, lag, round(r1, 5) AS r1, round(r2, 5) AS r2, round(least(abs(r1), abs(r2)), 5) AS stability FROM twice WHERE abs(r1) >= 0.001 AND abs(r2) >= 0.001")
def split_half_stability(spark, d):
    return rounded(event_halves(spark, d, 0.001), 5)


@query(chain(*EVENT_RETURNS, pairs_sql("ret", [0, 1]), HALVES) + " SELECT a, b, lag, (r1 > 0) = (r2 > 0) AS consistent FROM twice WHERE r1 IS NOT NULL AND r2 IS NOT NULL")
def sign_consistent(spark, d):
    return event_halves(spark, d, 0.0).select("a", "b", "lag", ((F.col("r1") > 0) == (F.col("r2") > 0)).alias("consistent"))


MARKET_HALVES = HALVES.replace("count(*) >= 10", "count(*) >= 20")


@query(chain(*MARKET_PAIRS, MARKET_HALVES) + " SELECT a, b, lag, round(r1, 5) AS r1, round(r2, 5) AS r2, round(least(abs(r1), abs(r2)), 5) AS stability FROM twice WHERE abs(r1) >= 0.4 AND abs(r2) >= 0.4")
def market_split_half_stability(spark, d):
    both = market_pairs(spark, d, least_n=1, tests=True).where("abs(r1) >= 0.4 and abs(r2) >= 0.4")
    return rounded(both.select("a", "b", "lag", "r1", "r2", F.least(F.abs("r1"), F.abs("r2")).alias("stability")), 5)


@query(chain(*MARKET_PAIRS, MARKET_HALVES) + " SELECT a, b, lag, (r1 > 0) = (r2 > 0) AS consistent FROM twice WHERE r1 IS NOT NULL AND r2 IS NOT NULL")
def market_sign_consistent(spark, d):
    both = market_pairs(spark, d, least_n=1, tests=True).where("r1 is not null and r2 is not null")
    return both.select("a", "b", "lag", ((F.col("r1") > 0) == (F.col("r2") > 0)).alias("consistent"))


# --- monthly, partial ------------------------------------------------------------------------------------------------

MONTHLY_RETURNS = """
ms AS (SELECT key, date FROM (SELECT DISTINCT key, key LIKE 'asset:%' AS k FROM monthly) JOIN (SELECT DISTINCT date, key LIKE 'asset:%' AS k FROM monthly) USING (k)),
mp AS (SELECT key, date, value, lag(value) OVER w AS p, row_number() OVER w AS rn FROM ms LEFT JOIN monthly USING (key, date) WINDOW w AS (PARTITION BY key ORDER BY date)),
ret AS (SELECT key, date, CASE WHEN key LIKE 'asset:%' THEN CASE WHEN value / nullif(p, 0) > 0 THEN ln(value / nullif(p, 0)) END ELSE value - p END AS value FROM mp WHERE rn > 1)"""


def monthly(spark, d):
    return S.monthly_changes(keep(market_long(spark, d)))


@query(chain(MARKET, MONTHLY, MONTHLY_RETURNS) + " SELECT key, date, round(value, 6) AS value FROM ret WHERE key LIKE 'asset:%'")
def monthly_log_returns(spark, d):
    return rounded(monthly(spark, d).where("key like 'asset:%'"))


@query(chain(MARKET, MONTHLY, MONTHLY_RETURNS) + " SELECT key, date, round(value, 5) AS value FROM ret WHERE key LIKE 'indicator:%'")
def monthly_indicator_diff(spark, d):
    return rounded(monthly(spark, d).where("key like 'indicator:%'"), 5)


def monthly_pairs(spark, d):
    return pipelines.month_pairs(monthly(spark, d))


MP = "pairs AS (SELECT a.date, a.key AS a, b.key AS b, 0 AS lag, a.value AS x, b.value AS y FROM ret a JOIN ret b ON a.date = b.date WHERE a.key LIKE 'asset:%' AND b.key LIKE 'indicator:%' AND a.value IS NOT NULL AND b.value IS NOT NULL)"


#: Rank correlations of the whole, the halves and the thirds of each pair's months, and what they say of it.
MONTH_PARTS = """
t AS (SELECT a, b, x, y, row_number() OVER (PARTITION BY a, b ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY a, b) AS n FROM pairs),
p AS (SELECT a, b, x, y, unnest(['all', CASE WHEN i < n // 2 THEN 'h1' ELSE 'h2' END, 't' || least(i // greatest(n // 3, 1), 2)]) AS part FROM t),
k AS (SELECT a, b, part, rank() OVER (PARTITION BY a, b, part ORDER BY x) + (count(*) OVER (PARTITION BY a, b, part, x) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY a, b, part ORDER BY y) + (count(*) OVER (PARTITION BY a, b, part, y) - 1) / 2.0 AS y FROM p),
s AS (SELECT a, b, part, """ + R + """ AS r, count(*) AS n FROM k GROUP BY ALL),
f AS (SELECT a, b, max(n) AS n, max(r) FILTER (part = 'all') AS w, max(r) FILTER (part = 'h1') AS h1, max(r) FILTER (part = 'h2') AS h2, max(r) FILTER (part = 't0') AS t0, max(r) FILTER (part = 't1') AS t1, max(r) FILTER (part = 't2') AS t2 FROM s GROUP BY ALL)"""
MONTH_JUDGED = """
judged AS (SELECT a, b, n, w, n // 2 < 6 OR coalesce((h1 > 0) = (h2 > 0), false) AS sign_ok, n // 3 < 6 OR coalesce((t0 > 0) = (t1 > 0) AND (t1 > 0) = (t2 > 0), false) AS tercile_ok,
  CASE WHEN w IS NULL OR abs(w) < 0.01 THEN false WHEN n // 2 < 6 THEN true ELSE coalesce(least(abs(h1), abs(h2)) >= 0.4 * abs(w), false) END AS magnitude_ok FROM f)"""


@query(chain(MARKET, MONTHLY, MONTHLY_RETURNS, MP) + " SELECT a, b, count(*) AS n, round(sum(x), 5) AS sx FROM pairs GROUP BY ALL")
def monthly_join(spark, d):
    return rounded(monthly_pairs(spark, d).groupBy("a", "b").agg(F.count("*").alias("n"), F.sum("x").alias("sx")), 5)


@query(chain(MARKET, MONTHLY, MONTHLY_RETURNS, MP, SPEARMAN) + f" SELECT a, b, round({R}, 5) AS rho, count(*) AS n FROM ranks GROUP BY a, b HAVING count(*) >= 10")
def monthly_spearman(spark, d):
    return rounded(P.spearman(monthly_pairs(spark, d), ["a", "b"]).where("n >= 10"), 5)


@query()
def bootstrap_ci(spark, d):
    return rounded(P.bootstrap(monthly_pairs(spark, d).select("a", "b", "idx", "x", "y"), ["a", "b"]))


@query(chain(*EVENT_RETURNS) + " SELECT a.key AS a, b.key AS b, round(covar_pop(a.value, b.value), 6) AS cov FROM ret a JOIN ret b ON a.date = b.date AND a.key <= b.key GROUP BY ALL")
def covariance_matrix(spark, d):
    r = S.transform(S.forward_fill(event_long(spark, d)))
    return rounded(P.covariances(r).select("a", "b", F.col("c").alias("cov")))


@query(chain(*EVENT_RETURNS) + ", c AS (SELECT covar_pop(a.value, b.value) AS v FROM ret a JOIN ret b ON a.date = b.date AND a.key < b.key GROUP BY a.key, b.key) SELECT round(max(abs(v)), 6) AS alpha_max FROM c")
def alpha_max(spark, d):
    return rounded(event_pairs(spark, d, [0]).groupBy("a", "b").agg(F.covar_pop("x", "y").alias("v")).agg(F.max(F.abs("v")).alias("alpha_max")))


LISTWISE = (MARKET, FILLED, CHANGED, SCALED, """
rows AS (SELECT * FROM z SEMI JOIN (SELECT date FROM z GROUP BY date HAVING count(value) = (SELECT count(DISTINCT key) FROM z)) USING (date)),
cov AS (SELECT a.key AS a, b.key AS b, covar_pop(a.value, b.value) AS cov FROM rows a JOIN rows b ON a.date = b.date AND a.key <= b.key GROUP BY ALL)""")


def complete(spark, d):
    return P.listwise(keep(S.zscore(returns(spark, d))))


def market_covariances(spark, d):
    return P.covariances(complete(spark, d)).select("a", "b", F.col("c").alias("cov"))


@query(chain(*LISTWISE) + " SELECT a, b, round(cov, 6) AS cov FROM cov")
def market_covariance_matrix(spark, d):
    return rounded(market_covariances(spark, d))


@query(chain(*LISTWISE) + " SELECT round(max(abs(cov)), 6) AS alpha_max FROM cov WHERE a < b")
def market_alpha_max(spark, d):
    return rounded(market_covariances(spark, d).where("a < b").agg(F.max(F.abs("cov")).alias("alpha_max")))


MOVED = [0, 1, 2, 3, 5, 10]


@query(chain(MARKET, FILLED, CHANGED, pairs_sql("ret", MOVED)) + f" SELECT a, b, lag, round({R}, 5) AS r, count(*) AS n FROM pairs WHERE idx BETWEEN 90 AND 349 AND idx - lag >= 90 GROUP BY ALL HAVING count(*) >= 30 AND {R} IS NOT NULL")
def moving_correlations(spark, d):
    """Correlations of a window of 260 rows that moves three times, by 40, 25 and 25 rows: sums are added at its end and taken away at its start."""
    on = keep(P.indexed(returns(spark, d)))
    state, window = P.window_moments(on, MOVED, (0, 259)), (0, 259)
    for step in (40, 25, 25):
        new = (window[0] + step, window[1] + step)
        state, window = keep(P.move_window(state, on, MOVED, window, new)), new
    return rounded(P.moment_correlations(state), 5)


@query()
def glasso_ebic_pairs(spark, d):
    return rounded(P.partial_correlations(keep(S.zscore(returns(spark, d)))), 5)


# --- graph and status --------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT n_nationkey AS id, n_regionkey AS other, 'BELONGS_TO' AS rel_type FROM nation UNION SELECT n_regionkey + 1000, n_nationkey, 'HOLDS' FROM nation WHERE n_regionkey + 1000 < 0 UNION SELECT DISTINCT n_regionkey, n_nationkey, 'BELONGS_TO' FROM nation")
def adjacency_union(spark, d):
    return G.adjacency(table(spark, d, "nation").select(F.col("n_nationkey").alias("from_id"), F.col("n_regionkey").alias("to_id"), F.lit("BELONGS_TO").alias("rel_type")))


@query("SELECT DISTINCT o_custkey AS from_id, l_suppkey AS to_id, 'BUYS_FROM' AS rel_type FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND o_custkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def edge_upsert_endpoint_check(spark, d):
    rels = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("from_id"), F.col("l_suppkey").alias("to_id"), F.lit("BUYS_FROM").alias("rel_type"))
    return G.edges_between(rels, table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id")))


@query("SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NOT NULL THEN b.o_totalprice * 2 ELSE a.o_totalprice END AS value, CASE WHEN a.o_orderkey IS NULL THEN 'new' ELSE a.o_orderstatus END AS unit FROM (SELECT * FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) b ON a.o_orderkey = b.o_orderkey")
def upsert_facts(spark, d):
    o = table(spark, d, "orders")
    old = o.where("o_orderkey % 3 <> 0").select("o_orderkey", F.col("o_totalprice").alias("value"), F.col("o_orderstatus").alias("unit"))
    new = o.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("value"), F.lit("new").alias("unit"))
    return G.upsert(old, new, ["o_orderkey"], ["value"])


#: A verdict for each order, all five of them and one that nobody knows.
VERDICT = "CASE o_orderkey % 6 WHEN 0 THEN 'confirmed_plausible' WHEN 1 THEN 'likely_plausible' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'likely_spurious' WHEN 4 THEN 'confirmed_spurious' ELSE 'no verdict' END"
STATUS = "CASE WHEN {0} IN ('confirmed_spurious', 'likely_spurious') THEN 'rejected' WHEN {0} IN ('confirmed_plausible', 'likely_plausible') THEN 'candidate' ELSE 'pending_verification' END"


@query(f"SELECT o_orderkey, {STATUS.format('v')} AS status FROM (SELECT o_orderkey, {VERDICT} AS v FROM orders)")
def verdict_writeback(spark, d):
    return table(spark, d, "orders").select("o_orderkey", G.verdict_status(F.expr(VERDICT)).alias("status"))


@query(f"WITH v AS (SELECT {VERDICT} AS v FROM orders), t AS (SELECT unnest({G.VERDICTS}) AS verdict, unnest(range(5)) AS place) SELECT CAST(place AS INT) AS place, verdict, count(v) AS n, round(100.0 * count(v) / (SELECT count(*) FROM v), 4) AS percent FROM t LEFT JOIN v ON v = verdict GROUP BY ALL")
def verdict_report(spark, d):
    return rounded(G.verdict_counts(table(spark, d, "orders").select(F.expr(VERDICT).alias("verdict"))), 4)


@query("SELECT quality, toxic, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM labels GROUP BY ALL")
def verdict_distribution(spark, d):
    n = table(spark, d, "labels").groupBy("quality", "toxic").count()
    total = n.agg(F.sum("count").alias("total"))
    return n.join(F.broadcast(total)).select("quality", "toxic", F.col("count").alias("n"), F.round(F.col("count") * 100.0 / F.col("total"), 4).alias("percent"))


@query(f"SELECT o_orderkey, v = 'uncertain' OR (v IN ('likely_plausible', 'likely_spurious') AND o_totalprice / 300000 < 0.65) AS review FROM (SELECT *, {VERDICT} AS v FROM orders)")
def review_routing(spark, d):
    return table(spark, d, "orders").select("o_orderkey", G.needs_review(F.expr(VERDICT), F.col("o_totalprice") / 300000).alias("review"))


def built(found):
    """Candidates of pairs, as a daily run builds them."""
    return validate.candidates(found.withColumns({"method": F.lit("pearson"), "window_days": F.lit(63)}))[0]


@query(chain(*EVENT_RETURNS, pairs_sql("ret", [0, 1]), f"c AS (SELECT a, b, lag, {R} AS r, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) >= 10)") + " SELECT 'asset:' || upper(a[7:]) AS a, 'asset:' || upper(b[7:]) AS b, lag, n, round(round(abs(r), 6), 5) AS strength, CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' ELSE 'store' END AS tier FROM c WHERE r IS NOT NULL")
def candidate_build(spark, d):
    found = built(P.correlations(event_pairs(spark, d, [0, 1]), 10).withColumn("p", F.lit(0.0)))
    return found.select("a", "b", "lag", "n", F.round("strength", 5).alias("strength"), "direction", "tier")


@query(chain(*MARKET_PAIRS, f"c AS (SELECT a, b, lag, {R} AS r, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) >= 30)") + " SELECT a, b, lag, n, round(abs(r), 6) AS strength, CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' ELSE 'store' END AS tier FROM c WHERE r IS NOT NULL")
def market_candidate_build(spark, d):
    return built(P.p_values(market_tested(spark, d))).select("a", "b", "lag", "n", "strength", "direction", "tier")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def dedup_keep_first(spark, d):
    return G.first_of(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_extendedprice >= 40000 THEN 'active' ELSE 'pending_verification' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def merge_passes_keep_strongest(spark, d):
    best = G.first_of(table(spark, d, "lineitem").withColumn("neg", -F.col("l_extendedprice")), ["l_orderkey"], ["neg", "l_linenumber"])
    return best.select("l_orderkey", "l_linenumber", "l_extendedprice", F.when(F.col("l_extendedprice") >= 40000, "active").otherwise("pending_verification").alias("status"))


@query("(SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000) UNION SELECT s_suppkey FROM supplier INTERSECT SELECT ps FROM (SELECT DISTINCT l_suppkey AS ps FROM lineitem WHERE l_quantity > 45)")
def pass_sets(spark, d):
    t = lambda n, c, w="true": table(spark, d, n).where(w).select(F.col(c).alias("id"))
    left = t("customer", "c_custkey").subtract(t("orders", "o_custkey", "o_totalprice > 100000"))
    return left.union(t("supplier", "s_suppkey").intersect(t("lineitem", "l_suppkey", "l_quantity > 45"))).distinct()


# --- text ----------------------------------------------------------------------------------------------------------------


def _html_sql() -> str:
    x = r"regexp_replace(regexp_replace(html, '(?s)<!\[CDATA\[(.*?)\]\]>', '\1', 'g'), '<[^>]+>', '', 'g')"
    for entity, char in [("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]:
        x = f"replace({x}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return f"SELECT page_id, trim(regexp_replace({x}, '[\\s ]+', ' ', 'g')) AS text FROM pages"


@query(_html_sql())
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n <= 20 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def article_admit(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("feed"), F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("url"), "doc_id")
    known = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("url"))
    return X.admit(docs, known).select(F.col("feed").alias("source"), "doc_id")


WORDS = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}0-9]+'), lambda w: w <> '')"


@query(f"WITH n AS (SELECT DISTINCT array_to_string(({WORDS.format('text')})[1:2], '. ') AS name FROM benchmark), t AS (SELECT doc_id, ' ' || array_to_string({WORDS.format('text')}, ' ') || ' ' AS t FROM documents) SELECT doc_id, name FROM t JOIN n ON contains(t, ' ' || array_to_string({WORDS.format('name')}, ' ') || ' ')")
def mention_match(spark, d):
    w = F.filter(F.split(F.lower("text"), r"[^\p{L}0-9]+"), lambda w: w != "")
    return X.mentions(table(spark, d, "documents"), table(spark, d, "benchmark").select(F.array_join(F.slice(w, 1, 2), ". ").alias("name")).distinct())


NAMES_SQL = f"n AS (SELECT DISTINCT array_to_string(({WORDS.format('text')})[1:k], ' - ') AS name FROM benchmark, (SELECT unnest([1, 2, 5, 9]) AS k) WHERE len({WORDS.format('text')}) >= k)"


@query(
    f"WITH {NAMES_SQL}, w AS (SELECT name, {WORDS.format('name')} AS w FROM n), t AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), "
    "p AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t), (SELECT DISTINCT len(w) AS k FROM w) WHERE i + k - 1 <= len(w)) "
    "SELECT doc_id, name, CAST(i - 1 AS INT) AS word, CAST(k AS INT) AS words FROM p JOIN (SELECT name, array_to_string(w, ' ') AS run FROM w) USING (run)"
)
def mention_spans(spark, d):
    """Every place where a document holds the first 1, 2, 5 or 9 words of a benchmark text, overlaps too."""
    w = F.filter(F.split(F.lower("text"), r"[^\p{L}0-9]+"), lambda w: w != "")
    names = table(spark, d, "benchmark").select(w.alias("w"), F.explode(F.array(*map(F.lit, (1, 2, 5, 9)))).alias("k")).where("size(w) >= k").select(F.array_join(F.expr("slice(w, 1, k)"), " - ").alias("name"))
    return X.mention_spans(table(spark, d, "documents"), names, longest=False).select("doc_id", "name", "word", "words")


@query(
    "WITH n AS (SELECT doc_id, lower(text) AS t, lower(coalesce(source, '') || ' Apache Group') AS name, lower(lang) AS span FROM documents) "
    "SELECT doc_id, coalesce(contains(t, span), false) OR contains(t, trim(name)) OR len(list_filter(string_split_regex(trim(name), '\\s+'), lambda w: len(w) > 4 AND w <> 'group' AND contains(t, w))) > 0 AS grounded FROM n"
)
def hallucination_filter(spark, d):
    name = F.concat(F.coalesce("source", F.lit("")), F.lit(" Apache Group"))
    return table(spark, d, "documents").select("doc_id", X.grounded(F.col("text"), name, F.col("lang")).alias("grounded"))


@query(
    "SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, coalesce(o.window_days, 63) AS window_days, coalesce(n.r, o.r) AS r, "
    "CASE WHEN o.verdict IS NOT NULL THEN o.status WHEN n.o_orderkey IS NOT NULL THEN 'candidate' ELSE o.status END AS status, o.verdict FROM "
    "(SELECT o_orderkey, o_totalprice AS r, CASE WHEN o_orderstatus = 'F' THEN 'candidate' ELSE 'active' END AS status, CASE WHEN o_orderkey % 5 = 0 THEN 'plausible' END AS verdict, CASE WHEN o_orderkey % 7 = 0 THEN 252 ELSE 63 END AS window_days FROM orders "
    "WHERE NOT (o_orderstatus = 'F' AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0)) o FULL JOIN (SELECT o_orderkey, o_totalprice * 2 AS r FROM orders WHERE o_orderkey % 2 = 0) n ON o.o_orderkey = n.o_orderkey AND o.window_days = 63"
)
def replace_candidates(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "candidate").otherwise("active").alias("status")
    old = o.select("o_orderkey", F.col("o_totalprice").alias("r"), status, F.when(F.col("o_orderkey") % 5 == 0, "plausible").alias("verdict"), F.when(F.col("o_orderkey") % 7 == 0, 252).otherwise(63).alias("window_days"))
    return G.replace_candidates(old, o.where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_totalprice") * 2).alias("r")), ["o_orderkey"], 63)


@query("SELECT n_nationkey AS id, CASE WHEN n_regionkey = 1 THEN n_name ELSE upper(n_name) END AS name, CASE WHEN n_regionkey = 1 THEN NULL ELSE CAST(n_regionkey AS VARCHAR) END AS region FROM nation")
def node_upsert(spark, d):
    n = table(spark, d, "nation")
    old = n.select(F.col("n_nationkey").alias("id"), F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string")).alias("props"))
    gone = n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("id"), F.create_map(F.lit("region"), F.lit(None).cast("string")).alias("props"))
    new = n.where("n_regionkey <> 1").select(F.col("n_nationkey").alias("id"), F.create_map(F.lit("name"), F.upper("n_name")).alias("props"))
    return G.overlay(old, new.union(gone), ["id"]).select("id", F.col("props")["name"].alias("name"), F.col("props")["region"].alias("region"))


@query("SELECT key, min(pos) AS pos FROM (SELECT n_name AS key, n_nationkey AS pos FROM nation UNION ALL SELECT r_name, r_regionkey + 100 FROM region UNION ALL SELECT n_name, n_nationkey + 200 FROM nation) GROUP BY key")
def registry_union_distinct(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    part = lambda t, k, p, base: t.select(F.col(k).alias("key"), (F.col(p) + base).alias("pos"))
    return part(n, "n_name", "n_nationkey", 0).union(part(r, "r_name", "r_regionkey", 100)).union(part(n, "n_name", "n_nationkey", 200)).groupBy("key").agg(F.min("pos").alias("pos"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND NOT (o_orderpriority = '1-URGENT' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))")
def relationship_rules(spark, d):
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "Commodity").otherwise("Company").alias("entity_type")
    entities = table(spark, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit(" C"), F.col("c_custkey")).alias("name"), kind)
    rel = F.when(F.col("o_orderpriority") == "1-URGENT", "SUPPLIES_TO").otherwise("COMPETES_WITH").alias("relationship_type")
    name = F.concat(F.lit("c"), F.col("o_custkey"))
    rels = table(spark, d, "orders").select("o_orderkey", "o_custkey", name.alias("subject"), name.alias("object"), rel)
    return X.relationships(rels, entities).select("o_orderkey", "o_custkey")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def news_stream_dedup(spark, d):
    """All of events, each sent twice, through a stream that keeps each id once; the rows it wrote are then counted."""
    source = table(spark, d, "events")
    out = shared_dir(spark)
    rows = lambda: N.read_stream(spark, f"{d}/events.parquet*", source).withColumn("ts", F.col("ts").cast("timestamp"))
    N.run_available(N.dedup_stream(rows().union(rows()), "event_id", "ts", "400 days"), f"{out}/rows", f"{out}/state")
    return spark.read.parquet(f"{out}/rows").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


# --- whole runs ------------------------------------------------------------------------------------------------------------

WINDOW = 252
BLOCKED_ROWS = "(('fred_other', 'index'), ('rates', 'rates'))"
#: The frame of a window, the pairs of its complete dates, and what their own rows say of them.
DAILY = (MARKET.replace("market AS (", "everything AS (", 1), f"market AS (SELECT * FROM everything WHERE date > (SELECT max(date) FROM everything) - INTERVAL {WINDOW} DAY)", FILLED.replace("filled AS (", "whole AS (", 1),
    "filled AS (SELECT * FROM whole SEMI JOIN (SELECT key FROM whole GROUP BY key HAVING count(value) >= 189) USING (key))", CHANGED.replace("CASE WHEN key LIKE 'asset:%'", "CASE WHEN key = 'asset:N3' THEN (value - p) / nullif(p, 0) WHEN key LIKE 'asset:%'"), SCALED, CLIPPED, f"""
dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS idx FROM (SELECT DISTINCT date FROM w)),
onidx AS (SELECT key, idx, value FROM w JOIN dates USING (date) WHERE value IS NOT NULL),
lags AS (SELECT unnest({P.MACRO_LAGS}) AS lag),
kept AS (SELECT key, lag FROM onidx CROSS JOIN lags WHERE idx + lag < (SELECT count(*) FROM dates) GROUP BY ALL HAVING count(*) >= 189 AND stddev_pop(value) >= 1e-10),
complete AS (SELECT idx + lag AS idx FROM onidx JOIN kept USING (key) WHERE idx + lag < (SELECT count(*) FROM dates) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM kept)),
rows AS (SELECT a.key AS a, b.key AS b, lag, a.idx, a.value AS x, b.value AS y FROM onidx a JOIN (SELECT * FROM kept WHERE key IN (SELECT key FROM kept WHERE lag = 0)) k ON true JOIN onidx b ON b.key = k.key AND b.idx = a.idx - lag
  WHERE (lag = 0 AND a.key < b.key OR lag > 0 AND a.key <> b.key) AND a.key IN (SELECT key FROM kept WHERE lag = 0) AND (lag NOT IN (21, 63) OR a.key LIKE 'indicator:%' OR b.key LIKE 'indicator:%')),
g AS {GROUPS}, c AS (SELECT key, {CATEGORY} AS c FROM market GROUP BY key),
strong AS (SELECT a, b, lag, {R} AS r, count(*) AS n FROM rows SEMI JOIN complete USING (idx) GROUP BY ALL HAVING count(*) >= 30 AND abs({R}) >= 0.4),
open AS (SELECT strong.* FROM strong LEFT JOIN g ga ON ga.key = a LEFT JOIN g gb ON gb.key = b JOIN c ca ON ca.key = a JOIN c cb ON cb.key = b
  WHERE (ga.grp IS NULL OR gb.grp IS NULL OR ga.grp <> gb.grp) AND (least(ca.c, cb.c), greatest(ca.c, cb.c)) NOT IN {BLOCKED_ROWS}),
pairs AS (SELECT rows.* FROM rows SEMI JOIN open USING (a, b, lag))""", SPEARMAN, HALVES.replace("count(*) >= 10", "count(*) >= 20"), f"rho AS (SELECT a, b, lag, {R} AS rho, count(*) AS m FROM ranks GROUP BY ALL)")  # fmt: skip


def blocked(spark):
    return spark.createDataFrame(BLOCKED, "lo string, hi string")


def rules(spark, d, long):
    """Regions are the groups of nations; the third nation counts as a series of volatility."""
    return pipelines.Rules(keep(groups(spark, d)), keep(categories(long)), blocked(spark), ("asset:N3",))


@query(chain(*DAILY) + " SELECT a, b, lag, n, round(r, 5) AS r, round(rho, 5) AS rho, round(r1, 5) AS r1, round(r2, 5) AS r2 FROM open JOIN rho USING (a, b, lag) LEFT JOIN twice USING (a, b, lag) WHERE m < 20 OR rho IS NULL OR abs(rho) >= 0.4")
def daily_pairs(spark, d):
    return rounded(window_pairs(spark, d).select("a", "b", "lag", "n", "r", "rho", "r1", "r2"), 5)


def window_pairs(spark, d):
    long = keep(market_long(spark, d))
    frame = keep(pipelines.frame(long, WINDOW, ("asset:N3",)))
    return pipelines.daily_pairs(frame, WINDOW, groups(spark, d), categories(long), blocked(spark))


def not_daily(spark):
    """Indicators that daily runs leave out; the rest of them is not among the monthly ones."""
    return spark.createDataFrame([("5-LOW",)], "id string")


def monthly_set(spark, d):
    return table(spark, d, "orders").where("o_orderpriority <> '3-MEDIUM'").select(F.col("o_orderpriority").alias("id")).distinct()


def passes(long):
    """What the two passes of a partial run leave out: regions and the market, nations."""
    ids = long.select("key").distinct().select(S.key_id(F.col("key")).alias("id"))
    return ids.where("id like 'R%' or id = 'MKT'"), ids.where("id like 'N%'")


def daily_sql(window: int) -> str:
    """A daily run of a window: market and sectors taken out of the frame, its strong pairs, their false discovery rate, both halves."""
    recent = DAILY[1].replace(f"INTERVAL {WINDOW} DAY", f"INTERVAL {window} DAY").replace("FROM everything", "FROM daily_only")
    head, tail = DAILY[3], DAILY[7].replace("FROM w ", "FROM rest ").replace("FROM w)", "FROM rest)")
    least = f">= {max(15, window * 3 // 4)}"
    return chain(DAILY[0], "daily_only AS (SELECT * FROM everything WHERE key <> 'indicator:5-LOW')", recent, DAILY[2], head.replace(">= 189", least), *DAILY[4:7], """
sector AS (SELECT DISTINCT 'asset:N' || s_nationkey AS key, 'asset:R' || n_regionkey AS sk FROM supplier JOIN nation ON s_nationkey = n_nationkey),
j AS (SELECT w.key, w.date, w.value AS y, m.value AS m, CASE WHEN sk IN (SELECT key FROM w) THEN s.value ELSE 0 END AS s FROM w JOIN sector USING (key)
  LEFT JOIN w m ON m.key = 'asset:MKT' AND m.date = w.date LEFT JOIN w s ON s.key = sk AND s.date = w.date),
f AS (SELECT key, count(*) AS n, var_pop(m) AS mm, var_pop(s) AS ss, covar_pop(m, s) AS ms, covar_pop(m, y) AS my, covar_pop(s, y) AS sy, avg(m) AS am, avg(s) AS asx, avg(y) AS ay
  FROM j WHERE y IS NOT NULL AND m IS NOT NULL AND s IS NOT NULL GROUP BY key),
fit AS (SELECT key, n, am, asx, ay, CASE WHEN mm * ss - ms * ms > 1e-12 THEN (ss * my - ms * sy) / (mm * ss - ms * ms) ELSE my / nullif(mm, 0) END AS b1,
  CASE WHEN mm * ss - ms * ms > 1e-12 THEN (mm * sy - ms * my) / (mm * ss - ms * ms) ELSE 0 END AS b2 FROM f),
rest AS (SELECT j.key, j.date, CASE WHEN coalesce(n, 0) < 30 THEN y ELSE y - ay - b1 * (m - am) - b2 * (s - asx) END AS value FROM j LEFT JOIN fit USING (key)
  UNION ALL SELECT key, date, value FROM w WHERE key NOT IN (SELECT key FROM sector))""", tail.replace(">= 189", least), *DAILY[8:], f"""
tv AS (SELECT a, b, lag, r, n, {T} AS t FROM open JOIN rho USING (a, b, lag) WHERE m < 20 OR rho IS NULL OR abs(rho) >= 0.4)""", TAILS, ADJUSTED) + (
        f" SELECT a, b, lag, round(r, 6) AS r, round(q, 6) + 0.0 AS p, n, 'pearson' AS method, CAST({window} AS INT) AS window_days, round(abs(r), 6) AS strength,"
        " CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' ELSE 'store' END AS tier,"
        f" 'candidate' AS status, round(least(abs(r1), abs(r2)), 6) AS stability FROM found {'JOIN twice USING (a, b, lag) WHERE abs(r1) >= 0.4 AND abs(r2) >= 0.4 AND' if window >= 42 else 'WHERE'} q <= 0.1"
    )


@query(f"SELECT * FROM ({daily_sql(63)}) UNION ALL SELECT * FROM ({daily_sql(WINDOW)})")
def daily_correlations(spark, d):
    """Both windows of the daily run: market and sectors taken out, false discovery rate, both halves."""
    long = keep(market_long(spark, d))
    known, of = rules(spark, d, long), keep(sectors(spark, d))
    runs = [pipelines.daily(long, w, not_daily(spark), "asset:MKT", of, known).candidates for w in (63, WINDOW)]
    return rounded(runs[0].unionByName(runs[1]))


@query()
def monthly_correlations(spark, d):
    long = keep(market_long(spark, d))
    return rounded(pipelines.monthly(long, monthly_set(spark, d), rules(spark, d, long)).candidates)


@query(chain(MARKET.replace("market AS (", "everything AS (", 1), """
recent AS (SELECT * FROM everything WHERE date >= (SELECT max(date) FROM everything) - INTERVAL 10 YEAR),
market AS (SELECT * FROM recent WHERE key LIKE 'asset:%' OR key <> 'indicator:3-MEDIUM')""", MONTHLY, MONTHLY_RETURNS, MP, SPEARMAN, f"c AS (SELECT key, {CATEGORY} AS c FROM market GROUP BY key)", f"""
above AS (SELECT s.* FROM (SELECT a, b, {R} AS r, count(*) AS n FROM ranks GROUP BY a, b HAVING count(*) >= 10 AND abs({R}) >= 0.2) s JOIN c ca ON ca.key = a JOIN c cb ON cb.key = b
  WHERE (least(ca.c, cb.c), greatest(ca.c, cb.c)) NOT IN {BLOCKED_ROWS})""", f"tv AS (SELECT *, {T} AS t FROM above)", TAILS, ADJUSTED, MONTH_PARTS, MONTH_JUDGED) + """
  SELECT a, b, h.n, round(r, 5) AS r, round(q, 6) + 0.0 AS p, array_to_string(list_filter(['sign_inconsistent', 'tercile_inconsistent', 'magnitude_unstable'], lambda x: x = CASE WHEN NOT sign_ok THEN 'sign_inconsistent' END
    OR x = CASE WHEN NOT tercile_ok THEN 'tercile_inconsistent' END OR x = CASE WHEN NOT magnitude_ok THEN 'magnitude_unstable' END), ',') AS flags,
  CASE WHEN sign_ok AND tercile_ok AND magnitude_ok THEN 'stable' ELSE 'under_review' END AS stability FROM found h JOIN judged USING (a, b)""")  # fmt: skip
def monthly_flags(spark, d):
    """Pairs of the monthly run, weaker and less certain ones too, stable and flagged ones together, by the checks that need no resampling."""
    long = keep(market_long(spark, d))
    rows, above = pipelines.month_strong(keep(S.monthly_changes(keep(pipelines.monthly_input(long, monthly_set(spark, d))))), rules(spark, d, long), strength=0.2)
    kept = keep(pipelines.tested(above, 1.0))
    checks = P.monthly_stability(rows.join(kept.select("a", "b"), ["a", "b"], "left_semi")).drop("n", "rho")
    found = pipelines.flagged(kept.join(checks, ["a", "b"]))
    return rounded(found.select("a", "b", "n", F.round("r", 5).alias("r"), F.col("adjusted_p").alias("p"), F.array_join("flags", ",").alias("flags"), "stability"))


@query()
def partial_candidates(spark, d):
    """The partial run: one pass without regions and the market, one without nations."""
    long = keep(market_long(spark, d))
    return rounded(pipelines.partial(long, 2 * WINDOW, not_daily(spark), *passes(long), rules(spark, d, long)).candidates, 4)


@query()
def correlation_runs(spark, d):
    """A whole round of runs over both windows, each stored before the next: what they tested, kept and stored."""
    long = keep(market_long(spark, d))
    nodes = long.select("key").distinct().select(F.upper("key").alias("key")).select(F.concat_ws(":", F.lower(S.key_kind(F.col("key"))), S.key_id(F.col("key"))).alias("key"))
    _, rows, failed = pipelines.run_windows(long, pipelines.no_edges(long), nodes, [63, WINDOW], not_daily(spark), monthly_set(spark, d), "asset:MKT", sectors(spark, d), passes(long), rules(spark, d, long))
    if failed:
        raise RuntimeError(f"runs failed: {failed}")
    return rows


#: Every pair of series as an edge of an earlier run: some with a verdict, some of another window, some of another method.
OLD_EDGES = """old AS (SELECT a.key AS a, b.key AS b, 0 AS lag, CASE WHEN hash_a % 5 = 4 THEN 'partial' ELSE 'pearson' END AS method, CASE WHEN hash_a % 7 = 3 THEN 63 ELSE 252 END AS window_days, -0.5 AS r,
  CASE WHEN hash_a % 3 = 0 THEN 'candidate' WHEN hash_a % 3 = 1 THEN 'pending_verification' ELSE 'rejected' END AS status, CASE WHEN hash_a % 4 = 1 THEN 'uncertain' END AS verdict
  FROM (SELECT key, length(key) + ascii(substr(key, length(key), 1)) AS h FROM names) a JOIN (SELECT key, ascii(substr(key, length(key), 1)) * 3 AS h FROM names) b ON a.key < b.key, LATERAL (SELECT a.h + b.h AS hash_a))"""


@query(chain(*DAILY) + """, found AS (SELECT a, b, lag, CAST(round(r, 6) AS DOUBLE) AS r FROM open JOIN rho USING (a, b, lag) WHERE m < 20 OR rho IS NULL OR abs(rho) >= 0.4),
  names AS (SELECT DISTINCT key FROM everything), new AS (SELECT * FROM found WHERE a <> 'asset:R1' AND b <> 'asset:R1'), """ + OLD_EDGES + """,
  stay AS (SELECT * FROM old WHERE NOT (window_days = 252 AND verdict IS NULL AND status = 'candidate'))
  SELECT coalesce(s.a, n.a) AS a, coalesce(s.b, n.b) AS b, coalesce(s.lag, n.lag) AS lag, coalesce(method, 'pearson') AS method, coalesce(window_days, 252) AS window_days, round(coalesce(n.r, s.r), 5) + 0.0 AS r,
  CASE WHEN n.a IS NOT NULL AND verdict IS NULL THEN 'candidate' ELSE status END AS status, verdict FROM stay s FULL JOIN new n ON s.a = n.a AND s.b = n.b AND s.lag = n.lag AND method = 'pearson' AND window_days = 252""")  # fmt: skip
def run_replaces_candidates(spark, d):
    """The pairs of a window stored over the edges of an earlier run: all pairs of series, of several states. One region is no node."""
    long = keep(market_long(spark, d))
    keys = long.select("key").distinct()
    code = F.length("a") + F.ascii(F.substring("a", -1, 1)) + F.ascii(F.substring("b", -1, 1)) * 3
    every = market_pairs(spark, d, [0], [0], least_n=2).select("a", "b")
    old = every.select(
        "a", "b", F.lit(0).alias("lag"), F.when(code % 5 == 4, "partial").otherwise("pearson").alias("method"), F.when(code % 7 == 3, 63).otherwise(252).alias("window_days"), F.lit(-0.5).alias("r"),
        F.when(code % 3 == 0, "candidate").when(code % 3 == 1, "pending_verification").otherwise("rejected").alias("status"), F.when(code % 4 == 1, "uncertain").alias("verdict"),
    )
    found = keep(window_pairs(spark, d).select("a", "b", "lag", F.lit("pearson").alias("method"), F.lit(WINDOW).alias("window_days"), F.round("r", 6).alias("r"), F.lit("candidate").alias("status")))
    run = pipelines.Found(found, found.agg(F.count("*").alias("n")), found, found)
    edges, _ = pipelines.store(old, run, keys.where("key <> 'asset:R1'"), WINDOW, F.current_date(), "pearson")
    return rounded(edges, 5)


@query(chain(MARKET, MONTHLY, MONTHLY_RETURNS, MP, MONTH_PARTS, MONTH_JUDGED) + " SELECT a, b, n, round(w, 5) AS rho, sign_ok, tercile_ok, magnitude_ok FROM judged")
def monthly_stability(spark, d):
    return rounded(P.monthly_stability(monthly_pairs(spark, d)), 5)


@query(chain(*LISTWISE, """
r AS (SELECT c.a, c.b, c.cov / sqrt(x.cov * y.cov) AS r FROM cov c JOIN cov x ON x.a = c.a AND x.b = c.a JOIN cov y ON y.a = c.b AND y.b = c.b WHERE c.a <> c.b),
m AS (SELECT CASE WHEN a = 'asset:MKT' THEN b ELSE a END AS k, r FROM r WHERE a = 'asset:MKT' OR b = 'asset:MKT')""")
    + " SELECT r.a, r.b, round(r.r, 5) + 0.0 AS r, round((r.r - x.r * y.r) / sqrt((1 - x.r * x.r) * (1 - y.r * y.r)), 5) + 0.0 AS partial_r FROM r JOIN m x ON x.k = r.a JOIN m y ON y.k = r.b WHERE r.a <> 'asset:MKT' AND r.b <> 'asset:MKT'")
def partial_corr_3var(spark, d):
    """What is left between two series once the market is known."""
    return rounded(P.partial_given(complete(spark, d), "asset:MKT"), 5)


# --- checks, keys, lifecycle -------------------------------------------------------------------------------------------------

#: Orders as candidates, some of them outside every range.
AS_CANDIDATES = "SELECT 'asset:' || o_custkey AS a, CASE WHEN o_orderkey % 11 = 0 THEN 'bond:' ELSE 'indicator:' END || lower(o_orderpriority) AS b, CAST(o_orderkey % 9 - 1 AS INT) AS lag, o_totalprice / 199999.7 - 1 AS r, (o_orderkey % 103) / 100.0 AS p, CAST(o_orderkey % 50 AS INT) AS n, CASE WHEN o_orderkey % 13 = 0 THEN 'kendall' ELSE 'pearson' END AS method, 63 AS window_days, o_orderkey FROM orders"
RIGHT = "r BETWEEN -1 AND 1 AND p BETWEEN 0 AND 1 AND lag >= 0 AND n > 0 AND method <> 'kendall' AND b LIKE 'indicator:%'"


def as_candidates(spark, d):
    kind = F.when(F.col("o_orderkey") % 11 == 0, "bond").otherwise("indicator")
    return table(spark, d, "orders").select(
        S.entity_key(F.lit("asset"), F.col("o_custkey").cast("string")).alias("a"), S.entity_key(kind, F.lower("o_orderpriority")).alias("b"), (F.col("o_orderkey") % 9 - 1).cast("int").alias("lag"),
        (F.col("o_totalprice") / 199999.7 - 1).alias("r"), (F.col("o_orderkey") % 103 / 100.0).alias("p"), (F.col("o_orderkey") % 50).cast("int").alias("n"),
        F.when(F.col("o_orderkey") % 13 == 0, "kendall").otherwise("pearson").alias("method"), F.lit(63).alias("window_days"), "o_orderkey",
    )


@query(f"WITH c AS ({AS_CANDIDATES}) SELECT o_orderkey, a, b, lag FROM c WHERE NOT ({RIGHT})")
def candidate_reject(spark, d):
    return validate.candidates(as_candidates(spark, d))[1].select("o_orderkey", "a", "b", "lag")


@query(f"WITH c AS ({AS_CANDIDATES}) SELECT o_orderkey, upper(b) AS b, round(abs(r), 6) AS strength, CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction, CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.5 THEN 'moderate' ELSE 'store' END AS tier, 0.5 AS confidence, 0 AS times_tested FROM c WHERE {RIGHT}")
def candidate_valid(spark, d):
    built = validate.candidates(as_candidates(spark, d))[0].withColumn("status", F.lit("candidate"))
    edges = validate.edge_properties(built, F.current_timestamp(), F.current_timestamp())
    return built.select("a", "b", "lag", "r", "o_orderkey").join(edges.select(F.col("a"), F.col("b"), "props"), ["a", "b"]).where("props.lag_days = lag and props.correlation = r").select(
        "o_orderkey", F.upper("b").alias("b"), "props.strength", "props.direction", "props.tier", "props.confidence", "props.times_tested"
    ).distinct()


@query(f"WITH c AS ({AS_CANDIDATES}) SELECT o_orderkey, CASE WHEN abs(r) >= 0.15 THEN 'candidate' ELSE 'pending_verification' END AS status FROM c WHERE abs(r) >= 0.10")
def tier_split(spark, d):
    return gates.strong(as_candidates(spark, d), pipelines.PARTIAL_FLOOR).select("o_orderkey", gates.tier_status(F.col("r")).alias("status"))


@query(
    f"WITH c AS ({AS_CANDIDATES}), u AS (SELECT *, 1 AS pass FROM c WHERE o_orderkey % 2 = 0 UNION ALL SELECT b, a, lag, r, p, n, method, window_days, o_orderkey, 2 FROM c WHERE o_orderkey % 3 = 0), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY abs(r) DESC, pass, a, b) AS i FROM u) SELECT least(a, b) AS lo, greatest(a, b) AS hi, round(abs(r), 6) AS strength FROM o WHERE i = 1"
)
def merge_passes(spark, d):
    c = as_candidates(spark, d)
    second = c.where("o_orderkey % 3 = 0").withColumns({"a": F.col("b"), "b": F.col("a")})
    best = gates.strongest(c.where("o_orderkey % 2 = 0"), second)
    return best.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), F.round(F.abs("r"), 6).alias("strength"))


@query(f"SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 = 0 THEN {STATUS.format('v')} ELSE 'candidate' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN v END AS verdict, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice / 1e6 END AS confidence FROM (SELECT *, {VERDICT} AS v FROM orders)")
def status_transition(spark, d):
    """Orders as edges; every fourth gets a verdict and with it a status."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"), F.lit("partial").alias("method"), F.lit(63).alias("window_days"), F.expr(VERDICT).alias("verdict"), (F.col("o_totalprice") / 1e6).alias("confidence"))
    edges = rows.withColumns({"status": F.lit("candidate"), "verdict": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    done = G.write_verdicts(edges, rows.where("a % 4 = 0"))
    return done.select(F.col("a").alias("o_orderkey"), F.col("b").alias("o_custkey"), "status", "verdict", "confidence")


@query("SELECT upper(event_type) AS entity_id, event_id FROM events WHERE event_type <> 'error' AND user_id % 7 <> 0 AND value IS NOT NULL")
def fact_validation(spark, d):
    kind, source = F.when(F.col("event_type") == "error", "bond").otherwise("asset"), F.when(F.col("user_id") % 7 == 0, "hearsay").otherwise("feed")
    facts = table(spark, d, "events").select(kind.alias("entity_type"), F.col("event_type").alias("entity_id"), F.lit("value").alias("metric"), "value", F.col("ts").alias("timestamp"), source.alias("source"), "event_id")
    return validate.facts(facts, ["feed"])[0].select("entity_id", "event_id")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey % 5 AS region, CASE WHEN c_custkey % 2 = 0 THEN 'kept' END AS note, 'Customer ' || c_custkey AS shown FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def entity_validation(spark, d):
    meta = F.create_map(F.lit("name"), F.lit("lost"), F.lit("region"), (F.col("c_custkey") % 5).cast("string"), F.lit("note"), F.when(F.col("c_custkey") % 2 == 0, "kept"))
    rows = table(spark, d, "customer").select(F.initcap("c_mktsegment").alias("label"), F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit("Customer "), "c_custkey").alias("name"), F.lit("").alias("description"), meta.alias("metadata"))
    p = F.col("props")
    return validate.entities(rows, ["Building", "Machinery"])[0].select("id", p["region"].cast("long").alias("region"), p["note"].alias("note"), p["name"].alias("shown"))


@query("SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Company' WHEN '2-HIGH' THEN 'Sector' END AS label, replace(upper(trim(o_orderstatus || ' moves ')), ' ', '_') AS rel, greatest(0.0, least(1.0, o_totalprice / 300000.0 - 0.2)) AS confidence, o_orderpriority <> '3-MEDIUM' AS safe FROM orders")
def normalised_output(spark, d):
    raw = F.when(F.col("o_orderpriority") == "1-URGENT", " com PANY ").when(F.col("o_orderpriority") == "2-HIGH", "SECTOR").otherwise("planet")
    kind = F.when(F.col("o_orderpriority") == "3-MEDIUM", "drop table").otherwise("SUPPLIES_TO")
    return table(spark, d, "orders").select(
        "o_orderkey", validate.label_of(raw, ["Company", "Sector"]).alias("label"), validate.relation_of(F.concat("o_orderstatus", F.lit(" moves "))).alias("rel"),
        validate.clamp(F.col("o_totalprice") / 300000.0 - 0.2).alias("confidence"), validate.safe_relation(kind).alias("safe"),
    )


@query("SELECT key, 'asset' AS kind, 'US:' || c_custkey AS id FROM (SELECT 'asset:US:' || c_custkey AS key, c_custkey FROM customer) WHERE c_custkey % 4 <> 0")
def entity_keys(spark, d):
    """Keys built and cut at their first colon, without the series that are not daily."""
    rows = table(spark, d, "customer").select(S.entity_key(F.lit("asset"), F.concat(F.lit("US:"), "c_custkey")).alias("key"), F.col("c_custkey").alias("k"))
    late = rows.where("k % 4 = 0").select(S.key_id(F.col("key")).alias("id"))
    return S.without(rows, late).select("key", S.key_kind(F.col("key")).alias("kind"), S.key_id(F.col("key")).alias("id"))


@query(chain(MARKET) + " SELECT key, round(value, 6) AS value FROM market WHERE date = (SELECT max(date) FROM market)")
def latest_row(spark, d):
    return rounded(S.latest_only(keep(market_long(spark, d))).select("key", "value"))


@query("SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '')) >= 50 AS long_enough FROM documents")
def short_article_gate(spark, d):
    return table(spark, d, "documents").select("doc_id", validate.long_enough(F.col("text")).alias("long_enough"))


@query("WITH e AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY user_id) SELECT user_id, array_to_string(list_filter(ids, lambda x: x % 3 = 0), ',') AS ids FROM e")
def mention_ids(spark, d):
    """Each user's events, less those that are not among the known ones: every third."""
    ids = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    known = F.transform("ids", lambda x: F.when(x % 3 == 0, x))
    return ids.select("user_id", F.array_join(validate.known_ids(F.col("ids"), F.array_compact(known)), ",").alias("ids"))


@query("SELECT DISTINCT CAST(event_id % 500 AS VARCHAR) AS url, user_id AS id FROM events WHERE user_id IN (SELECT c_custkey FROM customer)")
def mention_edges(spark, d):
    found = table(spark, d, "events").groupBy((F.col("event_id") % 500).cast("string").alias("url")).agg(F.collect_list("user_id").alias("ids"))
    old = spark.createDataFrame([], "url string, id bigint, matched_at timestamp")
    return G.upsert_mentions(old, found, table(spark, d, "customer").select(F.col("c_custkey").alias("id")), F.current_timestamp()).select("url", "id")


@query("SELECT o_orderkey AS to_id, CASE WHEN o_orderkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'new' ELSE 'old' END AS seen, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS status FROM orders WHERE o_orderkey % 3 = 0 OR (o_orderkey % 2 = 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))")
def edge_upsert_merge(spark, d):
    """Every third order is an edge already; every second one comes anew and is merged in where both of its ends are known."""
    o = table(spark, d, "orders")
    edge = lambda rows, props: rows.select(F.col("o_custkey").alias("from_id"), F.lit("BUYS").alias("rel_type"), F.col("o_orderkey").alias("to_id"), props.alias("props"))
    old = edge(o.where("o_orderkey % 3 = 0"), F.create_map(F.lit("seen"), F.lit("old"), F.lit("status"), F.col("o_orderstatus")))
    new = edge(o.where("o_orderkey % 2 = 0"), F.create_map(F.lit("seen"), F.lit("new")))
    back = lambda e: e.withColumn("to_id", -1 - F.col("to_id"))  # noqa: E731  orders and customers are nodes of one table
    nodes = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id")).union(o.select(-1 - F.col("o_orderkey")))
    both = G.upsert_edges(back(old), back(new), nodes)
    return both.select((-1 - F.col("to_id")).alias("to_id"), F.col("props")["seen"].alias("seen"), F.col("props")["status"].alias("status"))


ARTICLES = "SELECT CAST(doc_id AS VARCHAR) AS url, CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END AS summary, CASE WHEN doc_id % 3 = 0 THEN 'mentions_done' ELSE 'raw' END AS status, n_chars AS collected_at FROM documents"


def articles(spark, d):
    summary, status = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("text")), F.when(F.col("doc_id") % 3 == 0, "mentions_done").otherwise("raw")
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("url"), summary.alias("summary"), status.alias("status"), F.col("n_chars").alias("collected_at"))


@query(f"SELECT url, collected_at FROM ({ARTICLES}) WHERE status = 'raw' AND trim(summary) <> '' AND collected_at >= 100")
def raw_articles(spark, d):
    return G.raw_articles(articles(spark, d), F.lit(100)).select("url", "collected_at")


@query(f"WITH a AS ({ARTICLES}) SELECT url, CASE WHEN status <> 'raw' THEN status WHEN coalesce(trim(summary), '') = '' THEN 'skipped_no_summary' WHEN toxic = 0 THEN 'mentions_done' WHEN toxic = 1 THEN 'mentions_failed' ELSE status END AS status FROM a LEFT JOIN labels ON url = CAST(doc_id AS VARCHAR)")
def article_status(spark, d):
    outcomes = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("url"), (F.col("toxic") == 0).alias("ok"))
    return G.article_status(articles(spark, d), outcomes).select("url", "status")


@query(f"WITH a AS ({ARTICLES}) SELECT a.url, CASE WHEN CAST(a.url AS BIGINT) % 2 = 0 THEN 'renewed' ELSE a.summary END AS summary, CASE WHEN CAST(a.url AS BIGINT) % 5 = 0 AND CAST(a.url AS BIGINT) % 2 = 0 THEN 'raw' ELSE a.status END AS status FROM a WHERE CAST(a.url AS BIGINT) % 5 <> 0 OR CAST(a.url AS BIGINT) % 2 = 0")
def article_upsert(spark, d):
    """All articles but every fifth are there; every second one comes again, twice."""
    a = articles(spark, d)
    n = F.col("url").cast("long")
    new = a.where(n % 2 == 0).withColumns({"summary": F.lit("renewed"), "status": F.lit("raw"), "pos": F.lit(1)})
    return G.article_upsert(a.where(n % 5 != 0), new.unionByName(new.withColumns({"summary": F.lit("late"), "pos": F.lit(2)}))).select("url", "summary", "status")


@query("SELECT a, b, round(r, 6) AS r, a_name FROM (SELECT o_custkey AS a, o_orderkey AS b, o_totalprice / 1000.0 AS r, c_name AS a_name FROM orders JOIN (SELECT c_custkey, c_mktsegment AS c_name FROM customer) ON o_custkey = c_custkey WHERE o_orderstatus = 'O') ORDER BY abs(r) DESC, a, b LIMIT 200")
def pending_edges(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending_verification").otherwise("active")
    edges = o.select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"), (F.col("o_totalprice") / 1000.0).alias("r"), status.alias("status"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.lit("Indicator").alias("label"))
    goods = o.select(F.col("o_orderkey").alias("id"), F.lit("order").alias("name"), F.lit("Asset").alias("label"))
    first = G.pending(edges.withColumn("b", -1 - F.col("b")), people.unionByName(goods.withColumn("id", -1 - F.col("id"))))
    return first.select("a", (-1 - F.col("b")).alias("b"), F.round("r", 6).alias("r"), "a_name")


@query("SELECT n_name AS name, 'Nation' AS label FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT r_name, 'Region' FROM region")
def entity_list(spark, d):
    n = table(spark, d, "nation").select(F.lit("Nation").alias("label"), F.when(F.col("n_regionkey") != 2, F.col("n_nationkey")).alias("id"), F.col("n_name").alias("name"))
    r = table(spark, d, "region").select(F.lit("Region").alias("label"), F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return G.entity_list(n.unionByName(r).unionByName(n.withColumn("label", F.lit("Other"))), ["Nation", "Region"]).select("name", "label")


#: Four minutes in all, whenever it runs.
def run_times():
    return (F.lit(f"2026-03-23 14:0{m}:00").cast("timestamp") for m in (0, 4))


def verified(spark, d):
    """Orders as the results of a verification run; every second has no method."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("a"), F.when(F.col("o_orderkey") % 2 == 0, "pearson").alias("method"), F.expr(VERDICT).alias("verdict"))


@query(f"SELECT 240 AS duration_seconds, count(*) AS total_pairs, count(*) FILTER (v IN ('confirmed_plausible', 'likely_plausible')) AS promoted, count(*) FILTER (v IN ('confirmed_spurious', 'likely_spurious')) AS rejected, count(*) FILTER (v = 'uncertain') AS uncertain FROM (SELECT {VERDICT} AS v FROM orders)")
def verification_run(spark, d):
    return G.run_record(verified(spark, d), "run", *run_times())[0].select(F.col("duration_seconds").cast("int").alias("duration_seconds"), "total_pairs", "promoted", "rejected", "uncertain")


@query(f"SELECT 'run' AS run_id, o_orderkey AS a, CASE WHEN o_orderkey % 2 = 0 THEN 'pearson' ELSE 'partial' END AS method, {VERDICT} AS verdict FROM orders")
def verification_results(spark, d):
    return G.run_record(verified(spark, d), "run", *run_times())[1].select("run_id", "a", "method", "verdict")


@query("WITH e AS (SELECT user_id, bool_or(event_type = 'view') AS ok, count(*) AS k FROM events GROUP BY user_id) SELECT count(*) AS articles, count(*) FILTER (NOT ok) AS failed, CAST(sum(k) FILTER (ok) AS BIGINT) AS mentions, round(avg(k) FILTER (ok), 6) AS average FROM e")
def mention_totals(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "view").alias("ok"), F.collect_list(F.col("event_id").cast("string")).alias("ids"))
    return rounded(G.mention_totals(e))


@query("SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN value * 2 ELSE value END AS value FROM events")
def stream_late_revision(spark, d):
    """Events through a stream, those of even ids again with revised values in a later micro-batch; the merged table."""
    source, out = table(spark, d, "events").select("event_id", "user_id", "value"), shared_dir(spark)
    first = source.withColumn("revision", F.lit(0))
    second = source.where("event_id % 2 = 0").withColumns({"value": F.col("value") * 2, "revision": F.lit(1)})
    for rows in (first, second):
        rows.write.mode("append").parquet(f"{out}/arrived")
        done = N.upsert_available(N.read_stream(spark, f"{out}/arrived", first), f"{out}/table", f"{out}/state", layout.by_hash("event_id", parts=16), ["event_id"], ["value", "revision"], ["revision"])
    return done.select("event_id", "user_id", "value")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 0 ELSE CAST(epoch(o_orderdate) AS BIGINT) END AS second FROM orders")
def published_dates(spark, d):
    """Dates of orders written in four forms that feeds use, and one that nobody can read, read back."""
    at = F.col("o_orderdate")
    ahead = F.concat(F.date_format(at + F.expr("interval 2 hours"), "d MMM yyyy HH:mm:ss"), F.lit(" +0200"))
    forms = [F.concat(F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT")), F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), ahead, F.concat(F.date_format(at, "EEE, d MMM yyyy HH:mm"), F.lit(" GMT")), F.concat(F.lit("some day in "), F.date_format(at, "yyyy"))]
    text = F.element_at(F.array(*forms), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", F.unix_seconds(X.published(text, F.timestamp_seconds(F.lit(0)))).alias("second"))


@query("SELECT doc_id, CASE WHEN trim(coalesce(d.text, '')) = '' THEN 'skipped_no_summary' WHEN l.quality = 1 THEN 'mentions_done' WHEN l.quality = 0 THEN 'mentions_failed' ELSE 'raw' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def stream_status(spark, d):
    """Outcomes of the labelled documents arrive first, the documents later, and then all outcomes turned round, which changes nothing."""
    out, day = shared_dir(spark), lambda n: F.timestamp_seconds(F.lit(1772323200 + n * 86400)).alias("at")
    articles = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("url"), F.col("text").alias("summary"), day(1))
    outcomes = lambda ok, n: N.outcome_events(table(spark, d, "labels").where("quality is not null").select(F.col("doc_id").cast("string").alias("url"), ok.alias("ok"), day(n)))
    good = F.col("quality") == 1
    for events in (outcomes(good, 0), N.article_events(articles), outcomes(~good, 2)):
        events.write.mode("append").parquet(f"{out}/arrived")
        N.run_available(N.article_states(N.read_stream(spark, f"{out}/arrived", events)), f"{out}/steps", f"{out}/state")
    return N.latest_states(spark.read.parquet(f"{out}/steps")).select(F.col("url").cast("long").alias("doc_id"), "status")


# --- tables in partitions --------------------------------------------------------------------------------------------------

FACTS = ["entity_type", "entity_id", "metric", "at"]


def facts(spark, d, unit, value):
    """Lines of orders as facts of their suppliers, the last of each day."""
    rows = table(spark, d, "lineitem").select(F.lit("asset").alias("entity_type"), F.concat(F.lit("S"), "l_suppkey").alias("entity_id"), F.lit("close").alias("metric"), F.col("l_shipdate").alias("at"), value.alias("value"), F.lit(unit).alias("unit"), "l_orderkey", "l_linenumber")
    return rows.groupBy(*FACTS).agg(F.max_by(F.struct("value", "unit"), F.struct("l_orderkey", "l_linenumber")).alias("f")).select(*FACTS, "f.*")


@query("""WITH f AS (SELECT 'S' || l_suppkey AS entity_id, l_shipdate AS t, arg_max(l_extendedprice, (l_orderkey, l_linenumber)) AS v FROM lineitem GROUP BY ALL),
  u AS (SELECT entity_id, t, CASE WHEN t >= TIMESTAMP '1998-06-01' THEN v * 2 ELSE v END AS value, CASE WHEN t < TIMESTAMP '1998-09-01' THEN 'old' ELSE 'new' END AS unit FROM f)
  SELECT strftime(t, '%Y-%m') AS month, unit, count(*) AS n, round(sum(value), 2) AS total FROM u GROUP BY ALL""")  # fmt: skip
def partition_upsert(spark, d):
    """Facts laid out by month; a late batch of revised and of new ones rewrites its own months. Units of those that are there stay."""
    path, month = shared_dir(spark), layout.by_month("at")
    layout.create(facts(spark, d, "old", F.col("l_extendedprice")).where("at < '1998-09-01'"), path, month)
    new = facts(spark, d, "new", F.col("l_extendedprice") * 2).where("at >= '1998-06-01'")
    layout.upsert_rows(path, new, new.schema, month, FACTS, ["value"])
    return rounded(layout.read(spark, path, new.schema).groupBy(F.col("part").alias("month"), "unit").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 2)


@query("SELECT DISTINCT o_custkey AS from_id, l_suppkey AS to_id, CASE WHEN max(o_orderkey) FILTER (o_orderkey % 97 = 5) OVER w IS NULL THEN 'seen' ELSE 'renewed' END AS state FROM orders JOIN lineitem ON o_orderkey = l_orderkey WINDOW w AS (PARTITION BY o_custkey, l_suppkey)")
def partition_edges(spark, d):
    """Edges laid out by the hash of both ends; every ninety-seventh order comes again, and its edges' properties are overlaid in their partitions."""
    path, rule = shared_dir(spark), layout.by_hash("from_id", "rel_type", "to_id", parts=32)
    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    edge = lambda state, some: rows.where(some).select(F.col("o_custkey").alias("from_id"), F.lit("BUYS").alias("rel_type"), F.col("l_suppkey").alias("to_id")).distinct().withColumn("props", F.create_map(F.lit("state"), F.lit(state)))
    old, new = edge("seen", "true"), edge("renewed", "o_orderkey % 97 = 5")
    layout.create(old, path, rule)
    layout.rewrite(path, new, old.schema, rule, lambda there, came: G.overlay(there, came, ["from_id", "rel_type", "to_id"]))
    return layout.read(spark, path, old.schema).select("from_id", "to_id", F.col("props")["state"].alias("state"))
