"""Operators on pairs of series: correlation with lags, ranks, significance, stability, partial correlation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidesmith.operators.series import by_key
from tidesmith.sources.kept import keep


#: Lags of pairs of assets, and of pairs with an indicator.
LAGS, MACRO_LAGS = [0, 1, 2, 3, 5, 10], [0, 1, 2, 3, 5, 10, 21, 63]


#: Series of a block: a cell of two blocks takes some 50 MB of matrices at a few thousand dates.
BLOCK_SERIES = 256


def pearson(x: str, y: str) -> Column:
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def indexed(df: DataFrame) -> DataFrame:
    """df with idx, the place of its date among all dates, from 0; the window runs over the few distinct dates alone."""
    dates = df.select("date").distinct().withColumn("idx", F.row_number().over(Window.orderBy("date")) - 1)
    return df.join(F.broadcast(dates), "date")


def lagged(df: DataFrame, lags: list[int]) -> DataFrame:
    """(a, b, lag, idx, x, y): a at a date with b `lag` rows of the spine earlier; b leads. Lag 0 once for a < b.

    The join key is made on one side, so Spark joins by hash; each pair and lag costs one row a date.
    """
    on = indexed(df).where("value is not null")
    left = on.select(F.col("key").alias("a"), F.col("idx"), F.col("value").alias("x")).withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("at", F.col("idx") - F.col("lag"))
    right = on.select(F.col("key").alias("b"), F.col("idx").alias("at"), F.col("value").alias("y"))
    return left.join(right, "at").where("(lag = 0 and a < b) or (lag > 0 and a <> b)").select("a", "b", "lag", "idx", "x", "y")


def correlations(rows: DataFrame, least: int = 30) -> DataFrame:
    """(a, b, lag, r, n) of pairs with at least so many common rows and some variance."""
    return rows.groupBy("a", "b", "lag").agg(pearson("x", "y").alias("r"), F.count("*").alias("n")).where((F.col("n") >= least) & F.col("r").isNotNull())


def _ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties at their mean."""
    _, at, times = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(times) - (times - 1) / 2)[at]


def _r(x: np.ndarray, y: np.ndarray, least: int = 2) -> float:
    if len(x) < least:
        return np.nan
    x, y = x - x.mean(), y - y.mean()
    scale = np.sqrt((x @ x) * (y @ y))
    return float(x @ y / scale) if scale > 1e-12 else np.nan


def _products(x: np.ndarray, on_x: np.ndarray, y: np.ndarray, on_y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(r, n, least variance) of all pairs of rows of x and rows of y over the columns that both have, by products of matrices."""
    m, w = on_x.astype(float), on_y.astype(float)
    u, v = np.where(on_x, x, 0.0), np.where(on_y, y, 0.0)
    n, sx, sy = m @ w.T, u @ w.T, m @ v.T
    with np.errstate(divide="ignore", invalid="ignore"):
        vx, vy = (u * u) @ w.T - sx * sx / n, m @ (v * v).T - sy * sy / n
        return (u @ v.T - sx * sy / n) / np.sqrt(vx * vy), n, np.minimum(vx, vy)


def _halves(x: np.ndarray, lag: int, least: int) -> list[np.ndarray]:
    """r of all pairs of series in either half of the spine, the right one leading by lag inside the half; NaN under `least` rows."""
    out, middle = [], x.shape[1] // 2
    for part in (x[:, :middle], x[:, middle:]):
        left, right = part[:, lag:], part[:, : max(part.shape[1] - lag, 0)]
        r, n, low = _products(left, ~np.isnan(left), right, ~np.isnan(right))
        out.append(np.where((n >= max(least, 2)) & (low > 1e-12), r, np.nan))
    return out


def _rank_correlations(x: np.ndarray, lag: int, pairs: list[tuple[int, int]]) -> tuple[list[float], list[int]]:
    """Rank correlation and rows of each pair of series, the second leading by lag.

    A series without a gap is ranked once for all its pairs, whose correlations are then one product; a pair with a gap is ranked on its own rows.
    """
    left, right = x[:, lag:], x[:, : x.shape[1] - lag]
    whole = [~np.isnan(side).any(1) for side in (left, right)]
    ranks = [np.array([_ranks(v) if on else np.zeros(side.shape[1]) for v, on in zip(side, full)]) for side, full in zip((left, right), whole)]
    ones = np.ones(left.shape, bool)
    r, _, low = _products(*(z for side in ranks for z in (side - (left.shape[1] + 1) / 2, ones)))
    rho, rows = [], []
    for i, j in pairs:
        if whole[0][i] and whole[1][j]:
            rho.append(float(r[i, j]) if low[i, j] > 1e-12 else np.nan)
            rows.append(left.shape[1])
        else:
            on = ~np.isnan(left[i] + right[j])
            rho.append(_r(_ranks(left[i][on]), _ranks(right[j][on])))
            rows.append(int(on.sum()))
    return rho, rows


def _cell(lags: list[int], macro_lags: list[int], least_n: int, least_r: float, tests: bool, half_n: int):
    """Task over the series of one or two blocks: all pairs between them (of one block: within it) at all lags, by products of matrices."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        size, names, block = int(pdf["size"].iloc[0]), pdf["key"].to_numpy(str), pdf["block"].to_numpy()
        x = np.full((len(pdf), size), np.nan)
        for row, (idx, value) in enumerate(zip(pdf["idx"], pdf["value"])):
            x[row, np.asarray(idx, np.int64)] = value
        has = ~np.isnan(x)
        centred = np.where(has, x - np.where(has, x, 0).sum(1, keepdims=True) / np.maximum(has.sum(1, keepdims=True), 1), 0.0)
        left = has
        if pdf["complete"].iloc[0] is not None:
            left = has & np.isin(np.arange(size), np.asarray(pdf["complete"].iloc[0], np.int64))
        same = pdf["i"].iloc[0] == pdf["j"].iloc[0]  # the other block of a cell may have no series
        meet = np.ones((len(pdf),) * 2, bool) if same else block[:, None] != block[None, :]
        macro = np.char.startswith(names, "indicator:")
        out: list[tuple] = []
        for lag in sorted({*lags, *macro_lags}):
            if lag >= size:
                continue
            r, n, low = _products(centred[:, lag:], left[:, lag:], centred[:, : size - lag], has[:, : size - lag])
            r = np.where(low > 1e-12, r, np.nan)
            on = meet & (n >= least_n) & (np.abs(r) >= least_r)
            on &= np.triu(np.ones_like(on), 1) if lag == 0 else ~np.eye(len(pdf), dtype=bool)
            on &= (macro[:, None] | macro[None, :] | (lag in lags)) & ((lag in macro_lags) | ~(macro[:, None] | macro[None, :]))
            on &= np.array([lag in k and 0 in k for k in pdf["kept"]])[None, :] & np.array([0 in k for k in pdf["kept"]])[:, None]
            found = [*zip(*(z.tolist() for z in np.nonzero(on)))]
            rows = [(names[i], names[j], lag, float(r[i, j]), int(n[i, j])) for i, j in found]
            if tests and found:
                r1, r2 = _halves(x, lag, half_n)
                rows = [(*row, rho, k, float(r1[at]), float(r2[at])) for row, rho, k, at in zip(rows, *_rank_correlations(x, lag, found), found)]
            out.extend(rows)
        return pd.DataFrame(out, columns=_PAIRS[: 9 if tests else 5])

    return run


_PAIRS = ["a", "b", "lag", "r", "n", "rho", "rho_n", "r1", "r2"]


def pair_statistics(
    df: DataFrame, lags: list[int] = LAGS, macro_lags: list[int] = MACRO_LAGS, least_n: int = 30, least_r: float = 0.0,
    complete: bool = False, min_obs: int = 0, tests: bool = False, half_n: int = 20, blocks: int | None = None,
) -> DataFrame:
    """(a, b, lag, r, n) of all pairs of series of a spine (key, date, value); b leads by lag rows; lag 0 once for a < b.

    Pairs with an indicator take macro_lags, others lags. Rows with a null in either series are left out pair by pair; with `complete`,
    n is the number of dates on which no series misses a value at any lag (a series at a lag that leaves it fewer than
    min_obs values, or no variance, takes no part). Pairs with fewer than least_n rows, weaker than least_r, or without variance go.
    tests adds rho and rho_n (rank correlation on the pair's own rows), r1 and r2 (r in either half of the spine, null
    under half_n rows).

    A series is packed into one row, its dates being a few thousand. Series are dealt to `blocks` by a hash (of about BLOCK_SERIES series, four at
    least), and each pair of blocks is one task's matrix product, so a series moves `blocks` times and no row is made for a pair's dates; a task holds
    matrices of twice that many series, however many there are. Empty input: empty result.
    """
    blocks = blocks or max(4, -(-df.agg(F.approx_count_distinct("key")).head()[0] // BLOCK_SERIES))
    every = sorted({*lags, *macro_lags})
    on = indexed(df.select("key", "date", "value"))
    size = on.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("size")).scalar()
    packed = on.where("value is not null").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("v")).select("key", F.col("v.idx").alias("idx"), F.col("v.value").alias("value"), size.alias("size"))

    @F.pandas_udf("array<int>")
    def usable(idx: pd.Series, value: pd.Series, size: pd.Series) -> pd.Series:
        def of(i, v, t):
            left = [(k, np.asarray(v)[np.asarray(i) + k < t]) for k in every]
            return [k for k, x in left if len(x) >= max(1, min_obs) and x.std() >= 1e-10]

        return pd.Series([of(*x) for x in zip(idx, value, size)])

    packed = packed.withColumn("kept", usable("idx", "value", "size") if complete else F.array(*map(F.lit, every)))
    if complete:
        rows = packed.select("size", "kept", F.explode("idx").alias("idx")).select("size", "idx", F.explode("kept").alias("lag")).select((F.col("idx") + F.col("lag")).alias("idx"), "size").where("idx < size")
        full = packed.agg(F.sum(F.size("kept")).alias("k")).scalar()
        dates = rows.groupBy("idx").agg(F.count("*").alias("k")).where(F.col("k") == full).agg(F.collect_list("idx").alias("dates"))
        packed = packed.withColumn("complete", dates.scalar())
    else:
        packed = packed.withColumn("complete", F.lit(None).cast("array<int>"))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    dealt = packed.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other")
    kinds = "a string, b string, lag int, r double, n long" + ", rho double, rho_n long, r1 double, r2 double" * tests
    found = dealt.groupBy("i", "j").applyInPandas(_cell(lags, macro_lags, least_n, least_r, tests, half_n), kinds)
    null = lambda c: F.nanvl(c, F.lit(None).cast("double")).alias(c)
    return found.select(*(null(c) if t == "double" else F.col(c) for c, t in found.dtypes))


# --- windows that move ---------------------------------------------------------------------------------------------------

_SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _moments(on: DataFrame, lags: list[int], x: tuple[int, int], y: tuple[int, int]) -> DataFrame:
    """(a, b, lag, _SUMS) of pairs whose later value stands at a row of x and whose earlier one at a row of y, ends included."""
    some = on.where("value is not null")
    left = some.where(F.col("idx").between(*x)).select(F.col("key").alias("a"), "idx", F.col("value").alias("x")).withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("at", F.col("idx") - F.col("lag"))
    right = some.where(F.col("idx").between(*y)).select(F.col("key").alias("b"), F.col("idx").alias("at"), F.col("value").alias("y"))
    rows = left.join(right, "at").where("(lag = 0 and a < b) or (lag > 0 and a <> b)")
    u, v = F.col("x"), F.col("y")
    return rows.groupBy("a", "b", "lag").agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in zip(_SUMS[1:], (u, v, u * u, v * v, u * v))))


def window_moments(on: DataFrame, lags: list[int], window: tuple[int, int]) -> DataFrame:
    """The state of a window of rows (first, last) of a spine: what correlations need, as sums. on: (key, idx, value) as indexed() gives it."""
    return _moments(on, lags, window, window)


def move_window(state: DataFrame, on: DataFrame, lags: list[int], old: tuple[int, int], new: tuple[int, int]) -> DataFrame:
    """The state of a window that has moved forward: sums of pairs that come in at its end are added, of those whose earlier row has gone taken away.

    Only rows at both ends are read. The values must not depend on the window (changes do not, scaled ones would). Rounding errors of sums that are
    added and taken away are of the order of 1e-16 of the largest sum; to be rid of them, begin a new state now and then.
    """
    if not (old[0] <= new[0] <= old[1] <= new[1]):
        raise ValueError(f"a window moves forward by less than its own length: {old} to {new}")
    gone = _moments(on, lags, old, (old[0], new[0] - 1)).select("a", "b", "lag", *((-F.col(c)).alias(c) for c in _SUMS))
    every = state.unionByName(_moments(on, lags, (old[1] + 1, new[1]), new)).unionByName(gone)
    return every.groupBy("a", "b", "lag").agg(*(F.sum(c).alias(c) for c in _SUMS)).where("n > 0")


def moment_correlations(state: DataFrame, least: int = 30) -> DataFrame:
    """(a, b, lag, r, n) of the pairs of a state with at least so many rows; pairs without variance go."""
    n = F.col("n")
    var = lambda s, ss: F.col(ss) - F.col(s) * F.col(s) / n
    some = lambda s, ss: var(s, ss) > 1e-12 * F.greatest(F.lit(1.0), F.col(ss))
    r = F.when(some("sx", "sxx") & some("sy", "syy"), (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(var("sx", "sxx") * var("sy", "syy")))
    return state.select("a", "b", "lag", r.alias("r"), "n").where((n >= least) & F.col("r").isNotNull())


def listwise(df: DataFrame) -> DataFrame:
    """Dates on which every series has a value."""
    keys = df.select("key").distinct().agg(F.count("*").alias("k"))
    full = df.groupBy("date").agg(F.count("value").alias("n")).join(F.broadcast(keys), F.col("n") == F.col("k")).select("date")
    return df.join(full, "date", "left_semi")


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1, ties at their mean."""
    same = Window.partitionBy(*by, value)
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(same) - 1) / 2


def spearman(rows: DataFrame, by: list[str]) -> DataFrame:
    ranked = rows.select(*by, average_rank("x", by).alias("rx"), average_rank("y", by).alias("ry"))
    return ranked.groupBy(*by).agg(pearson("rx", "ry").alias("rho"), F.count("*").alias("n"))


def t_statistic(r: Column, n: Column) -> Column:
    clipped = F.greatest(F.lit(-0.99999), F.least(F.lit(0.99999), r))
    return clipped * F.sqrt((n - 2) / (1 - clipped * clipped))


def two_sided_p(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) of Student's distribution, of arrays; NaN where df is not positive.

    The incomplete beta function by its continued fraction (modified Lentz), on the side where that converges fast.
    """
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    on = (df > 0) & np.isfinite(t)
    df, t = np.where(on, df, 1.0), np.where(on, t, 0.0)
    x, a, b = df / (df + t * t), df / 2, np.full(df.shape, 0.5)
    front = np.array([math.lgamma(p + 0.5) - math.lgamma(p) - math.lgamma(0.5) for p in a.ravel()]).reshape(a.shape)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.where((x > 0) & (x < 1), np.exp(front + a * np.log(x) + b * np.log1p(-x)), 0.0)
    swap = x >= (a + 1) / (a + b + 2)
    a, b, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    safe = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    c, d = np.ones_like(z), 1 / safe(1 - (a + b) * z / (a + 1))
    h, live = d.copy(), np.ones_like(z, bool)
    for m in range(1, 300):
        for num in (m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / safe(1 + num * d), safe(1 + num / c)
            h = np.where(live, h * d * c, h)  # what has converged stays, so a value does not depend on its neighbours
        live &= np.abs(d * c - 1) >= 1e-14
        if not live.any():
            break
    part = front * h / a
    return np.where(on, np.clip(np.where(swap, 1 - part, part), 0.0, 1.0), np.nan)


def p_values(df: DataFrame) -> DataFrame:
    """df (with t and n) and p; null where n is under 3 or t is null."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series(two_sided_p(t.to_numpy(float), n.to_numpy(float) - 2))

    return df.withColumn("p", F.when(F.col("t").isNotNull() & (F.col("n") >= 3), F.nanvl(tail("t", "n"), F.lit(None).cast("double"))))


def _place_of(p: Column) -> Column:
    """A whole number that never falls as p rises, of few values: even steps above 1/1024, steps of a 16th of a power of two below."""
    return F.when(p >= 1 / 1024, F.floor(p * 1024)).otherwise(F.coalesce(F.floor(F.log2(F.when(p > 0, p)) * 16), F.lit(-100_000)))


def false_discovery(df: DataFrame, alpha: float = 0.10) -> DataFrame:
    """Benjamini-Hochberg: rows whose adjusted p is at most alpha. The family is what has passed the strength filter; rows of null p are no part of it.

    Ties share the rank of their last, so only distinct p and their counts matter: those are summed up before anything moves. Running
    sums and minima are taken within places of p (see _place_of), each a key of its own, and carried over by the totals of the places, of
    which there are at most some 18,000. df is written once: rows meet their adjusted p by p itself, which must not be computed twice.
    """
    df = keep(df)
    counts = df.where("p is not null").groupBy("p").agg(F.count("*").alias("k")).withColumn("place", _place_of(F.col("p")))
    up, down = Window.partitionBy("place").orderBy("p"), Window.partitionBy("place").orderBy(F.desc("p"))
    totals = counts.groupBy("place").agg(F.sum("k").alias("total"))
    before = totals.select("place", (F.sum("total").over(Window.orderBy("place")) - F.col("total")).alias("before"), F.sum("total").over(Window.partitionBy()).alias("m"))
    raw = counts.join(F.broadcast(before), "place").withColumn("raw", F.col("p") * F.col("m") / (F.col("before") + F.sum("k").over(up)))
    lows = raw.groupBy("place").agg(F.min("raw").alias("low"))
    above = lows.select("place", F.min("low").over(Window.orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)).alias("above"))
    adjusted = raw.join(F.broadcast(above), "place").select("p", F.least(F.lit(1.0), F.coalesce("above", F.lit(1.0)), F.min("raw").over(down)).alias("adjusted_p"))
    return df.join(adjusted.where(F.col("adjusted_p") <= alpha), "p")


def split_half(rows: DataFrame, dates: DataFrame, least_r: float = 0.4, least_n: int = 20) -> DataFrame:
    """(a, b, lag, r1, r2, stability) of pairs strong in either half of the spine, each with enough rows.

    rows: (a, b, lag, idx, x, y); dates: the spine's (date). A lag is taken inside a half, so rows that reach over the middle count in neither.
    """
    middle = F.floor(dates.select("date").distinct().agg(F.count("*")).scalar() / 2)
    half = F.when(F.col("idx") < middle, 1).when(F.col("idx") - F.col("lag") >= middle, 2)
    parts = rows.groupBy("a", "b", "lag", half.alias("part")).agg(pearson("x", "y").alias("r"), F.count("*").alias("n")).where(F.col("n") >= least_n)
    both = parts.groupBy("a", "b", "lag").agg(*(F.max(F.when(F.col("part") == i, F.col("r"))).alias(f"r{i}") for i in (1, 2)))
    return both.where((F.abs("r1") >= least_r) & (F.abs("r2") >= least_r)).withColumn("stability", F.least(F.abs("r1"), F.abs("r2")))


def monthly_stability(rows: DataFrame, least_part: int = 6, share: float = 0.4) -> DataFrame:
    """(a, b, n, rho, sign_ok, tercile_ok, magnitude_ok) of pairs of short series (a, b, idx, x, y), by rank correlations of parts.

    Halves and thirds are cut by place; the last takes the rest. Parts of under least_part rows are not judged and pass. sign: both halves
    have one sign; tercile: all thirds do; magnitude: the weaker half has at least `share` of the whole's strength, which is at least 0.01. A
    part without variance fails.
    """
    pair = Window.partitionBy("a", "b")
    placed = rows.withColumn("place", F.row_number().over(pair.orderBy("idx")) - 1).withColumn("n", F.count("*").over(pair))
    half, third = F.floor(F.col("n") / 2), F.floor(F.col("n") / 3)
    parts = F.array(F.lit("all"), F.when(F.col("place") < half, "h1").otherwise("h2"), F.concat(F.lit("t"), F.least(F.floor(F.col("place") / F.greatest(third, F.lit(1))), F.lit(2)).cast("string")))
    rho = spearman(placed.select("a", "b", "x", "y", F.explode(parts).alias("part")), ["a", "b", "part"])
    at = lambda k: F.max(F.when(F.col("part") == k, F.col("rho")))
    wide = rho.groupBy("a", "b").agg(F.max(F.when(F.col("part") == "all", F.col("n"))).alias("n"), *(at(k).alias(k) for k in ("all", "h1", "h2", "t0", "t1", "t2")))
    few = lambda k: F.floor(F.col("n") / k) < least_part
    same = lambda *c: F.coalesce(F.greatest(*(F.col(x) > 0 for x in c)) == F.least(*(F.col(x) > 0 for x in c)), F.lit(False))
    whole = lambda *c: F.lit(True) if not c else F.col(c[0]).isNotNull() & whole(*c[1:])
    weak = F.coalesce(F.abs("all") < 0.01, F.lit(True))
    strong = F.least(F.abs("h1"), F.abs("h2")) >= share * F.abs("all")
    return wide.select(
        "a", "b", "n", F.col("all").alias("rho"), (few(2) | whole("h1", "h2") & same("h1", "h2")).alias("sign_ok"),
        (few(3) | whole("t0", "t1", "t2") & same("t0", "t1", "t2")).alias("tercile_ok"),
        F.when(weak, False).when(few(2), True).otherwise(whole("h1", "h2") & F.coalesce(strong, F.lit(False))).alias("magnitude_ok"),
    )


def low_variance(df: DataFrame, least: float = 1e-10) -> DataFrame:
    return df.withColumn("sd", F.stddev_pop("value").over(by_key())).where(F.col("sd") >= least).drop("sd")


def bootstrap(rows: DataFrame, by: list[str], resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(by, n, low, high, excludes_zero): percentile interval (2.5, 97.5) of the rank correlation over resamples of each pair's rows.

    rows: by, idx, x, y. Ranks in a resample are ordinal, so they are permutations and the correlation is 1 - 6 sum(d^2) / (n (n^2 - 1)). Under 6
    rows there is no interval. One pair is one group: its rows are the months of a series.
    """

    def interval(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        n, low, high, clear = len(pdf), None, None, False
        if n >= 6:
            drawn = np.random.default_rng(seed).integers(0, n, (resamples, n))
            x, y = (pdf[c].to_numpy()[drawn].argsort(axis=1).argsort(axis=1) for c in ("x", "y"))
            low, high = np.percentile(1 - 6 * ((x - y) ** 2).sum(1) / (n * (n * n - 1)), [2.5, 97.5]).tolist()
            clear = low > 0 or high < 0
        return pd.DataFrame([[*pdf[by].iloc[0], n, low, high, clear]], columns=[*by, "n", "low", "high", "excludes_zero"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in by)
    return rows.groupBy(*by).applyInPandas(interval, f"{kinds}, n long, low double, high double, excludes_zero boolean")


def _lasso(v: np.ndarray, s: np.ndarray, b: np.ndarray, alpha: float, tol: float) -> np.ndarray:
    """b of least b'vb / 2 - s'b + alpha |b|, by coordinate descent from b; places at rest are passed over."""
    d, left = np.diag(v), s - v @ b
    for _ in range(1000):
        moved = 0.0
        for k in np.flatnonzero((b != 0) | (np.abs(left) > alpha)):
            g = left[k] + d[k] * b[k]
            new = math.copysign(max(abs(g) - alpha, 0.0), g) / d[k]
            if new != b[k]:
                left -= v[:, k] * (new - b[k])
                moved, b[k] = max(moved, abs(new - b[k])), new
        if moved < tol:
            break
    return b


def graphical_lasso(cov: np.ndarray, alpha: float, rounds: int = 200, tol: float = 1e-4) -> np.ndarray:
    """Precision matrix of least trace(cov T) - logdet(T) + alpha * sum of |off-diagonal T|; the diagonal is not penalised.

    Block coordinate descent (Friedman, Hastie and Tibshirani); soft thresholds give exact zeros.
    """
    p = len(cov)
    w, beta, theta = cov.copy(), np.zeros((p, p)), np.zeros((p, p))
    w[~np.eye(p, dtype=bool)] *= 0.95
    for _ in range(rounds):
        before = w.copy()
        for j in range(p):
            rest = np.arange(p) != j
            v = w[np.ix_(rest, rest)]
            beta[rest, j] = _lasso(v, cov[rest, j], beta[rest, j], alpha, tol * 1e-2)
            w[rest, j] = w[j, rest] = v @ beta[rest, j]
        if np.abs(w - before).mean() < tol * 1e-2:
            break
    for j in range(p):
        rest = np.arange(p) != j
        theta[j, j] = 1 / (w[j, j] - w[rest, j] @ beta[rest, j])
        theta[rest, j] = -beta[rest, j] * theta[j, j]
    return (theta + theta.T) / 2


def covariances(df: DataFrame) -> DataFrame:
    """(a, b, c, n) for a <= b of complete rows (key, date, value): each date's values meet as one array, sums are made before they move."""
    day = df.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("v"))
    one = day.select("v", F.posexplode("v").alias("i", "x")).select("x", F.explode(F.expr("slice(v, i + 1, size(v))")).alias("y"))
    return one.groupBy(F.col("x.key").alias("a"), F.col("y.key").alias("b")).agg(F.covar_pop("x.value", "y.value").alias("c"), F.count("*").alias("n"))


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of weighted edges (a, b, w) those of a spanning forest of the largest weights: what is left of a task's edges, and of the edges so far."""
    left = None
    for pdf in batches:
        left = pdf if left is None else pd.concat([left, pdf])
        left = left.sort_values(["w", "a", "b"], ascending=[False, True, True], ignore_index=True)
        root: dict = {}

        def find(k):
            while root.setdefault(k, k) != k:
                root[k] = k = root[root[k]]
            return k

        keep_ = []
        for a, b in zip(left["a"], left["b"]):
            p, q = find(a), find(b)
            keep_.append(p != q)
            root[p] = q
        left = left[keep_]
    if left is not None:
        yield left


def covariance_blocks(cov: DataFrame, alphas: list[float]) -> DataFrame:
    """(step, key, block): for each penalty the components of series that covariances over it in size join; block is the least key of one.

    The components of every threshold come from one spanning forest of the largest covariances, which has fewer edges than there are series: each
    task leaves a forest of its own edges, and a last one, of at most that many edges a task, joins them.
    """
    edges = cov.where("a <> b").select("a", "b", F.abs("c").alias("w")).where(F.col("w") > min(alphas))
    tree = edges.mapInPandas(_forest, "a string, b string, w double")
    tree = tree.repartition(1).mapInPandas(_forest, "a string, b string, w double")
    names = cov.where("a = b").select("a", F.col("a").alias("b"), F.lit(float("inf")).alias("w"))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("w", ascending=False)
        for step, alpha in enumerate(alphas):
            root = {k: k for k in sorted(rows["a"][np.isinf(rows["w"])])}

            def find(k):
                while root[k] != k:
                    root[k] = k = root[root[k]]
                return k

            for a, b, w in zip(rows["a"], rows["b"], rows["w"]):
                if alpha < w < np.inf:
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
            yield pd.DataFrame({"step": step, "key": list(root), "block": [find(k) for k in root]})

    return tree.unionByName(names).repartition(1).mapInPandas(label, "step int, key string, block string")


def partial_correlations(df: DataFrame, alphas: int = 25, gamma: float = 0.1) -> DataFrame:
    """(a, b, partial_r, n) of the sparse precision matrix with the least extended BIC over a grid of penalties.

    df: (key, date, value); series without any value go, then dates on which one of the rest has none. For each penalty the optimum falls apart, exactly,
    into the components of series that covariances larger than it join (see covariance_blocks), so a task fits one component at one penalty and
    holds its covariances alone; a component of a few hundred series is the bound of the method. A fit sends one row; likelihoods, traces and edges of
    the components of a penalty add up.
    """
    named = df.groupBy("key").agg(F.count("value").alias("n")).where("n > 0").select("key")
    cov = keep(covariances(listwise(df.join(named, "key", "left_semi"))))
    top, least, n = cov.agg(F.max(F.when(F.col("a") != F.col("b"), F.abs("c"))), F.min(F.when(F.col("a") == F.col("b"), F.col("c"))), F.max("n")).head()
    schema = "a string, b string, partial_r double, n long"
    if top is None or not n or least <= 0:
        return df.sparkSession.createDataFrame([], schema)
    grid = [float(x) for x in np.logspace(np.log10(max(1e-12, 0.01 * top)), np.log10(max(1e-12, top)), alphas)]
    blocks = keep(covariance_blocks(cov, grid))
    at = lambda c: blocks.select("step", F.col("key").alias(c), "block")
    parts = cov.join(at("a"), "a").join(at("b"), ["b", "step", "block"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        step, block = int(pdf["step"].iloc[0]), pdf["block"].iloc[0]
        names = sorted({*pdf["a"], *pdf["b"]})
        where, p = {k: i for i, k in enumerate(names)}, len(names)
        s = np.zeros((p, p))
        i, j = pdf["a"].map(where), pdf["b"].map(where)
        s[i, j] = s[j, i] = pdf["c"]
        theta = graphical_lasso(s, grid[step]) if p > 1 else 1 / s
        sign, logdet = np.linalg.slogdet(theta)
        upper = np.triu_indices(p, 1)
        d = np.sqrt(np.abs(np.diag(theta)))
        r = (-theta / np.outer(d, d))[upper]
        on = r != 0
        ok = bool(sign > 0 and np.isfinite(logdet))
        row = (step, block, ok, float(logdet), float(np.trace(s @ theta)), int((np.abs(theta[upper]) > 1e-10).sum()), p, [names[k] for k in upper[0][on]], [names[k] for k in upper[1][on]], r[on].tolist())
        return pd.DataFrame([row], columns=["step", "block", "ok", "logdet", "trace", "edges", "p", "a", "b", "r"])

    fits = keep(parts.groupBy("step", "block").applyInPandas(fit, "step int, block string, ok boolean, logdet double, trace double, edges long, p long, a array<string>, b array<string>, r array<double>"))
    whole = fits.groupBy("step").agg(F.bool_and("ok").alias("ok"), *(F.sum(c).alias(c) for c in ("logdet", "trace", "edges", "p"))).where("ok")
    ebic = -n * (F.col("logdet") - F.col("trace")) + F.col("edges") * math.log(n) + 4 * gamma * F.col("edges") * F.log("p")
    best = whole.agg(F.min_by("step", F.struct(ebic, "step"))).scalar()
    pairs = fits.where(F.col("step") == best).select(F.explode(F.arrays_zip("a", "b", "r")).alias("x"))
    return pairs.select("x.a", "x.b", F.col("x.r").alias("partial_r"), F.lit(n).cast("long").alias("n"))


def partial_given(df: DataFrame, given: str) -> DataFrame:
    """(a, b, r, partial_r): correlations of all pairs but of `given`, and what is left of them once `given` is known. df: complete rows."""
    c = covariances(df)
    sd = c.where("a = b").select(F.col("a").alias("k"), F.sqrt("c").alias("sd"))
    r = c.where("a <> b").join(sd.select(F.col("k").alias("a"), F.col("sd").alias("sa")), "a").join(sd.select(F.col("k").alias("b"), F.col("sd").alias("sb")), "b").select("a", "b", F.try_divide("c", F.col("sa") * F.col("sb")).alias("r"))
    own = r.where((F.col("a") == given) | (F.col("b") == given)).select(F.when(F.col("a") == given, F.col("b")).otherwise(F.col("a")).alias("k"), "r")
    rest = r.where((F.col("a") != given) & (F.col("b") != given))
    both = rest.join(own.select(F.col("k").alias("a"), F.col("r").alias("ra")), "a").join(own.select(F.col("k").alias("b"), F.col("r").alias("rb")), "b")
    left = F.try_divide(F.col("r") - F.col("ra") * F.col("rb"), F.sqrt((1 - F.col("ra") ** 2) * (1 - F.col("rb") ** 2)))
    return both.select("a", "b", "r", left.alias("partial_r"))
